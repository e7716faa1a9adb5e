"""Keyword search over postings: phrases, prefixes, proximity, boolean combinations, and BM25.

An index is an ordinary table with a row for each term and document that holds it: how often, where, and the document's
length. A search is built from the classes below. The postings of all its terms meet once, by document; what matches is
then decided by expressions over the places of one document. Searches of plain terms don't read places at all.

A stored index lies in folders by bucket of the term's first two letters, so that a search for a term, or for a prefix of
two letters or more, reads the buckets it needs alone. In a bucket, files are in order of their terms and, within a term,
of tiers: blocks of postings with like weights, the highest first. A small table counts the documents of each term and
tier, so a search for the best few knows beforehand which tiers can't reach them, and skips those.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from lectern.functions.text import tokens

K1, B = 1.2, 0.75

#: Buckets of a stored index, and letters that a term's bucket depends on.
BUCKETS, LETTERS = 64, 2
#: Tiers: a posting with f instances in a document of dl tokens has f / (f + K1 * (1 - B + B * dl / mean)) of the largest
#: weight, and lies in tier floor(TIERS * that share), by the mean that was assumed when the index was written.
TIERS = 32
#: A place is its column's number times this, plus the position: places of different columns are never near.
COLUMN = 1 << 40
#: What a posting has besides its document.
POSTING = (StructField("dl", LongType()), StructField("term", StringType()), StructField("f", IntegerType()), StructField("places", ArrayType(LongType())))
#: Characters of a token and what follows it, on average; only guesses the mean that tiers are cut by.
TOKEN_CHARS = 6.0


@dataclass(frozen=True)
class Facts:
    """How many documents a whole index has, and tokens in all of them."""

    documents: int
    tokens: int

    @property
    def mean(self) -> float:
        return self.tokens / self.documents if self.documents else 1.0


def _share(f: Column, dl: Column, mean: float) -> Column:
    return f / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(mean)))


def posted(texts: DataFrame, key: str, columns: list[str], tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """``doc, dl, term, f, places`` of all texts: a row for each document and term, and one without a term where a
    document has none. A document's columns are tokenised at once; no shuffle."""
    held = texts.select(F.col(key).alias("doc"), F.array(*[tokenize(F.coalesce(c, F.lit(""))) for c in columns]).alias("terms"))
    schema = StructType([held.schema["doc"], *POSTING])
    kind = to_arrow_type(held.schema["doc"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                doc, dl, terms, f, places = _grouped(part.column(1), len(columns))
                rows = [part.column(0).take(doc).cast(kind), dl, terms, f, places]
                yield pa.RecordBatch.from_arrays(rows, ["doc", "dl", "term", "f", "places"])

    return held.mapInArrow(run, schema)


def _grouped(texts: pa.Array, columns: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]:
    """Of documents as lists (one for each column) of tokens: the document's number, its length, each of its terms, how
    often it has it, and where; a document without tokens has a row without a term."""
    lists = texts.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(starts)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(starts[:-1] - starts[0], sizes) + owner % columns * COLUMN
    doc, many = owner // columns, max(1, len(coded.dictionary))
    key = doc * many + code
    order = np.argsort(key, kind="stable")  # places of a term stay in order
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first, len(key))
    length = sizes.reshape(-1, columns).sum(axis=1)
    empty = np.flatnonzero(length == 0)
    docs = np.concatenate([key[first] // many, empty])
    terms = coded.dictionary.take(pa.array(key[first] % many)).cast(pa.string())
    offsets = np.concatenate([ends, np.full(len(empty), len(key))]).astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order]))
    counts = np.concatenate([np.diff(ends), np.zeros(len(empty), np.int64)]).astype(np.int32)
    return pa.array(docs), pa.array(length[docs]), pa.concat_arrays([terms, pa.nulls(len(empty), pa.string())]), pa.array(counts), found


@dataclass(frozen=True)
class Index:
    """``postings`` (doc, dl, term, f, places) and ``lengths`` (doc, dl): every document, also those without a token.

    Of a stored index, postings have their ``tier`` and ``bucket`` too, ``stats`` (term, tier, n, bucket) counts them,
    ``assumed`` is the mean that tiers were cut by, and ``facts`` are known.
    """

    postings: DataFrame
    lengths: DataFrame
    columns: tuple[str, ...]
    buckets: int | None = None
    stats: DataFrame | None = None
    assumed: float | None = None
    facts: Facts | None = field(default=None, compare=False)

    @classmethod
    def of(cls, texts: DataFrame, key: str, columns: list[str], tokenize: Callable[[Column], Column] = tokens) -> Index:
        """The index of ``texts``, not stored."""
        rows = posted(texts, key, columns, tokenize)
        return cls(rows.filter("term is not null"), rows.groupBy("doc").agg(F.max("dl").alias("dl")), tuple(columns))

    @staticmethod
    def store(path: str, texts: DataFrame, key: str, columns: list[str], tokenize: Callable[[Column], Column] = tokens, buckets: int = BUCKETS) -> None:
        """Writes the index of ``texts``."""
        spark = texts.sparkSession
        stored = write_postings(posted(texts, key, columns, tokenize), path, buckets, assumed := assumed_mean(texts, columns))
        stored.groupBy("doc").agg(F.max("dl").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
        lengths = spark.read.parquet(f"{path}/lengths")
        facts = lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))
        facts.select("*", F.lit(assumed).alias("assumed"), F.lit(buckets).alias("buckets"), F.array(*map(F.lit, columns)).alias("columns")).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        known = spark.read.parquet(f"{path}/facts").first()
        stats = spark.read.schema(STATS).parquet(f"{path}/stats")
        postings = spark.read.parquet(f"{path}/postings").filter("bucket >= 0")
        return cls(postings, spark.read.parquet(f"{path}/lengths"), tuple(known["columns"]), known["buckets"], stats, known["assumed"], Facts(known["documents"], known["tokens"]))

    def corpus(self) -> DataFrame:
        """One row: ``N`` documents, of ``mean`` tokens."""
        return self.lengths.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("mean"))

    def of_terms(self, atoms: Iterable[Atom]) -> DataFrame:
        """The postings of some terms and prefixes."""
        return chosen(self.postings, atoms, self.buckets)

    def tiers(self, terms: list[str], mean: float) -> dict[str, list[tuple[float, float, int, Column]]]:
        """For each term its blocks of postings: the least and the largest share of the largest weight that they can
        have, how many documents there are, and what tells the block's postings."""
        if self.stats is None:
            return {}
        out: dict[str, list] = {t: [] for t in terms}
        for r in chosen(self.stats, [Atom(t) for t in terms], self.buckets).groupBy("term", "tier").agg(F.sum("n").alias("n")).collect():  # at most TIERS for each term
            out[r["term"]].append((*bounds(r["tier"], self.assumed / mean), r["n"], (F.col("term") == r["term"]) & (F.col("tier") == r["tier"])))
        return out

    def without(self, changed: DataFrame) -> Index:
        """The index less the documents in ``changed`` (doc)."""
        return Index(self.postings.join(changed, "doc", "left_anti"), self.lengths.join(changed, "doc", "left_anti"), self.columns, self.buckets)

    def plus(self, other: Index) -> Index:
        names = ["doc", "dl", "term", "f", "places"]
        added = other.postings.select(*names)
        if self.buckets:
            names, added = [*names, "bucket"], added.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        return Index(self.postings.select(*names).unionByName(added), self.lengths.unionByName(other.lengths), self.columns, self.buckets)


def assumed_mean(texts: DataFrame, columns: list[str]) -> float:
    """A guess of the mean length in tokens, from the texts' characters."""
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(reduce(Column.__add__, [F.length(F.coalesce(c, F.lit(""))) for c in columns])).alias("chars")).first()
    return max(1.0, (size["chars"] or 0) / TOKEN_CHARS / max(1, size["n"]))


def write_postings(rows: DataFrame, path: str, buckets: int, assumed: float) -> DataFrame:
    """Writes ``posted`` rows (and what columns they have besides) with their tiers, by bucket, and counts them; returns
    them as stored, those without a term in bucket -1.

    One shuffle; a bucket goes to as many tasks, and files, as its size asks for: some letters begin a fifth of all postings.
    """
    spark = rows.sparkSession
    rows = rows.withColumns({"tier": tier(assumed), "bucket": F.coalesce(bucket_of(F.col("term"), buckets), F.lit(-1))})
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", F.desc("tier"), "doc")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    counted = stored.filter("bucket >= 0").groupBy("bucket", "term", "tier").agg(F.count(F.lit(1)).alias("n"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/stats")
    return stored


STATS = "term string, tier int, n long, bucket int"


def chosen(rows: DataFrame, atoms: Iterable[Atom], buckets: int | None) -> DataFrame:
    """Of rows by ``term``, in ``buckets`` buckets if they are, those of some terms and prefixes."""
    if buckets is not None and not any(a.prefix and len(a.text) < LETTERS for a in atoms):
        rows = rows.filter(F.col("bucket").isin(sorted({zlib.crc32(a.text[:LETTERS].encode()) % buckets for a in atoms})))
    return rows.filter(reduce(Column.__or__, [a.fits(F.col("term")) for a in atoms]))


def bucket_of(term: Column, buckets: int) -> Column:
    return (F.crc32(F.substring(term, 1, LETTERS).cast("binary")) % buckets).cast("int")


def tier(assumed: float) -> Column:
    return F.floor(F.lit(TIERS) * _share(F.col("f"), F.col("dl"), assumed)).cast("int")


def bounds(tier: int, ratio: float) -> tuple[float, float]:
    """Within which a tier's shares lie if the mean isn't the one assumed but that over ``ratio``.

    With share = 1 / (1 + c / f), the part of c that stands for the length grows with the ratio, the rest stays.
    """
    low, high = tier / TIERS, (tier + 1) / TIERS
    least = 1 / (1 + max(1.0, ratio) * (1 / low - 1)) if low > 0 else 0.0
    return least * (1 - 1e-9), min(1.0, 1 / (1 + min(1.0, ratio) * (1 / high - 1)) * (1 + 1e-9))


@dataclass(frozen=True)
class Atom:
    """A term, or all terms that begin so."""

    text: str
    prefix: bool = False

    def fits(self, term: Column) -> Column:
        return term.startswith(self.text) if self.prefix else term == self.text


class Query:
    def __and__(self, other: Query) -> Query:
        return Both(self, other)

    def __or__(self, other: Query) -> Query:
        return Either(self, other)

    def __sub__(self, other: Query) -> Query:
        return Without(self, other)

    def phrases(self) -> list[Phrase]:
        """The phrases that scores are made of."""
        raise NotImplementedError

    def asked(self) -> list[Phrase]:
        """All phrases, also those that mustn't occur."""
        return self.phrases()

    def matches(self, rows: Found) -> Column:
        """Whether a document matches."""
        raise NotImplementedError

    def scored(self) -> list[tuple[Phrase, Callable[[Found], Column]]]:
        """Each phrase of ``phrases`` with how many of its instances count."""
        return [(p, lambda rows, p=p: rows.count(p)) for p in self.phrases()]


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda x: x - back)


def _runs(places: Column, first: int, last: int) -> Column:
    """All places from ``first`` to ``last`` from each."""
    return F.flatten(F.transform(places, lambda x: F.sequence(x + first, x + last)))


class Found:
    """The postings that a query needs, a row for each document, and expressions over it."""

    def __init__(self, postings: DataFrame, query: Query, columns: tuple[str, ...]):
        self.columns = columns
        phrases = query.asked()
        self.atoms = list(dict.fromkeys(a for p in phrases for a in p.atoms()))
        self.placed = isinstance(query, Near) or any(not p.plain() for p in phrases) or _holds_near(query)
        if self.placed:
            which = F.array_compact(F.array(*[F.when(a.fits(F.col("term")), F.lit(k)) for k, a in enumerate(self.atoms)]))
            each = postings.select("doc", "dl", "places", F.explode(which).alias("k"))
            self.rows = each.groupBy("doc").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("k", "places")).alias("held"))
        else:
            sums = [F.sum(F.when(a.fits(F.col("term")), F.col("f")).otherwise(0)).alias(f"f{k}") for k, a in enumerate(self.atoms)]
            self.rows = postings.groupBy("doc").agg(F.max("dl").alias("dl"), *sums)

    def places(self, atom: Atom) -> Column:
        k = self.atoms.index(atom)
        return F.flatten(F.transform(F.filter("held", lambda h: h["k"] == k), lambda h: h["places"]))

    def starts(self, p: Phrase) -> Column:
        """Where the phrase's instances begin."""
        at = [self.places(a) for a in p.atoms()]
        found = reduce(F.array_intersect, [_moved(c, k) if k else c for k, c in enumerate(at)])
        if p.column is not None:
            number = self.columns.index(p.column) if p.column in self.columns else -1
            found = F.filter(found, lambda x: F.floor(x / COLUMN) == number)
        return F.filter(found, lambda x: x % COLUMN == 0) if p.first else found

    def count(self, p: Phrase) -> Column:
        return F.size(self.starts(p)) if self.placed else F.col(f"f{self.atoms.index(p.atoms()[0])}")


@dataclass(frozen=True)
class Phrase(Query):
    """Successive terms of one column; with ``prefix`` the last is only begun, with ``first`` they open the column."""

    terms: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False

    def atoms(self) -> list[Atom]:
        last = len(self.terms) - 1
        return [Atom(t, self.prefix and k == last) for k, t in enumerate(self.terms)]

    def plain(self) -> bool:
        """A term or prefix anywhere."""
        return len(self.terms) == 1 and self.column is None and not self.first

    def phrases(self) -> list[Phrase]:
        return [self]

    def matches(self, rows: Found) -> Column:
        return rows.count(self) > 0


class Near(Query):
    """Phrases in one column, each with at most ``most`` tokens between its end and the start of the last one."""

    def __init__(self, *phrases: Phrase, most: int = 10):
        self.near, self.most = phrases, most

    def phrases(self) -> list[Phrase]:
        return list(self.near)

    def _reach(self, p: Phrase) -> int:
        return len(p.terms) + self.most

    def lasts(self, rows: Found) -> Column:
        """Where the last phrase starts with all others in reach. Work grows with instances times ``most``."""
        starts = [rows.starts(p) for p in self.near]
        reached = [_runs(s, 0, self._reach(p)) for s, p in zip(starts, self.near)]
        return reduce(F.array_intersect, reached, F.array_distinct(F.concat(*starts)))

    def instances(self, rows: Found, p: Phrase) -> Column:
        """The instances of one of the phrases that are near some of all others."""
        return F.array_intersect(rows.starts(p), _runs(self.lasts(rows), -self._reach(p), 0))

    def matches(self, rows: Found) -> Column:
        return F.size(self.lasts(rows)) > 0

    def scored(self) -> list[tuple[Phrase, Callable[[Found], Column]]]:
        return [(p, lambda rows, p=p: F.size(self.instances(rows, p))) for p in self.near]


@dataclass(frozen=True)
class Both(Query):
    a: Query
    b: Query

    def phrases(self) -> list[Phrase]:
        return self.a.phrases() + self.b.phrases()

    def asked(self) -> list[Phrase]:
        return self.a.asked() + self.b.asked()

    def matches(self, rows: Found) -> Column:
        return self.a.matches(rows) & self.b.matches(rows)

    def scored(self) -> list[tuple[Phrase, Callable[[Found], Column]]]:
        return self.a.scored() + self.b.scored()


@dataclass(frozen=True)
class Either(Both):
    def matches(self, rows: Found) -> Column:
        return self.a.matches(rows) | self.b.matches(rows)


@dataclass(frozen=True)
class Without(Both):
    def phrases(self) -> list[Phrase]:
        return self.a.phrases()

    def matches(self, rows: Found) -> Column:
        return self.a.matches(rows) & ~self.b.matches(rows)

    def scored(self) -> list[tuple[Phrase, Callable[[Found], Column]]]:
        return self.a.scored()


def _holds_near(query: Query) -> bool:
    return isinstance(query, Near) or isinstance(query, Both) and (_holds_near(query.a) or _holds_near(query.b))


def term(word: str, **options) -> Phrase:
    return Phrase((word,), **options)


def phrase(words: str, **options) -> Phrase:
    return Phrase(tuple(words.split()), **options)


def all_of(words: str) -> Query:
    return reduce(Both, map(term, words.split()))


def _needed(query: Query) -> list[Phrase]:
    """Phrases that every match holds."""
    if isinstance(query, Without):
        return _needed(query.a)
    if isinstance(query, Either):
        return []
    return _needed(query.a) + _needed(query.b) if isinstance(query, Both) else query.phrases()


#: A term is looked up first, and the others' postings among its documents alone, if it is in so many times fewer, and the
#: most frequent one in more documents than are soon shuffled.
RARER, SOON = 8, 100_000


def _postings(index: Index, query: Query, counts: dict[str, int]) -> DataFrame:
    """The postings of the query's terms. Where a rare term must occur, the others' only for documents that hold it
    (unless they are counted anyway, as those of phrases are)."""
    atoms = list(dict.fromkeys(a for p in query.asked() for a in p.atoms()))
    rows = index.of_terms(atoms)
    needed = [p.terms[0] for p in _needed(query) if p.plain() and not p.prefix and p.terms[0] in counts]
    rare = min(needed, key=counts.__getitem__, default=None)
    if rare is None or any(not p.plain() or p.prefix for p in query.asked()) or max(counts.values()) < max(SOON, RARER * counts[rare]):
        return rows
    docs = index.of_terms([Atom(rare)]).select("doc").distinct()
    return rows.join(docs, "doc", "left_semi")


def _bm25(index: Index, query: Query, postings: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``bm25`` over some postings; ``counts`` has the documents of terms where they are known."""
    found = Found(postings, query, index.columns)
    scored = query.scored()
    unknown = [k for k, (p, _) in enumerate(scored) if not p.plain() or p.prefix or p.terms[0] not in counts]
    rows = found.rows.filter(query.matches(found)).select("doc", "dl", *[f(found).alias(f"n{k}_f") for k, (_, f) in enumerate(scored)])
    if index.facts is None:
        rows = rows.crossJoin(F.broadcast(index.corpus()))  # one row
    else:
        rows = rows.withColumns({"N": F.lit(index.facts.documents), "mean": F.lit(index.facts.mean)})
    if unknown:
        spread = found.rows.agg(*[F.count_if(found.count(scored[k][0]) > 0).alias(f"n{k}") for k in unknown])
        rows = rows.crossJoin(F.broadcast(spread))  # one row
    total = F.lit(0.0)
    for k, (p, _) in enumerate(scored):
        n, f = F.col(f"n{k}") if k in unknown else F.lit(counts[p.terms[0]]), F.col(f"n{k}_f")
        idf = F.greatest(F.ln((F.col("N") - n + F.lit(0.5)) / (n + F.lit(0.5))), F.lit(1e-6))
        total = total - idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("mean")))
    return rows.select("doc", total.alias("bm25"))


def _blocks(index: Index, query: Query) -> dict[str, list[tuple[float, float, int, Column]]]:
    terms = list(dict.fromkeys(p.terms[0] for p in query.asked() if p.plain() and not p.prefix))
    return index.tiers(terms, index.facts.mean) if terms and index.facts is not None and index.facts.documents else {}


def _documents(blocks: dict) -> dict[str, int]:
    return {t: sum(b[2] for b in of) for t, of in blocks.items()}


def bm25(index: Index, query: Query) -> DataFrame:
    """``doc, bm25`` of the documents that match; the smallest value is the best.

    Each phrase adds -idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean dl)), where f counts its instances in the
    document and idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6, for n of N documents that hold it.
    """
    counts = _documents(_blocks(index, query))
    return _bm25(index, query, _postings(index, query, counts), counts)


def _any_terms(query: Query) -> list[str] | None:
    """The terms of a search for any of some plain terms, else None."""
    if isinstance(query, Phrase):
        return [query.terms[0]] if query.plain() and not query.prefix else None
    if isinstance(query, Either):
        a, b = _any_terms(query.a), _any_terms(query.b)
        return None if a is None or b is None else [*a, *b]
    return None


def reachable(blocks: dict[str, list[tuple[float, float, int, Column]]], terms: list[str], documents: int, wanted: int) -> tuple[float, list[Column]]:
    """A score (positive) that at least ``wanted`` documents are known to have, 0 if none is, and the blocks of postings
    that a document with that score can lie in.

    If a document reaches the score, then for each of its terms the block's largest value and the other terms' largest
    ones do together; so no posting of such a document is left out.
    """
    # A term that is named twice scores twice.
    weight: dict[str, float] = {}
    for t in terms:
        n = sum(b[2] for b in blocks[t])
        weight[t] = weight.get(t, 0.0) + max(math.log((documents - n + 0.5) / (n + 0.5)) if documents - n + 0.5 > 0 else 0.0, 1e-6) * (K1 + 1)
    sure = 0.0
    for t, w in weight.items():
        held = 0
        for low, _, n, _ in sorted(blocks[t], key=lambda b: -b[0]):
            held += n
            if held >= wanted:
                sure = max(sure, w * low)
                break
    most = {t: w * max((b[1] for b in blocks[t]), default=0.0) for t, w in weight.items()}
    rest = {t: sum(most.values()) - most[t] for t in weight}
    return sure, [b[3] for t, w in weight.items() for b in blocks[t] if (w * b[1] + rest[t]) * (1 + 1e-9) >= sure]


def top(index: Index, query: Query, most: int, kept: DataFrame | None = None) -> DataFrame:
    """The ``most`` best of ``bm25`` (ties to smaller docs), of the documents in ``kept`` (doc) alone if that is given.

    For any of some plain terms, blocks of postings that can't hold one of the best are skipped; if too few of what is
    found is ``kept``, more is read. The result's few rows come through the driver.
    """
    spark = index.lengths.sparkSession
    blocks = _blocks(index, query)
    counts, terms = _documents(blocks), _any_terms(query)
    wanted, skipping = 2 * most if kept is not None else most, terms is not None and all(t in blocks for t in terms)
    while True:
        sure, postings = 0.0, _postings(index, query, counts)
        if skipping:
            sure, needed = reachable(blocks, terms, index.facts.documents, wanted)
            if sure > 0.0:
                postings = postings.filter(reduce(Column.__or__, needed))
        hits = _bm25(index, query, postings, counts)
        if kept is not None:
            hits = hits.join(kept.select("doc"), "doc", "left_semi")
        best = hits.orderBy("bm25", "doc").limit(most).collect()
        # What was left out scores less than what is sure.
        if sure == 0.0 or len(best) == most and -best[-1]["bm25"] >= sure * (1 - 1e-9):
            return spark.createDataFrame(best, hits.schema)
        wanted *= 4
