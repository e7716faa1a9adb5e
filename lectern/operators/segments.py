"""A keyword index that is kept up by appending: segments of postings, each with the folders whose documents it replaces.

An ingest writes one small segment. A search reads the buckets of its terms in each segment, and passes over postings
whose folder a later segment replaces; segments are merged, the newer and smaller ones first, so that there are few and a
posting is rewritten a bounded number of times while the index doubles. Lengths are a table of their own (``tables``).
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import search
from lectern.operators.search import Atom, Facts, Index
from lectern.operators.tables import SEQ, Tables

#: Bytes of a segment's bucket, and buckets of a segment at most.
BUCKET, MOST = 64 << 20, 4096
#: Segments of like size that are merged: a run of them, from the newest on, each at most LIKE times those after it.
RUN, LIKE = 4, 2.0
#: Segments up to so many bytes are alike anyway.
SMALL = 1 << 20


def owner_of(doc: Column) -> Column:
    """The folder of a document: that before a slash, or the document itself."""
    return F.substring_index(doc, "/", 1)


def _schema(bucketed: bool = True) -> str:
    return f"doc string, dl long, term string, f int, places array<long>, {SEQ} long, tier int" + ", bucket int" * bucketed


@dataclass(frozen=True)
class Segments(Index):
    """An index over the segments of ``name``; ``lengths`` is its table of documents."""

    tables: Tables | None = None
    name: str = ""

    @classmethod
    def open(cls, tables: Tables, name: str, columns: list[str]) -> Segments:
        documents, tokens = tables.state["facts"].get(name, [0, 0])
        lengths = tables.table(f"{name}_docs").select("doc", "dl")
        return cls(tables.spark.createDataFrame([], _schema()), lengths, tuple(columns), None, None, None, Facts(documents, tokens), tables, name)

    def parts(self) -> list[dict]:
        return self.tables.state["segments"].get(self.name, [])

    def _replaced(self, after: list[dict]) -> DataFrame | None:
        """Folders that some segments replace, with the latest commit that did."""
        paths = [f"{self.tables.path}/{self.name}/{s['version']}/replaced" for s in after if s["replaced"]]
        if not paths:
            return None
        rows = self.tables.spark.read.schema(f"folder_name string, {SEQ} long").parquet(*paths)
        return rows.groupBy(F.col("folder_name").alias("replaced_name")).agg(F.max(SEQ).alias("replaced_seq"))

    def _live(self, rows: DataFrame, after: list[dict]) -> DataFrame:
        replaced = self._replaced(after)
        if replaced is None:
            return rows
        return rows.join(replaced, (owner_of(F.col("doc")) == F.col("replaced_name")) & (F.col(SEQ) < F.col("replaced_seq")), "left_anti")

    def _read(self, segment: dict, kind: str = "postings") -> DataFrame:
        return self.tables.spark.read.schema(search.STATS if kind == "stats" else _schema()).parquet(f"{self.tables.path}/{self.name}/{segment['version']}/{kind}")

    def of_terms(self, atoms: list[Atom]) -> DataFrame:
        parts, found = self.parts(), []
        for k, s in enumerate(parts):
            rows = search.chosen(self._read(s), atoms, s["buckets"])
            found.append(self._live(rows, parts[k + 1 :]).withColumn("segment", F.lit(k)))
        return reduce(DataFrame.unionByName, found) if found else self.postings.withColumn("segment", F.lit(0))

    def tiers(self, terms: list[str], mean: float) -> dict[str, list[tuple[float, float, int, Column]]]:
        """Nothing where some postings may be replaced: then only reading them tells how many there are."""
        parts = self.parts()
        if any(s["replaced"] for s in parts[1:]):
            return {}
        atoms, found = [Atom(t) for t in terms], []
        for k, s in enumerate(parts):
            found.append(search.chosen(self._read(s, "stats"), atoms, s["buckets"]).select("term", "tier", "n", F.lit(k).alias("segment")))
        out: dict[str, list] = {t: [] for t in terms}
        for r in reduce(DataFrame.unionByName, found).groupBy("segment", "term", "tier").agg(F.sum("n").alias("n")).collect() if found else ():
            block = (F.col("segment") == r["segment"]) & (F.col("term") == r["term"]) & (F.col("tier") == r["tier"])
            out[r["term"]].append((*search.bounds(r["tier"], parts[r["segment"]]["assumed"] / mean), r["n"], block))
        return out


def _version() -> str:
    return f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"


def _staged(tables: Tables, name: str, drop: list[str], segment: dict) -> None:
    held = tables.staged.setdefault("segments", {}).setdefault(name, {"drop": [], "add": []})
    held["drop"] += drop
    held["add"].append(segment)


def put(tables: Tables, name: str, texts: DataFrame, columns: list[str], tokenize: Callable[[Column], Column], gone: DataFrame | None = None) -> None:
    """Stages a segment with the index of ``texts`` (folder_name, doc and ``columns``), all documents of their folders, and
    that the folders in ``gone`` have none. Old documents are looked up in the buckets of these folders alone."""
    seq, version = tables.state["number"] + 1, _version()
    path = f"{tables.path}/{name}/{version}"
    assumed = search.assumed_mean(texts, columns)
    characters = assumed * search.TOKEN_CHARS * max(1, texts.count())
    buckets = min(MOST, 1 << max(0, int(characters / BUCKET).bit_length()))
    rows = search.posted(texts, "doc", columns, tokenize).withColumn(SEQ, F.lit(seq).cast("long"))
    stored = search.write_postings(rows, path, buckets, assumed)
    docs = stored.groupBy("doc").agg(F.max("dl").alias("dl")).select(owner_of(F.col("doc")).alias("folder_name"), "doc", "dl")
    named = docs.select("folder_name") if gone is None else docs.select("folder_name").unionByName(gone.select("folder_name"))
    touched = sorted(r["b"] for r in named.select(tables.bucket().alias("b")).distinct().collect())  # at most as many as there are
    before = tables.table(f"{name}_docs", touched).join(named.distinct(), "folder_name", "left_semi")
    before.select("folder_name").distinct().withColumn(SEQ, F.lit(seq).cast("long")).write.parquet(f"{path}/replaced")
    replaced = tables.spark.read.schema(f"folder_name string, {SEQ} long").parquet(f"{path}/replaced").count()
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    new, old = count(docs), count(before) if replaced else {"n": 0, "t": 0}
    tables.put(f"{name}_docs", docs, gone, order=("folder_name", "doc"))
    facts = tables.staged.setdefault("facts", {})
    facts[name] = [a + b for a, b in zip(facts.get(name, [0, 0]), (new["n"] - old["n"], new["t"] - old["t"]))]
    _staged(tables, name, [], {"version": version, "seq": seq, "buckets": buckets, "assumed": assumed, "replaced": replaced, "bytes": tables.files.size(f"{name}/{version}")})


def merge(tables: Tables, name: str, run: int = RUN) -> int:
    """Merges the newest segments, if ``run`` or more of them are alike, and stages the result; returns how many."""
    parts = tables.state["segments"].get(name, [])
    k, size = len(parts), 0
    while k and (k == len(parts) or parts[k - 1]["bytes"] <= max(LIKE * size, SMALL)):
        k, size = k - 1, size + parts[k - 1]["bytes"]
    chosen = parts[k:]
    if len(chosen) < run:
        return 0
    whole = Segments.open(tables, name, [])
    rows = [whole._live(whole._read(s), chosen[i + 1 :]) for i, s in enumerate(chosen)]
    version = _version()
    path = f"{tables.path}/{name}/{version}"
    assumed = max(1.0, whole.facts.mean)
    buckets = min(MOST, 1 << max(0, int(size / BUCKET).bit_length()))
    search.write_postings(reduce(DataFrame.unionByName, rows).drop("tier", "bucket"), path, buckets, assumed)
    replaced = whole._replaced(chosen)
    # What the oldest segments replace is of no use once there is nothing older.
    kept = tables.spark.createDataFrame([], f"folder_name string, {SEQ} long") if replaced is None or not k else replaced.select(F.col("replaced_name").alias("folder_name"), F.col("replaced_seq").alias(SEQ))
    kept.write.parquet(f"{path}/replaced")
    left = tables.spark.read.schema(f"folder_name string, {SEQ} long").parquet(f"{path}/replaced").count()
    _staged(tables, name, [s["version"] for s in chosen], {"version": version, "seq": chosen[-1]["seq"], "buckets": buckets, "assumed": assumed, "replaced": left, "bytes": tables.files.size(f"{name}/{version}")})
    return len(chosen)
