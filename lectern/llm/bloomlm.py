"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

The filter holds quantised n-gram counts: an n-gram counted c times is entered with every level from 1 to
1 + floor(log_B c), and its count is read back by probing level after level until one is missing. Words and pairs of
words of the training texts are counted in Spark over all of them: each task counts its own n-grams by hash, the counts
are dealt by hash and summed, and each share of the hashes becomes its own segment of the filter. A segment has BITS
bits for each level of its entries, so the filter grows with the counts and its share of false positives does not depend
on the corpus. It is never gathered: questions go to the segments by hash.

A text's probability is the product over its tokens of

    t * c(previous, token) / c(previous) + (1 - t) * p(token),    p(token) = (c(token) + 1) / (N + V + 1)

where t, the trust in pairs, grows with c(previous) up to TRUST: c(previous) / (c(previous) + MU), and with the counts
that the filter gives back. The base score uses exact counts of words, which the segments hold too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, utf8, written

#: Base of the levels, and probes for each level.
BASE, PROBES = 1.5, 4
MU, TRUST = 5.0, 0.5  # the pair with the lowest perplexity on held-out documents of the test tables
#: Bits for each entry and level.
BITS = 7
#: Bytes of text for each share of the hashes at most, and tokens of the texts that ask together.
SHARE, ASKED = 32 << 20, 1_500_000
#: Words whose hashes are remembered in a worker.
REMEMBERED = 600_000
LEVELS = 80
#: The token that ends each text.
END = b"\n"

_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_HASHES: dict[bytes, int] = {}


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def token_hashes(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased words and of the end token, as unsigned 64-bit integers."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    words.append(END)
    get = _HASHES.get
    found = list(map(get, words))
    if None in found:
        if len(_HASHES) > REMEMBERED:
            _HASHES.clear()
        for k, h in enumerate(found):
            if h is None:
                h = found[k] = xxh64_intdigest(words[k], 9)
                if len(words[k]) < 100:
                    _HASHES[words[k]] = h
    return np.array(found, np.uint64)


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it; the end token stands before the first."""
    before = np.concatenate([tokens[-1:], tokens[:-1]])
    return mixed_bits(before * _GOLD + tokens)


def _summed(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _squeezed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as planes of bytes of their differences, the highest of which are nearly all 0 and compress."""
    return np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _spread(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes with their counts; counts take as few bytes as the largest needs."""
    width = 1 if not len(counts) or counts.max() < 1 << 8 else 4 if counts.max() < 1 << 32 else 8
    return bytes([width]) + _squeezed(hashes) + counts.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    n = (len(data) - 1) // (8 + width)
    return _spread(data[1 : 1 + 8 * n]), np.frombuffer(data, f"<u{width}", n, 1 + 8 * n).astype(np.int64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each hash: equal ranges of the hash, so that ascending hashes lie in ascending segments."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _shares(kind: int, hashes: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[dict]:
    cuts = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
    for k in range(segments):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            yield {"kind": kind, "segment": k, "data": _packed(hashes[a:b], counts[a:b])}


_SHARES = pa.schema([("kind", pa.int32()), ("segment", pa.int32()), ("data", pa.binary())])
_BLOCK = 3_000_000


def counted(texts: DataFrame, text: str, segments: int) -> DataFrame:
    """Each segment of the model of all texts: its ``bits`` and ``filter`` of words and pairs, exact counts of its ``words``, their number ``n`` and their ``total``."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [*_shares(1, *_summed(np.concatenate(held)), segments), *_shares(2, *_summed(np.concatenate(pairs)), segments)]
            yield pa.RecordBatch.from_pylist(rows, schema=_SHARES)

        for batch in batches:
            for value in batch.column(0).to_pylist():
                tokens = token_hashes(value)
                held.append(tokens)
                pairs.append(pair_hashes(tokens))
                many += len(tokens)
                if many >= _BLOCK:
                    yield from flush()
                    held, pairs, many = [], [], 0
        if held:
            yield from flush()

    def summed(shares: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, size = [], 0
        for data in [*shares, None]:
            if data is not None:
                parts.append(_unpacked(data))
                size += len(parts[-1][0])
            if parts and (data is None or size > _BLOCK):  # in steps, so that repeats don't pile up
                hashes, counts = _summed(np.concatenate([hashes, *[p[0] for p in parts]]), np.concatenate([counts, *[p[1] for p in parts]]))
                parts, size = [], 0
        return hashes, counts

    def total(key: tuple, pdf):
        import pandas as pd

        words, pairs = (summed(pdf["data"][pdf["kind"] == kind]) for kind in (1, 2))
        hashes, counts = np.concatenate([words[0], pairs[0]]), np.concatenate([words[1], pairs[1]])
        bits = 64 + BITS * int(_levels(counts).sum()) // 8 * 8
        return pd.DataFrame({"segment": [key[0]], "bits": [bits], "filter": [LogFrequencyFilter.segment(hashes, counts, bits)], "words": [_packed(*words)], "n": [len(words[0])], "total": [int(words[1].sum())]})

    shares = texts.select(utf8(text).alias("value")).mapInArrow(local, "kind int, segment int, data binary")
    return shares.groupBy("segment").applyInPandas(total, "segment int, bits long, filter binary, words binary, n long, total long")


def _levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)).astype(np.int64)


#: The count that stands for each level found: the middle of the counts it holds.
EXPECTED = np.array([0.0] + [(np.ceil(BASE ** (q - 1) - 1e-9) + max(np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1)) / 2 for q in range(1, LEVELS)])


class LogFrequencyFilter:
    """The filter: one byte array, and where each segment's bytes start and how many bits it has."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes

    @staticmethod
    def positions(hashes: np.ndarray, level: np.ndarray | int, probe: int, size: np.ndarray | int) -> np.ndarray:
        """The bit, within its segment, that a probe of a level falls on."""
        salt = np.atleast_1d(level).astype(np.uint64) * np.uint64(PROBES) + np.uint64(probe + 1)
        x = mixed_bits(hashes + salt * _GOLD)
        return ((x >> np.uint64(32)) * np.asarray(size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def segment(cls, hashes: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
        """A segment's bytes, with all levels of its entries set."""
        array = np.zeros((bits + 7) // 8, np.uint8)
        top = _levels(counts)
        level = 1
        while len(hashes):
            for probe in range(PROBES):
                at = cls.positions(hashes, level, probe, bits)
                np.bitwise_or.at(array, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            level += 1
            left = top >= level
            hashes, top = hashes[left], top[left]
        return array.tobytes()

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The counts that repeated probes give back; 0 for what isn't there."""
        return EXPECTED[self.levels(hashes)]

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level that repeated probes find of each entry."""
        found = np.zeros(len(hashes), np.int64)
        live = np.arange(len(hashes))
        segment = segment_of(hashes, len(self.sizes))
        start, size = self.starts[segment], self.sizes[segment]
        live = live[size > 0]
        for level in range(1, LEVELS):
            for probe in range(PROBES):
                if not len(live):
                    return found
                at = self.positions(hashes[live], level, probe, size[live])
                live = live[(self.data[start[live] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            found[live] = level
        return found


class Model(NamedTuple):
    """A trained model: its table (``segment``, ``bits``, ``filter``, exact counts of ``words``), tokens, distinct words, segments."""

    table: DataFrame
    tokens: int
    distinct: int
    segments: int


def log_shares(tokens: np.ndarray, counts: np.ndarray, pairs: np.ndarray, denominator: float) -> np.ndarray:
    """log10 probabilities of tokens, given the filter's counts of those before, of them, and of their pairs."""
    trust = np.minimum(tokens / (tokens + MU), TRUST)
    return np.log10(trust * np.minimum(np.minimum(pairs, counts) / np.maximum(tokens, 1), 1) + (1 - trust) * ((counts + 1) / denominator))


def segments_for(df: DataFrame, text: str = "text") -> int:
    """Shares of the hashes: four for each shuffle partition, and more where a share would hold over SHARE bytes of text."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(4 * max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-int(size) // SHARE))


def trained(texts: DataFrame, segments: int, text: str = "text") -> Model:
    """The model of all ``texts``; a segment of its filter has BITS for each level of its entries."""
    table = written(counted(texts, text, segments), "lm-model")
    sums = table.agg(F.sum("total"), F.sum("n")).first()
    return Model(table.select("segment", "bits", "filter", "words"), sums[0] or 0, sums[1] or 0, segments)


def _previous(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each one of texts that follow each other; a text's last (end) token stands before its first."""
    before = np.concatenate([flat[-1:], flat[:-1]])
    ends = np.cumsum(sizes)
    before[ends - sizes] = flat[ends - 1]
    return before


def _block(rows: list[np.ndarray], texts: list[np.ndarray]) -> bytes:
    """Rows' numbers, texts' sizes, the distinct words' hashes (the frequent first), and each token's place among them.

    Places are kept in three planes of bytes (four if need be), the higher of which compress to little.
    """
    flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts], "<i8")
    distinct, of, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order))
    planes = np.ascontiguousarray(rank[of].view(np.uint8).reshape(-1, 4).T[: 3 if len(order) <= 1 << 24 else 4])
    head = np.array([len(sizes), len(distinct), len(flat), len(planes)], "<i8")
    return b"".join([head.tobytes(), np.concatenate(rows).astype("<i8").tobytes(), sizes.tobytes(), distinct[order].astype("<u8").tobytes(), planes.tobytes()])


def _read_block(data: bytes) -> tuple[np.ndarray, ...]:
    """A block's rows, sizes, distinct words' hashes, tokens' places among them, and hashes of the tokens' pairs."""
    n, m, many, planes = np.frombuffer(data, "<i8", 4).tolist()
    rows, sizes = np.frombuffer(data, "<i8", n, 32), np.frombuffer(data, "<i8", n, 32 + 8 * n)
    words = np.frombuffer(data, "<u8", m, 32 + 16 * n)
    place = np.zeros((many, 4), np.uint8)
    place[:, :planes] = np.frombuffer(data, np.uint8, planes * many, 32 + 16 * n + 8 * m).reshape(planes, many).T
    place = place.view("<u4").ravel()
    tokens = words[place]
    return rows, sizes, words, place, mixed_bits(_previous(tokens, sizes) * _GOLD + tokens)


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``'s columns (or those in ``keep``) with ``n_tokens, n_known, base_score, score`` of each whole text.

    Nothing of the model is broadcast. Texts are packed into blocks of about ASKED tokens; a block asks each segment for
    its distinct words and pairs, a segment answers with levels of the filter and exact counts of words, and the block
    is scored where the answers meet it.

    Rows are told apart by a number given in the first pass, which is written; so repeated rows, null ids and any
    columns are fine. Null and empty texts are the end token alone. With no training text at all, every count is 0.
    Columns that bear a result's name are replaced.
    """
    results = {"n_tokens", "n_known", "base_score", "score"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    names = docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(0).alias(r) for r in sorted(results)])
    row, value, of = free_name(names, "row_of_text"), free_name(names, "bytes_of_text"), free_name(names, "of_row")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(row), utf8(text).alias(value))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    first_schema = StructType([*source.schema[:-1], StructField(value, BinaryType())])
    arrow = to_arrow_schema(first_schema)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        many, waiting = 0, None

        def passed(block: bytes | None) -> pa.RecordBatch:
            columns = [*waiting, pa.array([None] * (len(waiting[0]) - 1) + [block], pa.binary())]
            return pa.RecordBatch.from_arrays([c if c.type == t.type else c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if waiting is not None:  # a block goes with its last row
                    yield passed(_block(rows, texts) if many >= ASKED else None)
                    if many >= ASKED:
                        rows, texts, many = [], [], 0
                found = [token_hashes(t) for t in part.column(part.num_columns - 1).to_pylist()]
                rows.append(part.column(part.num_columns - 2).to_numpy())
                texts += found
                many += sum(map(len, found))
                waiting = [part.column(i) for i in range(part.num_columns - 1)]
        if waiting is not None:
            yield passed(_block(rows, texts))

    rows = written(source.mapInArrow(first, first_schema), "lm-first")
    blocks = rows.filter(F.col(value).isNotNull()).select(F.col(row).alias("block"), F.col(value).alias("data"))
    results_of = _answered(blocks, model).withColumnRenamed("of_row", of)
    joined = rows.drop(value).join(results_of, rows[row] == results_of[of])
    return joined.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", "n_known", "base_score", "score")


def _answered(blocks: DataFrame, model: Model) -> DataFrame:
    """``of_row, n_tokens, n_known, base_score, score`` of all rows in the blocks (``block``, ``data``)."""
    segments, denominator = model.segments, float(model.tokens + model.distinct + 1)
    asks = pa.schema([("segment", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("pairs", pa.binary())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, _, words, _, pairs = _read_block(data.as_py())
                cut = []
                for hashes in (np.sort(words), np.unique(pairs)):
                    at = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
                    cut.append([_squeezed(hashes[a:b]) for a, b in zip(at[:-1], at[1:])])
                yield pa.RecordBatch.from_pylist([{"segment": k, "block": block, "words": w, "pairs": p} for k, (w, p) in enumerate(zip(*cut)) if w or p], schema=asks)

    def answer(asked, held):
        import pandas as pd

        known, filled = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), LogFrequencyFilter(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
        for bits, data, words in zip(held["bits"], held["filter"], held["words"]):
            known, filled = _unpacked(words), LogFrequencyFilter(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([bits]))
        exact, levels = [], []
        for at in range(0, len(asked), 64):  # some blocks' questions at once
            words, pairs = ([_spread(x) for x in asked[c].iloc[at : at + 64]] for c in ("words", "pairs"))
            flat = np.concatenate(words)
            place = np.minimum(np.searchsorted(known[0], flat), max(0, len(known[0]) - 1))
            counts = np.where(known[0][place] == flat, known[1][place], 0) if len(known[0]) else np.zeros(len(flat), np.int64)
            found = filled.levels(np.concatenate([flat, *pairs])).astype(np.uint8)
            a, b = 0, len(flat)
            for w, p in zip(words, pairs):
                exact.append(counts[a : a + len(w)].astype("<i8").tobytes())
                levels.append(found[a : a + len(w)].tobytes() + found[b : b + len(p)].tobytes())
                a, b = a + len(w), b + len(p)
        return pd.DataFrame({"block": asked["block"].to_numpy(np.int64), "segment": asked["segment"].to_numpy(np.int32), "exact": exact, "levels": levels})

    def score(block, answers):
        import pandas as pd

        out = []
        answers = answers.sort_values("segment")  # segments are ranges of the hashes, so answers follow the hashes' order
        for data in block["data"]:
            rows, sizes, words, place, pairs = _read_block(data)
            order = np.argsort(words)
            exact, levels = np.empty(len(words), np.int64), np.empty(len(words), np.uint8)
            exact[order] = np.frombuffer(b"".join(answers["exact"]), "<i8")
            levels[order] = np.frombuffer(b"".join(x[: len(e) // 8] for e, x in zip(answers["exact"], answers["levels"])), np.uint8)
            distinct, of_pair = np.unique(pairs, return_inverse=True)
            of_pairs = np.frombuffer(b"".join(x[len(e) // 8 :] for e, x in zip(answers["exact"], answers["levels"])), np.uint8)
            if len(of_pairs) != len(distinct):
                raise ValueError(f"{len(of_pairs)} answers for {len(distinct)} pairs")
            starts = np.cumsum(sizes) - sizes
            counts = EXPECTED[levels][place]
            known = exact[place]
            out.append(
                pd.DataFrame(
                    {
                        "of_row": rows,
                        "n_tokens": sizes,
                        "n_known": np.add.reduceat((known > 0).astype(np.int64), starts),
                        "base_score": np.add.reduceat(np.log10((exact + 1) / denominator)[place], starts),
                        "score": np.add.reduceat(log_shares(_previous(counts, sizes), counts, EXPECTED[of_pairs][of_pair], denominator), starts),
                    }
                )
            )
        return pd.concat(out)

    asked = blocks.mapInArrow(ask, "segment int, block long, words binary, pairs binary")
    answers = asked.groupBy("segment").cogroup(model.table.groupBy("segment")).applyInPandas(answer, "block long, segment int, exact binary, levels binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "of_row long, n_tokens long, n_known long, base_score double, score double")


def language_scores(docs: DataFrame, training: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``scored`` under the model of the rows that ``training`` names, with ``train_tokens`` (replaced, if there)."""
    model = trained(docs.filter(training), segments_for(docs, text), text)
    return scored(docs, model, text, keep).drop("train_tokens").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
