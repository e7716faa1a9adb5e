"""Resampling of documents towards a target distribution of n-grams, by importance weights.

Runs of words are hashed into buckets; a bucket's gain is the logarithm of its share in the target against its share in
the documents, and a document's weight the mean gain of its runs, looked up in one array. Noise of a Gumbel
distribution, fixed by the document's id, makes drawing the highest scores drawing without replacement by weight.

The k-th highest score is found by radix selection: counts of the keys' next digits over all rows say in which digit
the k-th key lies, and only rows that share its digits so far are counted on. No sort sees more than the drawn rows,
which are dealt out by ranges of the key and numbered range by range.

What is counted from the corpus travels as one row for each bucket and task; gains (one number a bucket) are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.llm.common import discarded, map_column, scratch, utf8, written

GRAMS, BUCKETS, SALT = 1, 10_000, "2024:"
#: Documents with fewer words aren't drawn; of the others so many in a hundred are.
LEAST_WORDS, SHARE = 20, 10
#: Bytes of a text that are taken apart at once, and words whose buckets a task remembers.
PIECE, KNOWN = 1 << 20, 1 << 19
#: Bits of a digit.
RADIX = 12

#: Letters a to z and digits, A to Z lower-cased, all beyond ASCII, and a space for everything else.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


class Buckets(dict):
    """Words' buckets, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; a longer word is whole."""
    text, at = text.translate(_WORD_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(text: bytes, grams: int, known: Buckets) -> Iterator[tuple[int, np.ndarray]]:
    """By piece, the number of words and the buckets of all runs of 1 to ``grams`` words that end in it."""
    tail: list[bytes] = []
    for words in pieces(text):
        found = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        if grams > 1:
            joined = tail + words
            for n in range(2, grams + 1):
                first = max(0, len(tail) + 1 - n)
                found.append(np.array([zlib.crc32(b" ".join(joined[i : i + n])) % known.buckets for i in range(first, len(joined) - n + 1)], np.int64))
            tail = joined[-(grams - 1) :]
        yield len(words), np.concatenate(found)


def bucket_counts(docs: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; null texts have no words."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, found in features(value.as_py(), grams, known):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(utf8(text)).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share in the target over that in the source, each count plus one."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", grams: int = GRAMS, salt: str = SALT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_features, weight (0 without features) and score, the weight plus the id's noise.

    A null id is hashed as an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    value = F.struct(utf8(text).alias("text"), F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long").alias("h"))

    def make():
        gain_of = sent.value
        known = Buckets(len(gain_of))

        def score(rows: list) -> dict[str, pa.Array]:
            out: list[tuple[int, int, int, int]] = []
            for row in rows:
                words = runs = total = 0
                for n, found in features(row["text"], grams, known):
                    words, runs, total = words + n, runs + len(found), total + int(gain_of[found].sum())
                weight = total // runs if runs else 0
                out.append((words, runs, weight, weight + math.floor(-1000 * math.log(-math.log((row["h"] + 0.5) / 4294967296)))))
            names = ("n_words", "n_features", "weight", "score")
            return {name: pa.array(x, pa.int64()) for name, x in zip(names, list(zip(*out)) or [()] * 4)}

        return score

    return map_column(docs, value, "n_words long, n_features long, weight long, score long", make, keep)


_SIGN = -(2**63)


def kth_key(rows: DataFrame, k: int) -> tuple[int, int]:
    """The ``k``-th smallest of the composite keys (``a``, ``b``), two longs; ``rows`` has at least ``k``.

    A round counts one digit of the rows that share the key's digits so far: at most 2 ** RADIX counts come to the
    driver. Those rows are written after each round.
    """
    left, need, found = rows.select("a", "b"), k, []
    stored: DataFrame | None = None
    for name in ("a", "b"):
        span = left.agg(F.min(name).alias("low"), F.max(name).alias("high")).first()
        low, high = span["low"] - _SIGN, span["high"] - _SIGN
        bits = (low ^ high).bit_length()  # those above are common to all rows
        key, unsigned = high >> bits, F.col(name).bitwiseXOR(F.lit(_SIGN))
        while bits:
            width = min(RADIX, bits)
            bits -= width
            digit = F.shiftrightunsigned(unsigned, bits).bitwiseAND(F.lit((1 << width) - 1))
            for r in sorted(left.groupBy(digit.cast("int").alias("digit")).count().collect(), key=lambda r: r["digit"]):
                if r["count"] >= need:
                    break
                need -= r["count"]
            key = key << width | r["digit"]
            if bits or name == "a":
                left, before = written(left.filter(digit == r["digit"]), "radix-left"), stored
                stored = left
                if before is not None:
                    discarded(before)
        found.append(key + _SIGN)
    return found[0], found[1]


def drawn(rows: DataFrame, k: int, ties: list[str]) -> tuple[DataFrame, Column]:
    """The rows at or before the ``k``-th key (``a``, ``b``) with their ``rank`` in order (null after k rows, where keys
    are equal), and the condition that tells them. ``ties`` order rows of equal keys."""
    first, second = kth_key(rows, k)
    within = (F.col("a") < first) | ((F.col("a") == first) & (F.col("b") <= second))
    # Equal rows are told apart by their place in the stored table, so that ranges can split them.
    order = ["a", "b", *ties, "place"]
    chosen = rows.filter(within).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    schema = StructType([*chosen.schema, StructField("part", LongType()), StructField("at", LongType())])

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            at = np.arange(n + 1, n + 1 + batch.num_rows, dtype=np.int64)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int64)), pa.array(at)], schema.fieldNames())

    stored = written(chosen.mapInArrow(numbered, schema), "resample-drawn", lasting=True)
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.max("at").alias("n")).collect())  # a row for each range
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part long, before long")
    rank = F.col("before") + F.col("at")
    return stored.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= k, rank)).drop("part", "at", "before"), within


def resampled(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS,
    share: int = SHARE, least_words: int = LEAST_WORDS, salt: str = SALT, keep: list[str] | None = None,
) -> DataFrame:
    """Every document with n_words, n_features, weight, score and rank: of those with ``least_words`` words, the
    ``share`` percent (rounded down) with the highest scores are drawn and numbered from 1; rank is null for the rest.

    ``keep`` names the columns that stay (all, if None); those that bear a result's name are replaced. Null texts have
    no words, and empty tables give empty or undrawn results. Ties go to smaller ids, null ids after all others, then
    to fewer features and smaller weights; of rows that agree in all these, repeated ones that is, just as many are
    drawn as are wanted. Texts of any length count whole; a long one is taken apart piece by piece.
    """
    results = ("n_words", "n_features", "weight", "score")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*results, "rank")]
    columns = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(kept)]  # out of the way of all names below
    with scratch():
        gain = gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, target_text, grams, buckets))
        named = docs.select(*columns, F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        scored = written(weighted(named, gain, "text", "id", grams, salt, [f"kept_{i}" for i in range(len(kept))] + ["id"]), "resample-scored", lasting=True)
        enough = F.col("n_words") >= least_words
        k = share * scored.filter(enough).count() // 100
        keyed = scored.select("*", F.bitwise_not("score").alias("a"), F.coalesce("id", F.lit(2**63 - 1)).alias("b"))
        out = keyed.withColumn("rank", F.lit(None).cast("long"))
        if k:
            ranked, within = drawn(keyed.filter(enough), k, ["n_features", "weight"])
            out = ranked.unionByName(out.filter(~(enough & within)))
        return out.drop("a", "b", "id").toDF(*kept, *results, "rank")
