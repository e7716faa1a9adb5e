"""Exact largest inner products by a bit-sliced index.

Components become whole numbers, floor(SCALE * x). The index holds rows in blocks; in each block every dimension's
values, less the dimension's least, keep their SLICES most significant bits, and bit s of dimension d over all rows of
the block is one bitmap. A query's components are written in signed digits (-1, 0, 1): its score is then a sum of
bitmaps, or complements of them, at powers of two, which full adders over whole bitmaps add up into the slices of the
score. From the most significant slice downward, the k-th largest sum is found by counting bits, and so are the rows
whose sum comes near enough that the bits left out could lift them into the top k. Those boundary rows alone are
multiplied out exactly. A task keeps each query's best as it goes through blocks and passes on ``top`` rows a query.

Queries are sent to the tasks in groups of bounded size; each group is one pass over the index, which is written once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.clusters import LONG, parts, vectors, whole
from lectern.llm.common import scratch, written

TOP, SCALE = 10, 1024
#: Most significant bits of each dimension that have bitmaps; rows in a block; bits of a query's components in a sum.
SLICES, BLOCK, WEIGHT = 6, 8192, 12
#: Queries that are added up together, queries in a group, and components in a group's broadcast at most.
TOGETHER, GROUP, SENT = 8, 8192, 4_000_000
#: Sums of products below this are exact in doubles.
EXACT = 2**53

_BLOCK = "dims int, rows int, ids binary, large array<string>, numbers binary, least array<string>, shift int, slices binary"


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows' bits (last axis) as 64-bit words, padded with zeros."""
    rows = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-rows // 64) * 64), np.uint8)
    padded[..., :rows] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def sliced(values: np.ndarray) -> tuple[list[int], int, np.ndarray]:
    """For a block (row, dimension) the least value of each dimension, how many bits are left out, and the bitmaps
    (dimension, slice, word)."""
    least = values.min(axis=0)
    above = values - least
    shift = max(0, max((int(x).bit_length() for x in above.max(axis=0).tolist()), default=0) - SLICES)
    kept = (above >> shift).astype(np.uint8).T
    return [int(x) for x in least.tolist()], shift, _pack((kept[:, None, :] >> np.arange(SLICES, dtype=np.uint8)[None, :, None]) & 1)


def _packed(ids: np.ndarray, values: np.ndarray) -> tuple:
    """A block's row of the index. Numbers that don't compute in 64 bits are kept as text."""
    least, shift, bitmaps = sliced(values)
    large = [str(x) for x in values.ravel().tolist()] if values.dtype == object else None
    return values.shape[1], len(ids), ids.astype("<i8").tobytes(), large, b"" if large else values.astype("<i4").tobytes(), [str(x) for x in least], shift, bitmaps.tobytes()


def indexed(rows: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The bit-sliced index of ``vec_id, vector`` rows: a row for each block of at most ``block`` vectors of one length."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.string()), pa.int32(), pa.binary()]

    def told(ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        row = _packed(np.concatenate(ids), np.concatenate(values))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list, int]] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                names_here = own.column(0).to_numpy()
                for at, values in parts(whole(own.column(1), scale)):
                    for k in range(0, len(at), block):
                        key = (dims, values.dtype == object)
                        ids, numbers, n = held.get(key, ([], [], 0))
                        more = at[k : k + block]
                        if n + len(more) > block:
                            yield told(ids, numbers)
                            ids, numbers, n = [], [], 0
                        held[key] = ([*ids, names_here[more]], [*numbers, values[k : k + block]], n + len(more))
        for ids, numbers, _ in held.values():
            yield told(ids, numbers)

    return rows.select("vec_id", "vector").mapInArrow(built, _BLOCK)


class Weights:
    """A group of queries of one length as sums of bitmaps: for each power of two, which bitmaps are added.

    Bitmap (d, s) has number d * SLICES + s; its complement follows after all of them, and one of zeros is last.
    """

    def __init__(self, values: np.ndarray):
        """``values``: query, dimension; int64 or Python's integers."""
        self.values = values
        self.dims = values.shape[1]
        self.largest = [max((abs(int(x)) for x in q), default=0) for q in values.tolist()]
        self.cut = [max(0, m.bit_length() - WEIGHT) for m in self.largest]
        self.weights = np.array([[int(x) >> cut for x in q] for q, cut in zip(values.tolist(), self.cut)], np.int64).reshape(values.shape)
        zeros, places = 2 * self.dims * SLICES, WEIGHT + 1 + SLICES
        self.below = np.zeros(len(values), np.int64)  # what complements add too much
        digits: list[list[list[int]]] = []
        for k, q in enumerate(self.weights.tolist()):
            at: list[list[int]] = [[] for _ in range(places)]
            for d, w in enumerate(q):
                place = 0
                while w:
                    if w & 1:
                        digit = 2 - (w & 3)  # 1 or -1, so that the next bit is 0
                        w -= digit
                        first = d * SLICES + (0 if digit > 0 else self.dims * SLICES)
                        self.below[k] += 0 if digit > 0 else ((1 << SLICES) - 1) << place
                        for s in range(SLICES):
                            at[place + s].append(first + s)
                    w, place = w >> 1, place + 1
            digits.append(at)
        self.chunks = []
        for begin in range(0, len(values), TOGETHER):
            some = digits[begin : begin + TOGETHER]
            terms = []
            for p in range(places):
                most = max(len(at[p]) for at in some)
                terms.append(np.array([at[p] + [zeros] * (most - len(at[p])) for at in some], np.int64).reshape(len(some), most).T)
            self.chunks.append((begin, begin + len(some), terms))


def added(bitmaps: np.ndarray, terms: list[np.ndarray]) -> list[np.ndarray]:
    """The sums' slices (query, word), lowest first: full adders make one bitmap of three, and one for the next power."""
    slices: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    place = 0
    while place < len(terms) or carried:
        stack = [*carried, bitmaps[terms[place]]] if place < len(terms) else carried
        shape = (0, terms[0].shape[1], bitmaps.shape[1])
        stack = np.concatenate(stack) if stack else np.zeros(shape, np.uint64)
        carried = []
        while len(stack) > 2:
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            both = a ^ b
            carry = a & b
            carry |= c & both
            both ^= c
            carried.append(carry)
            stack = np.concatenate([both, stack[3 * third :]])
        if len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        slices.append(stack[0] if len(stack) else np.zeros(shape[1:], np.uint64))
        place += 1
    return slices


def kth_largest(slices: list[np.ndarray], there: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th largest sum (the least, if there are fewer rows): from the highest slice down, rows with the
    bit are kept if they are enough, else counted and left."""
    queries = len(slices[0])
    rest = np.broadcast_to(there, slices[0].shape)
    need = np.full(queries, min(k, int(np.bitwise_count(there).sum())), np.int64)
    value = np.zeros(queries, np.int64)
    for s in range(len(slices) - 1, -1, -1):
        on = rest & slices[s]
        n = np.bitwise_count(on).sum(axis=1, dtype=np.int64)
        enough = n >= need
        rest = np.where(enough[:, None], on, rest ^ on)
        value += enough.astype(np.int64) << s
        need = np.where(enough, need, need - n)
    return value


def at_least(slices: list[np.ndarray], there: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose sum is at least each query's bound."""
    top = (1 << len(slices)) - 1
    bound = np.clip(bounds, 0, top)
    above, equal = np.zeros_like(slices[0]), np.broadcast_to(there, slices[0].shape)
    for s in range(len(slices) - 1, -1, -1):
        on = equal & slices[s]
        bit = ((bound >> s) & 1).astype(bool)[:, None]
        above = np.where(bit, above, above | on)
        equal = np.where(bit, on, equal ^ on)
    return np.where((bounds > top)[:, None], 0, above | equal)


class Best:
    """A query's best rows so far: scores descending, then ids; each id once for each score."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
        scores, ids = scores[order], ids[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = ((scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])).astype(bool)
        self.scores, self.ids = scores[fresh][: self.top], ids[fresh][: self.top]

    def worst(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.top else None


def _products(values: np.ndarray, query: np.ndarray, largest: int) -> np.ndarray:
    """Exact inner products of rows with a query. ``values``: doubles that hold whole numbers, or Python's integers."""
    if values.dtype != object and query.dtype != object and values.shape[1] * largest * (np.abs(values).max() if values.size else 0) < EXACT:
        return (values @ query.astype(np.float64)).astype(np.int64)
    out = values.astype(np.int64).astype(object) if values.dtype != object else values
    return (out * query.astype(object)).sum(axis=1) if values.shape[1] else np.zeros(len(values), np.int64)


def scan(weights: Weights, own: np.ndarray, best: list[Best], ids: np.ndarray, values: np.ndarray, least: list[int], shift: int, slices: np.ndarray) -> int:
    """Offers a block's rows to all queries of its length; returns how many were multiplied out."""
    rows, words, resolved = len(ids), slices.shape[-1], 0
    bitmaps = slices.reshape(-1, words)
    bitmaps = np.concatenate([bitmaps, ~bitmaps, np.zeros((1, words), np.uint64)])
    there = _pack(np.ones(rows, np.uint8))
    for begin, end, terms in weights.chunks:
        sums = added(bitmaps, terms)
        who = np.arange(begin, end)
        # A row's score is base + unit * sum + something between 0 and slack.
        base, unit, slack = [], [], []
        for k in who.tolist():
            q, cut = [int(x) for x in weights.values[k].tolist()], weights.cut[k]
            lost = sum(x - ((x >> cut) << cut) for x in q) * ((1 << SLICES) - 1) << shift
            spread = (1 << shift) - 1
            low = sum(x * y for x, y in zip(q, least)) + sum(min(x, 0) for x in q) * spread
            unit.append(1 << (shift + cut))
            base.append(low - (int(weights.below[k]) << (shift + cut)))
            slack.append(lost + sum(map(abs, q)) * spread)
        wanted, k = np.ones(len(who), bool), best[begin].top + 1
        while wanted.any():
            kth = kth_largest(sums, there, k)
            bounds = np.zeros(len(who), np.int64)
            for j in np.flatnonzero(wanted).tolist():
                bound, worst = int(kth[j]) - slack[j] // unit[j], best[who[j]].worst()
                if worst is not None:
                    bound = max(bound, -((base[j] + slack[j] - worst) // unit[j]))
                bounds[j] = min(max(bound, 0), 1 << 62)
            near = at_least(sums, there, bounds)
            for j in np.flatnonzero(wanted).tolist():
                at = np.flatnonzero(np.unpackbits(near[j].view(np.uint8), count=rows, bitorder="little"))
                at = at[ids[at] != own[who[j]]]
                resolved += len(at)
                if len(at):
                    best[who[j]].offer(_products(values[at], weights.values[who[j]], weights.largest[who[j]]), ids[at])
                # Rows left out score less than the k-th sum at least gives; they matter only if fewer than top do better.
                worst = best[who[j]].worst()
                wanted[j] = k < rows and (worst is None or worst < base[j] + unit[j] * int(kth[j]))
            k *= 4
    return resolved


def _beyond(score: int) -> bytes:
    """Orders, as bytes, scores that a long can't hold, among those of its sign; nothing for others."""
    if -LONG - 1 <= score <= LONG:
        return b""
    digits = abs(score).to_bytes((score.bit_length() + 7) // 8 + 1, "big")
    told = len(digits).to_bytes(4, "big") + digits
    return told if score > 0 else bytes(255 - b for b in told)


def _searched(index: DataFrame, queries: list, scale: int, top: int) -> DataFrame:
    """``query, query_id, vec_id, score, beyond``: each task's best rows of each query (number, id, vector)."""
    groups = []
    for dims in sorted({len(q["vector"]) for q in queries}):
        mine = [q for q in queries if len(q["vector"]) == dims]
        values = np.floor(scale * np.array([q["vector"] for q in mine], np.float64)).reshape(len(mine), dims)
        for at, v in parts(values):
            groups.append((dims, [mine[i]["query"] for i in at.tolist()], np.array([mine[i]["query_id"] for i in at.tolist()], np.int64), v))
    sent = index.sparkSession.sparkContext.broadcast(groups)

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(dims, numbers, own, Weights(v), [Best(top) for _ in numbers]) for dims, numbers, own, v in sent.value]
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                if row["large"]:
                    values = np.array([int(x) for x in row["large"]], object).reshape(len(ids), row["dims"])
                else:
                    values = np.frombuffer(row["numbers"], "<i4").reshape(len(ids), row["dims"]).astype(np.float64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], SLICES, -(-len(ids) // 64))
                for dims, _, own, weights, best in held:
                    if dims == row["dims"]:
                        scan(weights, own, best, ids, values, [int(x) for x in row["least"]], row["shift"], slices)
        out: list[tuple] = []
        for _, numbers, own, _, best in held:
            for number, name, b in zip(numbers, own.tolist(), best):
                out += [(number, name, i, min(max(int(s), -LONG - 1), LONG), _beyond(int(s))) for s, i in zip(b.scores.tolist(), b.ids.tolist())]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 10_000]), kinds)], ["query", "query_id", "vec_id", "score", "beyond"])

    return index.mapInArrow(searched, "query long, query_id long, vec_id long, score long, beyond binary")


def best(table: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The ``top`` rows of largest inner product for each row that ``queries`` (of the id column) names: query_id, rank,
    vec_id, score; ties go to smaller ids.

    Rows with a null id, or a vector that is null or holds null or non-finite components (also if they are so
    ``scale``-fold), take no part; vectors of different lengths aren't compared, those of zeros are. Rows that bear the
    query's id are its own. A repeated id counts once for each distinct score; a query id with several distinct vectors
    is several queries. Scores are compared exactly; one beyond a long is given as the largest or smallest long. An
    empty table, or one without queries, gives an empty result. Other columns don't matter.
    """
    with scratch():
        rows = vectors(table, vec_id, vector, scale).filter("vec_id is not null")
        asks = vectors(table.filter(queries), vec_id, vector, scale).filter("vec_id is not null").distinct()
        asked = written(asks.select(F.col("vec_id").alias("query_id"), "vector", F.xxhash64("vec_id", "vector").alias("query")), "slice-queries")
        size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("components")).first()
        groups = max(1, -(-size["n"] // GROUP), -(-size["components"] // SENT))
        cores = table.sparkSession.sparkContext.defaultParallelism
        index = written(indexed(rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows, scale, block), "slice-index")
        found = None
        for g in range(groups):
            # Hashes deal queries out: a group has about 1/groups of at most GROUP * groups queries.
            mine = asked.filter(F.pmod(F.xxhash64("query", F.lit(1)), F.lit(groups)) == g).collect()
            part = written(_searched(index, mine, scale, top), "slice-found")
            found = part if found is None else found.unionByName(part)
        first = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
        once = found.distinct().withColumn("rank", first).filter(F.col("rank") <= top)
        return written(once.select("query_id", "rank", "vec_id", "score"), "slice-best", lasting=True)
