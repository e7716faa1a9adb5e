"""Near-duplicate groups by SimHash fingerprints and BK-trees.

A BK-tree keeps fingerprints so that a child's key is its integer Hamming distance to the parent; a search within a
radius follows only edges whose key lies within the radius of the distance just measured. The trees are shards: one
for each set of fingerprints that agree on two blocks of bits. Fingerprints within the radius must agree on two of
``radius + 2`` blocks, so searching every shard a fingerprint belongs to finds all its links. Shards are built and
searched in the tasks that hold them, since a broadcast from the driver would need all fingerprints there; a shard too
large for a task is dealt again by two blocks of its remaining bits, which bounds it by the bits then left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discarded, free_name, map_column, utf8, written

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in one tree at most; larger shards are dealt again.
TREE = 1 << 16
#: Pairs of searched fingerprint and visited node held at a time.
FRONTIER = 2_000_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased text, repeats included.

    With fewer words than that, the whole sequence is the one shingle; without words there is none.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: lower() changes A-Z alone, split() cuts at space and U+0009 to U+000D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    pairs = zip(starts[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist())
    return np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], np.uint64, len(words) - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned 64-bit integer; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE, out: str = "fingerprint_bits", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with each whole text's fingerprint as a (signed) long. One pass, no shuffle."""

    def make() -> Callable[[list], dict[str, pa.Array]]:
        return lambda texts: {out: pa.array(np.array([simhash(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64))}

    return map_column(docs, utf8(text), f"`{out}` long", make, keep)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def forest(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each group: the root of each value, and the edges by ``parent * 128 + distance`` with the child.

    ``group`` ascends; values differ within a group. All trees grow at once: each round, every value not yet placed
    goes one edge down, and the first to need an edge that isn't there becomes that child.
    """
    n = len(values)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    root = np.repeat(begins, np.diff(np.append(begins, n)))
    left = np.setdiff1d(np.arange(n), begins, assume_unique=True)
    at = root[left]
    keys, children = [], []
    while len(left):
        edge = at * 128 + distance(values[left], values[at])
        found, first, which = np.unique(edge, return_index=True, return_inverse=True)
        keys.append(found)
        children.append(left[first])
        at = left[first][which]
        rest = np.ones(len(left), bool)
        rest[first] = False
        left, at = left[rest], at[rest]
    if not keys:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return root, key[order], child[order]


def links(values: np.ndarray, root: np.ndarray, key: np.ndarray, child: np.ndarray, radius: int, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within the radius in the same tree, each searched value against the nodes its search visits.

    Without ``asked`` all positions are searched and a pair is given once; otherwise those alone, against all others.
    """
    step = max(1, FRONTIER // 64)
    searched = np.arange(len(values)) if asked is None else asked
    for begin in range(0, len(searched), step):
        some = searched[begin : begin + step]
        stack = [(some, root[some])]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = distance(values[query], values[node])
            near = (d <= radius) & (query > node if asked is None else query != node)
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(key, node * 128 + np.maximum(d - radius, 0))
            high = np.searchsorted(key, node * 128 + d + radius, side="right")
            many = high - low
            total = int(many.sum())
            if total:
                ends = np.cumsum(many)
                stack.append((np.repeat(query, many), child[np.repeat(low - (ends - many), many) + np.arange(total)]))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest position that each is connected with) after the pairs (a, b) are connected too."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            next_label = label[label]
            if (next_label == label).all():
                break
            label = next_label
    return label


def joined(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of ``n`` positions is connected with."""
    label = np.arange(n)
    for a, b in pairs:
        label = merged(label, a, b)
    return label


def _block_keys(bits: Column, offset: int, width: int, blocks: int) -> list[Column]:
    """For ``width`` bits from ``offset``, cut into blocks: each pair of blocks with its number."""
    cuts = [offset + width * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(bits, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(blocks)]
    return [F.struct(F.lit(k).alias("k"), F.shiftleft(part[a], 32).bitwiseOR(part[b]).alias("v")) for k, (a, b) in enumerate(combinations(range(blocks), 2))]


def _searched(keyed: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """Links (fp, root) within each group of equal ``columns``; a task takes many groups, a whole group at a time."""
    schema = "fp long, root long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            change = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
            group, values = np.cumsum(change), rows[:, -1].view(np.uint64)
            shared = np.bincount(group)[group] > 1
            group, values = group[shared], values[shared]
            root, key, child = forest(values, group)
            label = joined(len(values), links(values, root, key, child, radius))
            moved = np.flatnonzero(label != np.arange(len(values)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[label[moved]].view(np.int64))], ["fp", "root"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if sum(map(len, held)) < TREE or (rows[0, :-1] == rows[-1, :-1]).all():
                continue
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[:, :-1] != rows[-1, :-1]).any(axis=1))[-1] + 1  # the last group may go on
            yield from search(rows[:cut])
            held = [rows[cut:]]
        if held:
            yield from search(np.concatenate(held))

    dealt = keyed.repartition(*columns).sortWithinPartitions(*columns, "fp")
    return dealt.select(*[F.col(c).cast("long") for c in columns], "fp").mapInArrow(run, schema)


def hamming_links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """For distinct fingerprints ``fp``: links (fp, root) that connect all those within ``radius`` bits of each other."""
    blocks = radius + 2
    first = fps.select("fp", F.explode(F.array(*_block_keys(F.col("fp"), 0, 64, blocks))).alias("key")).select(F.col("key.k").alias("k"), F.col("key.v").alias("v"), "fp")
    large = written(first.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree).select("k", "v"), "simhash-large")
    if large.isEmpty():
        return _searched(first, ["k", "v"], radius)
    small = first.join(large, ["k", "v"], "left_anti")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    finer = None
    for k, (a, b) in enumerate(combinations(range(blocks), 2)):
        rest = [(cuts[c], cuts[c + 1] - cuts[c]) for c in range(blocks) if c not in (a, b)]
        packed, used = F.lit(0).cast("long"), 0
        for offset, width in rest:
            packed = packed.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), offset).bitwiseAND(F.lit((1 << width) - 1)), used))
            used += width
        keys = F.array(*_block_keys(packed, 0, used, blocks))
        part = first.filter(F.col("k") == k).join(large.filter(F.col("k") == k), ["k", "v"], "left_semi")
        part = part.select("k", "v", F.explode(keys).alias("key"), "fp").select("k", "v", F.col("key.k").alias("k2"), F.col("key.v").alias("v2"), "fp")
        finer = part if finer is None else finer.unionByName(part)
    return _searched(small, ["k", "v"], radius).unionByName(_searched(finer, ["k", "v", "k2", "v2"], radius))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of links (a, b): every node but the smallest of each component, with that smallest one.

    Alternating large and small stars (Kiveris et al., 2014): each round points neighbours to the smallest one, and
    the number of rounds grows with the logarithm of the longest path. Rounds are written, so their lineage is short.
    """
    ends = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    e = written(edges.select(*ends(F.col(edges.columns[0]), F.col(edges.columns[1]))).filter("a <> b").distinct(), name)
    before = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["hub"]).filter(F.col("b") > F.col("a")).select(*ends(F.col("b"), F.col("m"))).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), "m")
        small = large.join(least, large["a"] == least["hub"]).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(*ends(F.col("b"), F.col("m"))), F.struct(*ends(F.col("a"), F.col("m"))))).alias("e")).select("e.*")
        old, e = e, written(small.filter("a <> b").distinct(), name)
        discarded(old)


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """``docs``'s ids with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Fingerprints that differ in at most ``radius`` bits link. Null and wordless texts have fingerprint 0, linked like
    any other; a null id takes part and gets its component's id (null if no id is known there); repeated rows stay.
    An empty table gives an empty result. Only ids and fingerprints are shuffled.
    """
    ids = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width, out="fp", keep=["doc_id"]), "simhash-fingerprints")
    distinct = written(ids.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    stars = components(hamming_links(distinct.select("fp"), radius, tree), "simhash-stars")
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = rooted.join(named, "root").select(F.col("fp").alias("of_fp"), "component_id")
    out = ids.join(of, ids["fp"] == of["of_fp"])
    return out.select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["components", "fingerprints", "free_name", "grouped", "hamming_links"]
