"""Near copies by word shingles: SimHash in BK-trees finds them, exact Jaccard similarity decides.

Two bits of 64 catch only the nearest copies, and a radius wide enough for a similarity of 0.8 leaves a BK-tree over all
fingerprints nothing to prune. So the trees are smaller shards: a document enters one for each band of its min-hash
signature, and two documents of the wanted similarity share a band all but surely (``1 - (1 - 0.8**4)**16`` = 0.9998).

Two steps follow, and both only ask what is connected with what.

1. In each shard, documents within the radius whose signatures may belong to similar texts are connected. Both bounds lie
   four standard errors beyond the wanted similarity. The families found this way hold every wanted link.
2. Each family's shingle sets meet in one task, once, and are compared exactly there. Only verified links merge.

In either step, documents that are connected already needn't be compared with each other, so only those outside the
group's largest class are looked up: a large group of copies costs one comparison each. A group too large for a task is
dealt into parts that all hold the group's first document; then every document outside the largest class visits every
part. No pair is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, map_column, scratch, utf8, written
from lectern.llm.simhash import TREE, components, forest, links, merged, shingle_hashes, simhash

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Bits within which fingerprints may belong to similar texts: texts of similarity 0.8 differ in 10 to 12, give or take 3.
RADIUS = 24
#: How far below the wanted similarity the signature's estimate may lie (its standard error is 0.05).
SLACK = 0.2
#: Shingles of a family that one task compares; larger families are dealt into parts.
FAMILY = 4_000_000
#: Pairs of signatures compared at a time.
COMPARED = 1 << 17

_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

#: What looks for links in one task: rows' groups (ascending), ids, labels (what is connected already) and two more
#: columns -> for each row the position of the first row that it is connected with.
Search = Callable[[np.ndarray, np.ndarray, list[pa.Array]], np.ndarray]


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The set of shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, width))


def signature(found: np.ndarray) -> np.ndarray:
    """The least value of the set under each of BANDS * ROWS hash functions."""
    out = np.full(len(_FACTORS), np.uint64(2**64 - 1))
    for at in range(0, len(found), 1024):
        x = (found[at : at + 1024, None] ^ _SALTS) * _FACTORS
        x ^= x >> np.uint64(32)
        out = np.minimum(out, (x * _FACTORS).min(axis=0))
    return out


def packed(found: np.ndarray) -> bytes:
    """The set by the high 32 bits of its hashes: the bytes of ascending hashes' differences in four planes.

    The plane of the highest bytes is nearly all 0, so that tables and shuffles compress it away.
    """
    high = np.unique((found >> np.uint64(32)).astype("<u4"))
    return np.ascontiguousarray(np.diff(high, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def sketches(keyed: DataFrame, text: str, key: list[str], width: int) -> DataFrame:
    """``key``, fingerprint ``fp``, ``bands``, the low bytes of the signature, and the packed shingle ``set`` of each row."""

    def make() -> Callable[[list], dict[str, pa.Array]]:
        def work(texts: list) -> dict[str, pa.Array]:
            number: dict[bytes, int] = {}
            of = [number.setdefault(t, len(number)) for t in texts]  # texts that repeat here are sketched once
            sets = [shingles(t, width) for t in number]
            signed = np.stack([signature(s) for s in sets])
            rows = signed.reshape(-1, BANDS, ROWS)
            bands = rows[:, :, 0].copy()
            for k in range(1, ROWS):
                bands = (bands ^ (bands >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + rows[:, :, k]
            bands = (bands * np.uint64(2 * BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            low, held = (signed >> np.uint64(40)).astype(np.uint8), [packed(s) for s in sets]
            return {
                "fp": pa.array(np.array([simhash(s) for s in sets], np.uint64).view(np.int64)[of]),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(of) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands[of].ravel())),
                "low": pa.array([low[k].tobytes() for k in of], pa.binary()),
                "set": pa.array([held[k] for k in of], pa.binary()),
            }

        return work

    return map_column(keyed, utf8(text), "fp long, bands array<long>, low binary, `set` binary", make, key)


def outside(group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which positions lie outside the largest class (``label``) of their group."""
    size = np.bincount(label, minlength=len(label))[label]
    order = np.lexsort((label, -size, group))
    first = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    largest = label[order[first]]
    return label != np.repeat(largest, np.diff(np.append(first, len(group))))


def maybe_similar(radius: int, least: float) -> Search:
    """Connects documents (fingerprint, low bytes of the signature) that may be similar, by one BK-tree for each group."""

    def search(group: np.ndarray, label: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
        fps = columns[0].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        low = np.frombuffer(b"".join(columns[1].to_pylist()), np.uint8).reshape(len(fps), -1)

        def connect(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            for at in range(0, len(a), COMPARED):
                x, y = a[at : at + COMPARED], b[at : at + COMPARED]
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                if len(x):
                    similar = (low[x] == low[y]).mean(axis=1) >= least
                    label = merged(label, x[similar], y[similar])

        # Equal fingerprints share a node; most of its documents are connected with its first, and it stands for them.
        order = np.lexsort((np.arange(len(fps)), fps, group))
        g, f = group[order], fps[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (f[1:] != f[:-1])])
        node = np.cumsum(new) - 1
        heads = order[new]
        connect(order, heads[node])
        connect(np.arange(len(fps)), np.searchsorted(group, group))  # all with the first of their group
        stands = new | (label[order] != label[heads[node]])
        standing, of_node = order[stands], node[stands]
        begins = np.searchsorted(of_node, np.arange(len(heads) + 1))
        asked = np.flatnonzero(outside(group, label)[standing])
        if not len(asked):
            return label
        asked_node = of_node[asked]
        root, key, child = forest(fps[heads], group[heads])
        # Each node that is asked for, against the nodes within the radius and itself.
        nodes = np.unique(asked_node)
        for a, b in [*links(fps[heads], root, key, child, radius, nodes), (nodes, nodes)]:
            for at in range(0, len(a), COMPARED):
                x, y = a[at : at + COMPARED], b[at : at + COMPARED]
                many_x, many_y = begins[x + 1] - begins[x], begins[y + 1] - begins[y]
                if (many_x * many_y == 1).all():
                    connect(standing[begins[x]], standing[begins[y]])
                    continue
                for n, m in zip(x.tolist(), y.tolist()):  # unlike texts with one fingerprint
                    other = standing[begins[m] : begins[m + 1]]
                    for one in standing[begins[n] : begins[n + 1]]:
                        connect(np.full(len(other), one), other)
        return label

    return search


def similar(least: float) -> Search:
    """Connects documents whose shingle sets have the wanted similarity, exactly, by an index of each group's shingles."""

    def one(label: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        n, sizes = len(sets), np.array([len(s) for s in sets])
        empty = np.flatnonzero(sizes == 0)
        label = merged(label, empty[1:], np.full(max(0, len(empty) - 1), empty[0] if len(empty) else 0))
        _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)[np.argsort(which, kind="stable")]
        starts, begins = np.cumsum(times) - times, np.cumsum(sizes) - sizes
        asked = np.zeros(n, bool)
        while True:
            counts = np.bincount(label, minlength=n)
            left = np.flatnonzero(~asked & (label != counts.argmax()))
            if not len(left):
                return label
            k = left[0]
            asked[k] = True
            mine = which[begins[k] : begins[k] + sizes[k]]
            ends = np.cumsum(times[mine])
            at = np.repeat(starts[mine] - (ends - times[mine]), times[mine]) + np.arange(ends[-1] if len(ends) else 0)
            both = np.bincount(owner[at], minlength=n)
            near = np.flatnonzero(both / np.maximum(sizes + sizes[k] - both, 1) >= least)
            label = merged(label, near, np.full(len(near), k))

    def search(group: np.ndarray, label: np.ndarray, columns: list[pa.Array]) -> np.ndarray:
        out = label.copy()
        for a, b in zip(*_ranges(group)):
            if b - a > 1:
                sets = [unpacked(x) for x in columns[0].slice(a, b - a).to_pylist()]
                out[a:b] = one(label[a:b] - a, sets) + a
        return out

    return search


def _ranges(group: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist()
    return cuts, [*cuts[1:], len(group)]


def _first_labels(group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row the position of the first row of its group that bears the same label."""
    order = np.lexsort((np.arange(len(group)), label, group))
    new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])])
    out = np.empty(len(group), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _searched(dealt: DataFrame, attributes: DataFrame, search: Search, held: int) -> DataFrame:
    """Links (a, b) found in each ``group`` and ``part`` of ``dealt`` (with ``id, label, weight``); a task takes groups whole."""
    names = [c for c in attributes.columns if c != "id"]
    rows = dealt.join(attributes, "id").repartition("group", "part").sortWithinPartitions("group", "part", "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        many = 0

        def found(table: pa.Table) -> pa.RecordBatch:
            first, part, ids, label = (table.column(k).to_numpy() for k in range(4))
            group = np.cumsum(np.concatenate([[False], (first[1:] != first[:-1]) | (part[1:] != part[:-1])]))
            root = search(group, _first_labels(group, label), [table.column(k).combine_chunks() for k in range(5, table.num_columns)])
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            many += sum(batch.column(4).to_pylist())
            if many < held:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            group, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            differ = np.flatnonzero((group != group[-1]) | (part != part[-1]))
            cut = int(differ[-1]) + 1 if len(differ) else 0  # the last group may go on
            if cut:
                yield found(table.slice(0, cut))
                kept = table.slice(cut).to_batches()
                many = sum(table.column(4).slice(cut).to_pylist())
        if kept:
            yield found(pa.Table.from_batches(kept).combine_chunks())

    return rows.select("group", "part", "id", "label", "weight", *names).mapInArrow(run, "a long, b long")


def linked(members: DataFrame, attributes: DataFrame, search: Search, most: int, name: str) -> DataFrame:
    """Links (a, b) that connect what ``search`` connects in each group of ``members`` (``group, id, weight``).

    A group over ``most`` in weight is dealt into parts by a hash of the ids, each with the group's smallest id. Parts
    are searched alone at first; then every id outside the group's largest class so far visits all parts.
    """
    sizes = members.groupBy("group").agg(F.min("id").alias("head"), F.max("id").alias("tail"), F.sum("weight").alias("all")).filter("head < tail")
    parts = F.when(F.col("all") <= most, 1).otherwise(F.ceil(2 * F.col("all") / most)).cast("int")
    sizes = written(sizes.select("group", "head", parts.alias("parts")), f"{name}-groups")
    shared = members.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = shared.select("group", "id", F.col("id").alias("label"), "weight", F.explode(F.when(F.col("id") == F.col("head"), everywhere).otherwise(F.array("own"))).alias("part"))
    first = written(_searched(dealt, attributes, search, most).distinct(), f"{name}-links")
    if sizes.filter("parts > 1").isEmpty():
        return first
    stars = components(first, f"{name}-stars")
    large = shared.filter("parts > 1").join(stars, F.col("id") == F.col("node"), "left").select("group", "id", "weight", "parts", "own", F.coalesce("root", "id").alias("label"))
    large = written(large, f"{name}-large")
    classes = large.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    visits = F.explode(F.when(F.col("label") == F.col("largest"), F.array("own")).otherwise(everywhere)).alias("part")
    second = _searched(large.join(classes, "group").select("group", "id", "label", "weight", visits), attributes, search, most)
    return written(first.union(second).distinct(), f"{name}-links")


def copies(sketched: DataFrame, least: float = SIMILARITY, radius: int = RADIUS, tree: int = TREE, family: int = FAMILY) -> DataFrame:
    """``node, root`` of every text but the first in each group of near copies; ``sketched`` holds ``id`` and the sketches."""
    bands = sketched.select(F.explode("bands").alias("group"), "id").withColumn("weight", F.lit(1))
    maybe = components(linked(bands, sketched.select("id", "fp", "low"), maybe_similar(radius, least - SLACK), tree, "copies-maybe"), "copies-families")
    both = maybe.select(F.col("root").alias("group"), F.col("node").alias("id")).union(maybe.select("root", "root").distinct())
    weights = sketched.select("id", (F.octet_length("set") / 4 + 64).cast("int").alias("weight"))
    families = written(both.join(weights, "id").select("group", "id", "weight"), "copies-members")
    return components(linked(families, sketched.select("id", "set"), similar(least), family, "copies-exact"), "copies-groups")


def text_key(text: Column) -> Column:
    """128 bits that know a text."""
    return F.unhex(F.md5(text))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that know a row's id and text."""
    name = F.coalesce(F.concat(F.lit("id "), doc_id.cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(name, F.lit("\n"), text)))


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, least: float = SIMILARITY, tree: int = TREE, family: int = FAMILY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id (nulls last).

    Texts equal to the last character are one class from the start (by a 128-bit hash), sketched by one of its rows;
    texts themselves are read where they lie and only move to the result. Texts of no words are copies of each other; with
    fewer words than ``width``, the whole sequence is the one shingle. Null texts are empty. An empty table gives an
    empty result; all columns stay as they are.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    with scratch():
        rows = docs.select(F.col(doc_id).alias("doc"), body.alias("t")).select("doc", "t", row_key(F.col("doc"), F.col("t")).alias("key"), text_key(F.col("t")).alias("of_text"), F.monotonically_increasing_id().alias("id"))
        rows = written(sketches(rows, "t", ["doc", "key", "of_text", "id"], width), "copies-rows")
        order = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "key", "id")
        classes = written(rows.groupBy("of_text").agg(F.min(order).alias("first")).select("first.*"), "copies-classes")
        sketched = rows.select("id", "fp", "bands", "low", "set").join(classes.select("id"), "id", "left_semi")
        groups = copies(sketched, least, tree=tree, family=family)
        rooted = classes.join(groups, classes["id"] == groups["node"], "left").select("unknown", "doc", "key", F.coalesce("root", "id").alias("root"))
        kept = rooted.groupBy("root").agg(F.min(F.struct("unknown", "doc", "key")).alias("first")).select(F.col("first.key").alias("kept"))
        of_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(kept, F.col("key") == F.col("kept"), "left_semi")
        of_key = written(of_key, "copies-kept", lasting=True)
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key(F.col(doc_id), body))
    out = keyed.join(of_key.filter("n = 1").select(F.col("key").alias(key)), key, "left_semi")
    if not of_key.filter("n > 1").isEmpty():  # rows that repeat in id and text
        out = out.unionByName(keyed.join(of_key.filter("n > 1").select(F.col("key").alias(key)), key, "left_semi").dropDuplicates([key]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
