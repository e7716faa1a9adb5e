"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to unit length, so that the largest cosine is the smallest Euclidean distance. Coarse centroids cut
the vectors into lists, about as many as the root of the number of vectors; a vector's residual to its list's centroid
is coded by the nearest of 256 codewords in each of its subspaces. A query visits its nearest lists: as many as it took
to hold the wanted share of nearest neighbours in the sample that the index was fitted on. Tables of its products with
all codewords give each code's approximate distance by lookups alone (asymmetric distances), and RERANKED candidates,
the best over all its lists, are compared exactly.

Only codes travel to queries. Lists lie in an order in which near ones tend to follow each other; runs of them with at
most SHARD members form shards (a longer list is split), queries whose nearest lists follow each other form blocks, and
a task compares one block with one shard. Vectors move once when equal ones are found, and again for candidates alone.

Vectors that are equal to the last bit form one class, indexed once with its smallest ids: no query's result can hold
more than ``top`` members of a class, since ties go to smaller ids. That keeps a very frequent vector from loading one
list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

TOP = 5
#: Lists at most, and vectors for each list that the index is fitted on: those with the smallest hashes of their ids.
LISTS, SAMPLED = 1024, 32
#: Subspaces at most, codewords of each, and residuals that codewords are fitted on at most.
SUBSPACES, CODES, CODED = 32, 256, 4096
#: Share of nearest neighbours that the visited lists hold, in the sample; candidates that a query compares exactly.
RECALL, RERANKED = 0.98, 64
#: Members in a shard of lists, and queries in a block.
SHARD, BLOCK = 16_384, 1024
ROUNDS = 12


class Index(NamedTuple):
    """What is broadcast (at most LISTS centroids and SUBSPACES times CODES codewords): lists lie in order."""

    centroids: np.ndarray
    codewords: np.ndarray  # subspace, code, dimension
    visits: int  # lists that a query visits


def _squares(centroids: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances (point, centroid), less each point's own square."""
    return (centroids**2).sum(axis=1) - 2 * points @ centroids.T


def kmeans(points: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids; an empty one moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        d = _squares(centroids, points)
        nearest = d.argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        counts = np.bincount(nearest, minlength=k)
        full = counts > 0
        centroids[full] = np.add.reduceat(points[order], (np.cumsum(counts) - counts)[full], axis=0) / counts[full, None]
        if not full.all():
            far = np.argsort(d[np.arange(len(points)), nearest] + (points**2).sum(axis=1))[::-1]
            centroids[~full] = points[far[: int((~full).sum())]]
    return centroids


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def subspaces(dims: int) -> int:
    """The number of subspaces: SUBSPACES, or the largest divisor of the dimensions below it."""
    return max(m for m in range(1, SUBSPACES + 1) if dims % m == 0)


def lists_for(vectors: int) -> int:
    return max(1, min(LISTS, int(vectors**0.5)))


def fit(sample: np.ndarray, lists: int, top: int = TOP, recall: float = RECALL) -> Index:
    """An index of unit vectors (at least one)."""
    centroids = kmeans(sample, min(lists, len(sample)))
    middle = centroids - centroids.mean(axis=0)
    centroids = centroids[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]
    d = _squares(centroids, sample)
    nearest = d.argmin(axis=1)
    m, some = subspaces(sample.shape[1]), slice(0, CODED)
    residuals = (sample - centroids[nearest])[some].reshape(-1, m, sample.shape[1] // m)
    codewords = np.stack([kmeans(residuals[:, j], min(CODES, len(residuals)), j + 1) for j in range(m)])
    # The place, in the order of each query's lists, of the lists that hold its nearest neighbours.
    asked = np.arange(min(256, len(sample)))
    likeness = sample[asked] @ sample.T
    likeness[asked, asked] = -np.inf
    wanted = np.argsort(-likeness, axis=1)[:, : min(top, len(sample) - 1)]
    place = d[asked].argsort(axis=1).argsort(axis=1)
    places = np.sort(np.take_along_axis(place, nearest[wanted], axis=1).ravel())
    visits = int(places[int(np.ceil(recall * len(places))) - 1]) + 1 if len(places) else 1
    return Index(centroids, codewords, visits)


def encode(index: Index, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """The codes of unit vectors' residuals, a byte for each subspace."""
    m = len(index.codewords)
    residuals = (vectors - index.centroids[lists]).reshape(len(vectors), m, -1)
    return np.stack([_squares(index.codewords[j], residuals[:, j]).argmin(axis=1) for j in range(m)], axis=1).astype(np.uint8)


def approximate(index: Index, asked: np.ndarray, lists: np.ndarray, codes: np.ndarray, visited: np.ndarray) -> np.ndarray:
    """Approximate squared distances (query, member), infinite where a query doesn't visit the member's list.

    With q the query, c the centroid and w the codewords of a member, |q - c - w|^2 is |q - c|^2 plus |w|^2 + 2 c.w,
    which is the member's own, less 2 q.w, which tables of q with all codewords give by lookup. ``lists`` ascends;
    ``visited`` says (query, list) who goes where.
    """
    m = len(index.codewords)
    q = asked.reshape(len(asked), m, -1)
    tables = np.stack([-2 * q[:, j] @ index.codewords[j].T for j in range(m)], axis=1).astype(np.float32)
    squares, own = (index.codewords**2).sum(axis=2), index.centroids.reshape(len(index.centroids), m, -1)
    apart = (_squares(index.centroids, asked) + 1).astype(np.float32)
    out = np.full((len(asked), len(lists)), np.inf, np.float32)
    begins = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(lists)]):
        who = np.flatnonzero(visited[:, lists[a]])
        if not len(who):
            continue
        d = np.repeat(apart[who, lists[a]][:, None], b - a, axis=1)
        mine = np.zeros(b - a)
        for j in range(m):
            code = codes[a:b, j]
            d += np.take(tables[who, j], code, axis=1)
            mine += (squares[j] + 2 * index.codewords[j] @ own[lists[a], j])[code]
        out[who, a:b] = d + mine.astype(np.float32)
    return out


def valid(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def classes(rows: DataFrame, top: int) -> DataFrame:
    """``class, ids, h, g``: the ``top`` + 1 smallest ids of each distinct vector (known by its hashes h and g).

    Only ids and hashes are shuffled, and of a frequent vector each task passes on its few smallest ids.
    """
    first = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    few = rows.select("h", "g", "vec_id").distinct().withColumn("rank", first).filter(F.col("rank") <= top + 1)
    few = few.groupBy("h", "g").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return few.select(F.element_at("ids", 1).alias("class"), "ids", "h", "g")


def _runs(sizes: np.ndarray, most: int) -> np.ndarray:
    """For each list in order the run it belongs to; runs hold at most ``most`` in all, or a single list."""
    out, run, held = np.zeros(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            run, held = run + 1, 0
        out[k], held = run, held + n
    return out


def nearest(table: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", top: int = TOP, recall: float = RECALL) -> DataFrame:
    """The ``top`` nearest rows found for each row that ``queries`` (of the id column) names: query_id, rank, vec_id, score.

    Rows with a null id, or a vector that is null, zero, holds null or non-finite components or has other dimensions
    than most, take no part. A repeated id counts once for each distinct vector. Fewer candidates than ``top`` are all
    found: a query visits further lists until it has met as many vectors as it compares exactly. An empty table, or one without queries,
    gives an empty result. Other columns don't matter.
    """
    spark, budget = table.sparkSession, max(RERANKED, top + 1)
    kind = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"), queries.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    dims = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == dims["dims"]).withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), F.reverse("vector"))})
    known = written(classes(rows, top), "ann-classes")
    same = ["vec_id", "h", "g"]
    distinct = rows.select(*same, "vector").join(known.select(F.col("class").alias("vec_id"), "h", "g"), same, "left_semi").dropDuplicates(same)
    distinct = written(distinct.select(F.col("vec_id").alias("class"), "vector"), "ann-vectors")
    lists = lists_for(distinct.count())
    few = distinct.orderBy(F.xxhash64("class"), "class").limit(SAMPLED * lists).select("vector").toPandas()["vector"]
    index = spark.sparkContext.broadcast(fit(unit(np.stack(few.to_list()).astype(np.float64)), lists, top, recall))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for batch in batches:
            if batch.num_rows:
                v = unit(_matrix(batch.column(1)))
                nearest_list = _squares(at.centroids, v).argmin(axis=1)
                codes = encode(at, v, nearest_list)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest_list.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["class", "list", "code"])

    inverted = written(distinct.select("class", "vector").mapInArrow(listed, "class long, list int, code binary"), "ann-lists")
    asked = rows.filter("asks").select("vec_id", "h", "g").distinct().join(known.select("class", "h", "g"), ["h", "g"]).select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    asked = written(asked, "ann-asked")
    query_vectors = distinct.join(asked.select(F.col("query").alias("class")).distinct(), "class", "left_semi")
    placed = inverted.join(asked.select(F.col("query").alias("class")).distinct(), "class", "left_semi")

    # Shards of lists, and blocks of the queries that lie in them, from two counts for each list.
    number = lambda counted: np.bincount([r["list"] for r in counted], [r["count"] for r in counted], len(index.value.centroids)).astype(np.int64)
    members, asking = (number(df.groupBy("list").count().collect()) for df in (inverted, placed))
    split = np.maximum(1, -(-members // SHARD))  # shards of a list
    run = _runs(members, SHARD)
    alone = split > 1
    shard = np.cumsum(np.concatenate([[0], np.where(alone[:-1] | (run[1:] != run[:-1]), split[:-1], 0)]))
    block_split = np.maximum(1, -(-asking // BLOCK))
    block_run = _runs(asking, BLOCK)
    block = np.cumsum(np.concatenate([[0], np.where((block_split[:-1] > 1) | (block_run[1:] != block_run[:-1]), block_split[:-1], 0)]))
    plan = spark.createDataFrame([(k, int(shard[k]), int(split[k])) for k in range(len(members))], "list int, shard long, split long")
    sent = spark.sparkContext.broadcast((members, shard, split, block, block_split))

    def probes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, (many, first, parts, of_block, block_parts) = index.value, sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = _squares(at.centroids, unit(_matrix(batch.column(1)))).argsort(axis=1)
            enough = np.maximum(at.visits, (np.cumsum(many[order], axis=1) < budget).sum(axis=1) + 1)
            query, shards, chosen, blocks = [], [], [], []
            for k, (name, o, n) in enumerate(zip(batch.column(0).to_pylist(), order, enough)):
                visited = np.sort(o[:n][many[o[:n]] > 0])
                own = int(of_block[o[0]] + name % block_parts[o[0]])
                for s in np.unique(first[visited]).tolist():
                    here = visited[first[visited] == s].tolist()
                    for part in range(int(parts[here[0]])):
                        query.append(k)
                        shards.append(s + part)
                        chosen.append(here)
                        blocks.append(own)
            of = pa.array(query, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(shards, pa.int64()), pa.array(blocks, pa.int64()), pa.array(chosen, pa.list_(pa.int32()))], ["query", "asked", "shard", "block", "lists"])

    visits = written(query_vectors.select("class", "vector").mapInArrow(probes, f"query long, asked {kind}, shard long, block long, lists array<int>"), "ann-visits")
    held = inverted.join(F.broadcast(plan), "list").withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("class"), F.col("split")))
    cells = visits.select(F.col("shard").alias("of"), F.col("block").alias("with")).distinct()
    held = held.join(cells, F.col("shard") == F.col("of")).select("class", "list", "code", F.col("of").alias("shard"), F.col("with").alias("block"))

    def search(key: tuple, queries, members):
        import pandas as pd

        if not len(queries) or not len(members):
            return pd.DataFrame({"query": [], "class": [], "distance": []}).astype({"query": "int64", "class": "int64", "distance": "float64"})
        at, members = index.value, members.sort_values(["list", "class"])
        codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
        visited = np.zeros((len(queries), len(at.centroids)), bool)
        for k, chosen in enumerate(queries["lists"]):
            visited[k, chosen] = True
        d = approximate(at, unit(np.stack(queries["asked"].to_list()).astype(np.float64)), members["list"].to_numpy(), codes, visited)
        n = min(budget, d.shape[1])
        best = np.argpartition(d, n - 1, axis=1)[:, :n]
        distance = np.take_along_axis(d, best, axis=1).ravel()
        found = np.isfinite(distance)
        return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), n)[found], "class": members["class"].to_numpy()[best.ravel()[found]], "distance": distance[found].astype(np.float64)})

    near = visits.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInPandas(search, "query long, class long, distance double")
    first = F.row_number().over(Window.partitionBy("query").orderBy("distance", "class"))
    near = near.withColumn("rank", first).filter(F.col("rank") <= budget).select("query", "class")

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
                score = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query", "class", "score"])

    pairs = near.join(distinct.select("class", F.col("vector").alias("candidate")), "class").join(query_vectors.select(F.col("class").alias("query"), F.col("vector").alias("asked")), "query")
    scored = pairs.select("query", "class", "asked", "candidate").mapInArrow(compared, "query long, class long, score double")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))
    scored = scored.withColumn("rank", first).filter(F.col("rank") <= top + 1).drop("rank")
    several = scored.join(known.select("class", F.explode("ids").alias("vec_id")), "class").select("query", "vec_id", "score")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    hits = several.withColumn("rank", first).filter(F.col("rank") <= top + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hits"))
    each = asked.join(hits, "query").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, top).alias("hits"))
    flat = each.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
