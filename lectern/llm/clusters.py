"""Centroid clustering in whole numbers, each vector's nearest centroid found by partial distances.

Components become floor(SCALE * x), so squared distances and centroids (floors of means) are exact integers and every
run agrees. A vector's squared differences are added up over a few dimensions at a time, those of the highest variance
first; a centroid is given up once its part of the distance lies strictly above the best whole distance so far, and
what survives goes through all dimensions. The best starts as the centroid that is nearest in the first few dimensions.

A round reads the vectors once. Its tasks pass on sums for each centroid and dimension alone, so neither a centroid
that holds most vectors nor one task gathers vectors; centroids (K times the dimensions) go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import scratch, written

DIMS, SCALE, K, ROUNDS, SALT = 64, 64, 16, 3, "1:"
#: Dimensions whose squared differences are added before centroids are given up again.
STEP = 8
#: Components up to this size are computed with in 64 bits (squares of differences, summed over up to 64 dimensions, fit);
#: beyond, with Python's integers.
NARROW = 2**27
LONG = 2**63 - 1
#: Sums travel as digits of this many bits, so that they can be added in Spark however large they are.
DIGIT = 32


class Centroids(NamedTuple):
    points: np.ndarray  # centroid, dimension: Python's integers
    order: np.ndarray  # dimensions, highest variance first

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in self.points.tolist()]


def _small(values: np.ndarray) -> np.ndarray:
    """Whether each row (or a row) computes in 64 bits."""
    return (np.abs(values) <= NARROW).all(axis=-1)


def partial_search(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """For each vector (int64 if all components are NARROW, else objects) its nearest centroid, the smaller number of
    equally near ones, and the squared distance."""
    points, order = centroids
    x, dims = vectors[:, order], len(order)
    small = [x.dtype != object and bool(_small(p)) for p in points]
    ordered = [p[order].astype(np.int64 if s else object) for p, s in zip(points, small)]

    def added(rows: np.ndarray, k: int, at: int, end: int) -> np.ndarray:
        part = x[rows, at:end] if end - at < dims else x[rows]
        return ((part if small[k] else part.astype(object)) - ordered[k][at:end]).__pow__(2).sum(axis=1)

    lead = np.array([p[:STEP].astype(float) for p in ordered])
    first = x[:, :STEP].astype(float)
    cluster = np.stack([((first - p) ** 2).sum(axis=1) for p in lead]).argmin(axis=0)
    guess, best = cluster.copy(), np.zeros(len(x), np.int64 if all(small) else object)
    for k in range(len(points)):
        rows = np.flatnonzero(guess == k)
        if len(rows):
            best[rows] = added(rows, k, 0, dims)
    for k in range(len(points)):
        rows = np.flatnonzero(guess != k)
        part = np.zeros(len(rows), np.int64 if small[k] else object)
        for at in range(0, dims, STEP):
            part = part + added(rows, k, at, at + STEP)
            going = (part <= best[rows]).astype(bool)
            rows, part = rows[going], part[going]
            if not len(rows):
                break
        nearer = ((part < best[rows]) | (k < cluster[rows])).astype(bool)
        best[rows[nearer]], cluster[rows[nearer]] = part[nearer], k
    return cluster, best


def whole(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as doubles (which hold them exactly)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat.reshape(len(column), -1))


def parts(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their values, those that compute in 64 bits apart from those that take Python's integers."""
    small = _small(values)
    for rows, kind in ((np.flatnonzero(small), np.int64), (np.flatnonzero(~small), object)):
        if len(rows):
            v = values[rows]
            yield rows, v.astype(np.int64) if kind is np.int64 else np.array([[int(c) for c in r] for r in v.tolist()], object).reshape(v.shape)


def usable(vector: Column, scale: int, dims: int | None = None) -> Column:
    """Not null, of ``dims`` components, each finite, also ``scale``-fold."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == F.lit(float("inf")))
    right = F.lit(True) if dims is None else F.size(vector) == dims
    return vector.isNotNull() & right & ~F.exists(vector, bad)


def vectors(table: DataFrame, vec_id: str, vector: str, scale: int, dims: int | None = None) -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    kind = "array<float>" if dict(table.dtypes)[vector] == "array<float>" else "array<double>"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    return rows.filter(usable(F.col("vector"), scale, dims))


def _digits(number: int) -> Iterator[tuple[int, int]]:
    """The number's digits of DIGIT bits from the lowest; the last one bears the sign."""
    place = 0
    while not -(1 << (DIGIT - 1)) <= number < 1 << (DIGIT - 1):
        yield place, number & ((1 << DIGIT) - 1)
        place, number = place + 1, number >> DIGIT
    yield place, number


def _sums(rows: DataFrame, centroids: Centroids, scale: int) -> tuple[list[int], list[list[int]]]:
    """How many vectors each centroid has, and their sum. A task passes on one row for each digit of its sums."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        k, dims = at.points.shape
        total = np.zeros((k, dims + 1), object)
        for batch in batches:
            for _, v in parts(whole(batch.column(0), scale)) if batch.num_rows else ():
                cluster, _ = partial_search(v, at)
                for c in np.unique(cluster).tolist():
                    mine = v[cluster == c]
                    total[c, :dims] += mine.sum(axis=0).astype(object)
                    total[c, dims] += len(mine)
        out = [(c, d, place, int(digit)) for c in range(k) for d in range(dims + 1) if total[c, d] for place, digit in _digits(int(total[c, d]))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "place", "digit"])

    added = rows.select("vector").mapInArrow(summed, "cluster int, dim int, place int, digit long").groupBy("cluster", "dim", "place").agg(F.sum("digit").alias("digit"))
    k, dims = centroids.points.shape
    total = [[0] * (dims + 1) for _ in range(k)]
    for r in added.collect():  # at most K times the dimensions, but for digits
        total[r["cluster"]][r["dim"]] += r["digit"] << (DIGIT * r["place"])
    sent.unpersist()
    return [t[dims] for t in total], [t[:dims] for t in total]


def _variances(rows: DataFrame, dims: int, scale: int) -> np.ndarray:
    """Of each dimension; they only say in which order dimensions are added."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            v = np.clip(whole(batch.column(0), scale), -NARROW, NARROW) if batch.num_rows else np.zeros((0, dims))
            n, s, q = n + len(v), s + v.sum(axis=0), q + (v**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n, np.int64)), pa.array(s), pa.array(q)], ["dim", "n", "s", "q"])

    found = rows.select("vector").mapInArrow(moments, "dim int, n long, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    out = np.zeros(dims)
    for r in found:
        out[r["dim"]] = r["q"] / max(1, r["n"]) - (r["s"] / max(1, r["n"])) ** 2
    return out


def fitted(rows: DataFrame, dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> Centroids:
    """Centroids of ``vec_id, vector`` rows after ``rounds`` rounds.

    They start as the ``k`` vectors (all, if fewer) with the smallest lowercase-hex sha256 of salt and id; rows without
    an id come last, and repeated ids in order of their vectors. An empty centroid stays where it is.
    """
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "vector").limit(k).collect()
    points = np.array([[int(np.floor(scale * float(c))) for c in r["vector"]] for r in first], object).reshape(len(first), dims)
    out = Centroids(points, np.argsort(-_variances(rows, dims, scale), kind="stable"))
    for _ in range(rounds if len(first) else 0):
        counts, sums = _sums(rows, out, scale)
        moved = [[s // n for s in total] if n else p for n, total, p in zip(counts, sums, out.points.tolist())]
        out = out._replace(points=np.array(moved, object).reshape(len(first), dims))
    return out


def assigned(rows: DataFrame, centroids: Centroids, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance`` of each of the ``vec_id, vector`` rows; a distance beyond a long is the largest long."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, v in parts(whole(batch.column(1), scale)) if batch.num_rows else ():
                cluster[at], far = partial_search(v, sent.value)
                distance[at] = np.minimum(far, LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "vector").mapInArrow(placed, "vec_id long, cluster int, distance long")


def clustered(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, salt: str = SALT
) -> DataFrame:
    """Each vector's cluster: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length than ``dims``, or hold a null or non-finite component (also if it is so
    ``scale``-fold) take no part. Every other row counts and is returned, repeated rows and rows without an id too;
    of equally near centroids the smaller number is taken. Distances and sums beyond a long are given as the largest
    long, though compared exactly. An empty table gives an empty result; other columns don't matter.
    """
    with scratch():
        rows = written(vectors(table, vec_id, vector, scale, dims), "cluster-vectors")
        centroids = fitted(rows, dims, scale, k, rounds, salt)
        placed = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")) if not len(centroids.points) else assigned(rows, centroids, scale)
        placed = written(placed, "clusters", lasting=True)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    capped = lambda c: F.least(F.col(c), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias(c)
    by_cluster = placed.groupBy("cluster").agg(exact.alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in by_cluster)
    hashes = centroids.sha256()
    facts = [(r["cluster"], r["cluster_inertia"], total, hashes[r["cluster"]]) for r in by_cluster]
    told = table.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", capped("cluster_inertia"), capped("inertia"), "centroid_sha256")
