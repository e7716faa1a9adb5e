"""Exact nearest rows without reading all vectors: stored in balls, those skipped that can't hold a near one.

Vectors are scaled to unit length, where cosine distance is half the squared Euclidean one, and dealt to the nearest of
some centres; each centre's vectors lie in a folder of their own, in order of their distance to it. By the triangle
inequality a vector is no nearer to the query than the difference of the query's and its own distance to the centre. So
the balls nearest to the query are read first; the k-th distance found then says which other balls, and in each which
range of distances to the centre, can hold anything nearer. How much that skips depends on how clustered vectors are;
what is found is exact in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lectern.operators.vectors import cosine_distance

#: Vectors of a ball, on average; balls at most; vectors for each ball that centres are fitted on, and rounds of it.
MEMBERS, BALLS, SAMPLED, ROUNDS = 4096, 4096, 16, 8
#: Components of that sample at most.
FITTED = 8_000_000
#: What rounding may add to a distance.
SLACK = 1e-6


@dataclass(frozen=True)
class Found:
    rows: DataFrame  # key, dist; ties in order of keys
    balls: int
    files: int
    of_files: int


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # else squares of large components overflow
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _fitted(sample: np.ndarray, balls: int) -> np.ndarray:
    """Centres: means of the sample's vectors that are nearest to them, from a spread-out start."""
    rng = np.random.default_rng(0)
    centres = sample[rng.permutation(len(sample))[:balls]].copy()
    for _ in range(ROUNDS):
        nearest = ((centres**2).sum(axis=1) - 2 * sample @ centres.T).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, sample)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def _comparable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _dealt(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with the ``ball`` of each and its distance ``off`` the centre."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    at = vectors.columns.index("embedding")
    schema = StructType([*vectors.schema, StructField("ball", IntegerType()), StructField("off", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            ball, off = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for begin in range(0, batch.num_rows, 1024):
                part = slice(begin, min(begin + 1024, batch.num_rows))
                v = _unit(_matrix(batch.column(at).slice(begin, 1024)))
                ball[part] = ((c**2).sum(axis=1) - 2 * v @ c.T).argmin(axis=1)
                off[part] = np.linalg.norm(v - c[ball[part]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(off)], schema.fieldNames())

    return vectors.mapInArrow(run, schema)


@dataclass(frozen=True)
class Balls:
    """Stored balls. ``facts`` has for each its number, centre, radius and how many vectors it holds (at most BALLS rows)."""

    spark: SparkSession
    path: str
    schema: StructType

    @classmethod
    def store(cls, path: str, vectors: DataFrame, members: int = MEMBERS) -> Balls:
        """Writes ``vectors`` (``embedding`` and other columns, a key among them).

        Vectors that are null, zero or hold null or non-finite components are near nothing and left out, and so are those
        of other lengths than most. Centres are fitted on at most BALLS * SAMPLED of the vectors (and FITTED components); all are dealt out.
        """
        rows = vectors.filter(_comparable(F.col("embedding"))).withColumn("embedding", F.col("embedding").cast("array<double>"))
        sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        spark, dims, n = vectors.sparkSession, sizes["dims"] if sizes else 0, sizes["count"] if sizes else 0
        rows = rows.filter(F.size("embedding") == dims)
        balls = max(1, min(BALLS, -(-n // members)))
        sampled = max(1, min(balls * SAMPLED, FITTED // max(1, dims)))
        few = rows.select("embedding").orderBy(F.xxhash64("embedding")).limit(sampled).toPandas()["embedding"]
        centres = _fitted(_unit(np.stack(few.to_list())), balls) if n else np.zeros((1, 0))
        made = cls(spark, path, rows.schema)
        spark.createDataFrame([(k, c) for k, c in enumerate(centres.tolist())], "ball int, centre array<double>").write.parquet(f"{path}/centres")
        made._write(rows, centres)
        return made

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Balls:
        schema = spark.read.parquet(f"{path}/vectors").schema
        return cls(spark, path, StructType([f for f in schema if f.name not in ("ball", "off")]))

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("ball").toPandas()["centre"]  # at most BALLS
        return np.stack(found.to_list())

    def add(self, vectors: DataFrame) -> None:
        """Further vectors, dealt to the centres there are: new files beside the old ones."""
        centres = self.centres()
        rows = vectors.filter(_comparable(F.col("embedding")) & (F.size("embedding") == centres.shape[1]))
        self._write(rows.withColumn("embedding", F.col("embedding").cast("array<double>")).select(*self.schema.names), centres)

    def _write(self, rows: DataFrame, centres: np.ndarray) -> None:
        dealt = _dealt(rows, centres).repartition("ball", F.pmod(F.xxhash64("embedding"), F.lit(4))).sortWithinPartitions("ball", "off")
        dealt.write.mode("append").partitionBy("ball").parquet(f"{self.path}/vectors")
        held = self._read().groupBy("ball").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n"))
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/balls")

    def _read(self, *balls: int) -> DataFrame:
        schema = StructType([*self.schema, StructField("off", DoubleType()), StructField("ball", IntegerType())])
        paths = [f"{self.path}/vectors/ball={b}" for b in balls] or [f"{self.path}/vectors"]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/vectors").parquet(*paths)

    def nearest(self, query: list[float], key: str, most: int, kept: DataFrame | None = None) -> Found:
        """The ``most`` nearest rows by cosine distance, of those whose key is in ``kept`` alone if that is given.

        The few rows found go through the driver, as do the balls' centres.
        """
        facts = {r["ball"]: r for r in self.spark.read.parquet(f"{self.path}/balls").collect()}  # at most BALLS
        centres = self.centres()
        vector = np.array([query], np.float64)
        none = self._read().select(key, F.lit(0.0).alias("dist")).limit(0)
        if not facts or vector.shape[1] != centres.shape[1] or not np.isfinite(vector).all() or not vector.any():
            return Found(none, 0, 0, 0)
        apart = np.linalg.norm(centres - _unit(vector), axis=1)
        bound = {b: max(0.0, apart[b] - r["radius"]) for b, r in facts.items()}
        order = sorted(facts, key=lambda b: (bound[b], apart[b]))
        best: list[tuple] = []
        begun, reach, files, share = 0, math.inf, 0, most
        while begun < len(order) and bound[order[begun]] <= reach + SLACK:
            # First as many balls as may hold enough; once that many are known, all that are in reach, in one pass.
            some, held = [], 0
            while begun < len(order) and bound[order[begun]] <= reach + SLACK and (held < share or reach < math.inf):
                held += facts[order[begun]]["n"]
                some.append(order[begun])
                begun += 1
            rows = self._read(*some)
            files += len(rows.inputFiles())
            if reach < math.inf:
                near = [(F.col("ball") == b) & F.col("off").between(float(apart[b] - reach - SLACK), float(apart[b] + reach + SLACK)) for b in some]
                rows = rows.filter(_any(near))
            if kept is not None:
                rows = rows.join(kept.select(key), key, "left_semi")
            found = rows.select(key, cosine_distance(F.col("embedding"), query).alias("dist")).filter("dist is not null").orderBy("dist", key).limit(most).collect()
            best = sorted(best + [(r["dist"], r[key]) for r in found])[:most]
            share *= 4
            if len(best) == most:
                reach = math.sqrt(max(0.0, 2 * best[-1][0]))
        out = self.spark.createDataFrame([(k, d) for d, k in best], none.schema)
        return Found(out, begun, files, len(self._read().inputFiles()))


def _any(conditions: list[Column]) -> Column:
    """Any of them, as a tree: a chain of thousands would be too deep."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + conditions[len(conditions) & ~1 :]
    return conditions[0]
