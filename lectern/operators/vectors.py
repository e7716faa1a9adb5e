"""Exact vector retrieval: cosine distance, nearest rows, centroids, blobs, rank fusion."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cosine_distance(vector: Column, query: list[float] | Column) -> Column:
    """1 - cosine, from 0 to 2; null for a null or zero vector."""
    other = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return F.lit(1.0) - F.try_divide(dot(vector, other), F.sqrt(dot(vector, vector)) * F.sqrt(dot(other, other)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda total, x: total + x)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row: what stands in a function of elements is computed for each."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(vector: Column) -> Column:
    """The vector at unit length; null for a zero vector."""
    return _once(F.sqrt(dot(vector, vector)), lambda norm: F.transform(vector, lambda x: F.try_divide(x, norm)))


def band(distance: Column) -> Column:
    """How to read a distance."""
    return F.when(distance < 0.25, "strong").when(distance < 0.45, "related").when(distance < 0.55, "weak").otherwise("unrelated")


def nearest(vectors: DataFrame, query: list[float], key: str, most: int) -> DataFrame:
    """The ``most`` nearest rows (ties by key): ``key, dist``. Each task keeps its own best; no global sort."""
    return vectors.select(key, cosine_distance(F.col("embedding"), query).alias("dist")).filter("dist is not null").orderBy("dist", key).limit(most)


def ranked(top: DataFrame, *order: Column | str) -> DataFrame:
    """``top`` (already limited) with its row number ``r``: the one task that ranks has only these few rows."""
    return top.withColumn("r", F.row_number().over(Window.orderBy(*order)))


def fused(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``key, r``): every row of either, with ``rrf``."""
    a, b = first.select(key, F.col("r").alias("r1")), second.select(key, F.col("r").alias("r2"))
    share = lambda r: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(r)), F.lit(0.0))
    return a.join(b, key, "full_outer").select(key, (share("r1") + share("r2")).alias("rrf"))


#: Components that a task's sums of vectors may hold before they are passed on.
HELD = 500_000


def _sums(key: str, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ``key, chunk_idx, embedding``, for each key the sum of its vectors, their least and greatest length, and
    the first of them: one row for each key and task, unless a task has very many keys."""
    kinds = to_arrow_schema(schema)

    def told(held: dict) -> pa.RecordBatch:
        keys, rows = pa.array(list(held), kinds.field(0).type), list(held.values())
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, vs)], dtype=np.int32)), pa.array(np.concatenate([np.zeros(0), *vs]))) for vs in ([r[0] for r in rows], [r[4] for r in rows])]
        low, high, at = (pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3))
        columns = [keys, lists[0], low, high, at, lists[1]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds)], schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        components = 0
        for batch in batches:
            keys, places, vectors = batch.columns
            ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            for k, at, valid, a, b in zip(keys.to_pylist(), places.to_pylist(), vectors.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if not valid:
                    continue
                v = flat[a:b]
                if k not in held:
                    held[k] = [v.copy(), b - a, b - a, at, v.copy()]  # a view would keep its whole batch
                    components += 2 * (b - a)
                else:
                    mine = held[k]
                    mine[1], mine[2] = min(mine[1], b - a), max(mine[2], b - a)
                    if mine[1] == mine[2]:
                        mine[0] += v
                    if at < mine[3]:
                        mine[3], mine[4] = at, v.copy()
                if components > HELD:
                    yield told(held)
                    held, components = {}, 0
        yield told(held)

    return run


def centroids(vectors: DataFrame, key: str = "folder_name") -> DataFrame:
    """The unit-length mean direction of each key's vectors (``embedding``), or the first of them (by ``chunk_idx``) if they cancel out.

    Each task adds up its vectors by key, so one row for each key and task is shuffled, whatever a vector's length. Null
    vectors don't count; those of one key must be equally long.
    """
    rows = vectors.select(key, F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("embedding").cast("array<double>").alias("embedding"))
    doubles, longs = ArrayType(DoubleType()), LongType()
    schema = StructType([rows.schema[key], StructField("sum", doubles), StructField("least", longs), StructField("most", longs), StructField("at", longs), StructField("first", doubles)])
    parts = rows.mapInArrow(_sums(key, schema), schema)
    wrong = F.raise_error(F.concat(F.lit("vectors of different lengths: "), F.col(key).cast("string")))
    sums = parts.groupBy(key).agg(F.collect_list("sum").alias("sums"), F.min("least").alias("least"), F.max("most").alias("most"), F.min_by("first", "at").alias("first"))
    total = F.aggregate(F.slice("sums", 2, F.size("sums")), F.element_at("sums", 1), lambda t, s: F.zip_with(t, s, lambda x, y: x + y))
    summed = sums.withColumn("total", F.when(F.col("least") != F.col("most"), wrong.cast("array<double>")).otherwise(total))
    scaled = lambda t: _once(F.sqrt(dot(t, t)), lambda norm: F.when(norm > 0, F.transform(t, lambda x: x / norm)).otherwise(F.col("first")))
    return summed.select(key, _once(F.col("total"), scaled).alias("embedding"))


def to_blob(vector: Column) -> Column:
    """A vector as the hex of little-endian 32-bit floats."""

    @F.pandas_udf("string")
    def pack(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes().hex().upper() for v in vectors], dtype=object)

    return pack(vector)


def from_blob(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(bytes.fromhex(b), "<f4") for b in blobs], dtype=object)

    return unpack(blob)


def blob_literal(vector: list[float]) -> str:
    return "x'" + struct.pack(f"<{len(vector)}f", *vector).hex().upper() + "'"


def stub_vector(text: str, dims: int = 1024) -> np.ndarray:
    """A unit vector fixed by a text: FNV-1a over UTF-16 units seeds a linear congruential sequence."""
    seed = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        seed = (seed ^ unit) * 0x01000193 & 0xFFFFFFFF
    out = np.empty(dims)
    for k in range(dims):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out[k] = seed / 0xFFFFFFFF * 2 - 1
    return out / np.linalg.norm(out)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[np.ndarray]], text: str = "embed_text", batch: int = 32) -> DataFrame:
    """``texts`` with ``embedding``, from any function of a batch of texts (a service's client, a local model).

    A batch that gives another number of vectors than it has texts raises.
    """
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[np.ndarray] = []
            values = frame[text].tolist()
            for at in range(0, len(values), batch):
                part = embed(values[at : at + batch])
                if len(part) != len(values[at : at + batch]):
                    raise ValueError(f"{len(part)} vectors for {len(values[at : at + batch])} texts")
                found += part
            columns = {c: pd.Series(frame[c].tolist(), dtype=object, index=frame.index) for c in frame.columns}
            yield pd.DataFrame(columns | {"embedding": pd.Series([np.asarray(v, np.float32) for v in found], dtype=object, index=frame.index)})

    return texts.mapInPandas(run, StructType([*texts.schema, StructField("embedding", ArrayType(FloatType()))]))
