"""Exact nearest rows from balls, and centroids by partial sums, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators.balls import Balls
from lectern.operators.vectors import centroids, nearest


def table(spark, vectors, first=0):
    rows = [(first + k, None if v is None else [float(x) for x in v], f"n{k}") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, note string")


def agree(balls, plain, query, most, kept=None):
    found = balls.nearest(query, "id", most, kept)
    want = nearest(plain if kept is None else plain.join(kept, "id", "left_semi"), query, "id", most).collect()
    got = found.rows.orderBy("dist", "id").collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    assert [r["dist"] for r in got] == pytest.approx([r["dist"] for r in want], abs=1e-12)
    return found


def test_nearest_rows_from_balls(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.standard_normal((20, 12)) * 3
    vectors = np.concatenate([m + rng.standard_normal((100, 12)) * 0.3 for m in middles]).tolist()
    vectors += [vectors[0]] * 30 + [None, [0.0] * 12, [float("nan")] * 12, [1.0] * 11, [1e200] * 12]
    plain = table(spark, [v if v is None or len(v) == 12 and v[0] == v[0] and v[0] < 1e100 else None for v in vectors])
    balls = Balls.store(f"file://{tmp_path}/balls", table(spark, vectors), members=100)
    balls = Balls.read(spark, balls.path)
    for query, most in ((vectors[5], 10), (vectors[5], 40), (vectors[1999], 1), ([1.0] * 12, 7)):
        near = [1e200] * 12 == query
        found = agree(balls, plain if not near else table(spark, vectors), query, most)
        if query in vectors:
            assert found.files < found.of_files / 3
    some = spark.createDataFrame([(k,) for k in range(0, 2000, 97)], "id long")
    agree(balls, plain, vectors[5], 10, some)
    agree(balls, plain, vectors[5], 50, some)  # fewer than asked for
    assert agree(balls, plain, vectors[5], 5, some.limit(0)).rows.count() == 0
    more = table(spark, [[x + 0.01 for x in vectors[5]], [-x for x in vectors[5]], None], 5000)
    balls.add(more)
    assert agree(balls, plain.unionByName(more), vectors[5], 10).rows.filter("id = 5000").count() == 1
    agree(balls, plain.unionByName(more), [-x for x in vectors[5]], 3)
    for query in ([0.0] * 12, [1.0] * 11):
        assert balls.nearest(query, "id", 5).rows.count() == 0
    empty = Balls.store(f"file://{tmp_path}/none", table(spark, [None]))
    assert empty.nearest([1.0], "id", 5).rows.count() == 0


def test_centroids_shuffle_a_row_for_each_key_and_task(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{k % 7}", k, rng.standard_normal(50).tolist()) for k in range(400)] + [("one", 3, [0.0, 2.0]), ("none", 1, [1.0, 0.0]), ("none", 0, [-1.0, 0.0]), ("one", 9, None)]
    held = spark.createDataFrame(rows, "folder_name string, chunk_idx int, embedding array<double>").repartition(3)
    got = {r["folder_name"]: r["embedding"] for r in centroids(held).collect()}
    for k in range(7):
        mean = np.sum([v for name, _, v in rows if name == f"k{k}"], axis=0)
        assert got[f"k{k}"] == pytest.approx(mean / np.linalg.norm(mean))
    assert got["one"] == [0.0, 1.0] and got["none"] == [-1.0, 0.0] and len(got) == 9
    plan = centroids(held)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "posexplode" not in plan
    with pytest.raises(Exception, match="different lengths: a"):
        centroids(spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], "folder_name string, chunk_idx int, embedding array<double>")).collect()
    assert centroids(held.limit(0)).count() == 0 and held.filter(F.col("embedding").isNull()).count() == 1
