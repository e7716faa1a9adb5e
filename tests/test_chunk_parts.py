"""Chunks of very long texts by several tasks, against the plain loop."""

import random
import uuid

import pytest

from lectern.operators.chunks import Strategy, chunked, chunked_by_parts


def text(rng, n):
    words = ["word", "other", "stop.", "Dr.", "what?", "longer-word", "1.", "x"]
    out = []
    while len(out) < n:
        if rng.random() < 0.02:
            out += ["Speaker", f"{rng.randrange(9)}:"]
        out.append(rng.choice(words))
    return rng.choice([" ", "\n", " \t "]).join(out[:n])


@pytest.fixture
def written(spark, tmp_path):
    def write(name, rows):
        path = f"file://{tmp_path}/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.mark.parametrize("strategy", [Strategy(), Strategy(size=20, overlap=8, threshold=30, boundary_window=5), Strategy(size=7, overlap=6, threshold=1, boundary_window=9)])
def test_parts_give_the_same_chunks(spark, written, strategy):
    rng = random.Random(4)
    rows = [(f"t{k}", text(rng, n)) for k, n in enumerate([0, 1, 29, 30, 31, 47, 48, 300, 499, 500, 517, 1000, 1999, 3000])]
    rows += [("t12", rows[12][1]), ("none", None), ("long", "  " + text(rng, 20_000) + "\n"), ("flat", "y " * 4000)]
    table = spark.createDataFrame(rows, "folder_name string, body string").repartition(3)
    want = sorted(map(tuple, chunked(table, strategy=strategy).collect()))
    for part in (40, 700, 20_000):
        assert sorted(map(tuple, chunked_by_parts(table, written, strategy=strategy, part=part).collect())) == want
    assert len(want) > 100 and chunked_by_parts(table.limit(0), written, strategy=strategy).count() == 0


def test_a_long_text_is_the_work_of_several_tasks(spark, written):
    table = spark.createDataFrame([("a", text(random.Random(5), 1_000_000))], "folder_name string, body string")
    want = chunked(table).drop("chunk_id")
    got = chunked_by_parts(table, written, part=200_000).drop("chunk_id")
    assert got.count() == want.count() > 3000 and got.exceptAll(want).isEmpty()
