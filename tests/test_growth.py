"""Steps whose cost grew faster than their input: what they give, and that they don't any more."""

import sys
import timeit
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lectern.functions.text import folded, stemmed_tokens, tokens
from lectern.operators import search, vectors
from lectern.operators.chunks import chunked, chunked_by_parts
from lectern.operators.supersede import superseded
from lectern.plans import passthrough
from lectern.sources import demo

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_frames_of_modes(spark):
    """As the text says, over null modes, ties and rows that repeat; no frame is gone through anew for each row."""
    rows = [(str(k % 37), [None, "A", "B"][k % 3], f"2024-01-{k % 9 + 1:02d}", k * k % 50) for k in range(90)] + [("x", "C", "2024", 3)]
    held = spark.createDataFrame(rows, "folder_name string, mode_name string, datetime_iso string, raw_word_count long")
    held.createOrReplaceTempView("rec")
    got = passthrough.frames(held)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.sql(passthrough.TEXTS["sql_frames"][0]).collect()))
    found = plan(passthrough.QUERIES["sql_frames"](spark, SF))
    assert "currentrow$(), unboundedfollowing$()" not in found and "WindowGroupLimit" in found


def test_recordings_shuffle_and_store_a_text_once(spark):
    held = superseded(spark.createDataFrame([("a", "h", "2024-01-01", "t"), ("b", "h", "2024-01-02", "t"), ("c", None, None, "u")], "folder_name string, audio_hash string, datetime string, text string"))
    assert {r["folder_name"]: r["superseded_by"] for r in held.collect()} == {"a": "b", "b": None, "c": None}
    assert "SortMergeJoin" not in plan(held) and "ShuffledHashJoin" in plan(held)
    rows = demo.recordings(spark, SF)
    stored = spark.read.parquet(*rows.inputFiles())
    assert {"raw_result", "superseded_by"} <= set(stored.columns) and not {"result", "llm_result", "raw_transcript", "processed_transcript"} & set(stored.columns)
    raw = demo.raw_recordings(spark, SF).select("folder_name", "result", "llm_result", "raw_result")
    assert rows.select(*raw.columns).exceptAll(raw).isEmpty() and raw.exceptAll(rows.select(*raw.columns)).isEmpty()


def test_large_bucket_goes_to_several_tasks(spark, tmp_path):
    texts = spark.range(4000).select("id", F.concat(F.lit("the that this "), F.col("id").cast("string")).alias("text")).repartition(8)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16k")
    try:
        search.Index.store(f"file://{tmp_path}/index", texts, "id", ["text"], tokens, buckets=4)
    finally:
        spark.conf.set(key, before)
    index = search.Index.read(spark, f"file://{tmp_path}/index")
    common = index.of_terms([search.Atom("the")])
    assert common.count() == 4000 and common.select(F.input_file_name()).distinct().count() > 1
    assert search.bm25(index, search.term("that")).count() == 4000 and index.facts.documents == 4000


def test_sums_of_vectors_are_passed_on_within_a_batch():
    keys, dims = 20_000, 64
    doubles, longs = ArrayType(DoubleType()), LongType()
    schema = StructType([StructField("k", StringType()), StructField("sum", doubles), StructField("least", longs), StructField("most", longs), StructField("at", longs), StructField("first", doubles)])
    flat = np.arange(keys * dims, dtype=float)
    vectors_ = pa.ListArray.from_arrays(pa.array(np.arange(keys + 1, dtype=np.int32) * dims), pa.array(flat))
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(keys)]), pa.array(np.zeros(keys, np.int64)), vectors_], ["k", "chunk_idx", "embedding"])
    got = list(vectors._sums("k", schema)(iter([batch])))
    assert max(b.num_rows for b in got) * 2 * dims <= vectors.HELD + 2 * dims and sum(b.num_rows for b in got) == keys
    assert all(b.schema.equals(to_arrow_schema(schema)) or b.schema.names == schema.fieldNames() for b in got)
    assert np.array_equal(np.concatenate([b.column(1).flatten().to_numpy() for b in got]), flat)


def test_norms_and_joins_are_made_once(spark):
    """A norm isn't computed for each component, nor are vectors joined with their chunks again."""
    found = plan(vectors.centroids(spark.createDataFrame([("a", 0, [3.0, 4.0])], "folder_name string, chunk_idx int, embedding array<double>")))
    final = found[found.index("== Optimized") : found.index("== Physical")]
    assert "/ sqrt(" not in final and "/ SQRT(" not in final
    chunks = spark.createDataFrame([(1, "3", 0)], "chunk_id long, folder_name string, chunk_idx int")
    assert demo.chunk_vectors(spark, SF, chunks, "folder_name", "chunk_idx").columns == ["chunk_id", "folder_name", "chunk_idx", "embedding"]


def test_folding_is_no_loop_over_characters():
    """Every character folds as by its combining class, in a fraction of the loop's time."""
    text = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    slow = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    assert folded(text) == slow(text)
    prose = "Crème brûlée with a few words, running happily. " * 20_000
    took = [min(timeit.repeat(lambda: fold(prose), number=1, repeat=3)) for fold in (folded, slow)]
    assert took[0] < took[1] / 1.5
    assert stemmed_tokens("Élan runs, running; élan", {}) == ["elan", "run", "run", "elan"]


def test_parts_need_no_group_of_python_for_each_text(spark, tmp_path):
    words = lambda n, s: " ".join(f"w{k}{'.' if k * s % 11 == 0 else ''}" for k in range(n))
    rows = [("short", words(40, 1)), ("none", None), ("just", words(500, 3)), ("under", words(499, 2)), ("long", words(7000, 5)), ("long", words(2600, 7))]
    texts = spark.createDataFrame(rows, "folder_name string, body string")

    def written(name, df):
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/{name}")
        return spark.read.parquet(f"file://{tmp_path}/{name}")

    got = chunked_by_parts(texts, written, part=900)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, chunked(texts).collect()))
    assert "FlatMapGroupsInPandas" not in plan(got) and "SortMergeJoin" not in plan(got)
    assert spark.read.parquet(f"file://{tmp_path}/parts").filter("text_key in ('short', 'none')").isEmpty()
