"""The pipeline on a small folder of tables, against what each stage's operator says."""

import random

import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    words = "the quick brown fox jumps over lazy dogs while rivers run near old stone bridges every summer morning".split()
    words += [a + b for a in ("mor", "lin", "tas", "ver") for b in ("ing", "ed", "ly", "er", "est")]
    rows, labels = [], []
    for k in range(240):
        text = rng.choices(words, k=120)
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(120)] = rng.choice(["vile", "rotten"])
        rows.append((k, " ".join(text), "en", f"src{k % 3}", 0))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, rows[2 * k + 1][1], "en", "src0", 0) for k in range(10) if (2 * k + 1) % 5]
    rows += [(2000, "too short", "en", "src1", 0), (2001, None, None, None, None)]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return f"file://{top}"


def test_stages(spark, tables):
    import corpus_pipeline
    from lectern.llm import bpe
    from lectern.llm.common import written

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, tables), name)
        assert docs.columns == columns
        left = [r["doc_id"] for r in docs.collect()]
        gone, ids = ids - set(left), set(left)
        if name == "quality_rules":
            assert gone == {2000, 2001}
        elif name == "toxicity":
            assert len([k for k in gone if k % 5 == 0 and k < 1000]) >= 40 and len([k for k in gone if k % 5]) <= 4
        elif name == "simhash_near_dedup":
            assert gone <= set(range(1000, 1010)) and not ids & set(range(1000, 1010)) and len(left) == len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.count() == len(left)
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in bpe.digests(docs, keep=["doc_id"]).collect()}


def test_stages_on_odd_tables(spark, tables, tmp_path):
    """Empty tables give empty results; nulls, empty texts and repeated rows pass; other columns stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(5, "", "en", "src0", 0)] + [(6, "w " * 60, None, None, 1)] * 2, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0, name
        out = stage(spark, odd, tables)
        assert out.count() <= 3 * 5 and (name == "bpe" or out.columns == docs.columns), name
    rows = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 40").withColumnRenamed("n_chars", "Row_Key")
    assert corpus_pipeline.near_copies(spark, rows, tables).columns == rows.columns
