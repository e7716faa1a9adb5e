"""SQL functions against SQLite, and the keyword queries that have no SQL twin against its full-text search."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.operators.recordings import body
from lectern.operators.vectors import band
from lectern.plans import recipes
from lectern.sources import demo

SF = "/root/testdata/sf0.001"


def test_scalars_are_those_of_sqlite(spark):
    sql.register(spark)
    rng = random.Random(5)
    patterns = ["[^a]*", "[a-c]?", "*[]x]*", "[^]]*", "a[", "[[]", "*.*", "a\\b", "[a^]", "[&&]", "*", "?", "", "[a-", "x[^0-9]y", "\n*", "$^"]
    patterns += ["".join(rng.choices(["*", "?", "[ab]", "[^a]", "a", "b", ".", "("], k=rng.randrange(1, 5))) for _ in range(60)]
    texts = ["bcd", "a", "ab", "]", "[", "x]y", "a\\b", "^", "&", "a.b", "", "xay", "x7y", "\nz", "b(", "aab.", "it's", None]
    db = sqlite3.connect(":memory:")
    pairs = spark.createDataFrame([(p, t) for p in patterns for t in texts], "p string, t string")
    for r in pairs.selectExpr("p", "t", "glob(p, t) AS g", "quote(t) AS q").collect():
        want, quoted = db.execute("SELECT glob(?, ?), quote(?)", (r["p"], r["t"], r["t"])).fetchone()
        assert (None if want is None else bool(want)) == r["g"], (r["p"], r["t"])
        assert quoted == r["q"]
    row = spark.sql("SELECT max(iif(n > 1, n, 0)) AS n, typeof(max(iif(n > 1, n, 0))) AS kind, max(iif(n > 1, 'x', 'y')) AS t, typeof(random()) AS r, vec_version() AS v FROM VALUES (9), (10) AS t(n)").first()
    assert tuple(row) == (10, "int", "x", "bigint", sql.VERSION)
    assert spark.sql("SELECT count(DISTINCT r) AS n FROM (SELECT random() AS r FROM range(50))").first()["n"] == 50


def test_bands(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.2499, 0.25, 0.4499, 0.45, 0.5499, 0.55, 2.0)], "d double")
    assert [r["b"] for r in rows.select(band(F.col("d")).alias("b")).collect()] == ["strong", "strong", "related", "related", "weak", "weak", "unrelated", "unrelated"]


@pytest.fixture(scope="module")
def full_text(spark):
    db = sqlite3.connect(":memory:")
    tokenizer = "tokenize = 'porter unicode61 remove_diacritics 2'"
    db.execute(f"CREATE VIRTUAL TABLE rec USING fts5(raw, processed, folder UNINDEXED, {tokenizer})")
    db.execute(f"CREATE VIRTUAL TABLE words USING fts5(raw, processed, folder UNINDEXED, tokenize = 'unicode61 remove_diacritics 0')")
    rows = demo.recordings(spark, SF).select("folder_name", "raw_transcript", "processed_transcript", "superseded_by").collect()
    for r in rows:
        for t in ("rec", "words"):
            db.execute(f"INSERT INTO {t} VALUES (?, ?, ?)", (r["raw_transcript"] or "", r["processed_transcript"] or "", r["folder_name"]))
    return db, {r["folder_name"] for r in rows if r["superseded_by"] is None}


def test_porter_query_is_full_text_search(spark, full_text):
    db, _ = full_text
    want = {f: round(s, 6) for f, s in db.execute("SELECT folder, bm25(rec) FROM rec WHERE rec MATCH 'disgusting'")}
    got = {r["folder_name"]: r["bm25"] for r in recipes.kw_porter(spark, SF).collect()}
    assert got == pytest.approx(want, abs=2e-6) and got


def test_snippet_queries_are_full_text_search(spark, full_text):
    db, canonical = full_text
    want = [(f, round(s, 6)) for f, s in db.execute("SELECT folder, bm25(words) AS s FROM words WHERE words MATCH 'loser OR clown' ORDER BY s, folder") if f in canonical][:10]
    got = recipes.kw_snippet(spark, SF).collect()
    assert {r["folder_name"]: r["bm25"] for r in got} == pytest.approx(dict(want), abs=2e-6) and got
    cut = dict(db.execute("SELECT folder, snippet(rec, -1, '«', '»', '…', 10) FROM rec WHERE rec MATCH 'loser OR clown'"))
    assert {r["folder_name"]: r["snip"] for r in got} == {r["folder_name"]: cut[r["folder_name"]] for r in got}
    chunks = {f"{r['folder_name']}/{r['chunk_idx']}": r for r in recipes.kw_chunk_snippet(spark, SF).collect()}
    db.execute("CREATE VIRTUAL TABLE chunk USING fts5(text, doc UNINDEXED, tokenize = 'porter unicode61 remove_diacritics 2')")
    for r in demo.chunks(spark, SF).select(demo.chunk_key().alias("doc"), "text").collect():
        db.execute("INSERT INTO chunk VALUES (?, ?)", (r["text"], r["doc"]))
    cut = dict(db.execute("SELECT doc, snippet(chunk, 0, '«', '»', '…', 10) FROM chunk WHERE chunk MATCH 'loser'"))
    assert chunks.keys() <= cut.keys() and all(r["snip"] == cut[doc] for doc, r in chunks.items())
    assert demo.recordings(spark, SF).select(body()).count() > 0
