import random
import sqlite3

import pytest

from lectern.functions.text import porter_tokens, stem
from lectern.operators import search


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = "running runs group groups corporate notify queue queues bull pricing tiers happy day".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(3, 25))), " ".join(rng.choices(words, k=rng.randrange(0, 9))) or None) for k in range(50)]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize = 'porter unicode61 remove_diacritics 2')")
    db.executemany("INSERT INTO t (rowid, a, b) VALUES (?, ?, ?)", rows)
    table = spark.createDataFrame(rows, "id long, a string, b string")
    index = search.Index.of(table, "id", ["a", "b"], porter_tokens)
    index = search.Index(index.postings.cache(), index.lengths.cache(), index.columns)
    return db, index


def t(word, **options):
    return search.term(stem(word), **options)


CASES = [
    ("queue", t("queue")),
    ("running group", t("running") & t("group")),
    ('"corporate group"', search.Phrase((stem("corporate"), stem("group")))),
    ("que*", t("que", prefix=True)),
    ("bull OR pricing", t("bull") | t("pricing")),
    ("(bull OR pricing) NOT happy", (t("bull") | t("pricing")) - t("happy")),
    ("a : day", t("day", column="a")),
    ("^ bull", t("bull", first=True)),
    ("NEAR(bull day, 2)", search.Near(t("bull"), t("day"), most=2)),
    ('NEAR("corporate group" day, 3)', search.Near(search.Phrase((stem("corporate"), stem("group"))), t("day"), most=3)),
    ("NEAR(bull day queue, 4)", search.Near(t("bull"), t("day"), t("queue"), most=4)),
    ('NEAR("happy day" "bull pricing" que*, 9)', search.Near(search.Phrase((stem("happy"), stem("day"))), search.Phrase((stem("bull"), stem("pricing"))), t("que", prefix=True), most=9)),
]


@pytest.mark.parametrize(("match", "query"), CASES, ids=[c[0] for c in CASES])
def test_matches_and_scores_agree_with_sqlite(corpus, match, query):
    db, index = corpus
    want = dict(db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
    got = {r["doc"]: r["bm25"] for r in search.bm25(index, query).collect()}
    assert got.keys() == want.keys()
    if not match.startswith("^"):
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def stored_index(spark, rows, path, buckets=4):
    search.Index.store(path, spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"], porter_tokens, buckets)
    return search.Index.read(spark, path)


def test_stored_index_reads_the_buckets_of_its_terms(spark, corpus, tmp_path):
    db, index = corpus
    stored = stored_index(spark, db.execute("SELECT rowid, a, b FROM t").fetchall(), f"file://{tmp_path}/index")
    for _, query in CASES:
        exact = {r["doc"]: r["bm25"] for r in search.bm25(index, query).collect()}
        assert {r["doc"]: r["bm25"] for r in search.bm25(stored, query).collect()} == pytest.approx(exact, abs=1e-12)
    for atoms in ([search.Atom("queue")], [search.Atom("que", True)]):
        plan = stored.of_terms(atoms)._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    gone = spark.createDataFrame([(k,) for k in range(25)], "doc long")
    added = search.Index.of(spark.createDataFrame([(99, "queue", None)], "id long, a string, b string"), "id", ["a", "b"], porter_tokens)
    got = {r["doc"] for r in search.bm25(stored.without(gone).plus(added), t("queue")).collect()}
    assert 99 in got and all(k >= 25 for k in got)


def test_the_best_few_skip_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "SOON", 0)
    rng = random.Random(4)
    rows = []
    for k in range(400):
        n = rng.choice([5, 20, 80, 300])
        words = rng.choices(["filler", "other", "thing"], k=n) + ["common"] * rng.randrange(0, 9) + ["rare"] * (rng.random() < 0.05) + ["middling"] * (2 * (rng.random() < 0.3))
        rows.append((k, " ".join(words), None if k % 2 else "common text"))
    rows += [(1000, None, None), (1001, "", "")]
    index = stored_index(spark, rows, f"file://{tmp_path}/top")
    some = spark.createDataFrame([(k,) for k in range(0, 400, 7)], "doc long")
    queries = [t("common"), t("rare"), t("common") | t("rare"), t("common") | t("middling") | t("rare"), t("common") | t("common"), t("common") & t("rare"), t("common") - t("rare"), t("none"), t("none") | t("rare"), t("com", prefix=True)]
    skipped = 0
    for query in queries:
        for kept in (None, some):
            hits = search.bm25(index, query)
            hits = hits if kept is None else hits.join(kept, "doc", "left_semi")
            exact = [tuple(r) for r in hits.orderBy("bm25", "doc").limit(5).collect()]
            assert [tuple(r) for r in search.top(index, query, 5, kept).collect()] == exact
        blocks = search._blocks(index, query)
        terms = search._any_terms(query)
        if terms and all(x in blocks for x in terms):
            sure, chosen = search.reachable(blocks, terms, index.facts.documents, 5)
            skipped += sure > 0 and len(chosen) < sum(len(b) for b in blocks.values())
    assert skipped >= 2


def test_bounds_of_tiers_hold_for_any_mean():
    for assumed in (3.0, 40.0, 900.0):
        for mean in (2.0, 40.0, 1000.0):
            for f in (1, 2, 7, 400):
                for dl in (f, f + 1, 50 * f, 10**6):
                    share = lambda m, f=f, dl=dl: f / (f + search.K1 * (1 - search.B + search.B * dl / m))
                    low, high = search.bounds(int(search.TIERS * share(assumed)), assumed / mean)
                    assert low <= share(mean) <= high
