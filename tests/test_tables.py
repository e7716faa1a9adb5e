"""Deltas, merging, splitting and commits of an archive's tables; keyword indexes in segments; ingests at once."""

import hashlib
import os
import random
import re
import sqlite3
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_archive import Fixture, embed

from lectern.functions.text import porter_tokens, stem
from lectern.operators import archive as archive_module
from lectern.operators import reconcile, search, segments, tables
from lectern.operators.archive import Archive, _ingested, ingest
from lectern.operators.chunks import spans
from lectern.operators.supersede import superseded
from lectern.operators.tables import Conflict, Tables

cloudpickle.register_pickle_by_value(sys.modules["test_archive"])

SCHEMAS = {"t": "folder_name string, n long, word string", "fts_docs": "folder_name string, doc string, dl long"}


def begun(spark, path, buckets=4):
    out = Tables(spark, f"file://{path}", SCHEMAS)
    if not out.load():
        out.state["config"] = {"first_buckets": str(buckets), "buckets": str(buckets)}
        out.commit(dict(out.state["config"]))
    return out


def rows_of(table):
    return sorted(tuple(r) for r in table.table("t").collect())


def test_changes_merges_and_splits_keep_the_newest_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DELTAS", 3)
    rng, held, store = random.Random(3), {}, begun(spark, tmp_path)
    merged = 0
    for step in range(8):
        rows = [(f"f{rng.randrange(40)}", step * 100 + k, "x" * 50) for k in range(60 if step == 0 else 6)]
        gone = {f"f{rng.randrange(40)}" for _ in range(3)} - {r[0] for r in rows}
        store.put("t", spark.createDataFrame(rows, SCHEMAS["t"]), spark.createDataFrame([(g,) for g in gone], "folder_name string"))
        for f in {r[0] for r in rows} | gone:
            held[f] = [r for r in rows if r[0] == f]
        store.commit()
        want = sorted(r for of in held.values() for r in of)
        assert rows_of(store) == want
        merged += store.compact()
        assert rows_of(store) == want == rows_of(begun(spark, tmp_path))
    assert merged > 4 and all(len(p) <= 4 for p in store.parts("t").values())
    # Some folders go for good, then buckets are split: one by one, and all that are left.
    for buckets in (5, 8, 11):
        store.split(buckets)
        assert store.buckets == buckets and rows_of(store) == want == rows_of(begun(spark, tmp_path))
        for b in store.parts("t"):
            assert all(r["b"] == b for r in store.table("t", [b]).select(store.bucket().alias("b")).collect())
    store.put("t", spark.createDataFrame([("f1", -1, "new")], SCHEMAS["t"]))
    store.commit()
    assert [r for r in rows_of(store) if r[0] == "f1"] == [("f1", -1, "new")]
    with pytest.raises(ValueError, match="can't become"):
        store.split(40)
    before = rows_of(store)
    assert store.vacuum(-1.0) > 0 and store.vacuum(-1.0) == 0 and rows_of(store) == before


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    store = begun(spark, tmp_path, 2)
    store.put("t", spark.range(2000).select(F.concat(F.lit("f"), "id").alias("folder_name"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("word")))
    store.commit()
    monkeypatch.setattr(tables, "SPLIT", 40_000)
    while store.compact():
        pass
    sizes = [sum(p.bytes for p in parts) for parts in store.parts("t").values()]
    assert store.buckets >= 6 and max(sizes) < 4 * 40_000 and store.table("t").count() == 2000


def test_a_small_change_writes_little_whatever_lies_there(spark, tmp_path):
    written = {}
    for n in (100, 10_000):
        store = begun(spark, tmp_path / str(n))
        store.put("t", spark.range(n).select(F.concat(F.lit("f"), "id").alias("folder_name"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("word")))
        store.commit()
        before = store.files.size("")
        store.put("t", spark.createDataFrame([("f5", 1, "changed")], SCHEMAS["t"]))
        store.commit()
        written[n] = store.files.size("") - before
    assert written[10_000] < 1.2 * written[100] < 10_000


def test_writers_at_once(spark, tmp_path):
    store = begun(spark, tmp_path, 8)
    one = lambda name: spark.createDataFrame([(name, 1, "")], SCHEMAS["t"])
    place = {b: f for f, b in ((r["f"], r["b"]) for r in spark.createDataFrame([(f"f{k}",) for k in range(60)], "f string").select("f", store.bucket("f").alias("b")).collect())}
    a, b, c = (begun(spark, tmp_path) for _ in range(3))
    a.put("t", one(place[0]))
    b.put("t", one(place[1]))
    c.put("t", one(place[0]))
    a.commit()
    b.commit({"bookmark": "1"})  # goes on beside the other
    with pytest.raises(Conflict):
        c.commit()
    assert {r[0] for r in rows_of(begun(spark, tmp_path))} == {place[0], place[1]}
    d, e = begun(spark, tmp_path), begun(spark, tmp_path)
    d.put("t", one(place[2]))
    d.commit({"bookmark": "2"})
    e.put("t", one(place[3]))
    with pytest.raises(Conflict):  # what is told of the source has changed meanwhile
        e.commit({"bookmark": "3"})
    e.load()
    e.put("t", one(place[3]))
    e.commit({"bookmark": "3"})
    f, g = begun(spark, tmp_path), begun(spark, tmp_path)
    f.split(9)
    g.put("t", one(place[4]))
    with pytest.raises(Conflict):
        g.commit()
    assert len(rows_of(begun(spark, tmp_path))) == 4
    # Each number is taken once, and whole states stand in for commits.
    assert sum(begun(spark, tmp_path).files.create("other/x.json", b"x") for _ in range(3)) == 1
    for k in range(tables.STATES):
        f.commit({"k": str(k)})
    f.vacuum(-1.0)
    assert len(os.listdir(tmp_path / "commits")) < tables.STATES and rows_of(begun(spark, tmp_path)) == rows_of(f)


TEXTS = "folder_name string, doc string, a string, b string"


def indexed(spark, store, rows, gone=()):
    segments.put(store, "fts", spark.createDataFrame([(r[0].split("/")[0], *r) for r in rows], TEXTS), ["a", "b"], porter_tokens, spark.createDataFrame([(g,) for g in gone], "folder_name string"))
    store.commit()


def test_segments_are_a_fresh_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET", 500)  # several buckets in small segments
    rng, store, held = random.Random(8), begun(spark, tmp_path), {}
    words = "running runs group groups corporate notify queue queues bull pricing tiers happy day".split()
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(n)))
    t = lambda w, **o: search.term(stem(w), **o)
    queries = [t("queue"), t("queue") | t("day"), t("que", prefix=True), search.Phrase((stem("corporate"), stem("group"))), search.Near(t("bull"), t("day"), most=2), t("bull") - t("happy"), t("none")]

    def agrees():
        fresh = search.Index.of(spark.createDataFrame([(k, *v) for k, v in held.items()], "doc string, a string, b string"), "doc", ["a", "b"], porter_tokens)
        kept = segments.Segments.open(store, "fts", ["a", "b"])
        assert (kept.facts.documents, kept.facts.tokens) == tuple(fresh.lengths.agg(F.count(F.lit(1)), F.sum("dl")).first())
        for q in queries:
            want = {r["doc"]: r["bm25"] for r in search.bm25(fresh, q).collect()}
            assert {r["doc"]: r["bm25"] for r in search.bm25(kept, q).collect()} == pytest.approx(want, abs=1e-12)
            best = sorted((v, k) for k, v in want.items())[:3]
            assert [(r["bm25"], r["doc"]) for r in search.top(kept, q, 3).collect()] == [(pytest.approx(v, abs=1e-12), k) for v, k in best]
        return kept

    def write(names, gone=()):
        rows = [(f"{f}/{k}", text(30), text(5) or None) for f in names for k in range(rng.randrange(1, 4))]
        for f in [*names, *gone]:
            for doc in [d for d in held if d.split("/")[0] == f]:
                del held[doc]
        held.update({r[0]: r[1:] for r in rows})
        indexed(spark, store, rows, gone)

    write([f"f{k}" for k in range(30)])
    write([f"g{k}" for k in range(3)])
    kept = agrees()
    assert kept.tiers([stem("queue")], 10.0) != {}  # nothing is replaced yet
    found = kept.of_terms([search.Atom(stem("queue"))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[isnotnull\(bucket|PartitionFilters: \[bucket", plan)) == 2 == len({r["f"].split("/postings/")[0] for r in found.select(F.input_file_name().alias("f")).collect()})
    assert max(s["buckets"] for s in kept.parts()) > 1
    write(["f1", "f2", "g1"], ["f3"])
    assert agrees().tiers([stem("queue")], 10.0) == {}
    write(["h1", "f1"])
    assert segments.merge(store, "fts") == 4
    store.commit()
    assert len(agrees().parts()) == 1 and agrees().tiers([stem("queue")], 10.0) != {}
    write(["f3", "f4"])
    agrees()
    assert segments.merge(store, "fts") == 0 and store.vacuum(-1.0) >= 4
    agrees()


def test_ingests_at_once_lose_nothing(spark, tmp_path):
    f = Fixture(tmp_path)
    for k in range(4):
        f.add(str(k), f"2026-05-1{k}T00:00:00", f"text number {k}", audio=b"same" if k < 2 else b"")
    at = str(tmp_path / "archive")
    ingest(Archive.open(spark, at, buckets=8), f.db, f.folder, embed, dims=8)
    first, second = Archive.open(spark, at), Archive.open(spark, at)
    f.add("5", "2026-05-20T00:00:00", "newest take", audio=b"same")
    ingest(first, f.db, f.folder, embed, dims=8)
    f.add("6", "2026-05-21T00:00:00", "even newer take", audio=b"same")
    with pytest.raises(Conflict):  # decided on what was there before
        _ingested(second, f.db, f.folder, embed, dims=8)
    second.load()
    out = ingest(second, f.db, f.folder, embed, dims=8)
    assert (out.new_rows, out.updated_rows) == (1, 0)
    # Two threads at once, from the same state.
    f.add("7", "2026-05-22T00:00:00", "one more")
    errors = []

    def run():
        try:
            ingest(Archive.open(spark, at), f.db, f.folder, embed, dims=8)
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    archive = Archive.open(spark, at, readonly=True)
    rows = {r["folder_name"]: r for r in archive.table("recording").collect()}
    assert not errors and sorted(rows) == ["0", "1", "2", "3", "5", "6", "7"] and archive.checks()["no_orphans"]
    assert {k for k, r in rows.items() if r["superseded_by"]} == {"0", "1", "5"} and rows["5"]["superseded_by"] == "6"
    assert {r["doc"] for r in search.bm25(archive.index(), search.term(stem("take"))).collect()} == {"5", "6"}
    assert {r["folder_name"] for r in archive.table("recording_vec").collect()} == {"2", "3", "6", "7"}


def test_supersedence_is_kept_up_by_hash(spark, tmp_path):
    """Marks after some ingests are those of a full pass; an ingest reads the rows of its audio hashes alone."""
    rng = random.Random(9)
    f = Fixture(tmp_path)
    archive = Archive.open(spark, str(tmp_path / "archive"), buckets=16)
    day = 1
    for step in range(3):
        for k in range(6 if step == 0 else 3):
            f.add(f"{step}-{k}", f"2026-01-{day:02}T0{rng.randrange(10)}:00:00", f"text {k}", audio=rng.choice([b"a", b"b", b"c", b""]))
        day += 1
        if step == 1:
            (tmp_path / "recordings/0-0/output.wav").write_bytes(b"b")
        ingest(archive, f.db, f.folder, now=f"2026-02-0{step + 1}T00:00:00.000Z")
        rows = archive.table("recording")
        full = {r["folder_name"]: r["superseded_by"] for r in superseded(rows).collect()}
        kept = {r["folder_name"]: (r["superseded_by"], r["superseded_at"]) for r in rows.collect()}
        assert {k: v[0] for k, v in kept.items()} == full and all((by is None) == (at is None) for by, at in kept.values())
        side = {r["folder_name"]: (r["superseded_by"], r["superseded_at"]) for r in archive.table("recording_audio").collect()}
        assert side == {k: v for k, v in kept.items() if k in side} and {r["folder_name"] for r in rows.filter("audio_hash is not null").collect()} == side.keys()
    assert any(full.values())
    changes = spark.createDataFrame([("9", "2026-03-01T00:00:00", hashlib.sha1(b"a").hexdigest(), True)], "folder_name string, datetime string, audio_hash string, came boolean")
    changes = changes.withColumns({c: F.lit(None).cast("string") for c in ("audio_hash_was", "superseded_by", "superseded_at")})
    seen = []
    table = archive.table
    archive.table = lambda name, buckets=None: (seen.append((name, buckets)), table(name, buckets))[1]
    group = archive_module._regrouped(archive, changes, "2026-03-02T00:00:00.000Z").collect()
    assert seen == [("recording_audio", seen[0][1])] and len(seen[0][1]) == 1 and {r["audio_hash"] for r in group} == {hashlib.sha1(b"a").hexdigest()}
    assert {r["superseded_by"] for r in group if r["folder_name"] != "9"} <= {"9"}


def test_late_and_edited_rows_arrive(spark, tmp_path):
    f = Fixture(tmp_path)
    for k in range(1, 9):
        f.add(str(k), f"2026-05-1{k}T00:00:00", f"text number {k}")
    at = str(tmp_path / "archive")
    run = lambda **o: ingest(Archive.open(spark, at, buckets=16), f.db, f.folder, **o)
    assert run().new_rows == 8 and run(whole=True).ranges == 0
    f.add("late", "2026-01-01T00:00:00", "came late")
    with sqlite3.connect(f.db) as db:
        db.execute("UPDATE recording_fts SET rawResult = 'edited silently', result = 'edited silently' WHERE rawResult = 'text number 3'")
        db.execute("DELETE FROM recording WHERE folderName = '5'")
    assert run().new_rows == 0  # the bookmark is later
    archive = Archive.open(spark, at)
    read, table = [], Archive.table
    try:
        Archive.table = lambda self, name, buckets=None: (read.append(buckets) if name == reconcile.TABLE else None, table(self, name, buckets))[1]
        out = run(whole=True)
    finally:
        Archive.table = table
    assert (out.new_rows, out.updated_rows, out.ranges) == (1, 1, 3) and read and all(b is not None and len(b) <= 3 for b in read)
    archive = Archive.open(spark, at)
    rows = {r["folder_name"]: r["raw_result"] for r in archive.table("recording").collect()}
    assert rows["late"] == "came late" and rows["3"] == "edited silently" and len(rows) == 9
    assert {r["doc"] for r in search.bm25(archive.index(), search.term(stem("silently"))).collect()} == {"3"}
    assert run(whole=True).ranges == 0 and archive.state["facts"][reconcile.TABLE] == reconcile.sums(archive.table(reconcile.TABLE))
    for n in (16, 17, 31, 32, 48):
        archive.state["config"] |= {"buckets": str(n)}
        pairs = spark.range(3000).select(F.col("id").cast("string").alias("folder_name")).select(archive.bucket().alias("b"), reconcile.range_of().alias("r")).distinct().collect()
        assert all(p["b"] in reconcile.buckets_of(archive, [p["r"]]) for p in pairs) and len(reconcile.buckets_of(archive, [7])) <= 3


def test_a_very_long_text_is_chunked_by_parts(spark, tmp_path, monkeypatch):
    f = Fixture(tmp_path)
    text = " ".join(f"w{k}." if k % 17 == 0 else f"w{k}" for k in range(1500))
    f.add("1", "2026-05-18T08:30:00", text)
    monkeypatch.setattr(archive_module, "LONG", 1000)
    ingest(archive := Archive.open(spark, str(tmp_path / "archive")), f.db, f.folder, embed, dims=8)
    found = sorted((r["chunk_idx"], r["start_word"], r["end_word"]) for r in archive.table("recording_chunk").collect())
    assert found == [(k, a, b) for k, (a, b) in enumerate(spans(text.split()))] and archive.table("recording_chunk_vec").count() == len(found)


def test_archive_on_a_store_that_only_spark_reads(spark, tmp_path):
    (tmp_path / "store").mkdir()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.kept.link./a", f"file://{tmp_path}/store")
    f = Fixture(tmp_path)
    f.add("1", "2026-05-18T08:30:00", "some words here")
    at = "viewfs://kept/a/archive"
    assert ingest(Archive.open(spark, at), f.db, f.folder, embed, dims=8).new_rows == 1
    f.add("2", "2026-05-19T08:30:00", "other words")
    assert ingest(Archive.open(spark, at), f.db, f.folder, embed, dims=8).new_rows == 1
    archive = Archive.open(spark, at, readonly=True)
    assert {r["doc"] for r in search.bm25(archive.index(), search.term("word")).collect()} == {"1", "2"}
    again = Archive.open(spark, at)
    again.state["number"] -= 1
    with pytest.raises(Conflict):
        again.staged = {"tables": {"recording": {str(b): {"drop": [], "add": []} for b in range(64)}}}
        again.commit()
    assert sqlite3.connect(f.db).execute("SELECT count(*) FROM recording").fetchone() == (2,)
