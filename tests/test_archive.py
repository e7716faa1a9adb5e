import json
import os
import sqlite3
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import ParseException

from lectern.functions.text import stem
from lectern.operators import search
from lectern.operators.archive import MARKS, Archive, Change, ingest, migrated, updated
from lectern.operators.chunks import Strategy
from lectern.operators.vectors import blob_literal, cosine_distance, embedded, from_blob, stub_vector, to_blob
from lectern.plans.render import render
from lectern.sources import sqlite as source
from lectern.sources.embedding import EmbeddingService
from lectern.streaming import watch


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def embed(texts):
    return [stub_vector(t, 8) for t in texts]


class Fixture:
    def __init__(self, top):
        self.db, self.folder = str(top / "source.sqlite"), str(top / "recordings")
        (top / "recordings").mkdir()
        with sqlite3.connect(self.db) as db:
            db.execute("CREATE TABLE recording (id BLOB PRIMARY KEY, datetime TEXT, duration REAL, modeName TEXT, modelKey TEXT, modelName TEXT, languageModelKey TEXT, languageModelName TEXT, recordingDevice TEXT, rawWordCount INTEGER, llmWordCount INTEGER, folderName TEXT UNIQUE, appVersion TEXT)")
            db.execute("CREATE TABLE recording_fts (recordingId BLOB, llmResult TEXT, rawResult TEXT, result TEXT)")
        self.top = top

    def add(self, name, at, raw, llm=None, audio=b"", meta=True, language="en"):
        with sqlite3.connect(self.db) as db:
            db.execute("INSERT OR REPLACE INTO recording VALUES (?, ?, 1500, 'Meeting', 'k', NULL, NULL, NULL, NULL, ?, ?, ?, '1')", (name.encode().ljust(16, b"0"), at, len(raw.split()), len((llm or "").split()), name))
            db.execute("INSERT INTO recording_fts VALUES (?, ?, ?, ?)", (name.encode().ljust(16, b"0"), llm, raw, llm or raw))
        folder = self.top / "recordings" / name
        folder.mkdir(exist_ok=True)
        if meta:
            (folder / "meta.json").write_text(json.dumps({"promptContext": {"modeContext": {"language": language}, "applicationContext": {"name": "", "category": "x"}}, "other": [1]}) if meta is True else meta)
        if audio:
            (folder / "output.wav").write_bytes(audio)


def test_ingest_life(spark, tmp_path):
    f = Fixture(tmp_path)
    long = " ".join(f"w{k}" for k in range(700))
    f.add("100", "2026-05-18T08:30:00", "short words here", audio=b"same")
    f.add("200", "2026-05-17 15:12:33.470", long, audio=b"other")
    f.add("300", "2026-05-16T09:00:00Z", "an older take", audio=b"same", meta="{broken")
    archive = Archive.open(spark, str(tmp_path / "archive"))
    out = ingest(archive, f.db, f.folder, embed, dims=8, now="2026-06-01T00:00:00.000Z")
    assert (out.new_rows, out.updated_rows, out.embedded, out.fast_path) == (3, 0, 2, False)
    rows = {r["folder_name"]: r for r in archive.table("recording").collect()}
    assert rows["300"]["superseded_by"] == "100" and rows["300"]["language"] is None and rows["100"]["app_name"] == ""
    assert rows["100"]["recording_id_hex"] == b"100".ljust(16, b"0").hex().upper()
    chunks = archive.table("recording_chunk").collect()
    assert {c["folder_name"] for c in chunks} == {"200"} and archive.table("recording_chunk_vec").count() == len(chunks)
    centre = next(r["embedding"] for r in archive.table("recording_vec").collect() if r["folder_name"] == "200")
    assert np.linalg.norm(centre) == pytest.approx(1, abs=1e-4)
    assert ingest(archive, f.db, f.folder, embed, dims=8).fast_path
    # The latest take goes, so the older one returns; a new one comes; one loses its audio, one its source.
    (tmp_path / "recordings/100/output.wav").unlink()
    f.add("400", "2026-05-19T00:00:00", "the newest", audio=b"same")
    with sqlite3.connect(f.db) as db:
        db.execute("DELETE FROM recording WHERE folderName = '200'")
    (tmp_path / "recordings/200/meta.json").unlink()
    out = ingest(Archive.open(spark, str(tmp_path / "archive")), f.db, f.folder, embed, dims=8, now="2026-06-02T00:00:00.000Z")
    assert (out.new_rows, out.updated_rows, out.source_deletions) == (1, 0, 1)
    archive = Archive.open(spark, str(tmp_path / "archive"), readonly=True)
    rows = {r["folder_name"]: r for r in archive.table("recording").collect()}
    assert rows["100"]["superseded_by"] == rows["300"]["superseded_by"] == "400"
    assert rows["300"]["superseded_at"] == "2026-06-01T00:00:00.000Z" and rows["100"]["embed_model"] is None
    assert rows["200"]["source_deleted_at"] == "2026-06-02T00:00:00.000Z" and rows["100"]["has_audio"] == 0 and rows["100"]["source_audio_lost_at"]
    assert {r["folder_name"] for r in archive.table("recording_vec").collect()} == {"200", "400"}
    found = archive.sql("SELECT folder_name, duration_sec FROM recording WHERE mode_name_lower = :mode ORDER BY folder_name;", {"mode": "meeting"})
    assert list(render(found.limit(1), "markdown")) == ["| folder_name | duration_sec |", "|---|---|", "| 100 | 1.5 |"]
    assert list(render(found.limit(1))) == ["100|1.5"] and json.loads("".join(render(found, "json")))[0] == {"folder_name": "100", "duration_sec": 1.5}
    assert archive.sql("SELECT count(*) AS n FROM v_search", refresh=lambda: 1 / 0).first()["n"] == 4
    with pytest.raises(ParseException):
        archive.sql("DROP VIEW recording")
    assert set(archive.checks().items()) == {(k, True) for k in ("data_version", "schema_version", "chunks", "vectors", "no_orphans")}
    assert archive.sizes()["recording"] == 4 and archive.sql("SELECT vec_length(embedding) AS n FROM recording_vec LIMIT 1").first()["n"] == 8
    matches = lambda word, table="recording": {r["doc"] for r in search.bm25(archive.index(table), search.term(stem(word))).collect()}
    assert matches("newest") == {"400"} and matches("short") == {"100"} and len(matches("w690", "recording_chunk")) == 1


def test_sources(spark, tmp_path):
    f = Fixture(tmp_path)
    for k, at in enumerate(["2026-05-27 18:39:33.470", "2026-05-27T18:39:33.470Z", "2026-05-27T18:39:34", "nonsense"]):
        f.add(str(k), at, "x")
    assert {r["folder_name"] for r in source.source_recordings(spark, f.db, "2026-05-27T18:39:33.999Z").collect()} == {"2"}
    assert source.source_recordings(spark, f.db).count() == 4
    assert source.source_folders(spark, str(tmp_path / "none")).count() == 0 and source.modified(str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        Archive.open(spark, str(tmp_path / "none"), readonly=True)
    with sqlite3.connect(f.db) as db:
        db.execute("UPDATE recording SET modeName = NULL WHERE folderName = '1'")
    with pytest.raises(Exception, match="mode_name is null"):
        source.source_recordings(spark, f.db).collect()


def test_vectors(spark):
    v = [0.6, 0.8, 0.0]
    table = spark.createDataFrame([(1, v), (2, [0.0, 0.0, 0.0]), (3, None), (4, [-0.6, -0.8, 0.0])], "id int, embedding array<double>")
    got = {r["id"]: r["d"] for r in table.select("id", cosine_distance(table["embedding"], v).alias("d")).collect()}
    assert got[1] == pytest.approx(0, abs=1e-12) and got[2] is None and got[3] is None and got[4] == pytest.approx(2)
    back = table.filter("id = 1").select(from_blob(to_blob(table["embedding"])).alias("v")).first()["v"]
    assert back == pytest.approx(v) and blob_literal([1.0]) == "x'0000803F'"
    texts = spark.createDataFrame([("a",), ("b",)], "embed_text string")
    assert embedded(texts, embed).count() == 2
    with pytest.raises(Exception, match="vectors for"):
        embedded(texts, lambda texts: []).collect()


def test_what_makes_rows_dirty(spark, tmp_path):
    """Model and strategy switches, skipped embedding, a long text that becomes short; only touched buckets are written."""
    f = Fixture(tmp_path)
    long = " ".join(f"w{k}" for k in range(700))
    for k in range(6):
        f.add(str(k), f"2026-05-1{k}T00:00:00", long if k == 3 else f"text number {k}")
    at = str(tmp_path / "archive")
    run = lambda *a, **o: ingest(Archive.open(spark, at, buckets=16), f.db, f.folder, *a, dims=8, **o)
    first = run()
    archive = Archive.open(spark, at)
    assert (first.new_rows, first.embedded) == (6, 0) and archive.table("recording_vec").count() == 0 and archive.config("embed_model") is None
    assert run().fast_path  # nothing to embed with
    assert run(embed).embedded == 6 and run(embed).fast_path
    switched = run(embed, model="other")
    archive = Archive.open(spark, at)
    assert switched.model_switched and switched.embedded == 6 and {r["embed_model"] for r in archive.table("recording").collect()} == {"other"}
    before = archive.table("recording_chunk").count()
    assert run(embed, model="other", strategy=Strategy(size=100, overlap=10)).embedded >= 1
    archive = Archive.open(spark, at)
    assert archive.table("recording_chunk").count() > before and archive.checks()["no_orphans"]
    f.add("3", "2026-05-20T00:00:00", "short now")
    with sqlite3.connect(f.db) as db:
        db.execute("DELETE FROM recording_fts WHERE recordingId = ? AND rawResult LIKE 'w0 %'", (b"3".ljust(16, b"0"),))
    parts = archive.parts("recording")
    out = run(embed, model="other", strategy=Strategy(size=100, overlap=10))
    archive = Archive.open(spark, at)
    assert (out.new_rows, out.updated_rows, out.embedded, out.buckets_written) == (0, 1, 1, 1) and archive.table("recording_chunk").count() == 0
    changed = {b for b, now in archive.parts("recording").items() if parts.get(b) != now}
    assert len(changed) == 1 and archive.table("recording").count() == archive.table("recording_vec").count() == 6
    assert archive.vacuum(0.0) > 0 and archive.table("recording").count() == 6 and archive.vacuum(0.0) == 0
    assert not [p for p in (tmp_path / "archive/.snapshots").iterdir()] and not list((tmp_path / "archive/.work").iterdir())


def test_updaters_and_migrations(spark, tmp_path):
    f = Fixture(tmp_path)
    f.add("1", "2026-05-18T08:30:00", "one")
    archive = Archive.open(spark, str(tmp_path / "archive"))
    ingest(archive, f.db, f.folder, embed, dims=8)
    ran = []

    def fails(archive):
        raise RuntimeError("not yet")

    changes = [Change(8, "b", lambda a: ran.append(8)), Change(7, "a", lambda a: ran.append(7)), Change(9, "c", fails), Change(2, "old", lambda a: ran.append(2))]
    with pytest.raises(RuntimeError, match="not yet"):
        updated(archive, changes)
    assert ran == [7, 8] and Archive.open(spark, archive.path).config("data_version") == "8"
    assert updated(archive, changes[:2]) is False and ran == [7, 8]
    later = [(Change(1, "louder", lambda rows: rows.withColumn("mode_name", rows["folder_name"])), "recording"), (Change(2, "again", lambda rows: rows), "recording_vec")]
    assert migrated(archive, later) and not migrated(archive, later)
    again = Archive.open(spark, archive.path)
    assert again.config("schema_version") == "2" and [r["mode_name"] for r in again.table("recording").collect()] == ["1"] and again.config("embed_dim") == "8"
    assert Archive.open(spark, str(tmp_path / "other")).config("embed_dim") == "1024"
    assert set(MARKS) < set(again.table("recording").columns)


def test_snapshots(tmp_path, monkeypatch):
    f = Fixture(tmp_path)
    f.add("1", "2026-05-18T08:30:00", "one")
    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "snapshot-old.sqlite").write_text("x")
    os.utime(folder / "snapshot-old.sqlite", (1, 1))
    (folder / "snapshot-new.sqlite").write_text("x")
    with source.snapshot(f.db, str(folder)) as copy, sqlite3.connect(copy) as db:
        assert db.execute("SELECT count(*) FROM recording").fetchone() == (1,)
    assert [p.name for p in folder.iterdir()] == ["snapshot-new.sqlite"]
    real, tries = source.shutil.copyfile, []

    def sometimes(a, b):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return real(a, b)

    monkeypatch.setattr(source.sqlite3, "connect", lambda *a, **o: (_ for _ in ()).throw(sqlite3.OperationalError("locked")))
    monkeypatch.setattr(source.shutil, "copyfile", sometimes)
    with source.snapshot(f.db, str(folder)) as copy:
        assert os.path.getsize(copy) == os.path.getsize(f.db) and len(tries) == 3
    with pytest.raises(FileNotFoundError):
        source.snapshot(str(tmp_path / "none"), str(folder)).__enter__()


def test_embedding_service():
    answers, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def _say(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._say(200, {"models": [{"name": "m:latest"}, {"model": "exact"}]})

        def do_POST(self):
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._say(*answers.pop(0))

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        host = f"http://127.0.0.1:{server.server_port}"
        service = EmbeddingService(host, "m", pause=0.01)
        good = {"embeddings": [[1.0, 2.0], [3.0, 4.0]]}
        answers[:] = [(500, {}), (429, {}), (200, good)]
        assert [v.tolist() for v in service(["a", "b"])] == good["embeddings"] and len(asked) == 3
        assert asked[0] == {"model": "m", "input": ["a", "b"], "keep_alive": "15m"} and service([]) == []
        answers[:] = [(404, {})]
        with pytest.raises(OSError):
            service(["a"])
        answers[:] = [(503, {})] * 4
        with pytest.raises(OSError):
            service(["a"])
        assert not answers
        answers[:] = [(200, good)]
        with pytest.raises(ValueError, match="2 vectors for 1"):
            service(["a"])
        assert service.check() is None and EmbeddingService(host, "exact").check() is None and "doesn't hold" in EmbeddingService(host, "none").check()
    finally:
        server.shutdown()
    assert "can't be reached" in EmbeddingService("http://127.0.0.1:1", "m").check()


def test_formats(spark):
    rows = spark.createDataFrame([("a", 1), (None, 20)], "name string, n int").orderBy("n")
    assert list(render(rows, "column")) == ["name  n", "----  --", "a     1", "      20"]
    assert list(render(rows, "box")) == ["┌──────┬────┐", "│ name │ n  │", "├──────┼────┤", "│ a    │ 1  │", "│      │ 20 │", "└──────┴────┘"]


def test_watch_waits_for_quiet_and_goes_on_after_a_failure(spark, tmp_path):
    f = Fixture(tmp_path)
    calls = []

    def refresh():
        calls.append(time.monotonic())
        if len(calls) == 2:
            raise RuntimeError("once")

    def until(n):
        end = time.monotonic() + 60
        while len(calls) < n and time.monotonic() < end:
            time.sleep(0.05)
        return len(calls) >= n

    query = watch.watch(spark, f.folder, refresh, f"file://{tmp_path}/checkpoint", 1.0, f.db, 0.1)
    try:
        time.sleep(3)
        for k in range(4):  # each change sets the waiting back: one refresh for all
            f.add(f"{k}", "2026-01-01", "x")
            last = time.monotonic()
            time.sleep(0.4)
        assert until(2) and len(calls) == 2 and calls[1] >= last + 0.9
        (tmp_path / "recordings/1/meta.json").write_text("{}")  # rewritten, not new
        assert until(3)
        with sqlite3.connect(f.db) as db:
            db.execute("DELETE FROM recording WHERE folderName = '1'")
        assert until(4) and query.isActive
        time.sleep(2)
        assert len(calls) == 4
    finally:
        query.stop()
    with pytest.raises(FileNotFoundError):
        watch.watch(spark, str(tmp_path / "none"), refresh, "x")


def test_watch_tells_after_a_restart_what_was_waiting(spark, tmp_path):
    f = Fixture(tmp_path)
    f.add("1", "2026-01-01", "x")
    calls = []
    run = lambda seconds: watch.watch(spark, f"file://{f.folder}", lambda: calls.append(time.monotonic()), f"file://{tmp_path}/checkpoint", seconds, f.db, 0.1, 3)
    query = run(20.0)
    try:
        end = time.monotonic() + 60
        while not query.lastProgress and time.monotonic() < end:
            time.sleep(0.1)
        f.add("2", "2026-01-01", "x")
        batches, changed = query.lastProgress["batchId"], time.monotonic()
        while query.lastProgress["batchId"] < batches + 2 and time.monotonic() < end:
            time.sleep(0.1)
    finally:
        query.stop()
    assert len(calls) == 1
    query = run(600.0)  # what changed before is told when it was to be, though nothing changes any more
    try:
        end = time.monotonic() + 60
        while len(calls) < 3 and time.monotonic() < end:
            time.sleep(0.1)
    finally:
        query.stop()
    assert len(calls) == 3 and calls[2] >= changed + 19


def test_files_are_listed_by_tasks(spark, tmp_path):
    f = Fixture(tmp_path)
    for k in range(20):
        f.add(str(k), "2026-01-01", "x", audio=b"a" if k % 2 else b"")
    spark.dataSource.register(watch.ListingSource)
    listing = spark.read.format("recording_files").option("path", f.folder).option("shares", "5").option("database", f.db).load()
    rows = {r["share"]: r for r in listing.collect()}
    assert sorted(rows) == [-1, 0, 1, 2, 3, 4] and sum(r["files"] for r in rows.values()) == 30 and "source.sqlite" in rows[-1]["digest"]
    (tmp_path / "recordings/7/output.wav").write_bytes(b"other")
    again = {r["share"]: r for r in listing.collect()}
    assert sum(rows[k]["digest"] != again[k]["digest"] for k in rows) == 1
