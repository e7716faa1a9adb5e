"""The archive: append-only tables on shared storage, and what an ingest does to them.

Tables are kept as ``tables`` says, keyword indexes as ``segments`` does: an ingest writes the rows that change, and a
commit makes them valid at once. An ingest that fails changes nothing, one that is run again repeats no effect, and of
two at once the later decides anew what the other's rows bear on. Rows are never deleted.

Marks (deletions, audio, supersedence) are decided on the few columns that they depend on; texts are read only of rows
that are written.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import sql as functions
from lectern.functions.text import porter_tokens
from lectern.operators import reconcile, segments
from lectern.operators.chunks import LONG, Strategy, chunked, chunked_by_parts
from lectern.operators.recordings import body, parsed_time, with_derived
from lectern.operators.supersede import superseded
from lectern.operators.tables import Conflict, Tables
from lectern.operators.vectors import centroids, embedded
from lectern.sources import folders, sqlite

log = logging.getLogger(__name__)

TEXT_COLUMNS = ("model_key", "model_name", "language_model_key", "language_model_name", "recording_device", "result", "llm_result", "raw_result")
RECORDING = (
    "folder_name string, recording_id_hex string, datetime string, duration_ms double, mode_name string, "
    + ", ".join(f"{c} string" for c in TEXT_COLUMNS)
    + ", raw_word_count long, llm_word_count long, language string, app_name string, app_category string, has_audio int, meta_path string, audio_path string, "
    "source_deleted_at string, source_audio_lost_at string, indexed_at string, embed_model string, embed_dim int, embed_text_hash string, "
    "audio_hash string, superseded_by string, superseded_at string"
)
CHUNK = "folder_name string, chunk_idx int, text string, start_word int, end_word int, word_count int, chunk_id long, body_hash string"
_DOCUMENTS = "folder_name string, doc string, dl long"
SCHEMAS = {
    "recording": RECORDING,
    "recording_vec": "folder_name string, embedding array<float>",
    "recording_chunk": CHUNK,
    "recording_chunk_vec": "chunk_id long, folder_name string, embedding array<float>",
    # Which recordings have the same audio, by its hash, with what their rows say of it.
    "recording_audio": "audio_hash string, folder_name string, datetime string, superseded_by string, superseded_at string",
    # Digests of the source's rows as they were taken.
    reconcile.TABLE: reconcile.SCHEMA,
    # The documents of the keyword indexes of recordings and of chunks, and their lengths.
    "recording_fts_docs": _DOCUMENTS,
    "recording_chunk_fts_docs": _DOCUMENTS,
}
KEYS = {"recording_audio": ("audio_hash", "folder_name")}
#: The columns that a keyword index covers.
INDEXED = {"recording": ["raw_transcript", "processed_transcript"], "recording_chunk": ["text"]}
KEPT_ON_UPDATE = ("recording_id_hex", "source_deleted_at", "source_audio_lost_at", "embed_model", "embed_dim", "embed_text_hash", "audio_hash", "superseded_by", "superseded_at")
FILLED_ON_UPDATE = ("language", "app_name", "app_category")
#: What an ingest may change in rows that the source doesn't bring anew.
MARKS = ("has_audio", "source_deleted_at", "source_audio_lost_at", "audio_hash", "superseded_by", "superseded_at")
#: Buckets of a new archive's tables.
BUCKETS = 64
#: How often an ingest decides anew when another one has come between.
TRIES = 5

Embedder = Callable[[list[str]], list[np.ndarray]]


def columns_of(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


@dataclass
class Outcome:
    fast_path: bool = False
    new_rows: int = 0
    updated_rows: int = 0
    embedded: int = 0
    source_deletions: int = 0
    audio_changes: int = 0
    model_switched: bool = False
    buckets_written: int = 0
    ranges: int = 0  # of the source that differed from the archive
    seconds: float = 0.0


class Archive(Tables):
    @classmethod
    def open(cls, spark: SparkSession, path: str, readonly: bool = False, buckets: int = BUCKETS, dims: int = 1024) -> Archive:
        """The archive at ``path`` (any path or URI that Spark reads); a new one is begun unless ``readonly``."""
        archive = cls(spark, path.rstrip("/"), SCHEMAS, KEYS)
        if not archive.load() and readonly:
            raise FileNotFoundError(f"no archive at {path}")
        config = archive.state["config"]
        config.setdefault("first_buckets", str(buckets))
        config.setdefault("buckets", config["first_buckets"])
        config.setdefault("embed_dim", str(dims))
        if not archive.state["tables"].get("recording"):  # nothing yet that updates or migrations could change
            config.setdefault("data_version", str(latest(UPDATERS)))
            config.setdefault("schema_version", str(latest(MIGRATIONS)))
        return archive

    def commit(self, config: dict[str, str] | None = None) -> int:
        first = dict(self.state["config"]) if not self.state["number"] else {}  # an archive's first commit tells how it was begun
        return super().commit(first | (config or {}))

    @contextmanager
    def work(self) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
        """A function that writes a table for the time of the block, in the archive's own folder."""
        name = f".work/{uuid.uuid4().hex}"

        def written(step: str, rows: DataFrame) -> DataFrame:
            rows.write.parquet(f"{self.path}/{name}/{step}")
            return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/{step}")

        try:
            yield written
        finally:
            self.files.delete(name)

    def config(self, key: str) -> str | None:
        return self.state["config"].get(key)

    def index(self, table: str = "recording") -> segments.Segments:
        """The keyword index of ``recording`` or ``recording_chunk``, kept up by each ingest."""
        return segments.Segments.open(self, f"{table}_fts", INDEXED[table])

    def upkeep(self) -> None:
        """Merges what many small ingests have written, and removes what is no longer read."""
        for table in INDEXED:
            if segments.merge(self, f"{table}_fts"):
                try:
                    self.commit()
                except Conflict:  # a later ingest merges them
                    self.load()
        self.compact()
        self.vacuum()

    def views(self) -> None:
        """Registers the tables, with derived columns, the functions, and ``v_search``: recordings as keyword search sees them."""
        functions.register(self.spark)
        for name in SCHEMAS:
            rows = self.table(name)
            (with_derived(rows) if name == "recording" else rows).createOrReplaceTempView(name)
        self.spark.table("recording").filter("raw_transcript is not null or processed_transcript is not null").createOrReplaceTempView("v_search")

    def sql(self, text: str, args: dict | None = None, refresh: Callable[[], object] | None = None) -> DataFrame:
        """The result of a query over the archive's tables. ``refresh`` runs before; if it fails, what is there is used.

        The text stands as a subquery, so anything but a query is a syntax error: nothing can be written this way.
        """
        if refresh is not None:
            try:
                refresh()
            except Exception:
                log.warning("the archive couldn't be refreshed", exc_info=True)
        self.views()
        return self.spark.sql(f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)", args=args)

    def checks(self) -> dict[str, bool]:
        """Whether versions are current, long canonical recordings have chunks and vectors, and no chunk or vector is an orphan."""
        rows, chunks, vectors = self.table("recording"), self.table("recording_chunk"), self.table("recording_vec")
        long = rows.filter("superseded_by is null").withColumn("body", body()).filter(F.size(F.split("body", r"\s+")) > Strategy().threshold)
        embeddable = rows.filter("superseded_by is null and embed_text_hash is not null")
        return {
            "data_version": int(self.config("data_version") or 0) >= latest(UPDATERS),
            "schema_version": int(self.config("schema_version") or 0) >= latest(MIGRATIONS),
            "chunks": without(long, chunks).isEmpty() or self.config("embed_model") is None,
            "vectors": without(embeddable, vectors).isEmpty(),
            "no_orphans": without(chunks, rows).isEmpty() and without(vectors, rows).isEmpty() and self.table("recording_chunk_vec").join(chunks, "chunk_id", "left_anti").isEmpty(),
        }

    def sizes(self) -> dict[str, int]:
        """How many rows each table has."""
        return {name: self.table(name).count() for name in SCHEMAS}


@dataclass(frozen=True)
class Change:
    """A change to archives written before it, known by its number."""

    version: int
    name: str
    run: Callable


def _chunk_table(archive: Archive) -> None:
    if "recording_chunk" not in SCHEMAS:
        raise RuntimeError("there is no chunk table to fill")


def _marker(archive: Archive) -> None:
    """Nothing to change: that it runs takes the next ingest off its fast path, where dirty rows are found."""


#: Changes to the data, in order; each runs once. Long recordings get chunks as dirty rows once the first has run.
UPDATERS: list[Change] = [Change(4, "chunks", _chunk_table), Change(5, "texts without edits", _marker), Change(6, "transcript columns", _marker)]
#: Changes to the tables, in order: a function from the archive's table (in its present columns) to its rows, and which
#: table. Columns that are merely new need none: they read as null.
MIGRATIONS: list[tuple[Change, str]] = []


def latest(changes: list) -> int:
    return max((c[0].version if isinstance(c, tuple) else c.version for c in changes), default=0)


def updated(archive: Archive, updaters: list[Change] | None = None) -> bool:
    """Runs the updaters that the archive hasn't seen; one that fails stops them, and runs again next time."""
    seen, ran = int(archive.config("data_version") or 0), False
    for change in sorted(UPDATERS if updaters is None else updaters, key=lambda c: c.version):
        if change.version > seen:
            log.info("updater %s: %s", change.version, change.name)
            change.run(archive)
            archive.commit({"data_version": str(change.version)})
            ran = True
    return ran


def migrated(archive: Archive, migrations: list[tuple[Change, str]] | None = None) -> bool:
    """Rewrites tables by the migrations that the archive hasn't seen, each with its version in one commit."""
    seen, ran = int(archive.config("schema_version") or 0), False
    for change, table in sorted(MIGRATIONS if migrations is None else migrations, key=lambda m: m[0].version):
        if change.version > seen:
            log.info("migration %s: %s", change.version, change.name)
            archive.replace(table, change.run(archive.table(table)))
            archive.commit({"schema_version": str(change.version)})
            ran = True
    return ran


def merged(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """``old`` with ``new`` by folder: new rows are added, others overwritten but for what the source doesn't know."""
    columns = [c.split()[0] for c in RECORDING.split(", ")]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.folder_name") == F.col("n.folder_name"), "full_outer")
    is_new, untouched = F.col("o.folder_name").isNull(), F.col("n.folder_name").isNull()

    def column(name: str):
        was = F.col(f"o.{name}")
        if name == "indexed_at":
            return F.when(untouched, was).otherwise(F.lit(now))
        if name in KEPT_ON_UPDATE and name not in new.columns:
            return was
        if name not in new.columns:
            return was
        value = F.col(f"n.{name}")
        if name in FILLED_ON_UPDATE:
            return F.coalesce(value, was)
        if name in KEPT_ON_UPDATE:
            return F.when(is_new, value).otherwise(was)
        return F.when(untouched, was).otherwise(value)

    return joined.select(*[column(c).alias(c) for c in columns])


def deletions_marked(rows: DataFrame, in_source: DataFrame, with_meta: DataFrame, now: str) -> DataFrame:
    """Marks rows that are neither in the source nor have a meta file any more; marked rows stay as they are."""
    there = in_source.select("folder_name").unionByName(with_meta.select("folder_name")).distinct().withColumn("there", F.lit(True))
    gone = F.col("source_deleted_at").isNull() & F.col("there").isNull()
    return rows.join(there, "folder_name", "left").withColumn("source_deleted_at", F.when(gone, F.lit(now)).otherwise(F.col("source_deleted_at"))).drop("there")


def audio_marked(rows: DataFrame, audio: DataFrame, now: str) -> DataFrame:
    """Marks lost audio, and takes the mark back where it has returned; rows that never had audio aren't promoted."""
    there = audio.select("folder_name").distinct().withColumn("there", F.lit(True))
    lost = F.col("there").isNull() & (F.col("has_audio") == 1)
    found = F.col("there").isNotNull() & (F.col("has_audio") == 0) & F.col("source_audio_lost_at").isNotNull()
    return rows.join(there, "folder_name", "left").withColumns(
        {
            "has_audio": F.when(lost, 0).when(found, 1).otherwise(F.col("has_audio")),
            "source_audio_lost_at": F.when(lost, F.lit(now)).when(~found, F.col("source_audio_lost_at")),
        }
    ).drop("there")


def dirty(rows: DataFrame, vectors: DataFrame, chunks: DataFrame, model: str, strategy: Strategy) -> DataFrame:
    """Canonical rows whose text, model, vector or chunks aren't up to date: with ``body``, ``body_hash``, ``long``."""
    words = F.when(F.nullif(F.col("llm_result"), F.lit("")).isNotNull(), F.coalesce("llm_word_count", F.lit(0))).when(
        F.nullif(F.col("raw_result"), F.lit("")).isNotNull(), F.coalesce("raw_word_count", F.lit(0))
    ).otherwise(F.lit(0))
    text = rows.filter("superseded_by is null").withColumns({"body": body(), "long": words > strategy.threshold})
    text = text.filter("body <> ''").withColumn("body_hash", F.sha2(F.concat(F.lit("["), "mode_name", F.lit("] "), "body"), 256))
    has_vector = vectors.select("folder_name").distinct().withColumn("has_vector", F.lit(True))
    has_chunks = chunks.select("folder_name").distinct().withColumn("has_chunks", F.lit(True))
    joined = text.join(has_vector, "folder_name", "left").join(has_chunks, "folder_name", "left")
    stale = ~F.col("embed_text_hash").eqNullSafe(F.col("body_hash")) | ~F.col("embed_model").eqNullSafe(F.lit(model))
    return joined.filter(stale | F.col("has_vector").isNull() | (F.col("long") & F.col("has_chunks").isNull() & (F.size(F.split("body", r"\s+")) >= strategy.threshold)))


def without(rows: DataFrame, folders: DataFrame) -> DataFrame:
    return rows.join(folders.select("folder_name"), "folder_name", "left_anti")


def ingest(archive: Archive, source_db: str, recordings_dir: str, *args, **options) -> Outcome:
    """Brings the archive up to date with the source, as ``_ingested`` says; if another ingest has come between, decides
    anew on what that one left."""
    for left in range(TRIES - 1, -1, -1):
        try:
            out = _ingested(archive, source_db, recordings_dir, *args, **options)
        except Conflict:
            archive.load()
            if not left:
                raise
        else:
            if not out.fast_path:
                archive.upkeep()
            return out
    raise AssertionError("unreachable")


def _ingested(
    archive: Archive,
    source_db: str,
    recordings_dir: str,
    embed: Embedder | None = None,
    model: str = "stub",
    dims: int = 1024,
    strategy: Strategy = Strategy(),
    updaters: list[Change] | None = None,
    now: str | None = None,
    whole: bool = False,
) -> Outcome:
    """One ingest. Without ``embed``, text is ingested and embedding state stays. With ``whole``, rows count that came to
    the source late or were edited there, whatever their time; else those after the bookmark alone."""
    began, spark, out = time.time(), archive.spark, Outcome()
    now = now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    ran = migrated(archive) | updated(archive, updaters)
    changed = str(sqlite.modified(source_db))
    known = archive.config("embed_model")
    out.model_switched = embed is not None and known is not None and known != model
    embedded_then = archive.config("embedded_mtime_ns") == archive.config("source_mtime_ns")
    restructured = archive.config("chunk_strategy") not in (None, strategy.text())
    if not ran and not whole and archive.config("source_mtime_ns") == changed and not out.model_switched and (embed is None or archive.config("embedded_mtime_ns") == changed and not restructured):
        return replace(out, fast_path=True, seconds=time.time() - began)
    try:
        local = archive.files.local
        taken = sqlite.shipped(spark, source_db) if local is None else sqlite.snapshot(source_db, f"{local}/.snapshots")
        with taken as source, archive.work() as written:
            rows, gone = sqlite.source_recordings(spark, source, None if whole else archive.config("last_indexed_datetime")), None
            if whole:
                differing = reconcile.difference(archive, rows)
                rows, gone = differing.rows, written("gone", differing.gone)
                out.ranges = len(differing.ranges)
            new = written("new", _incoming(archive, rows.withColumn("digest", reconcile.digest(rows)), recordings_dir))
            changes = written("changes", _changes(archive, source, recordings_dir, new, now))
            groups = written("groups", _regrouped(archive, changes, now))
            moved = written("moved", _moved(changes, groups))
            counts = moved.agg(
                F.count_if(F.expr("came and was is null")).alias("new"),
                F.count_if(F.expr("came and was")).alias("updated"),
                F.count_if(F.expr("was and source_deleted_at_was is null and source_deleted_at is not null")).alias("deleted"),
                F.count_if(F.expr("was and has_audio_was <> has_audio")).alias("audio"),
                F.collect_set(archive.bucket()).alias("buckets"),  # at most as many as there are
            ).first()
            out.new_rows, out.updated_rows, out.source_deletions, out.audio_changes = counts["new"], counts["updated"], counts["deleted"], counts["audio"]
            touched = sorted(counts["buckets"])
            # Texts whose embedding may be stale are those that moved, unless an ingest went without or all is to be redone.
            every = embed is not None and (ran or out.model_switched or restructured or not embedded_then or known is None)
            before = archive.table("recording", touched).join(moved.select("folder_name"), "folder_name", "left_semi")
            rows = _with_marks(merged(before, new, now), moved)
            if every:
                rest = without(archive.table("recording"), moved).withColumns({"came": F.lit(None).cast("boolean"), "moved": F.lit(False)})
                rows = rows.unionByName(rest)
            if not new.isEmpty() or gone is not None and not gone.isEmpty():
                reconcile.taken(archive, new, gone)
            if touched or every:
                current = written("current", rows.select(*columns_of("recording"), "came", "moved"))
                changed_rows = current.filter("moved")
                if embed is not None:
                    out.embedded, changed_rows = _embedded(archive, current, None if every else touched, written, embed, model, dims, strategy, out.model_switched, restructured)
                out.buckets_written = len(archive.put("recording", changed_rows))
                archive.put("recording_audio", groups)
                texts = with_derived(current.filter("came")).select("folder_name", F.col("folder_name").alias("doc"), *INDEXED["recording"])
                if not texts.isEmpty():
                    segments.put(archive, "recording_fts", texts, INDEXED["recording"], porter_tokens)
            known_last = spark.createDataFrame([(archive.config("last_indexed_datetime"),)], "datetime string")
            last = new.select("datetime").unionByName(known_last).agg(F.max(F.struct(parsed_time(F.col("datetime")), "datetime")).alias("last")).first()["last"]
            told = {"source_mtime_ns": changed, "last_indexed_datetime": last["datetime"], "last_sync_finished_at": now, "last_sync_error": ""}
            if embed is not None:
                told |= {"embed_model": model, "embed_dim": str(dims), "chunk_strategy": strategy.text(), "embedded_mtime_ns": changed}
            archive.commit({k: v for k, v in told.items() if v is not None})
    except Conflict:
        raise
    except Exception as error:
        archive.staged = {}
        archive.commit({"last_sync_error": str(error)[:500]})
        raise
    return replace(out, seconds=time.time() - began)


def _changes(archive: Archive, source: str, recordings_dir: str, new: DataFrame, now: str) -> DataFrame:
    """The rows that ``came`` from the source or whose source or audio is no longer as marked: with their marks as they
    are to be and as they were (``_was``), but for supersedence, and whether the row ``was`` there before."""
    spark, old = archive.spark, archive.table("recording")
    meta, audio = folders.metadata(spark, recordings_dir), folders.audio(spark, recordings_dir)
    small = ["folder_name", "datetime", "audio_path", *MARKS]
    marked = audio_marked(deletions_marked(merged(old, new, now).select(*small), sqlite.source_folders(spark, source), meta, now), audio, now)
    unhashed = marked.filter("audio_hash is null and audio_path is not null").select("folder_name")
    hashes = folders.audio_hashes(spark, recordings_dir, unhashed).withColumnRenamed("audio_hash", "found_hash")
    hashed = marked.join(hashes, "folder_name", "left").withColumn("audio_hash", F.coalesce("audio_hash", "found_hash")).drop("found_hash")
    was = old.select("folder_name", F.lit(True).alias("was"), *[F.col(c).alias(f"{c}_was") for c in MARKS])
    came = new.select("folder_name", F.lit(True).alias("came"))
    both = hashed.join(was, "folder_name", "left").join(came, "folder_name", "left")
    differs = [~F.col(c).eqNullSafe(F.col(f"{c}_was")) for c in MARKS if not c.startswith("superseded")]
    return both.filter(F.col("came").isNotNull() | reduce(Column.__or__, differs))


def _regrouped(archive: Archive, changes: DataFrame, now: str) -> DataFrame:
    """The rows of ``recording_audio`` that change: of the audio hashes that came or were found, those recordings that are
    new there or are superseded by another than before. Only rows of these hashes are read."""
    columns = columns_of("recording_audio")
    touched = changes.filter(F.col("audio_hash").isNotNull() & (F.col("came").isNotNull() | ~F.col("audio_hash").eqNullSafe(F.col("audio_hash_was"))))
    buckets = [r["b"] for r in touched.select(archive.bucket("audio_hash").alias("b")).distinct().collect()]  # at most as many as there are
    there = archive.table("recording_audio", buckets).join(touched.select("audio_hash").distinct(), "audio_hash", "left_semi")
    now_there = without(there, touched).select(*columns, F.lit(False).alias("fresh")).unionByName(touched.select(*columns, F.lit(True).alias("fresh")))
    marked = superseded(now_there.withColumn("by_was", F.col("superseded_by")), now)
    return marked.filter(F.col("fresh") | ~F.col("superseded_by").eqNullSafe(F.col("by_was"))).select(*columns)


def _moved(changes: DataFrame, groups: DataFrame) -> DataFrame:
    """All rows that are to be written: ``changes``, and those in ``groups`` that nothing but supersedence changes, which
    are not ``known`` otherwise."""
    by = groups.select("folder_name", F.lit(True).alias("grouped"), F.col("superseded_by").alias("by"), F.col("superseded_at").alias("by_at"))
    return changes.withColumn("known", F.lit(True)).join(by, "folder_name", "full_outer")


def _with_marks(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """The rows that moved, with their new marks, ``came`` and ``moved``."""
    names = [c for c in MARKS if not c.startswith("superseded")]
    marks = moved.select("folder_name", "came", "known", "grouped", "by", "by_at", *[F.col(c).alias(f"{c}_now") for c in names])
    joined = rows.join(marks, "folder_name")
    columns = {c: F.when(F.col("known"), F.col(f"{c}_now")).otherwise(F.col(c)) for c in names}
    columns |= {c: F.when(F.col("grouped"), F.col(new)).otherwise(F.col(c)) for c, new in (("superseded_by", "by"), ("superseded_at", "by_at"))}
    return joined.withColumns(columns).withColumn("moved", F.lit(True)).select(*columns_of("recording"), "came", "moved")


def _incoming(archive: Archive, rows: DataFrame, recordings_dir: str) -> DataFrame:
    """Recordings of the source with what their folders say."""
    spark = archive.spark
    meta, audio = folders.metadata(spark, recordings_dir), folders.audio(spark, recordings_dir)
    return rows.join(meta.drop("meta_path"), "folder_name", "left").join(audio, "folder_name", "left").withColumns(
        {"has_audio": F.col("audio_path").isNotNull().cast("int"), "meta_path": F.concat(F.lit(recordings_dir.rstrip("/") + "/"), "folder_name", F.lit("/meta.json"))}
    )


def _embedded(
    archive: Archive, current: DataFrame, buckets: list[int] | None, written: Callable, embed: Embedder, model: str, dims: int, strategy: Strategy, switched: bool, restructured: bool
) -> tuple[int, DataFrame]:
    """Chunks and embeds what is dirty among ``current``, which lies in ``buckets``; superseded rows lose their chunks and
    vectors.

    Returns the number of rows embedded, and those of ``current`` that are to be written, with the proof of it.
    """
    of_rows = lambda name: archive.table(name, buckets).join(current.select("folder_name"), "folder_name", "left_semi")
    vectors, chunks, chunk_vectors = (of_rows(t).select("folder_name").distinct() for t in ("recording_vec", "recording_chunk", "recording_chunk_vec"))
    none = chunks.limit(0)
    stale = dirty(current, none if switched else vectors, none if restructured else chunks, model, strategy)
    todo = written("todo", stale.select("folder_name", "mode_name", "body", "body_hash", "long"))
    lost = current.filter("superseded_by is not null").select("folder_name")
    # Only what is too long for a task takes several, and more passes.
    found = chunked(todo.filter(F.col("long") & (F.length("body") <= LONG)), strategy=strategy)
    if not (very_long := todo.filter(F.col("long") & (F.length("body") > LONG))).isEmpty():
        found = found.unionByName(chunked_by_parts(very_long, written, strategy=strategy))
    made = written("chunks", found.join(todo.select("folder_name", "body_hash"), "folder_name").select(*columns_of("recording_chunk")))
    prefix = F.concat(F.lit("["), "mode_name", F.lit("] "))
    chunked_any = not made.isEmpty()
    row_texts = without(todo, made.select("folder_name").distinct()) if chunked_any else todo
    made_rows = embedded(row_texts.select("folder_name", F.concat(prefix, "body").alias("embed_text")), embed).drop("embed_text")
    # What has chunks or vectors now and isn't to have them any more.
    touched = todo.select("folder_name").unionByName(lost)
    unchunked = written("unchunked", without(chunks if restructured else chunks.join(touched, "folder_name", "left_semi"), made.select("folder_name").distinct()))
    unvectored = written("unvectored", without(chunk_vectors if switched or restructured else chunk_vectors.join(touched, "folder_name", "left_semi"), made.select("folder_name").distinct()))
    if chunked_any:
        texts = made.join(todo.select("folder_name", "mode_name"), "folder_name").select("chunk_id", "folder_name", F.concat(prefix, "text").alias("embed_text"))
        made_vectors = written("chunk_vectors", embedded(texts, embed).drop("embed_text"))
        of_chunks = made_vectors.join(made.select("chunk_id", "chunk_idx"), "chunk_id")
        made_rows = made_rows.unionByName(centroids(of_chunks.select("folder_name", "chunk_idx", "embedding")).select("folder_name", F.col("embedding").cast("array<float>").alias("embedding")))
    if chunked_any or not unchunked.isEmpty():
        archive.put("recording_chunk", made, unchunked, order=("folder_name", "chunk_idx"))
        docs = made.select("folder_name", F.concat_ws("/", "folder_name", F.col("chunk_idx").cast("string")).alias("doc"), "text")
        segments.put(archive, "recording_chunk_fts", docs, INDEXED["recording_chunk"], porter_tokens, unchunked)
    if chunked_any or not unvectored.isEmpty():
        archive.put("recording_chunk_vec", made_vectors if chunked_any else archive.table("recording_chunk_vec", []), unvectored)
    archive.put("recording_vec", made_rows, without(vectors if switched else vectors.join(lost, "folder_name", "left_semi"), todo))
    done = todo.select("folder_name", F.col("body_hash").alias("done_hash"))
    is_lost = F.col("superseded_by").isNotNull()
    proof = lambda name, new: F.when(is_lost, F.lit(None)).when(F.col("done_hash").isNotNull(), new).otherwise(F.col(name)).alias(name)
    kept = [c for c in columns_of("recording") if not c.startswith("embed_")]
    written_rows = current.join(done, "folder_name", "left").filter(F.col("moved") | F.col("done_hash").isNotNull() | (is_lost & F.col("embed_text_hash").isNotNull()))
    rows = written_rows.select(*kept, proof("embed_model", F.lit(model)), proof("embed_dim", F.lit(dims)), proof("embed_text_hash", F.col("done_hash")))
    return todo.count(), rows
