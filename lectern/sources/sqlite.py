"""SQLite files as a Spark data source, for the source database of an archive (``format("sqlite")``)."""

from __future__ import annotations

import logging
import os
import shutil
import sqlite3
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

#: What is read of a recording; NOT NULL in the source unless marked.
RECORDING = """id binary, datetime string, duration double, modeName string, modelKey string, modelName string, languageModelKey string,
    languageModelName string, recordingDevice string, rawWordCount long, llmWordCount long, folderName string"""
TRANSCRIPT = "recordingId binary, llmResult string, rawResult string, result string"
REQUIRED = ("folder_name", "recording_id_hex", "datetime", "duration_ms", "mode_name")


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    """Reads a table by ranges of its rowid; a table without one is read whole."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["dbtable"]
        self.partitions_wanted = int(options.get("numPartitions", 4))
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{here(self.path)}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
        if low is None:
            return []
        n = max(1, min(self.partitions_wanted, high - low + 1))
        cuts = [low + (high - low + 1) * k // n for k in range(n + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.schema.names)
        text = {f.name for f in self.schema if f.dataType.typeName() == "string"}
        binary = {f.name for f in self.schema if f.dataType.typeName() == "binary"}
        real = {f.name for f in self.schema if f.dataType.typeName() == "double"}
        where = "" if partition.low is None else f" WHERE rowid >= {partition.low} AND rowid < {partition.high}"
        with self._open() as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}"{where}'):
                out = []
                for name, x in zip(self.schema.names, row):
                    if x is not None:
                        x = str(x) if name in text and not isinstance(x, str) else x.encode() if name in binary and isinstance(x, str) else float(x) if name in real else x
                    out.append(x)
                yield tuple(out)


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("give the table's schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SQLiteReader(schema, self.options)


#: How snapshots are named, seconds after which one left behind is swept, and attempts at a plain copy.
_PREFIX, STALE, ATTEMPTS = "snapshot-", 3600.0, 5


def swept(folder: str) -> None:
    """Removes snapshots that runs which didn't end left in ``folder`` over an hour ago."""
    for name in os.listdir(folder):
        at = os.path.join(folder, name)
        if name.startswith(_PREFIX):
            try:
                if os.stat(at).st_mtime < time.time() - STALE:
                    os.unlink(at)
            except OSError:
                log.debug("%s couldn't be swept", at, exc_info=True)  # another run may have been first


@contextmanager
def shipped(spark: SparkSession, path: str) -> Iterator[str]:
    """A snapshot for an archive on storage that isn't a path here: taken beside nothing but the driver, and handed to the
    executors as a file of the application, which each fetches once."""
    with tempfile.TemporaryDirectory(prefix="snapshot-") as folder, snapshot(path, folder) as out:
        spark.sparkContext.addFile(out)
        yield out


def here(path: str) -> str:
    """Where a database, or the snapshot of it that was shipped, lies on this machine."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@contextmanager
def snapshot(path: str, folder: str) -> Iterator[str]:
    """A consistent copy of a database that another program may be writing, in a folder that executors share.

    It is removed at the end. Where the backup fails, the file is copied, with a few attempts.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    os.makedirs(folder, exist_ok=True)
    swept(folder)
    out = os.path.join(folder, f"{_PREFIX}{uuid.uuid4().hex}.sqlite")
    try:
        try:
            with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=30)) as source, closing(sqlite3.connect(out)) as copy:
                source.backup(copy)
        except sqlite3.Error:
            log.warning("%s couldn't be backed up; it is copied", path, exc_info=True)
            _copied(path, out)
        yield out
    finally:
        for name in (out, f"{out}-wal", f"{out}-shm"):
            if os.path.exists(name):
                os.unlink(name)


def _copied(path: str, out: str) -> None:
    for attempt in range(1, ATTEMPTS + 1):
        try:
            shutil.copyfile(path, out)
            return
        except OSError:
            if attempt == ATTEMPTS:
                raise
            time.sleep(0.05 * attempt)


def modified(path: str) -> int | None:
    """When the database last changed, in nanoseconds; None if it isn't there."""
    return os.stat(path).st_mtime_ns if os.path.exists(path) else None


def source_recordings(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The source's recordings with their transcripts, ordered by nothing; ``since`` keeps what is later by the second.

    Rows whose time can't be read are left out by ``since``. A null in a required column raises when rows are read.
    """
    spark.dataSource.register(SQLiteSource)
    read = lambda table, schema: spark.read.format("sqlite").schema(schema).option("path", path).option("dbtable", table).load()
    rows, texts = read("recording", RECORDING), read("recording_fts", TRANSCRIPT)
    out = rows.join(texts, rows["id"] == texts["recordingId"], "left").select(
        F.col("folderName").alias("folder_name"),
        F.hex("id").alias("recording_id_hex"),
        "datetime",
        F.col("duration").alias("duration_ms"),
        F.col("modeName").alias("mode_name"),
        F.col("modelKey").alias("model_key"),
        F.col("modelName").alias("model_name"),
        F.col("languageModelKey").alias("language_model_key"),
        F.col("languageModelName").alias("language_model_name"),
        F.col("recordingDevice").alias("recording_device"),
        F.col("rawWordCount").alias("raw_word_count"),
        F.col("llmWordCount").alias("llm_word_count"),
        "result",
        F.col("llmResult").alias("llm_result"),
        F.col("rawResult").alias("raw_result"),
    )
    if since is not None:
        second = lambda c: F.date_trunc("second", c.try_cast("timestamp"))
        out = out.filter(second(F.col("datetime")) > second(F.lit(since)))
    for name in REQUIRED:
        out = out.withColumn(name, F.coalesce(F.col(name), F.raise_error(f"{name} is null in the source").cast(out.schema[name].dataType)))
    return out


def source_folders(spark: SparkSession, path: str) -> DataFrame:
    """The folder names that the source holds; none if the file isn't there."""
    if not os.path.exists(path):
        return spark.createDataFrame([], "folder_name string")
    spark.dataSource.register(SQLiteSource)
    rows = spark.read.format("sqlite").schema("folderName string").option("path", path).option("dbtable", "recording").load()
    return rows.filter("folderName is not null").select(F.col("folderName").alias("folder_name"))
