"""Keeping an archive fresh with Structured Streaming, and windows over event streams."""

from __future__ import annotations

import hashlib
import logging
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

#: The state store that timers and states of a watch live in.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LISTING = "share int, digest string, files long"


class _Share(InputPartition):
    def __init__(self, share: int, database: str = ""):
        self.share, self.database = share, database


def _files(top: str, share: int, shares: int) -> Iterator[tuple[str, int, int]]:
    """Path, size and time (in nanoseconds) of the files in those of a folder's entries that a share has."""
    fs, at = FileSystem.from_uri(top) if "://" in top else (FileSystem.from_uri("file:///")[0], os.path.abspath(top))
    names = os.listdir(at) if fs.type_name == "local" else [f.base_name for f in fs.get_file_info(FileSelector(at))]
    for name in names:
        if zlib.crc32(os.fsencode(name)) % shares != share:
            continue
        first = fs.get_file_info(f"{at}/{name}")
        inside = fs.get_file_info(FileSelector(f"{at}/{name}", allow_not_found=True, recursive=True)) if first.type == FileType.Directory else []
        for f in (first, *inside):
            if f.type == FileType.File:
                yield f.path, f.size, f.mtime_ns or 0


def _database(path: str | None) -> str:
    """The name, size and time of a database and its companions (``name-wal`` and the like)."""
    if not path or not os.path.isdir(os.path.dirname(path)):
        return ""
    parent, base = os.path.split(path)
    out = []
    for name in sorted(n for n in os.listdir(parent) if n == base or n.startswith(f"{base}-")):
        try:
            status = os.stat(os.path.join(parent, name))
        except OSError:
            continue  # gone since it was listed
        out.append(f"{name} {status.st_size} {status.st_mtime_ns}")
    return "\n".join(out)


class Listing(DataSourceReader):
    """A folder's files as they are now: for each share of its entries (by name) a digest of their names, sizes and times.

    Each share is listed by a task of its own. Share -1 is the source database, whose few files the driver looks up.
    """

    def __init__(self, options: dict):
        self.folder, self.shares, self.database_path = options["path"], int(options.get("shares", 8)), options.get("database")

    def partitions(self) -> list[InputPartition]:
        return [_Share(-1, _database(self.database_path)), *[_Share(k) for k in range(self.shares)]]

    def read(self, partition: _Share) -> Iterator[tuple]:
        if partition.share < 0:
            yield -1, partition.database, 0
            return
        digest, files = 0, 0
        for path, size, changed in _files(self.folder, partition.share, self.shares):
            # A sum, so that no share is sorted or held.
            digest += int.from_bytes(hashlib.sha1(f"{path} {size} {changed}".encode("utf-8", "surrogateescape")).digest()[:16], "big")
            files += 1
        yield partition.share, f"{digest:x}", files


class ListingStream(Listing, DataSourceStreamReader):
    """The listing again and again: the offset is the time, and each batch lists what is there as it runs."""

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:  # type: ignore[override]
        return Listing.partitions(self)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_files"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> Listing:
        return Listing(self.options)

    def streamReader(self, schema: StructType) -> ListingStream:
        return ListingStream(self.options)


class Quiet(StatefulProcessor):
    """Tells, for each key, when what changes has been quiet for ``seconds``: a trailing debounce.

    State holds the digests seen last, which of them changed, and the timer that the latest change has set; all of it
    survives a restart, so a change that was waiting is told then. ``known`` stands for what was seen before the first.
    """

    def __init__(self, seconds: float, known: dict[int, str]):
        self.milliseconds, self.known = max(1, int(seconds * 1000)), known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.digests = handle.getMapState("digests", "share int", "digest string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed = False
        for part in rows:
            for share, digest in zip(part["share"], part["digest"]):
                at = (int(share),)
                before = self.digests.getValue(at)[0] if self.digests.containsKey(at) else self.known.get(int(share))
                if before != digest:
                    changed |= before is not None or bool(self.known)
                    self.digests.updateValue(at, (digest,))
        if changed:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.milliseconds
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame({"key": pd.Series([], dtype=str), "at": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield pd.DataFrame({"key": [key[0]], "at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def quiet(listing: DataFrame, seconds: float, known: dict[int, str] | None = None) -> DataFrame:
    """``key, at`` for each run of changes in a stream ``key, share, digest``, once it has been quiet for ``seconds``."""
    return listing.groupBy("key").transformWithStateInPandas(Quiet(seconds, known or {}), "key string, at long", outputMode="Append", timeMode="ProcessingTime")


def watch(
    spark: SparkSession, recordings_dir: str, refresh: Callable[[], object], checkpoint: str, seconds: float = 2.0, database: str | None = None, poll: float = 0.5, shares: int | None = None
) -> StreamingQuery:
    """Calls ``refresh`` once now, and whenever ``recordings_dir`` or the source ``database`` has changed and then been
    quiet for ``seconds``: each further change sets the waiting back.

    Files count recursively, new, rewritten and removed ones; of the database's folder, the file and its companions
    (``name-wal`` and the like). Tasks list the files, by ``shares`` of the folder's entries. Batches follow each other, so
    no two refreshes overlap and what changes meanwhile is one next batch. A refresh that fails is logged, and the stream
    goes on; a change that waits when the stream stops is told once it runs again. ``query.stop()`` waits for the batch.
    """
    if "://" not in recordings_dir and not os.path.isdir(recordings_dir):
        raise FileNotFoundError(recordings_dir)
    spark.dataSource.register(ListingSource)
    options = {"path": recordings_dir, "shares": str(shares or spark.sparkContext.defaultParallelism)} | ({"database": database} if database else {})
    before = {r["share"]: r["digest"] for r in spark.read.format("recording_files").options(**options).load().collect()}  # a row for each share
    attempt(refresh)
    listed = spark.readStream.format("recording_files").options(**options).load()

    def batch(rows: DataFrame, number: int) -> None:
        if rows.collect():  # one row at most; all of the batch is read, so that its state is kept
            attempt(refresh)

    set_back = {name: spark.conf.get(name, None) for name in (_PROVIDER, _PARTITIONS)}
    try:  # a stream keeps the settings that it begins with: one key needs one state partition
        spark.conf.set(_PROVIDER, STORE)
        spark.conf.set(_PARTITIONS, "1")
        writer = quiet(listed.select(F.lit("recordings").alias("key"), "share", "digest"), seconds, before).writeStream.foreachBatch(batch)
        return writer.queryName(f"watch-{uuid.uuid4().hex[:8]}").outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(poll * 1000)} milliseconds").start()
    finally:
        for name, value in set_back.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


def attempt(refresh: Callable[[], object]) -> bool:
    try:
        refresh()
        return True
    except Exception:
        log.exception("a refresh failed; the next change tries again")
        return False


def bursts(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Runs of events with less than ``gap`` between them, by user: the trailing debounce of a change stream.

    Works on streams (what comes more than ``late`` behind is dropped) and on tables.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Each event once, however often it is delivered."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def hourly(events: DataFrame, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
