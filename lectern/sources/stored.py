"""Tables that a session derives once and reads again, on storage that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where the tables of a session lie: (application, name) -> path.
_PATHS: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the warehouse; in local mode a folder of the session's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    key = (spark.sparkContext.applicationId, "")
    if key not in _PATHS:
        _PATHS[key] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _PATHS[key]


def stored_path(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """The path that ``write`` has filled for ``name`` in this session; it is called once."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _PATHS:
        path = f"{shared_folder(spark)}/{name.strip('/').replace('/', '-').replace(':', '')}-{uuid.uuid4().hex}"
        write(path)
        _PATHS[key] = path
    return _PATHS[key]


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written at its first use in this session."""
    return spark.read.parquet(stored_path(spark, name, lambda path: make().write.parquet(path)))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it comes in fewer partitions, as a single file that can't be split does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
