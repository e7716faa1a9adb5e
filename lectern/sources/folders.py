"""Recording folders: each one's ``meta.json`` and ``output.wav``."""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

META = """promptContext struct<modeContext: struct<language: string>, applicationContext: struct<name: string, category: string>>, _broken string"""
_FOLDER = r"/([^/]+)/[^/]+$"


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``folder_name, meta_path, language, app_name, app_category``; what can't be read is null, empty strings stay."""
    reader = spark.read.schema(META).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json")
    path = F.col("_metadata.file_path")
    return reader.json(folder).select(
        F.regexp_extract(path, _FOLDER, 1).alias("folder_name"),
        path.alias("meta_path"),
        F.col("promptContext.modeContext.language").alias("language"),
        F.col("promptContext.applicationContext.name").alias("app_name"),
        F.col("promptContext.applicationContext.category").alias("app_category"),
    )


def audio(spark: SparkSession, folder: str) -> DataFrame:
    """``folder_name, audio_path``: which recordings have audio; the files aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "output.wav").load(folder)
    return files.select(F.regexp_extract("path", _FOLDER, 1).alias("folder_name"), F.col("path").alias("audio_path"))


def audio_hashes(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """``folder_name, audio_hash`` (SHA-1) of all audio, or of the folders in ``wanted`` (folder_name).

    Only the wanted files are opened, each in the task that hashes it, piece by piece. A file that can't be read is left
    out; the next ingest tries again.
    """
    paths = audio(spark, folder)
    if wanted is not None:
        paths = paths.join(wanted, "folder_name", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name, _sha1(path)) for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            found = [f for f in found if f[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["folder_name", "audio_hash"])

    return paths.select("folder_name", "audio_path").mapInArrow(run, "folder_name string, audio_hash string")


def _sha1(path: str) -> str | None:
    try:
        fs, at = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        total = hashlib.sha1()
        with fs.open_input_stream(unquote(at)) as file:
            while piece := file.read(1 << 20):
                total.update(piece)
        return total.hexdigest()
    except OSError:
        log.warning("%s can't be read", path, exc_info=True)
        return None
