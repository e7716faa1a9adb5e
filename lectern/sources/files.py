"""Small files on the storage that Spark reads: local paths and any URI that Hadoop's file systems know."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    folder: bool
    size: int
    changed: float  # seconds since 1970


class Files:
    """What lies below a folder. Names are relative to it."""

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")
        fs, at = self._hadoop("")
        #: The folder's path if it is this machine's, else None. A path without a scheme is where Spark's default says.
        self.local = os.path.abspath(fs.makeQualified(at).toUri().getPath()) if fs.getUri().getScheme() == "file" else None

    def _hadoop(self, name: str):
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}".rstrip("/"))
        return at.getFileSystem(context.hadoopConfiguration()), at

    def read(self, name: str) -> bytes | None:
        """The file's bytes; None if there is none."""
        fs, at = self._hadoop(name)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        fs, at = self._hadoop(name)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file unless there is one of that name; it appears whole. False if there is one.

        Locally a hard link, elsewhere a rename that doesn't overwrite: atomic on HDFS and the like, while an object store
        needs a file system that makes it so.
        """
        folder, _, base = name.rpartition("/")
        draft = f"{folder}/.{base}-{uuid.uuid4().hex}"
        self.write(draft, data)
        try:
            if self.local is not None:
                try:
                    os.link(f"{self.local}/{draft}", f"{self.local}/{name}")
                    return True
                except FileExistsError:
                    return False
            jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
            _, source = self._hadoop(draft)
            fs, target = self._hadoop(name)
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context.hadoopConfiguration()).rename(source, target, none)
                return True
            except Exception:
                if fs.exists(target):
                    return False
                raise
        finally:
            self.delete(draft)

    def list(self, name: str = "") -> list[Entry]:
        fs, at = self._hadoop(name)
        if not fs.exists(at):
            return []
        return [Entry(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime() / 1000) for s in fs.listStatus(at)]

    def size(self, name: str) -> int:
        """Bytes of all files in a folder."""
        fs, at = self._hadoop(name)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0

    def delete(self, name: str) -> None:
        fs, at = self._hadoop(name)
        fs.delete(at, True)

    def folder(self, name: str) -> None:
        fs, at = self._hadoop(name)
        fs.mkdirs(at)
