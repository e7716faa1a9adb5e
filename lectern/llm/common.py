"""What the operators of this subpackage share: written intermediate tables, word rules, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and U+0009 to U+000D. ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\r\x0b\x0c"
#: The same rule as a regular expression that Java, Python and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``).

    Where the session names none, as in local tests, a temporary folder becomes the session's own setting.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What has been written since the innermost ``scratch`` began.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` as a table written to the shared folder: computed once, its lineage cut, safe from lost executors.

    Within ``scratch`` it is removed at the end, unless it is ``lasting``.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    held = _SCRATCH.get()
    if held is not None and not lasting:
        held.append(table)
    return table


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables written inside; what goes on from here must rest on lasting ones."""
    held: list[DataFrame] = []
    token = _SCRATCH.set(held)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for table in held:
            discarded(table)


def discarded(table: DataFrame) -> None:
    """Removes the files of a table that ``written`` gave and that nothing reads any more (an iteration's last round)."""
    files = table.inputFiles()
    if files:
        from py4j.java_gateway import java_import

        jvm = table.sparkSession.sparkContext._jvm
        java_import(jvm, "org.apache.hadoop.fs.Path")
        folder = jvm.Path(files[0]).getParent()
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def utf8(column: Column | str) -> Column:
    """The text's UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the column as text, modulo ``folds``; null where the column is."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem`` or the first variant of it that no column of ``df`` bears (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def map_column(
    df: DataFrame, value: Column, fields: str, make: Callable[[], Callable[[list], dict[str, pa.Array]]], keep: list[str] | None = None
) -> DataFrame:
    """``df``'s columns (or those in ``keep``) and new ones, computed batch by batch from one value of each row.

    ``make`` runs once in each Python worker's task and returns what turns a list of values into arrays by field
    name. Columns of ``df`` that bear a new field's name are replaced. No shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(fields)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    held = free_name(df.select(*kept, *[F.lit(0).alias(f.name) for f in new]) if kept else df.select(F.lit(0).alias("_")), "value_of_row")
    source = df.select(*[F.col(f"`{c}`") for c in kept], value.alias(held))
    schema = StructType([f for f in source.schema if f.name != held] + list(new))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = work(part.column(len(kept)).to_pylist())
                columns = [part.column(i) for i in range(len(kept))] + [made[f.name] for f in new]
                yield pa.RecordBatch.from_arrays([c if c.type == t.type else c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)
