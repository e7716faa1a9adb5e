"""Finding rows that differ between a source and an archive by digests of ranges.

A bookmark misses what comes late with an early time and what is edited without a new one. So the archive keeps a digest
of each source row that it took, and sums of them by range of the folder name's hash. The source's sums are formed in one
pass over it, and only in ranges whose sums differ are single digests compared and rows taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.tables import Tables

#: Ranges of the folder name's hash.
RANGES = 256
TABLE = "recording_digest"
SCHEMA = "folder_name string, digest long"


def digest(rows: DataFrame) -> Column:
    """A digest of all that a source row says; a null isn't an empty text."""
    return F.xxhash64(*[F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})])


def range_of(folder: Column | str = "folder_name") -> Column:
    return (F.crc32((F.col(folder) if isinstance(folder, str) else folder).cast("binary")) % RANGES).cast("int")


def sums(digests: DataFrame) -> list[int]:
    """How many rows each range has, and after all these the sums of their digests: 2 * RANGES numbers."""
    out = [0] * (2 * RANGES)
    by_range = digests.groupBy(range_of().alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("sum"))
    for r in by_range.collect():  # at most RANGES
        out[r["range"]], out[RANGES + r["range"]] = r["n"], int(r["sum"])
    return out


def buckets_of(tables: Tables, ranges: list[int]) -> list[int]:
    """The buckets in which folders of some ranges can lie, where both count in powers of two; else all."""
    whole, n = tables.rounds, tables.buckets
    width = lambda b: 2 * whole if b < n - whole or b >= whole else whole
    common = lambda w: min(w & -w, RANGES)
    return [b for b in range(n) if any((b - r) % common(width(b)) == 0 for r in ranges)]


@dataclass(frozen=True)
class Difference:
    ranges: list[int]
    rows: DataFrame  # of the source, that the archive lacks or has otherwise
    gone: DataFrame  # folder_name, of which the archive has a digest and the source no row


def difference(tables: Tables, source: DataFrame) -> Difference:
    """What of ``source`` (all its rows) isn't in the archive as it is there. Equal ranges' digests aren't read."""
    told = source.withColumn("digest", digest(source))
    there, here = sums(told), tables.state["facts"].get(TABLE, [0] * (2 * RANGES))
    ranges = [r for r in range(RANGES) if (there[r], there[RANGES + r]) != (here[r], here[RANGES + r])]
    within = range_of().isin(ranges)
    known = tables.table(TABLE, buckets_of(tables, ranges) if ranges else []).filter(within)
    asked = told.filter(within)
    rows = asked.join(known, ["folder_name", "digest"], "left_anti").drop("digest")
    return Difference(ranges, rows, known.join(asked.select("folder_name"), "folder_name", "left_anti").select("folder_name"))


def taken(tables: Tables, rows: DataFrame, gone: DataFrame | None = None) -> None:
    """Stages the digests of source rows that an ingest takes, and that those of folders in ``gone`` are forgotten."""
    digests = rows.select("folder_name", "digest")
    named = digests.select("folder_name") if gone is None else digests.select("folder_name").unionByName(gone)
    touched = [r["b"] for r in named.select(tables.bucket().alias("b")).distinct().collect()]  # at most as many as there are
    before = tables.table(TABLE, touched).join(named.distinct(), "folder_name", "left_semi")
    new, old = sums(digests), sums(before)
    tables.put(TABLE, digests, gone)
    facts = tables.staged.setdefault("facts", {})
    facts[TABLE] = [a + b - c for a, b, c in zip(facts.get(TABLE, [0] * (2 * RANGES)), new, old)]
