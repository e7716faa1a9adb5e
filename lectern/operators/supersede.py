"""Reprocessed duplicates: recordings of equal audio, of which the latest is canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.recordings import parsed_time


def superseded(recordings: DataFrame, at: str | None = None) -> DataFrame:
    """``recordings`` with ``superseded_by``, the latest recording of the same audio (null for that one itself).

    The winner of each hash is an aggregate that is combined before the shuffle, and is joined back; so a hash that
    very many recordings share is no single task's work. Of equally late ones the smaller folder name wins. A null
    hash forms no group. With ``at``, ``superseded_at`` is that time where it wasn't set before.
    """
    when = F.coalesce(parsed_time(F.col("datetime")), F.lit("0001-01-01").cast("timestamp"))
    order = F.struct((-F.unix_micros(when)).alias("late"), "folder_name")
    winners = recordings.filter(F.col("audio_hash").isNotNull()).groupBy(F.col("audio_hash").alias("of_hash")).agg(F.min(order).alias("first"))
    kept = recordings.drop("superseded_by")
    # The winners are looked up by hash: the rows with their texts aren't sorted.
    winners = winners.hint("shuffle_hash")
    joined = kept.join(winners, kept["audio_hash"] == winners["of_hash"], "left")
    by = F.when(F.col("first.folder_name") != F.col("folder_name"), F.col("first.folder_name"))
    out = joined.withColumn("superseded_by", by).drop("of_hash", "first")
    if at is not None:
        before = F.col("superseded_at") if "superseded_at" in recordings.columns else F.lit(None).cast("string")
        out = out.withColumn("superseded_at", F.when(F.col("superseded_by").isNotNull(), F.coalesce(before, F.lit(at))))
    return out
