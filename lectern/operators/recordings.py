"""The recording's derived columns and the filters that every query shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(text, _UPPER, _LOWER)


def parsed_time(datetime: Column) -> Column:
    """The point in time of either stored format; null where it can't be read."""
    return datetime.try_cast("timestamp")


def iso_time(datetime: Column) -> Column:
    return F.date_format(parsed_time(datetime), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def transcripts() -> dict[str, Column]:
    """The derived columns that repeat a text."""
    result, raw = F.col("result"), F.col("raw_result")
    # With a null raw_result the comparison is null, so this stays null while the count of words doesn't.
    return {"raw_transcript": raw, "processed_transcript": F.when(result.isNotNull() & (result != "") & (result != raw), result)}


def with_derived(recordings: DataFrame) -> DataFrame:
    """``recordings`` with the columns that are functions of a row."""
    result, raw = F.col("result"), F.col("raw_result")
    trimmed = F.trim(result)
    return recordings.withColumns(
        {
            "duration_sec": F.col("duration_ms") / F.lit(1000.0),
            "mode_name_lower": ascii_lower(F.col("mode_name")),
            **transcripts(),
            "processed_word_count": F.when(result.isNull() | (result == "") | (result == raw), F.lit(0)).otherwise(
                F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
            ),
            "datetime_iso": iso_time(F.col("datetime")),
        }
    )


def canonical(recordings: DataFrame) -> DataFrame:
    return recordings.filter(F.col("superseded_by").isNull())


def best_transcript() -> Column:
    return F.coalesce("processed_transcript", "raw_transcript")


def body(prefer_result: bool = False) -> Column:
    """The text to chunk and embed: the edited one, or else the raw one; blank counts as none.

    The choice is made before blanks are dropped: an edited text of white space alone wins, and gives "".
    """
    chosen = F.coalesce(F.nullif(F.col("llm_result"), F.lit("")), *([F.nullif(F.col("result"), F.lit(""))] if prefer_result else []), F.nullif(F.col("raw_result"), F.lit("")), F.lit(""))
    return F.when(F.regexp_like(chosen, F.lit(r"[^\s   -     　﻿]")), chosen).otherwise("")
