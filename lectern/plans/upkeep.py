"""Queries over what is kept up bit by bit: tables by deltas, an index by segments, a source by digests, a text by parts.

Each writes tables of its own, derived from the driver's, into the session's shared folder, changes them as ingests would,
and returns what a reader then sees. Their SQL says the same of the final state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens
from lectern.operators import reconcile, search, segments
from lectern.operators.chunks import chunked_by_parts
from lectern.operators.recordings import body, canonical
from lectern.operators.tables import Tables
from lectern.plans import oracle as o
from lectern.plans.recipes import query
from lectern.sources import demo
from lectern.sources.stored import shared_folder

SCHEMAS = {"row": "folder_name string, mode_name string, words long", "fts_docs": "folder_name string, doc string, dl long", reconcile.TABLE: reconcile.SCHEMA}


def _begun(spark: SparkSession, buckets: int = 8) -> Tables:
    tables = Tables(spark, f"{shared_folder(spark)}/upkeep-{uuid.uuid4().hex}", SCHEMAS)
    tables.state["config"] = {"first_buckets": str(buckets), "buckets": str(buckets)}
    tables.commit(dict(tables.state["config"]))
    return tables


@query("delta_upserts", f"WITH {o.REC} SELECT folder_name, CASE WHEN doc_id % 5 = 0 THEN 'late' ELSE mode_name END AS mode_name, raw_word_count + CASE WHEN doc_id % 5 = 0 THEN 2000 WHEN doc_id % 7 = 0 THEN 1000 ELSE 0 END AS words FROM rec WHERE doc_id % 5 = 0 OR doc_id % 13 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 <> 0)")
def delta_upserts(spark, sf_dir):
    """Two rounds of changed and gone rows, then some buckets split: each folder's newest rows."""
    rows = demo.raw_recordings(spark, sf_dir).select("folder_name", "doc_id", "mode_name", F.col("raw_word_count").alias("words"))
    of = lambda condition, more=0: rows.filter(condition).withColumn("words", F.col("words") + more).drop("doc_id")
    tables = _begun(spark)
    tables.put("row", of("true"))
    tables.commit()
    tables.put("row", of("doc_id % 7 = 0", 1000), of("doc_id % 11 = 0 and doc_id % 7 <> 0"))
    tables.commit()
    tables.put("row", of("doc_id % 5 = 0", 2000).withColumn("mode_name", F.lit("late")), of("doc_id % 13 = 0 and doc_id % 5 <> 0"))
    tables.commit()
    tables.split(11)
    return tables.table("row")


_FINAL = "(SELECT folder_name, CASE WHEN doc_id % 7 = 0 THEN 'Edited: loser ' || raw_transcript ELSE raw_transcript END AS raw_transcript, processed_transcript FROM rec WHERE doc_id % 7 = 0 OR doc_id % 11 <> 0)"
_FOUND = "SELECT doc FROM post WHERE term IN ('loser', 'clown')"


@query("segments_search", f"WITH {o.REC}, {o.postings(_FINAL, 'folder_name', ('raw_transcript', 'processed_transcript'))}, {o.scored(_FOUND, [(o.instances(w),) * 2 for w in ('loser', 'clown')])} SELECT doc, round(bm25, 6) AS bm25 FROM hits")
def segments_search(spark, sf_dir):
    """A search of an index after some of its documents were replaced and others have gone."""
    columns = ["raw_transcript", "processed_transcript"]
    rows = demo.recordings(spark, sf_dir).select("folder_name", F.col("folder_name").alias("doc"), "doc_id", *columns)
    edited = rows.filter("doc_id % 7 = 0").withColumn("raw_transcript", F.concat(F.lit("Edited: loser "), "raw_transcript"))
    tables = _begun(spark)
    for texts, gone in ((rows, None), (edited, rows.filter("doc_id % 11 = 0 and doc_id % 7 <> 0"))):
        segments.put(tables, "fts", texts.drop("doc_id"), columns, tokens, gone)
        tables.commit()
    hits = search.bm25(segments.Segments.open(tables, "fts", columns), search.term("loser") | search.term("clown"))
    return hits.select("doc", F.round("bm25", 6).alias("bm25"))


@query("reconcile_ranges", "SELECT CAST(doc_id AS VARCHAR) AS folder_name, doc_id % 17 = 0 AS late FROM documents WHERE doc_id % 17 = 0 OR doc_id % 19 = 0")
def reconcile_ranges(spark, sf_dir):
    """Source rows that the archive lacks or has otherwise, found by digests."""
    source = demo.table(spark, sf_dir, "documents").withColumn("folder_name", F.col("doc_id").cast("string"))
    before = source.filter("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 19 == 0, F.concat(F.lit("once: "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    tables = _begun(spark)
    reconcile.taken(tables, before.withColumn("digest", reconcile.digest(before)))
    tables.commit()
    return reconcile.difference(tables, source).rows.select("folder_name", (F.col("doc_id") % 17 == 0).alias("late"))


@query("chunks_by_parts", f"WITH RECURSIVE {o.REC}, {o.LONG}, {o.chunks('body', 'folder_name')} SELECT folder_name, chunk_idx, text, start_word, end_word, word_count FROM chunk")
def by_parts(spark, sf_dir, part: int = 5000):
    """All canonical texts, chunked by parts of few characters."""
    top = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"

    def written(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    texts = canonical(demo.recordings(spark, sf_dir)).select("folder_name", body().alias("body"))
    return chunked_by_parts(texts, written, part=part).drop("chunk_id")
