"""The registered queries of this subpackage; each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import ann, bitsliced, bloomlm, bpe, clusters, fertility, linkrank, mixing, resample, simhash, tokenfile, toxicity, transcript
from lectern.llm.common import crc_fold, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB's SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}


def query(name: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        return f

    return add


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read(spark, tokenfile.write(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files")), digest=True)


@query("op4_simhash_components")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


@query("op6_bpe_roundtrip")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_tokeniser_fertility")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judged(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op10_entropy_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fitted(docs, table(spark, sf_dir, "labels"), crc_fold("doc_id", 4) != 2)
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.scored(docs, weights, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_bloom_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_fold("doc_id", 7)
    out = bloomlm.language_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(fold != 2, F.lit(True)), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op1_ivf_pq")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_link_rank")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [linkrank.Rule(*r) for r in linkrank.RULES]
    return linkrank.judged(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


@query("op8_transcript_roles")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = transcript.marked(table(spark, sf_dir, "conversations"))
    model = transcript.trained(turns.filter(crc_fold("conv_id", 4) != 2))
    return transcript.recovered(turns, model)


@query("op11_partial_distance")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"))


@query("op12_bit_sliced")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.best(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op13_importance_resample")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WHOLE = """
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _cluster_sql() -> str:
    """Three rounds of assignment and floored means, written out; components are rows (vec_id, dim, x)."""
    steps = [f"kept AS ({_WHOLE.format(scale=64)} AND len(embedding) = 64)", "parts AS (SELECT vec_id, unnest(range(64)) AS dim, unnest(v) AS x FROM kept)"]
    steps.append("first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT 16)")
    steps.append("c0 AS (SELECT c, dim, x FROM first JOIN parts USING (vec_id))")
    for k in range(4):
        steps.append(f"d{k} AS (SELECT p.vec_id, c.c, sum((p.x - c.x) * (p.x - c.x)) AS d FROM parts p JOIN c{k} c USING (dim) GROUP BY ALL)")
        steps.append(f"a{k} AS (SELECT vec_id, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if k < 3:
            steps.append(f"s{k} AS (SELECT c, dim, sum(p.x) AS s, count(*) AS n FROM a{k} JOIN parts p USING (vec_id) GROUP BY ALL)")
            steps.append(f"c{k + 1} AS (SELECT c.c, c.dim, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{k} c LEFT JOIN s{k} s ON s.c = c.c AND s.dim = c.dim)")
    steps.append("hashes AS (SELECT c, sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY dim)) AS h FROM c3 GROUP BY c)")
    return "WITH " + ", ".join(steps) + """
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a3 JOIN hashes USING (c)"""


ORACLE_SQL["op11_partial_distance"] = _cluster_sql()
ORACLE_SQL["op12_bit_sliced"] = f"""
WITH kept AS ({_WHOLE.format(scale=1024)}),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
          FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""

# crc32 by its table, from the polynomial 0xEDB88320, over the bytes of each distinct word.
ORACLE_SQL["op13_importance_resample"] = r"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
split AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
counted AS (SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(words) AS word FROM split) GROUP BY ALL),
distinct_words AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM counted),
bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: CAST(('0x' || h[2 * i + 1 : 2 * i + 2]) AS BIGINT)) AS b FROM distinct_words),
hashed AS (SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
by_bucket AS (SELECT side, bucket, sum(n) AS n FROM counted JOIN hashed USING (word) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s_all, coalesce(sum(n) FILTER (side = 1), 0) AS t_all FROM by_bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain
          FROM (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM by_bucket GROUP BY bucket), totals),
weights AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS g, CAST(sum(n) AS BIGINT) AS f FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(f, 0) AS n_features, coalesce((g - ((g % f) + f) % f) // f, 0) AS weight,
           CAST(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) AS BIGINT) AS h FROM documents LEFT JOIN weights USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM final LEFT JOIN placed USING (doc_id)"""
