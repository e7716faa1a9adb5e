"""What plain SQL over the archive reaches besides the recipes: each text runs as it stands on the stored recordings, but
that of ``sql_frames``, whose frames are written so that their cost grows with the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import sql as functions
from lectern.plans import oracle as o
from lectern.plans.registry import ORACLE_SQL, QUERIES
from lectern.sources import demo

#: Name -> the text for Spark, and DuckDB's where it differs.
TEXTS: dict[str, tuple[str, str | None]] = {
    "sql_windows": (
        """SELECT folder_name, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quart, lag(folder_name, 1) OVER w AS prev, lead(folder_name, 1) OVER w AS nxt,
  round(cume_dist() OVER w, 6) AS cd, round(percent_rank() OVER w, 6) AS pr, round(sum(duration_sec) OVER (PARTITION BY mode_name ORDER BY datetime_iso, folder_name ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
FROM rec WINDOW w AS (PARTITION BY mode_name ORDER BY datetime_iso, folder_name)""",
        None,
    ),
    "sql_frames": (
        """SELECT folder_name, first_value(folder_name) OVER w AS earliest, last_value(folder_name) OVER (PARTITION BY mode_name ORDER BY datetime_iso, folder_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS latest,
  nth_value(folder_name, 2) OVER (PARTITION BY mode_name ORDER BY datetime_iso, folder_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
  count(*) OVER (PARTITION BY mode_name ORDER BY raw_word_count RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS alike,
  max(raw_word_count) OVER (PARTITION BY mode_name ORDER BY raw_word_count RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
FROM rec WINDOW w AS (PARTITION BY mode_name ORDER BY datetime_iso, folder_name)""",
        None,
    ),
    "sql_set_operations": ("SELECT mode_name FROM rec WHERE language = 'de' INTERSECT SELECT mode_name FROM rec WHERE app_name = 'Zoom' UNION SELECT app_name FROM rec EXCEPT SELECT 'Slack'", None),
    "sql_aggregates": (
        """SELECT language, count(*) FILTER (WHERE superseded_by IS NULL) AS canonical, count(DISTINCT mode_name) AS modes, min(datetime_iso) AS first_one, max(datetime_iso) AS last_one,
  sum(CASE WHEN app_name LIKE 'Z%' THEN 1 ELSE 0 END) AS zooms FROM rec GROUP BY language HAVING count(*) > 1""",
        None,
    ),
    "sql_text_aggregates": (
        """SELECT mode_name, listagg(DISTINCT language, ',') WITHIN GROUP (ORDER BY language) AS languages, coalesce(sum(CASE WHEN app_name = 'Zoom' THEN duration_sec END), 0D) AS total_zoom,
  to_json(array_sort(collect_set(app_name))) AS apps_json, max(greatest(raw_word_count, length(folder_name))) AS most, min(least(raw_word_count, 7)) AS fewest
FROM rec GROUP BY mode_name""",
        """SELECT mode_name, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, coalesce(sum(CASE WHEN app_name = 'Zoom' THEN duration_sec END), 0::DOUBLE) AS total_zoom,
  CAST(to_json(coalesce(list_sort(list(DISTINCT app_name) FILTER (WHERE app_name IS NOT NULL)), [])) AS VARCHAR) AS apps_json, max(greatest(raw_word_count, length(folder_name))) AS most, min(least(raw_word_count, 7)) AS fewest
FROM rec GROUP BY mode_name""",
    ),
    "sql_predicates": (
        """SELECT folder_name FROM rec WHERE mode_name_lower IN ('src1', 'src4', 'src6') AND (glob('*[13]', folder_name) OR folder_name RLIKE '^[2-4]+$' OR folder_name LIKE '_7')
  AND app_name IS DISTINCT FROM 'Zoom' AND (doc_id & 3) <> 2 AND (doc_id | 1) > 0 AND (doc_id ^ 5) <> 0 AND language NOT IN ('xx') AND NOT glob('9?9', folder_name)""",
        """SELECT folder_name FROM rec WHERE mode_name_lower IN ('src1', 'src4', 'src6') AND (folder_name GLOB '*[13]' OR regexp_full_match(folder_name, '[2-4]+') OR folder_name LIKE '_7')
  AND app_name IS DISTINCT FROM 'Zoom' AND (doc_id & 3) <> 2 AND (doc_id | 1) > 0 AND xor(doc_id, 5) <> 0 AND language NOT IN ('xx') AND NOT folder_name GLOB '9?9'""",
    ),
    "sql_scalars": (
        """SELECT folder_name, printf('%05d/%s', raw_word_count, language) AS made, instr(datetime_iso, 'T') AS at, iif(raw_word_count > 300, 'long', 'short') AS kind, ifnull(app_name, '-') AS app,
  round(julianday(datetime), 6) AS day, unixepoch(datetime) AS epoch, abs(raw_word_count - 300) AS off, greatest(raw_word_count, 300) AS high, char(65) AS letter, unicode(language) AS point,
  coalesce(quote(app_name), 'NULL') AS quoted, get_json_object('{"a":{"b":' || raw_word_count || '}}', '$.a.b') AS inner_one, hex(language) AS hexed, sign(raw_word_count - 300) AS side, ltrim('0', '00' || folder_name) AS bare FROM rec""",
        """SELECT folder_name, printf('%05d/%s', raw_word_count, language) AS made, instr(datetime_iso, 'T') AS at, CASE WHEN raw_word_count > 300 THEN 'long' ELSE 'short' END AS kind, ifnull(app_name, '-') AS app,
  round(epoch_us(ts) / 86400000000::DOUBLE + 2440587.5::DOUBLE, 6) AS day, epoch_us(ts) // 1000000 AS epoch, abs(raw_word_count - 300) AS off, greatest(raw_word_count, 300) AS high, chr(65) AS letter, unicode(language) AS point,
  coalesce('''' || app_name || '''', 'NULL') AS quoted, json_extract_string('{"a":{"b":' || raw_word_count || '}}', '$.a.b') AS inner_one, hex(language) AS hexed, CAST(sign(raw_word_count - 300) AS DOUBLE) AS side, ltrim('00' || folder_name, '0') AS bare FROM rec""",
    ),
    "sql_values_series": (
        """SELECT v.mode, s.n, j.app, count(r.folder_name) AS rows FROM VALUES ('SRC1'), ('SRC6'), ('none') AS v(mode) CROSS JOIN (SELECT explode(sequence(0, 2)) AS n) s
  CROSS JOIN (SELECT explode(from_json('["Cursor","Zoom"]', 'array<string>')) AS app) j LEFT JOIN rec r ON r.mode_name = v.mode AND r.doc_id % 3 = s.n AND r.app_name = j.app GROUP BY v.mode, s.n, j.app""",
        """SELECT v.mode, s.n, j.app, count(r.folder_name) AS rows FROM (VALUES ('SRC1'), ('SRC6'), ('none')) AS v(mode) CROSS JOIN (SELECT n::INTEGER AS n FROM generate_series(0, 2) g(n)) s
  CROSS JOIN (SELECT unnest(from_json('["Cursor","Zoom"]', '["VARCHAR"]')) AS app) j LEFT JOIN rec r ON r.mode_name = v.mode AND r.doc_id % 3 = s.n AND r.app_name = j.app GROUP BY v.mode, s.n, j.app""",
    ),
    "sql_joins": ("SELECT a.folder_name AS later, b.folder_name AS earlier FROM rec a RIGHT JOIN rec b ON a.audio_hash = b.audio_hash AND a.datetime_iso > b.datetime_iso", None),
}
_STEPS = "RECURSIVE steps(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM steps WHERE n < 40)"
_RECURSION = "SELECT n, n * n AS square FROM steps WHERE n IN (SELECT raw_word_count % 50 FROM rec)"


def over_recordings(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        functions.register(spark)
        demo.recordings(spark, sf_dir).createOrReplaceTempView("rec")
        return spark.sql(text)

    return run


for _name, (_text, _other) in TEXTS.items():
    QUERIES[_name], ORACLE_SQL[_name] = over_recordings(_text), f"WITH {o.REC} {_other or _text}"


def _held(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns that ``few`` has for their keys; null keys are equal."""
    named = few.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    return rows.join(named, same, "left").drop(*[f"of_{k}" for k in keys])


def frames(rows: DataFrame) -> DataFrame:
    """What the text of ``sql_frames`` says, without a frame that Spark goes through anew for each row (its cost is the
    square of a mode's rows): the ends of each mode are the first rows in either order, of which tasks pass on two, and
    counts by word count are frames over each mode's distinct word counts."""
    rows = rows.select("folder_name", "mode_name", "datetime_iso", F.col("raw_word_count").alias("words"))
    by_mode = Window.partitionBy("mode_name")
    at = F.row_number().over(by_mode.orderBy("datetime_iso", "folder_name"))
    back = F.row_number().over(by_mode.orderBy(F.desc("datetime_iso"), F.desc("folder_name")))
    nth = lambda k: F.max(F.when(F.col("r") == k, F.col("folder_name")))
    first = rows.withColumn("r", at).filter("r <= 2").groupBy("mode_name").agg(nth(1).alias("earliest"), nth(2).alias("second"))
    last = rows.withColumn("r", back).filter("r <= 1").groupBy("mode_name").agg(nth(1).alias("latest"))
    held = rows.groupBy("mode_name", "words").agg(F.count(F.lit(1)).alias("n"))
    by_words = by_mode.orderBy("words")
    alike = F.sum("n").over(by_words.rangeBetween(-20, 20))
    below = F.max("words").over(by_words.rangeBetween(Window.unboundedPreceding, -1))
    counted = held.select("mode_name", "words", alike.alias("alike"), below.alias("below"))
    ends = _held(first, last, "mode_name")
    out = _held(_held(rows, F.broadcast(ends), "mode_name"), counted, "mode_name", "words")
    return out.select("folder_name", "earliest", "latest", "second", "alike", "below")


QUERIES["sql_frames"] = lambda spark, sf_dir: frames(demo.recordings(spark, sf_dir))  # its SQL twin stays the text
QUERIES["sql_recursion"], ORACLE_SQL["sql_recursion"] = over_recordings(f"WITH {_STEPS} {_RECURSION}"), f"WITH {_STEPS}, {o.REC} {_RECURSION}"


_VEC = """SELECT vec_id, vec_length(v) AS n, vec_to_json(vec_slice(v, 0, 3)) AS head, round(vec_distance_l2(v, w), 6) AS l2, round(vec_distance_l1(v, w), 6) AS l1,
  round(vec_distance_cosine(v, w), 6) AS cosine, round(vec_dot(vec_add(v, w), w) + vec_dot(vec_sub(v, w), w), 6) AS crossed, round(vec_dot(vec_normalize(v), vec_normalize(w)), 6) AS likeness, vec_length(vec_from_json('[1, 2.5]')) AS parsed
FROM both_vectors"""


def vec_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the one with number 7."""
    functions.register(spark)
    rows = demo.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    rows.crossJoin(rows.filter("vec_id = 7").selectExpr("v AS w")).createOrReplaceTempView("both_vectors")  # one row
    return spark.sql(_VEC)


QUERIES["vec_functions"] = vec_functions
ORACLE_SQL["vec_functions"] = """WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS w FROM embeddings),
parts AS (SELECT vec_id, unnest(v) AS x, unnest(w) AS y FROM b), sums AS (SELECT vec_id, sum((x - y) * (x - y)) AS l2, sum(abs(x - y)) AS l1, sum(x * y) AS d, sum(x * x) AS xx, sum(y * y) AS yy FROM parts GROUP BY vec_id)
SELECT vec_id, len(v)::INTEGER AS n, '[' || array_to_string(list_transform(v[1:3], lambda x: printf('%.6f', x)), ',') || ']' AS head, round(sqrt(l2), 6) AS l2, round(l1, 6) AS l1,
  round(1 - d / (sqrt(xx) * sqrt(yy)), 6) AS cosine, round(2 * d, 6) AS crossed, round(d / (sqrt(xx) * sqrt(yy)), 6) AS likeness, 2::INTEGER AS parsed FROM b JOIN sums USING (vec_id)"""
