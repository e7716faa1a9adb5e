"""The same tables as ``sources.demo``, in DuckDB's SQL: common table expressions that the SQL twins begin with."""

from __future__ import annotations

WORDS = r"""list_filter(regexp_split_to_array({0}, '[\t\n\x0B\f\r ]+'), lambda w: w <> '')"""
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

REC = f"""
base AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS folder_name, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS ts,
    n_chars * 60.0::DOUBLE AS duration_ms, upper(source) AS mode_name, source AS mode_name_lower, lang AS language,
    CASE doc_id % 5 WHEN 1 THEN 'Cursor' WHEN 2 THEN 'Zoom' WHEN 3 THEN 'Slack' WHEN 4 THEN 'Notes' END AS app_name,
    text AS raw_transcript, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Edited: ' || text END AS result,
    CASE WHEN doc_id % 6 = 1 THEN 'Edited: ' || text END AS llm_result, len({WORDS.format("text")}) AS raw_word_count, sha1(text) AS audio_hash
  FROM documents),
rec AS (
  SELECT *, duration_ms / 1000.0 AS duration_sec, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS datetime_iso,
    CASE WHEN result IS NOT NULL AND result <> '' AND result <> raw_transcript THEN result END AS processed_transcript,
    CASE WHEN result IS NULL OR result = '' OR result = raw_transcript THEN 0
      ELSE length(trim(result)) - length(replace(trim(result), ' ', '')) + 1 END AS processed_word_count,
    NULLIF(first_value(folder_name) OVER (PARTITION BY audio_hash ORDER BY ts DESC, folder_name), folder_name) AS superseded_by
  FROM base)"""

ABBREVIATIONS = "'Mr.','Mrs.','Ms.','Dr.','Prof.','Sr.','Jr.','St.','vs.','etc.','e.g.','i.e.','Inc.','Ltd.','Co.','Corp.'"


def chunks(source: str, key: str, turns: bool = False) -> str:
    """CTEs ``spans`` (key, idx, s, e) and ``chunk`` (key, chunk_idx, text, ...) of ``source`` (key, body)."""
    near = lambda s, places: f"list_sort(list_transform(list_filter({places}, lambda k: k BETWEEN greatest({s} + 1, {s} + 299 - 30) AND least(n - 1, {s} + 299 + 30)), lambda k: abs(k - {s} - 299) * 100000 + k))[1] % 100000"
    pick = lambda s: f"CASE WHEN {s} + 299 >= n - 1 THEN n - 1 ELSE coalesce({near(s, 'sp')}, {near(s, 'se')}, {s} + 299) END"
    speaker = (
        r"list_filter(range(n - 1), lambda k: k >= 0 AND k + 2 < n AND regexp_full_match(w[k + 2] || ' ' || w[k + 3], '(Speaker|SPEAKER) [0-9]+:|\[(Speaker|SPEAKER) [0-9]+\]:'))" if turns else "[]::BIGINT[]"
    )
    return f"""
toks AS (SELECT {key}, {WORDS.format("body")} AS w FROM {source}),
marks AS (
  SELECT {key}, w, len(w) AS n, list_filter(range(len(w)), lambda k: w[k + 1] LIKE '%!' OR w[k + 1] LIKE '%?' OR (w[k + 1] LIKE '%.'
    AND w[k + 1] NOT LIKE '%..' AND NOT regexp_matches(w[k + 1], '^[0-9]') AND length(w[k + 1]) > 2 AND w[k + 1] NOT IN ({ABBREVIATIONS}))) AS se
  FROM toks WHERE len(w) >= 500),
flags AS (SELECT *, {speaker} AS sp FROM marks),
spans AS (
  SELECT {key}, n, se, sp, 0::BIGINT AS idx, 0::BIGINT AS s, ({pick("0")})::BIGINT AS e FROM flags
  UNION ALL
  SELECT {key}, n, se, sp, idx + 1, greatest(s + 1, e + 1 - 50), ({pick("greatest(s + 1, e + 1 - 50)")})::BIGINT FROM spans WHERE e < n - 1),
ends AS (SELECT {key}, idx, s, e, n, lead(e) OVER k AS next_e, lag(e) OVER k AS prev_e FROM spans WINDOW k AS (PARTITION BY {key} ORDER BY idx)),
kept AS (
  SELECT {key}, idx, s, CASE WHEN next_e = n - 1 AND next_e - e < 100 THEN next_e ELSE e END AS e FROM ends
  WHERE NOT (e = n - 1 AND prev_e IS NOT NULL AND e - prev_e < 100)),
chunk AS (
  SELECT k.{key}, k.idx::INTEGER AS chunk_idx, array_to_string(t.w[k.s + 1 : k.e + 1], ' ') AS text, k.s::INTEGER AS start_word,
    k.e::INTEGER AS end_word, (k.e - k.s + 1)::INTEGER AS word_count
  FROM kept k JOIN toks t USING ({key}))"""


LONG = """
body AS (SELECT folder_name, coalesce(llm_result, raw_transcript) AS body FROM rec WHERE superseded_by IS NULL)"""

QUERY = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 7)"
DISTANCE = "(1 - list_dot_product({0}::DOUBLE[], qv) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product(qv, qv))))"
ROWVEC = "rowvec AS (SELECT CAST(vec_id AS VARCHAR) AS folder_name, embedding::DOUBLE[] AS embedding FROM embeddings)"
CHUNKVEC = "chunkvec AS (SELECT folder_name, chunk_idx, c.text, embedding::DOUBLE[] AS embedding FROM chunk c JOIN embeddings v ON v.vec_id = (CAST(c.folder_name AS BIGINT) * 31 + c.chunk_idx) % (SELECT count(*) FROM embeddings))"


def postings(source: str, key: str, columns: tuple[str, ...]) -> str:
    """CTEs ``post`` (doc, col, pos, term), ``len_`` (doc, dl) and ``corpus`` (big_n, mean)."""
    parts = " UNION ALL ".join(f"SELECT doc, '{c}' AS col, unnest(t_{c}) AS term, unnest(range(len(t_{c}))) AS pos FROM split" for c in columns)
    return f"""
split AS (SELECT {key} AS doc, {", ".join(f"{TOKENS.format(f"coalesce({c}, '')")} AS t_{c}" for c in columns)} FROM {source}),
post AS ({parts}),
len_ AS (SELECT doc, {" + ".join(f"len(t_{c})" for c in columns)} AS dl FROM split),
corpus AS (SELECT count(*) AS big_n, avg(dl) AS mean FROM len_)"""


def instances(terms: str) -> str:
    """Instances of a phrase of unprefixed terms: (doc, col, pos)."""
    words = terms.split()
    joins = " ".join(f"JOIN post p{k} ON p{k}.doc = p0.doc AND p{k}.col = p0.col AND p{k}.pos = p0.pos + {k} AND p{k}.term = '{w}'" for k, w in enumerate(words) if k)
    return f"SELECT p0.doc, p0.col, p0.pos FROM post p0 {joins} WHERE p0.term = '{words[0]}'"


def scored(matched: str, parts: list[tuple[str, str]]) -> str:
    """CTE ``hits`` (doc, bm25): ``matched`` selects doc; ``parts`` are (instances that count, documents that hold the phrase)."""
    total = " + ".join(
        f"greatest(ln((big_n - n{k} + 0.5::DOUBLE) / (n{k} + 0.5::DOUBLE)), 1e-6::DOUBLE) * coalesce(f{k}, 0) * 2.2::DOUBLE / (coalesce(f{k}, 0) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))" for k in range(len(parts))
    )
    joins = " ".join(
        f"LEFT JOIN (SELECT doc, count(*) AS f{k} FROM ({a}) GROUP BY doc) i{k} USING (doc) CROSS JOIN (SELECT count(DISTINCT doc) AS n{k} FROM ({b}))" for k, (a, b) in enumerate(parts)
    )
    return f"hits AS (SELECT doc, -({total}) AS bm25 FROM len_ {joins} CROSS JOIN corpus WHERE doc IN ({matched}))"
