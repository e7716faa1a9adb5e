"""SQL functions that queries over an archive may call besides Spark's own, as expressions that Catalyst inlines.

They bear the names that the archive's users know: of vector functions, and of scalar functions of SQLite.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

VERSION = "lectern-vec 1"

#: Name and parameters -> type and expression.
FUNCTIONS = {
    "vec_version()": ("STRING", f"'{VERSION}'"),
    "vec_length(v ARRAY<DOUBLE>)": ("INT", "size(v)"),
    "vec_to_json(v ARRAY<DOUBLE>)": ("STRING", "'[' || array_join(transform(v, x -> format_string('%.6f', x)), ',') || ']'"),
    "vec_from_json(text STRING)": ("ARRAY<DOUBLE>", "from_json(text, 'array<double>')"),
    "vec_add(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x + y)"),
    "vec_sub(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("ARRAY<DOUBLE>", "zip_with(a, b, (x, y) -> x - y)"),
    "vec_slice(v ARRAY<DOUBLE>, first INT, beyond INT)": ("ARRAY<DOUBLE>", "slice(v, first + 1, beyond - first)"),
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (t, x) -> t + x)"),
    "vec_normalize(v ARRAY<DOUBLE>)": ("ARRAY<DOUBLE>", "transform(v, x -> try_divide(x, sqrt(aggregate(v, 0D, (t, y) -> t + y * y))))"),
    "vec_distance_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "1 - try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (t, x) -> t + x), sqrt(aggregate(a, 0D, (t, x) -> t + x * x)) * sqrt(aggregate(b, 0D, (t, x) -> t + x * x)))",
    ),
    "vec_distance_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (t, x) -> t + x))"),
    "vec_distance_l1(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (t, x) -> t + x)"),
    # Scalars of SQLite that Spark lacks or names otherwise.
    "unixepoch(at STRING)": ("BIGINT", "unix_seconds(try_cast(at AS TIMESTAMP))"),
    "julianday(at STRING)": ("DOUBLE", "unix_micros(try_cast(at AS TIMESTAMP)) / 86400000000D + 2440587.5D"),
    "unicode(text STRING)": ("INT", "nullif(ascii(text), 0)"),
    "sqlite_quote(text STRING)": ("STRING", r"""coalesce('\'' || replace(text, '\'', '\'\'') || '\'', 'NULL')"""),
    "sqlite_random()": ("BIGINT", "CAST((rand() - 0.5D) * 18446744073709551615D AS BIGINT)"),
    # A pattern's parts become those of a regular expression: * and ?, sets in brackets, any other character itself. A
    # bracket that isn't closed matches nothing.
    "glob(pattern STRING, text STRING)": (
        "BOOLEAN",
        r"""text RLIKE ('(?s)^' || array_join(transform(regexp_extract_all(pattern, r'(?s)\[\^?\]?[^\]]*\]|.', 0), part -> CASE
          WHEN part = '*' THEN '.*' WHEN part = '?' THEN '.' WHEN part = '[' THEN '(?!)'
          WHEN length(part) > 1 THEN '[' || if(startswith(part, '[^'), '^', '') || regexp_replace(substr(part, if(startswith(part, '[^'), 3, 2), length(part) - if(startswith(part, '[^'), 3, 2)), r'([\\\[\]&^])', r'\\$1') || ']'
          ELSE regexp_replace(part, r'([^\p{L}\p{N}\s])', r'\\$1') END), '') || '$')""",
    ),
}


#: Functions under other names: Spark's own, which take and give any type, and those that replace one of Spark's.
ALIASES = {"iif": "if", "quote": "sqlite_quote", "random": "sqlite_random"}


def register(spark: SparkSession) -> None:
    """Defines FUNCTIONS and ALIASES as temporary functions of the session."""
    for head, (kind, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {expression}")
    known, named = spark._jsparkSession.sessionState().functionRegistry(), spark.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
    for name, own in ALIASES.items():
        known.registerFunction(named(name), known.lookupFunction(named(own)).get(), known.lookupFunctionBuilder(named(own)).get())
