"""All queries of the library's own operators, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The query that ``entry`` runs.
FLAGSHIP = "hybrid_rrf"


from lectern.plans import passthrough, recipes, upkeep  # noqa: E402, F401  they register their queries here
