"""Session settings that every plan of the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the plans assume of a session: UTC for every date expression, adaptive execution for skew and small
#: partitions. Sizes (shuffle partitions, split sizes, memory) belong to the cluster and aren't set here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "lectern", **conf: str) -> SparkSession:
    """The running session, or a new one, with SETTINGS and the settings given as ``spark_x_y="..."``."""
    builder = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
