"""Spark session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "tillroll", master: str | None = None, **conf: str) -> SparkSession:
    """UTC clock, ANSI casts and adaptive execution with skew-join splitting.

    ``conf`` takes further settings with ``__`` for the dots, for example
    ``spark__sql__shuffle__partitions="8"``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Recording the Python call site of every column expression costs more than the planning.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
