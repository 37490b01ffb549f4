"""The session settings that the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "caselens", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution; shuffle partitions and memory are the cluster's business, or given in conf."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.master(master) if master else builder
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
