"""An extension: batches of case events as files that arrive, through the plans that a batch goes through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caselens.functions.expressions import event_type, parsed_time

SCHEMA = "cse_id string, case_id string, event string, ts string, actor string, handover_reason string"


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """A stream of recognised events: cse_id, case_id, type, time, actor."""
    rows = spark.readStream.schema(SCHEMA).option("header", True).csv(path)
    return rows.select("cse_id", "case_id", event_type(F.col("event")).alias("type"), parsed_time(F.col("ts")).alias("time"), "actor").where("type is not null and time is not null")


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each entity and type by time window; rows later than `late` are left out."""
    return stream.withWatermark("time", late).groupBy(F.window("time", width).alias("w"), "cse_id", "type").agg(F.count("*").alias("n")).select("cse_id", "type", F.col("w.start").alias("start"), "n")


def each_batch(stream: DataFrame, checkpoint: str, plan: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a batch plan over what has arrived, once for each micro-batch, until nothing is left."""
    return stream.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
