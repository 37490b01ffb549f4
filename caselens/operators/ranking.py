"""Ranks within keys that no task has to hold whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselens.sources.scratch import held

ROWS_PER_RANGE = 100_000


def ranked(rows: DataFrame, keys: list[str], lead: list[Column], order: list[Column], out: str) -> DataFrame:
    """1-based rank within `keys` by (lead, order).

    lead: coarse values that the order begins with, such as the first characters of an id. Rows that share keys and lead
    are ranked by one task; how many lie before them is a running sum over the counts of leads.
    """
    names = [f"_lead{i}" for i in range(len(lead))]
    rows = rows.withColumns(dict(zip(names, lead, strict=True)))
    sums = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*keys, *names).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(sums), F.lit(0))).drop("_n")
    inside = rows.withColumn("_inside", F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order)))
    return inside.join(before, [*keys, *names]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before", *names)


def start_of(text: str, width: int = 3) -> Column:
    """The first characters of a text, which order as the text does."""
    return F.substring(text, 1, width)


def ranked_by_range(rows: DataFrame, keys: list[str], order: list[Column], out: str, per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """1-based rank within `keys` by `order`, whatever its values begin with.

    Rows are cut into ranges of keys and order that follow from the rows themselves, so that no task ranks more than
    about `per_range` as long as they differ; how many lie before a range is a running sum over the ranges of its keys.
    """
    names = [f"_order{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    ranges = max(1, -(-rows.count() // per_range))
    cut = held(keyed.repartitionByRange(ranges, *keys, *names).withColumn("_range", F.spark_partition_id()))
    sums = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(sums), F.lit(0))).drop("_n")
    inside = cut.withColumn("_inside", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*names)))
    return inside.join(before, [*keys, "_range"]).withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before", "_range", *names)
