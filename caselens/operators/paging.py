"""Concerns written so that a page or a search reads few files: sorted and cut by range, with small indexes beside them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS_PER_PART = 50_000
ROWS_PER_FILE = 100_000
GRAM = 3


def by_score() -> list[Column]:
    """The order of pages: the best score first."""
    return [-F.col("concern_score"), F.col("cse_id"), F.col("finding_type"), F.col("primary_id")]


def _read(spark: SparkSession, at: str, schema: StructType | None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(at)


class Pages:
    """Rows in order in parts of ROWS_PER_PART, a stretch of a file each, and for each part its first key and how many rows
    lie before it.

    Keys are kept beside the rows as `_key`. What a page needs of the index is found by a filter, so the driver sees a
    row for each part that the page touches. How many files there are follows from the rows and not from the parts.
    """

    def __init__(self, spark: SparkSession, at: str, schema: StructType | None = None):
        """schema: that of the rows as they were written, which files of no row don't tell."""
        self.rows, self.index = _read(spark, f"{at}/rows", schema), spark.read.parquet(f"{at}/index")
        self.columns = [c for c in self.rows.columns if c not in ("_key", "_place", "_block", "_part")]

    @classmethod
    def write(cls, rows: DataFrame, at: str, order: list[Column], per_part: int = ROWS_PER_PART) -> Pages:
        """order: columns that together name a row, as ascending values."""
        keyed = rows.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
        files = max(1, -(-keyed.count() // max(per_part, ROWS_PER_FILE)))
        cut = keyed.repartitionByRange(files, "_key").withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", "_key")
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # a row's place in its sorted file
        cut = cut.withColumn("_place", place).withColumn("_block", F.floor(F.col("_place") / per_part))
        cut.write.partitionBy("_part").parquet(f"{at}/rows")
        spark, of = rows.sparkSession, ["_part", "_block"]
        back = spark.read.schema(cut.schema).parquet(f"{at}/rows")
        firsts = back.where(F.col("_place") % per_part == 0).select(*of, F.col("_key").alias("first"))
        before = F.coalesce(F.sum("n").over(W.orderBy(*of).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each part
        back.groupBy(*of).agg(F.count("*").alias("n")).join(firsts, of).withColumn("before", before).coalesce(1).write.parquet(f"{at}/index")
        return cls(spark, at, cut.schema)

    def _of(self, parts: list[Row]) -> DataFrame:
        """The rows of some parts of the index."""
        files = {p: [r["_block"] for r in parts if r["_part"] == p] for p in sorted({r["_part"] for r in parts})}
        some = reduce(Column.__or__, [(F.col("_part") == p) & F.col("_block").isin(blocks) for p, blocks in files.items()], F.lit(False))
        return self.rows.where(F.col("_part").isin(list(files)) & some)

    def page(self, number: int, size: int = 25) -> DataFrame:
        """The rows of a page by its number (from 0); none beyond the last."""
        start = number * size
        touched = self.index.where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).orderBy("before").collect()
        skip = start - touched[0]["before"] if touched else 0
        return self._of(touched).orderBy("_key").offset(skip).limit(size).select(*self.columns)

    def cursor(self, last: DataFrame, order: list[Column]) -> Row | None:
        """The key of the last of some rows, to go on from; None if there are none."""
        return last.select(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))).alias("k")).agg(F.max("k").alias("k")).first()["k"]

    def after(self, cursor: Row | None, size: int = 25) -> DataFrame:
        """The rows that follow a key, wherever it lies and even if its row is gone; without one, the first rows."""
        if cursor is None:
            return self.page(0, size)
        key = F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(cursor)))
        at = self.index.where(F.col("first") <= key).agg(F.max("before").alias("b")).first()["b"]
        at = -1 if at is None else at
        more = W.orderBy("before").rowsBetween(W.unboundedPreceding, -1)
        had = F.coalesce(F.sum(F.when(F.col("before") > at, F.col("n"))).over(more), F.lit(0))
        parts = self.index.where(F.col("before") >= at).withColumn("_had", had).where(F.col("_had") < size)
        return self._of(parts.select("_part", "_block").collect()).where(F.col("_key") > key).orderBy("_key").limit(size).select(*self.columns)


def grams(text: Column) -> Column:
    """The different runs of GRAM characters."""
    last = F.char_length(text) - GRAM + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    """Rows in blocks of alike ones, and for each run of three characters of what they show the blocks that have it."""

    def __init__(self, spark: SparkSession, at: str, shown: Callable[[], Column], schema: StructType | None = None):
        self.rows, self.postings, self.shown = _read(spark, f"{at}/rows", schema), spark.read.schema("_block int, gram string").parquet(f"{at}/postings"), shown

    @classmethod
    def write(cls, rows: DataFrame, at: str, shown: Callable[[], Column], alike: list[str], per_block: int = ROWS_PER_PART) -> SearchIndex:
        """shown: the text that a search looks in, in lower case. alike: columns that put rows of like text together."""
        parts = max(1, -(-rows.count() // per_block))
        cut = rows.repartitionByRange(parts, *alike).withColumn("_block", F.spark_partition_id())
        cut.write.partitionBy("_block").parquet(f"{at}/rows")
        spark = rows.sparkSession
        back = spark.read.schema(cut.schema).parquet(f"{at}/rows")
        has = back.select("_block", F.explode(grams(shown())).alias("gram")).distinct()
        has.repartitionByRange(parts, "gram").sortWithinPartitions("gram").write.parquet(f"{at}/postings")  # sorted, so few row groups hold a gram
        return cls(spark, at, shown, cut.schema)

    def blocks(self, text: str) -> list[int] | None:
        """The blocks that have every run of the text; None if it is too short to have one."""
        text = text.lower()
        wanted = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
        if not wanted:
            return None
        found = self.postings.where(F.col("gram").isin(wanted)).groupBy("_block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
        return [r["_block"] for r in found.collect()]  # a number for each block at most

    def search(self, text: str) -> DataFrame:
        """The rows whose shown text holds this one, whatever its case."""
        found = self.blocks(text)
        some = self.rows if found is None else self.rows.where(F.col("_block").isin(found))
        return some.where(F.contains(self.shown(), F.lit(text.lower()))).drop("_block")
