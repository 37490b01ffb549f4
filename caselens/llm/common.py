"""Small helpers that several corpus operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one where none is set and all runs on one machine (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="caselens-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, so its lineage ends there."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python steps that run within get so many rows at a time, as whole texts of ten thousand fill an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def with_ids(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """_id, further columns, _text for a Python step. The id goes as text, since pandas makes long ids with nulls floats."""
    return docs.select(F.col(id_col).cast("string").alias("_id"), *more, F.col(text_col).alias("_text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


HOT_SHARE = 1024  # a key with over 1 / HOT_SHARE of all rows is hot, so fewer than HOT_SHARE keys are
SALTS = 64


def skewed_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, by: list[str]) -> DataFrame:
    """rows with the columns of facts, which has one row for each key and in `n` how many rows hold it (not returned).

    Hot keys, fewer than HOT_SHARE of them and so safe to broadcast, are dealt by a hash of the columns `by` as well.
    """
    hot = F.col(n) > max(total // HOT_SHARE, SALTS)
    salts = facts.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(n)
    marked = rows.join(F.broadcast(facts.where(hot).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    return marked.withColumn("_salt", salt).drop("_hot").join(salts, [*keys, "_salt"]).drop("_salt")


def parts_for(total: float, each: float, least: int = 1) -> int:
    """How many groups of about `each` units hold `total`; follows the data without an upper bound."""
    return max(least, math.ceil((total or 0) / each))


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
