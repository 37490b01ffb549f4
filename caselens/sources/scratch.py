"""Intermediate results as Parquet in the folder that a cluster shares, with an owner that drops them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one where none is set and all runs on one machine (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="caselens-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/held-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A name for a folder that goes with what is held."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def held(df: DataFrame, at: str | None = None) -> DataFrame:
    """df written once and read back: its plan ends there, a lost executor costs nothing, and no cache holds it."""
    spark = df.sparkSession
    at = at or new_folder(spark)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_held(spark: SparkSession, at: str | None = None) -> None:
    """Drop what this application holds in a folder, or all of it, once the results that read it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at or _folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
