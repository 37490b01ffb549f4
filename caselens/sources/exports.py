"""Readers of case-management exports: every format gives {table: DataFrame}, all columns text."""

from __future__ import annotations

import json
import sqlite3
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from caselens.functions.vocabulary import TABLES

Tables = dict[str, DataFrame]


def _files(spark: SparkSession, directory: str, suffix: str) -> dict[str, str]:
    """Files of a folder in any file system that Spark reads, by table; names that are no table are passed over."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = {PurePosixPath(f.getPath().getName()): f.getPath().toString() for f in found}
    return {n.stem: p for n, p in names.items() if n.suffix == suffix and n.stem in TABLES}


def _text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "_position"), *(["_position"] if "_position" in df.columns else []))


def read_csv(spark: SparkSession, directory: str | None = None, paths: dict[str, str] | None = None) -> Tables:
    """One file for each table, with a header, in UTF-8."""
    paths = paths if paths is not None else _files(spark, directory, ".csv")
    return {t: spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for t, p in paths.items() if t in TABLES}


def _opens_with(spark: SparkSession, path: str) -> str:
    """The first character of a file that isn't white space."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        while 0 <= (c := stream.read()):
            if not chr(c).isspace():
                return chr(c)
        return ""
    finally:
        stream.close()


def read_json(spark: SparkSession, directory: str | None = None, paths: dict[str, str] | None = None) -> Tables:
    """One file for each table, an array of objects; anything else fails."""
    paths = paths if paths is not None else _files(spark, directory, ".json")
    out = {}
    for t, p in paths.items():
        if t in TABLES:
            if _opens_with(spark, p) != "[":
                raise ValueError(f"{p}: not an array")
            out[t] = spark.read.option("multiLine", True).option("primitivesAsString", True).json(p)
    return out


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.options["dbtable"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        quoted = '"' + partition.value.replace('"', '""') + '"'
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {', '.join('"' + c.replace('"', '""') + '"' for c in self.schema.names)} FROM {quoted}"):
                yield tuple(None if v is None else str(v) for v in row)


class Sqlite(DataSource):
    """A table of a SQLite file that every executor can open, read only: options path and dbtable."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            quoted = self.options["dbtable"].replace('"', '""')
            return StructType([StructField(r[1], StringType()) for r in db.execute(f'PRAGMA table_info("{quoted}")')])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]


def read_sqlite(spark: SparkSession, path: str) -> Tables:
    spark.dataSource.register(Sqlite)
    return {t: spark.read.format("sqlite_table").option("path", path).option("dbtable", t).load() for t in sqlite_tables(path) if t in TABLES}


def read_rest(spark: SparkSession, base: str, token: str | None = None, timeout: float = 10.0) -> Tables:
    """GET base/table for each table, by a task each; a failing request or bad JSON gives no table, a body that's no
    array fails. What came is held, so every table is asked for once."""
    if not base.startswith(("http://", "https://")):
        raise ValueError("http or https only")

    def fetch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for t in pdf["t"]:
                request = urllib.request.Request(f"{base.rstrip('/')}/{t}", headers={"Authorization": f"Bearer {token}"} if token else {})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as body:
                        rows = json.loads(body.read())
                except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
                    rows = []
                made = [json.dumps(r) for r in rows] if isinstance(rows, list) else [None]
                yield pd.DataFrame({"t": [t] * len(made), "row": made}, dtype=object)

    asked = spark.createDataFrame([(t,) for t in TABLES], "t string").repartition(len(TABLES), "t")
    got = asked.mapInPandas(fetch, "t string, row string").persist()
    if bad := [r.t for r in got.where("row is null").select("t").distinct().collect()]:
        raise ValueError(f"{', '.join(bad)}: not an array")
    rows = got.select("t", F.from_json("row", "map<string,string>").alias("m"))
    names: dict[str, list[str]] = {}
    for r in rows.select("t", F.explode(F.map_keys("m")).alias("c")).distinct().collect():  # columns, not rows
        names.setdefault(r.t, []).append(r.c)
    return {t: rows.where(F.col("t") == t).select(*(F.col("m")[c].alias(c) for c in sorted(cs))) for t, cs in names.items()}


READERS: dict[str, Callable[..., Tables]] = {"csv": read_csv, "json": read_json, "sqlite": read_sqlite, "rest": read_rest}


def discover(tables: Tables) -> dict[str, list[str]]:
    """Columns of each table as exported."""
    return {t: df.columns for t, df in tables.items()}
