"""Where logs, submissions and verdicts are kept."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caselens.operators.log import EVENT, OBJECT, OBJECT_ATTR, Log

_PARTS = ("event", "object", "object_attr")
MANIFEST = "cse_id string, batch_id string, submitted_at timestamp, n_cases long, n_concerns long, per_type map<string,struct<case_count:long,flagged_count:long>>"


class Store:
    """Tables under one folder of any file system; a log's rows lie under attempt, cse_id and batch_id, so a batch is read
    by its partitions alone.

    A batch is written in folders of its own, by the name of its attempt, and counts once the manifest has that: its rows,
    one file that appears as a whole, come last. What a failed attempt leaves is never read, batches can be written at
    the same time, and a batch that is submitted again takes the place of the one before. vacuum() drops what the manifest
    doesn't name.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _path(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str) -> DataFrame:
        path, files = self._path(name)
        return self.spark.read.schema(schema).parquet(self._at(name)) if files.exists(path) else self.spark.createDataFrame([], schema)

    def write_log(self, log: Log, batch_id: str, attempt: str) -> None:
        for name in _PARTS:
            getattr(log, name).withColumn("batch_id", F.lit(batch_id)).write.partitionBy("cse_id", "batch_id").parquet(self._at(f"{name}/attempt={attempt}"))

    def _attempt(self, cse_id: str, batch_id: str) -> str | None:
        """The attempt that the manifest names for a batch."""
        row = self._rows().where((F.col("cse_id") == cse_id) & (F.col("batch_id") == batch_id)).first()
        return row["attempt"] if row else None

    def read_log(self, cse_id: str, batch_id: str) -> Log:
        """The log of a batch; an empty one if there is no such batch."""
        attempt = self._attempt(cse_id, batch_id)

        def rows(name: str, schema: str) -> DataFrame:
            """Reading puts partition columns last, so the schema's order is restored."""
            got = self._read(name, f"{schema}, batch_id string, attempt string").where((F.col("cse_id") == cse_id) & (F.col("batch_id") == batch_id) & (F.col("attempt") == (attempt or "")))
            return got.select(*StructType.fromDDL(schema).names)

        return Log(*map(rows, _PARTS, (EVENT, OBJECT, OBJECT_ATTR)))

    def submit(self, log: Log, concerns: DataFrame, batch_id: str, submitted_at: str, low_confidence: DataFrame | None = None) -> None:
        """Store a batch: the log, the cases of low confidence, and last a manifest row for each entity."""
        attempt = uuid.uuid4().hex
        self.write_log(log, batch_id, attempt)
        if low_confidence is not None:
            low_confidence.select("cse_id", "case_id", F.lit(batch_id).alias("batch_id")).write.parquet(self._at(f"low_confidence/attempt={attempt}"))
        cases = log.object.where("type = 'Case'").groupBy("cse_id").agg(F.count("*").alias("n_cases"))
        kinds = concerns.groupBy("cse_id", "finding_type").agg(F.count("*").alias("n"), F.count_distinct("primary_id").alias("flagged")).join(cases, "cse_id")
        per_type = kinds.groupBy("cse_id").agg(F.sum("n").alias("n_concerns"), F.map_from_entries(F.collect_list(F.struct("finding_type", F.struct(F.col("n_cases").alias("case_count"), F.col("flagged").alias("flagged_count"))))).alias("per_type"))
        rows = cases.join(per_type, "cse_id", "left").select("cse_id", F.lit(batch_id).alias("batch_id"), F.lit(submitted_at).cast("timestamp").alias("submitted_at"), "n_cases", F.coalesce("n_concerns", F.lit(0).cast("long")).alias("n_concerns"), "per_type")
        rows.withColumn("written", F.lit(time.time_ns())).coalesce(1).write.parquet(self._at(f"manifest/attempt={attempt}"))

    def _rows(self) -> DataFrame:
        """The manifest with the attempt of each batch that was written last."""
        newest = F.row_number().over(W.partitionBy("cse_id", "batch_id").orderBy(F.desc("written"), F.desc("attempt")))
        return self._read("manifest", f"{MANIFEST}, written long, attempt string").withColumn("_n", newest).where("_n = 1").drop("_n", "written")

    def vacuum(self) -> int:
        """Drop the files of attempts that the manifest doesn't name, for when no batch is being written; how many
        folders went."""
        named = {r["attempt"] for r in self._rows().select("attempt").distinct().toLocalIterator()}
        gone = 0
        for name in (*_PARTS, "low_confidence", "manifest"):
            path, files = self._path(f"{name}/attempt=*")
            for found in files.globStatus(path) or []:
                if found.getPath().getName().removeprefix("attempt=") not in named:
                    files.delete(found.getPath(), True)
                    gone += 1
        return gone

    def manifest(self) -> DataFrame:
        return self._rows().drop("attempt")

    def entities(self) -> DataFrame:
        return self.manifest().select("cse_id").distinct()

    def submissions(self, cse_id: str) -> DataFrame:
        return self.manifest().where(F.col("cse_id") == cse_id).orderBy("submitted_at", "batch_id")

    def history(self, cse_id: str) -> DataFrame:
        """An entity's submissions, the newest first."""
        return self.manifest().where(F.col("cse_id") == cse_id).orderBy(F.desc("submitted_at"), F.desc("batch_id"))

    def latest_two(self) -> DataFrame:
        newest = F.row_number().over(W.partitionBy("cse_id").orderBy(F.desc("submitted_at"), F.desc("batch_id")))
        return self.manifest().withColumn("newest", newest).where("newest <= 2")

    def low_confidence(self, cse_id: str, batch_id: str) -> DataFrame:
        rows = self._read("low_confidence", "cse_id string, case_id string, batch_id string, attempt string")
        return rows.where((F.col("cse_id") == cse_id) & (F.col("batch_id") == batch_id) & (F.col("attempt") == (self._attempt(cse_id, batch_id) or ""))).drop("batch_id", "attempt")

    def load_batch(self, cse_id: str, batch_id: str) -> DataFrame:
        """The concerns of a stored batch, found again from its log, with the verdicts recorded since."""
        from caselens.operators import fusion, review

        found = fusion.fuse(self.read_log(cse_id, batch_id), self.low_confidence(cse_id, batch_id)).concerns
        return review.overlay(found, self.verdicts())

    def record_verdicts(self, verdicts: DataFrame) -> None:
        """Append; an invalid verdict stops the whole call and nothing is written."""
        from caselens.operators import review

        bad = review.validate(verdicts).where("problem is not null").select("finding_id", "problem").limit(10).collect()
        if bad:
            raise ValueError(f"invalid verdicts: {[tuple(r) for r in bad]}")
        verdicts.write.parquet(self._at(f"verdicts/{time.time_ns():020}-{uuid.uuid4().hex}"))

    def _recorded(self) -> list[str]:
        """Folders of verdicts that were written whole, oldest first."""
        path, files = self._path("verdicts/*/_SUCCESS")
        return sorted(str(found.getPath().getParent()) for found in files.globStatus(path) or [])

    def verdicts(self) -> DataFrame:
        """All verdicts recorded; one that was recorded twice in all its fields counts once."""
        from caselens.operators.review import VERDICT

        folders = self._recorded()
        return self.spark.read.schema(VERDICT).parquet(*folders).distinct() if folders else self.spark.createDataFrame([], VERDICT)

    def compact_verdicts(self) -> None:
        """Write the verdicts of all calls so far as one folder, then drop theirs. If this stops between the two, verdicts
        lie in both, which reading doesn't mind."""
        folders = self._recorded()
        if len(folders) > 1:
            self.verdicts().coalesce(1 + len(folders) // 100).write.parquet(self._at(f"verdicts/{time.time_ns():020}-{uuid.uuid4().hex}"))
            path, files = self._path("verdicts")
            for folder in folders:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def worse_prior(manifest: DataFrame) -> DataFrame:
    """A made-up earlier cycle for each entity's only submission, with more flagged: a demonstration, marked as such."""
    more = F.transform_values("per_type", lambda _, v: F.struct(v["case_count"].alias("case_count"), F.least(v["case_count"], v["flagged_count"] + F.greatest(F.lit(2), F.floor(v["flagged_count"] / 3))).cast("long").alias("flagged_count")))
    only = manifest.join(manifest.groupBy("cse_id").count().where("count = 1").select("cse_id"), "cse_id", "left_semi")
    return only.withColumns({"submitted_at": F.date_trunc("month", "submitted_at") - F.expr("interval 1 day"), "batch_id": F.lit("seed"), "per_type": more})


def evidence_json(concerns: DataFrame) -> DataFrame:
    """Each concern as one JSON text."""
    return concerns.select("cse_id", "finding_id", F.to_json(F.struct(*sorted(concerns.columns)), {"pretty": "true"}).alias("package"))


def evidence_bundle(concerns: DataFrame) -> DataFrame:
    """{cse_id, finding_count, findings} of each entity, in a fixed order and without a time, so equal runs are equal."""
    out = concerns.groupBy("cse_id").agg(F.count("*").alias("finding_count"), F.sort_array(F.collect_list(F.struct("finding_id", *sorted(set(concerns.columns) - {"finding_id", "cse_id"})))).alias("findings"))
    return out.select("cse_id", F.to_json(F.struct("cse_id", "finding_count", "findings")).alias("bundle"))
