"""Examiner verdicts: validation, overlay, feedback and agreement; cost overrides, review times and the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselens.functions.expressions import minutes
from caselens.functions.vocabulary import CONFIRMING, REFUTING, TRUE_SUB_TYPES, VERDICTS

VERDICT = "finding_id string, verdict string, capability_link string, authority_violated string, sub_type string, duplicate_of string, recorded_at timestamp, seq long"
MIN_CALIBRATION = 5


def validate(verdicts: DataFrame) -> DataFrame:
    """Adds `problem`: null for a verdict that may be recorded, else why it may not."""
    true = F.col("verdict") == "TRUE_SUPERVISORY_FINDING"
    lacks = F.col("capability_link").isNull() | F.col("authority_violated").isNull()
    problem = (
        F.when(F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS), "unknown verdict")
        .when(true & lacks, "a confirmed finding needs its capability and authority")
        .when(true & (F.col("sub_type").isNull() | ~F.col("sub_type").isin(*TRUE_SUB_TYPES)), "a confirmed finding needs a known sub-type")
        .when((F.col("verdict") == "DUPLICATE_OF_EXISTING_FINDING") & F.col("duplicate_of").isNull(), "a duplicate needs its target")
    )
    return verdicts.withColumn("problem", problem)


def latest(verdicts: DataFrame) -> DataFrame:
    """The last valid verdict of each finding in an append-only log."""
    newest = F.row_number().over(W.partitionBy("finding_id").orderBy(F.desc("recorded_at"), F.desc("seq")))
    return validate(verdicts).where("problem is null").withColumn("_n", newest).where("_n = 1").drop("_n", "problem")


def overlay(concerns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Concerns with the fields of their last verdict, null where there is none. Concerns themselves never change."""
    fields = ["verdict", "capability_link", "authority_violated", "sub_type", "duplicate_of", "recorded_at"]
    return concerns.join(latest(verdicts).select("finding_id", *fields), "finding_id", "left")


def feedback(outcomes: DataFrame) -> DataFrame:
    """outcomes: bucket, sample (risk_selected or random_calibration), verdict. Beta(1, 1) posteriors of each."""
    known = F.assert_true(F.col("sample").isin("risk_selected", "random_calibration"), "unknown sample")
    rows = outcomes.where(known.isNull())
    out = rows.groupBy("bucket", "sample").agg((1 + F.count_if(F.col("verdict").isin(*CONFIRMING))).alias("alpha"), (1 + F.count_if(F.col("verdict").isin(*REFUTING))).alias("beta"), F.count_if(~F.col("verdict").isin(*CONFIRMING, *REFUTING)).alias("n_logged"))
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def debiased(posteriors: DataFrame) -> DataFrame:
    """Per bucket the calibration sample's mean once it has MIN_CALIBRATION outcomes, else the selected sample's."""
    of = lambda s, c: F.max(F.when(F.col("sample") == s, F.col(c)))
    rows = posteriors.groupBy("bucket").agg(of("random_calibration", "mean").alias("_c"), (of("random_calibration", "alpha") + of("random_calibration", "beta") - 2).alias("_n"), of("risk_selected", "mean").alias("_r"))
    fit = F.coalesce(F.col("_n") >= MIN_CALIBRATION, F.lit(False))
    return rows.select("bucket", F.when(fit, F.col("_c")).otherwise(F.coalesce("_r", F.lit(0.5))).alias("rate"), F.when(fit, "random_calibration").otherwise("risk_selected").alias("source"))


def agreement(judged: DataFrame) -> DataFrame:
    """judged: finding_type, authority, verdict. Verdicts and confirmations by type, by authority and in all."""
    rows = judged.where("verdict is not null")
    out = rows.groupingSets([[F.col("finding_type")], [F.col("authority")], []], F.col("finding_type"), F.col("authority")).agg(F.count("*").alias("n_verdicts"), F.count_if(F.col("verdict").isin(*CONFIRMING)).alias("n_confirmed"))
    return out.withColumn("rate", F.try_divide(F.col("n_confirmed"), F.col("n_verdicts")))


def with_overrides(concerns: DataFrame, overrides: DataFrame) -> DataFrame:
    """Minutes as set by an examiner (finding_id, minutes) where one did; selection and its explanation both see them."""
    mine = overrides.groupBy("finding_id").agg(F.max_by("minutes", "seq").alias("_m"))
    return concerns.join(mine, "finding_id", "left").withColumn("minutes", F.coalesce("_m", "minutes")).drop("_m")


def review_times(timers: DataFrame) -> DataFrame:
    """timers: finding_id, started_at, stopped_at. Adds the minutes between; a timer that runs, or ran backwards, is left out."""
    took = minutes(F.col("started_at"), F.col("stopped_at"))
    return timers.withColumn("minutes", took).where("minutes >= 0")


AUDIT = "at timestamp, action string, finding_id string, value string"


def audit_rows(kind: str, rows: DataFrame, value: str) -> DataFrame:
    """COST_OVERRIDE, REVIEW_TIMER_STOPPED or VERDICT_RECORDED rows for the append-only trail."""
    return rows.select(F.current_timestamp().alias("at"), F.lit(kind).alias("action"), "finding_id", F.col(value).cast("string").alias("value"))
