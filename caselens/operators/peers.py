"""Peer statistics adjusted for exposure, with shrinkage; weekly rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.expressions import minutes
from caselens.functions.vocabulary import LOW_EXPOSURE, Z_95, Z_FLAG

from .log import Log, case_context, case_profile


def negative_space(obs: DataFrame, *keys: str) -> DataFrame:
    """obs: keys, group_id, exposure, observed. Adds expected, ci_low, ci_high, z, abstain, flagged (z <= -2).

    Within each key the pooled rate is that of a Poisson model with an exposure offset, in closed form: events over
    exposure, with a standard error of 1 / sqrt(events) on the log scale. Groups of little exposure are measured
    against a rate shrunk by the spread of all groups' rates. Under two groups with exposure, or no event at all: every
    row abstains with INSUFFICIENT_EVIDENCE.
    """
    some = F.col("exposure") > 0
    rate = F.when(some, F.col("observed") / F.col("exposure"))
    by = [F.col(k) for k in keys]
    pool = obs.groupBy(*by).agg(F.count_if(some).alias("_n"), F.sum(F.when(some, F.col("observed"))).cast("double").alias("_o"), F.sum(F.when(some, F.col("exposure"))).cast("double").alias("_e"), F.avg(rate).alias("_m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("_v"))
    rows = obs.join(pool, list(keys)) if keys else obs.crossJoin(F.broadcast(pool))  # one row
    fails = (F.col("_n") < 2) | (F.coalesce("_o", F.lit(0.0)) <= 0)
    abstain = F.when(fails, "INSUFFICIENT_EVIDENCE").when(~some, "INSUFFICIENT_EXPOSURE")
    pooled = F.col("_o") / F.col("_e")
    beta = F.col("_m") / F.col("_v")
    shrunk = F.when(F.col("_v") <= 0, F.col("_m")).otherwise((beta * F.col("_m") + F.col("observed")) / (beta + F.col("exposure")))
    expected = F.when(fails, None).when(~some, 0.0).otherwise(F.when(F.col("exposure") < LOW_EXPOSURE, shrunk).otherwise(pooled) * F.col("exposure"))
    wide = F.exp(F.lit(Z_95) / F.sqrt("_o"))
    rows = rows.withColumns({"abstain": abstain, "expected": expected, "ci_low": F.when(~fails, pooled / wide * F.col("exposure")), "ci_high": F.when(~fails, pooled * wide * F.col("exposure"))})
    z = F.when(F.col("expected") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("expected"))
    rows = rows.withColumn("z", F.when(F.col("abstain").isNull(), z))
    return rows.withColumn("flagged", F.coalesce(F.col("z") <= -Z_FLAG, F.lit(False))).drop("_n", "_o", "_e", "_m", "_v")


def two_sided(z: Column | str = "z") -> Column:
    return F.coalesce(F.abs(z) >= Z_FLAG, F.lit(False))


def weekly_rates(log: Log, within: float = 30.0) -> DataFrame:
    """cse_id, week, in_time, enriched: weeks since an entity's first assignment, the share of critical alerts on critical
    assets that were escalated within so many minutes of it, and the share of cases enriched. No such alert: 0."""
    profile = case_profile(log).where("first_ASSIGN is not null").select("cse_id", "case_id", "first_ASSIGN", "first_ESCALATE", (F.col("n_ENRICH") > 0).alias("_enriched"))
    start = profile.groupBy("cse_id").agg(F.min("first_ASSIGN").alias("_start"))
    duty = case_context(log).where("alert_severity = 'CRITICAL' and asset_criticality in ('HIGH', 'CRITICAL')").select("cse_id", "case_id", F.lit(True).alias("_duty")).distinct()
    rows = profile.join(start, "cse_id").join(duty, ["cse_id", "case_id"], "left")
    week = F.floor(minutes(F.col("_start"), F.col("first_ASSIGN")) / (7 * 24 * 60)).cast("int")
    soon = F.coalesce(minutes(F.col("first_ASSIGN"), F.col("first_ESCALATE")) <= within, F.lit(False))
    due = F.coalesce("_duty", F.lit(False))
    out = rows.groupBy("cse_id", week.alias("week")).agg(F.count_if(due).alias("_n"), F.count_if(due & soon).alias("_soon"), F.avg(F.col("_enriched").cast("double")).alias("enriched"))
    return out.select("cse_id", "week", F.coalesce(F.try_divide("_soon", "_n"), F.lit(0.0)).alias("in_time"), "enriched")
