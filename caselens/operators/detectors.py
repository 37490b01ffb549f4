"""Structural detectors over the event log. Each returns every row that it judged, with the verdict as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.expressions import minutes

from .log import Log, alert_assets, asset_chain, assignees, case_profile, closed_investigations, investigators, objects, reassignments, routed_cases


MIN_REASSIGNMENTS = 3


def loop_columns(max_distinct_analysts: int = 2) -> dict[str, Column]:
    """Over `reassignments`: what the reassignments of a case look like. A loop goes round few analysts; a shift change
    each time justifies it."""
    n, who = F.col("n_REASSIGN"), F.size(F.array_distinct("reassigned.to")).cast("long")
    loop, justified = (n > who) & (who <= max_distinct_analysts), F.forall("reassigned.shift", lambda s: s)
    return {"n_reassign": n, "n_analysts": who, "sequence": F.concat_ws(">", F.col("reassigned.to")), "is_loop": loop, "justified": justified, "flagged": loop & ~justified}


def reassignment_loops(log: Log, min_reassignments: int = MIN_REASSIGNMENTS, max_distinct_analysts: int = 2) -> DataFrame:
    """Cases with enough reassignments, and whether they go round."""
    rows = reassignments(log).where(F.col("n_REASSIGN") >= min_reassignments)
    return rows.select("cse_id", "case_id", *(c.alias(name) for name, c in loop_columns(max_distinct_analysts).items()))


def case_times(log: Log) -> DataFrame:
    """Closed cases: first event, last CLOSE and the minutes between."""
    out = case_profile(log).where("closed is not null").select("cse_id", "case_id", "opened", "closed")
    return out.withColumn("minutes", minutes(F.col("opened"), F.col("closed")))


def fast_close(log: Log, threshold: float = 30.0) -> DataFrame:
    return case_times(log).withColumn("is_fast", F.col("minutes") < threshold)


def asset_recurrence(log: Log, min_alerts: int = 3) -> DataFrame:
    """Assets with alerts: flagged when they recur and no case of theirs was looked into."""
    out = log.views.get("asset_recurrence")
    if out is None:
        out = asset_chain(log).groupBy("cse_id", "asset_id").agg(F.count_distinct("alert_id").alias("n_alerts"), F.count_distinct("case_id").alias("n_cases"), F.coalesce(F.bool_or("deep"), F.lit(False)).alias("remediated"))
    return out.withColumn("flagged", (F.col("n_alerts") >= min_alerts) & ~F.col("remediated"))


def asset_alerts(log: Log) -> DataFrame:
    """Every asset with its initial criticality and number of alerts, 0 included."""
    if "asset_alerts" in log.views:
        return log.views["asset_alerts"]
    n = alert_assets(log).groupBy("cse_id", "asset_id").agg(F.count("*").alias("n_alerts"))
    assets = objects(log, "Asset", "criticality").select("cse_id", F.col("object_id").alias("asset_id"), "criticality")
    return assets.join(n, ["cse_id", "asset_id"], "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0).cast("long")))


def investigation_uniformity(log: Log, min_cases: int = 5, threshold: float = 0.15) -> DataFrame:
    """Analysts whose investigations take suspiciously alike times: coefficient of variation under the threshold."""
    took = closed_investigations(log).withColumn("m", minutes(F.col("time"), F.col("closed"))).where("m >= 0")
    out = took.groupBy("cse_id", "analyst_id").agg(F.count("*").alias("n_durations"), F.avg("m").alias("mean_minutes"), F.stddev_samp("m").alias("_sd"))
    cov = F.when((F.col("n_durations") >= min_cases) & (F.col("mean_minutes") > 0), F.col("_sd") / F.col("mean_minutes"))
    return out.withColumn("cov", cov).withColumn("flagged", F.coalesce(F.col("cov") < threshold, F.lit(False))).drop("_sd")


def analyst_workload(log: Log) -> DataFrame:
    """Every analyst: cases assigned now and investigations done, zeros kept."""
    assigned = assignees(log).groupBy("cse_id", "analyst_id").agg(F.count("*").alias("n_assigned"))
    done = investigators(log).groupBy("cse_id", "analyst_id").agg(F.count("*").alias("n_investigated"))
    everyone = objects(log, "Analyst").select("cse_id", F.col("object_id").alias("analyst_id"))
    return everyone.join(assigned, ["cse_id", "analyst_id"], "left").join(done, ["cse_id", "analyst_id"], "left").fillna(0, ["n_assigned", "n_investigated"])


def queue_escalations(log: Log) -> DataFrame:
    """Every queue: cases routed to it now and their escalations, zeros kept."""
    n = routed_cases(log).groupBy("cse_id", "queue_id").agg(F.count("*").alias("n_routed"), F.coalesce(F.sum("n_up"), F.lit(0)).alias("n_escalated"))
    everyone = objects(log, "Queue").select("cse_id", F.col("object_id").alias("queue_id"))
    return everyone.join(n, ["cse_id", "queue_id"], "left").fillna(0, ["n_routed", "n_escalated"])
