"""Entities against each other and against their own last submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselens.functions.expressions import lookup
from caselens.functions.vocabulary import AUTHORITY_WEIGHT, CAPABILITY_WEIGHT, CORE_FINDINGS, LOW_EXPOSURE, Z_FLAG

from .log import Log, objects
from .peers import negative_space
from .ranking import ranked_by_range

TIERS = (0.7, 1.5)


def case_counts(log: Log) -> DataFrame:
    return objects(log, "Case").groupBy("cse_id").agg(F.count("*").alias("n_cases"))


def flagged_counts(concerns: DataFrame, *keys: str) -> DataFrame:
    return concerns.groupBy(*(keys or ("cse_id",)), "finding_type").agg(F.count_distinct("primary_id").alias("n_flagged"))


def peer_observations(cases: DataFrame, flagged: DataFrame) -> DataFrame:
    """For every entity and core finding type: exposure its cases, observed its cases that aren't flagged."""
    kinds = F.explode(F.array(*map(F.lit, CORE_FINDINGS))).alias("finding_type")
    rows = cases.select("cse_id", "n_cases", kinds).join(flagged, ["cse_id", "finding_type"], "left")
    return rows.select("finding_type", F.col("cse_id").alias("group_id"), F.col("n_cases").alias("exposure"), (F.col("n_cases") - F.coalesce("n_flagged", F.lit(0))).alias("observed"))


def peer_comparison(cases: DataFrame, flagged: DataFrame) -> DataFrame:
    return negative_space(peer_observations(cases, flagged), "finding_type")


def tier(risk: Column) -> Column:
    """LOW under 0.7, MEDIUM under 1.5, else CRITICAL; the scale has a HIGH that no value reaches."""
    return F.when(risk < TIERS[0], "LOW").when(risk < TIERS[1], "MEDIUM").otherwise("CRITICAL")


def entity_risk(peers: DataFrame) -> DataFrame:
    """Per entity the weighted sum of |z| over flagged core types, highest first, with its tier."""
    weight = lookup({k: CAPABILITY_WEIGHT[c] * AUTHORITY_WEIGHT[a] for k, (c, a) in CORE_FINDINGS.items()}, F.col("finding_type"))
    risk = F.coalesce(F.sum(F.when(F.col("flagged"), F.abs("z") * weight)), F.lit(0.0))
    out = peers.groupBy(F.col("group_id").alias("cse_id")).agg(risk.alias("risk"), F.count_if("flagged").alias("n_flagged_types"))
    return out.withColumn("tier", tier(F.col("risk"))).orderBy(F.desc("risk"), "cse_id")


def classify_trend(rows: DataFrame, exposure: tuple[str, str] = ("prior_exposure", "exposure"), observed: tuple[str, str] = ("prior_observed", "observed"), proxy: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Adds z and trend to rows that hold a prior and a current cycle.

    Both cycles are peers of each other. Little exposure in either, no events, or |z| of the current one under 2:
    INSUFFICIENT_EVIDENCE; z below 0: REGRESSED; else VERIFIED_IMPROVEMENT, unless the proxy (prior exposure, exposure,
    prior observed, observed) fell by 2 or more: POTENTIAL_DISPLACEMENT.
    """

    def z(e0: str, e1: str, o0: str, o1: str) -> Column:
        rate = (F.col(o0) + F.col(o1)) / (F.col(e0) + F.col(e1))
        expected = F.col(e1) * rate
        fine = (F.col(e0) >= LOW_EXPOSURE) & (F.col(e1) >= LOW_EXPOSURE) & (F.col(o0) + F.col(o1) > 0)
        return F.when(fine, (F.col(o1) - expected) / F.sqrt(expected))

    now = z(*exposure, *observed)
    fell = F.coalesce(z(proxy[0], proxy[1], proxy[2], proxy[3]) <= -Z_FLAG, F.lit(False)) if proxy else F.lit(False)
    kind = F.when(now.isNull() | (F.abs(now) < Z_FLAG), "INSUFFICIENT_EVIDENCE").when(now < 0, "REGRESSED").when(fell, "POTENTIAL_DISPLACEMENT").otherwise("VERIFIED_IMPROVEMENT")
    return rows.withColumn("z", now).withColumn("trend", kind)


def last_two(cycles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """cycles: keys, order, exposure, observed. The latest cycle of each key beside the one before it (zeros if none)."""
    w = W.partitionBy(*keys).orderBy(order)
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    rows = cycles.withColumns({f"prior_{c}": F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("exposure", "observed")}).withColumn("_n", newest)
    return rows.where("_n = 1").drop("_n")


def briefing(manifest: DataFrame) -> DataFrame:
    """For each entity and finding type of its last two submissions: flagged then and now, and the trend; beside them how
    many batches there are, when the last came, and its cases and concerns. One submission: nothing to compare with."""
    newest = F.row_number().over(W.partitionBy("cse_id").orderBy(F.desc("submitted_at"), F.desc("batch_id")))
    rows = manifest.withColumns({"_k": newest, "batches": F.count("*").over(W.partitionBy("cse_id"))}).where("_k <= 2")
    each = rows.select("cse_id", "_k", F.explode("per_type").alias("finding_type", "v")).groupBy("cse_id", "finding_type")
    of = lambda k, c: F.coalesce(F.max(F.when(F.col("_k") == k, F.col(f"v.{c}"))), F.lit(0)).alias(f"{'prior_' * (k - 1)}{c}")
    seen = each.agg(*(of(k, c) for k in (1, 2) for c in ("case_count", "flagged_count")))
    seen = seen.withColumns({f"{p}observed": F.col(f"{p}case_count") - F.col(f"{p}flagged_count") for p in ("", "prior_")})
    known = classify_trend(seen, ("prior_case_count", "case_count"), ("prior_observed", "observed"))
    last = rows.where("_k = 1").select("cse_id", "batches", F.col("submitted_at").alias("last_submitted"), "n_cases", "n_concerns")
    return last.join(known.select("cse_id", "finding_type", "prior_flagged_count", "flagged_count", F.when(F.col("prior_case_count") > 0, F.col("trend")).alias("trend")), "cse_id", "left")


def topk(concerns: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("cse_id").orderBy(F.desc("concern_score"), "finding_type", "primary_id"))
    return concerns.withColumn("rank", rank).where(F.col("rank") <= k)


def interleaved(concerns: DataFrame) -> DataFrame:
    """Position in turns over capabilities, the one with the highest score first, within each entity.

    A position follows from the capabilities' counts: each gives all its concerns of earlier turns, and those ahead in
    the order one more in this turn. Capabilities are few, so they are an array beside the concern.
    """
    rows = ranked_by_range(concerns, ["cse_id", "capability"], [-F.col("concern_score"), F.col("finding_type"), F.col("primary_id")], "turn").withColumn("turn", F.col("turn").cast("int"))
    counts = concerns.groupBy("cse_id", "capability").agg(F.count("*").cast("int").alias("n"), F.max("concern_score").alias("_top"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("_top")).alias("top"), "capability", "n")))
    rows = rows.join(counts.groupBy("cse_id").agg(order.alias("_all")), "cse_id")
    place = F.array_position(F.transform("_all", lambda c: c["capability"]), F.col("capability")).cast("int")
    earlier = F.aggregate(F.transform("_all", lambda c: F.least(c["n"], F.col("turn") - 1)), F.lit(0), lambda a, x: a + x)
    ahead = F.size(F.filter(F.slice("_all", F.lit(1), place), lambda c: c["n"] >= F.col("turn")))
    return rows.withColumn("position", earlier + ahead).drop("_all")


def search(concerns: DataFrame, text: str | None = None, capability: str | None = None, cse_id: str | None = None) -> DataFrame:
    """Concerns whose shown values hold the text, whatever its case."""
    out = concerns
    for name, value in (("capability", capability), ("cse_id", cse_id)):
        out = out.where(F.col(name) == value) if value is not None else out
    return out.where(F.contains(shown(), F.lit(text.lower()))) if text else out


def shown() -> Column:
    """What a search looks in."""
    return F.lower(F.concat_ws(" ", "cse_id", "finding_type", "primary_id", "capability", "authority", "evidence_quality", "detail"))


def page(rows: DataFrame, number: int, size: int = 25) -> DataFrame:
    return rows.orderBy(F.desc("concern_score"), "cse_id", "finding_type", "primary_id").offset(number * size).limit(size)


def totals(log: Log, concerns: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: entities, findings, entities of the upper tiers, objects, events."""
    one = [concerns.agg(F.count("*").alias("n_findings")), risk.agg(F.count("*").alias("n_entities"), F.count_if(F.col("tier").isin("HIGH", "CRITICAL")).alias("n_high")), log.object.agg(F.count("*").alias("n_objects")), log.event.agg(F.count("*").alias("n_events"))]
    out = one[0]
    for more in one[1:]:
        out = out.crossJoin(more)  # one row each
    return out
