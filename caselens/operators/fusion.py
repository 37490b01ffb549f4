"""Detectors and rules to scored, costed concerns, with a log of what was suppressed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.expressions import concern_score, filled, finding_id, label, lookup, minutes, review_minutes
from caselens.functions.vocabulary import QUALITY_WEIGHT

from . import detectors, rules
from .log import Log, alert_assets, asset_chain, case_alerts, case_events, case_profile, objects, reassignments
from .peers import negative_space, two_sided

@dataclass(frozen=True)
class Fusion:
    concerns: DataFrame
    suppressed: DataFrame


def _concern(rows: DataFrame, kind: str, primary: str, capability: str, authority: str = "PEER_NORMAL", supporting: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Concerns about something else than a case: no event of their own."""
    none = F.lit(None).cast("string")
    return rows.select("cse_id", F.lit(kind).alias("finding_type"), F.col(primary).alias("primary_id"), F.lit(capability).alias("capability"), F.lit(authority).alias("authority"), none.alias("event_type"), (none if supporting is None else supporting.cast("string")).alias("supporting"), (none if detail is None else detail).alias("detail"), F.lit(0).cast("long").alias("n_events"))


def severity_of_cases(log: Log) -> DataFrame:
    """cse_id, case_id, severity of cases with an alert; UNKNOWN where the alert has none."""
    if "severity_of_cases" in log.views:
        return log.views["severity_of_cases"]
    alerts = objects(log, "Alert", "severity").select("cse_id", F.col("object_id").alias("alert_id"), "severity")
    return case_alerts(log).join(alerts, ["cse_id", "alert_id"], "left").groupBy("cse_id", "case_id").agg(filled(F.min("severity")).alias("severity"))


def judged_cases(log: Log) -> DataFrame:
    """The case profile with each case's severity, null without an alert."""
    if "judged_cases" in log.views:
        return log.views["judged_cases"]
    return case_profile(log).join(severity_of_cases(log), ["cse_id", "case_id"], "left")


def fast_close_by_severity(log: Log, threshold: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """Closed cases with a severity, and their peer statistics by severity (observed: closed at a fair pace)."""
    cases = detectors.fast_close(log, threshold).join(severity_of_cases(log), ["cse_id", "case_id"])
    obs = cases.groupBy("cse_id", F.col("severity").alias("group_id")).agg(F.count("*").alias("exposure"), F.count_if(~F.col("is_fast")).alias("observed"))
    return cases, negative_space(obs, "cse_id")


def telemetry(log: Log) -> DataFrame:
    """Alerts of HIGH and CRITICAL assets against the other assets of their tier, each with exposure 1."""
    rows = detectors.asset_alerts(log).where("criticality in ('HIGH', 'CRITICAL')")
    obs = rows.select("cse_id", F.col("criticality").alias("tier"), F.col("asset_id").alias("group_id"), F.lit(1).cast("long").alias("exposure"), F.col("n_alerts").alias("observed"))
    return negative_space(obs, "cse_id", "tier")


def analyst_peers(log: Log) -> DataFrame:
    return negative_space(detectors.analyst_workload(log).select("cse_id", F.col("analyst_id").alias("group_id"), F.col("n_assigned").alias("exposure"), F.col("n_investigated").alias("observed")), "cse_id")


def queue_peers(log: Log) -> DataFrame:
    return negative_space(detectors.queue_escalations(log).select("cse_id", F.col("queue_id").alias("group_id"), F.col("n_routed").alias("exposure"), F.col("n_escalated").alias("observed")), "cse_id")


def _z(detail: str = "z") -> Column:
    return F.format_string("z=%.4f", F.col(detail))


# The rule behind a finding type, and the version of the rules and of the package layout.
RULES = {"EXCESSIVE_REASSIGNMENT_CARDINALITY": rules.FEW_REASSIGNMENTS.rule_id, "ESCALATION_SLA_VIOLATION": rules.ESCALATE_CRITICAL.rule_id, "MISSING_ENRICHMENT": rules.ENRICH_FIRST.rule_id}
VERSION = "1.0"
CASE_EVENTS = ("REASSIGN", "ESCALATE", "INVESTIGATE", "CLOSE")  # the types that findings about cases count


def case_findings(log: Log, few: rules.Rule = rules.FEW_REASSIGNMENTS, fast: float = 30.0) -> DataFrame:
    """The findings about single cases, from the case profile, the reassignments and each case's severity and scope."""
    key = ["cse_id", "case_id"]
    judged = judged_cases(log).withColumn("_fast", minutes(F.col("opened"), F.col("closed")) < fast)
    obs = judged.where("closed is not null and severity is not null").groupBy("cse_id", F.col("severity").alias("group_id")).agg(F.count("*").alias("exposure"), F.count_if(~F.col("_fast")).alias("observed"))
    odd = negative_space(obs, "cse_id").where("flagged").select("cse_id", F.col("group_id").alias("severity"))
    loop, enough = detectors.loop_columns(), F.col("n_REASSIGN") >= detectors.MIN_REASSIGNMENTS
    late, _ = rules.answer(rules.ESCALATE_CRITICAL)
    none = F.lit(None).cast("string")

    def of(kind: str, capability: str, authority: str, event: str, detail: Column = none) -> Column:
        parts = {"finding_type": F.lit(kind), "capability": F.lit(capability), "authority": F.lit(authority), "event_type": F.lit(event), "detail": detail, "n_events": F.col(f"n_{event}")}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    alone = F.array_compact(F.array(
        F.when(~enough & rules.out_of_bound(few), of("EXCESSIVE_REASSIGNMENT_CARDINALITY", few.capability, few.authority, "REASSIGN")),
        F.when(rules.out_of_order(rules.ENRICH_FIRST), of("MISSING_ENRICHMENT", "Investigation", "EXPECTED", "INVESTIGATE")),
    ))
    # What follows from the profile alone moves no row; the rest moves only the cases that it is about.
    found = [
        case_profile(log).select(*key, F.explode(alone).alias("f")),
        reassignments(log).where(enough & loop["flagged"]).select(*key, of("REASSIGNMENT_LOOP", "Operational Discipline", "EXPECTED", "REASSIGN", loop["sequence"]).alias("f")),
        rules.scope(log, rules.ESCALATE_CRITICAL, {"_late": late, "n_ESCALATE": F.col("n_ESCALATE")}).where("_late is not null").select(*key, of("ESCALATION_SLA_VIOLATION", "Escalation", "MANDATORY", "ESCALATE", F.col("_late")).alias("f")),
        judged.where("_fast").join(odd, ["cse_id", "severity"]).select(*key, of("FAST_CLOSE_OUTLIER", "Investigation", "PEER_NORMAL", "CLOSE", F.col("severity")).alias("f")),
    ]
    out = reduce(DataFrame.union, found)
    return out.select("cse_id", "f.finding_type", F.col("case_id").alias("primary_id"), "f.capability", "f.authority", "f.event_type", none.alias("supporting"), "f.detail", "f.n_events")


def suppressions(log: Log, few: rules.Rule = rules.FEW_REASSIGNMENTS) -> DataFrame:
    """cse_id, case_id, finding_type, reason of what a finer detector has settled: excesses of reassignments in cases with
    enough of them for a verdict, and justified loops."""
    loop = detectors.loop_columns()
    rows = reassignments(log).where(F.col("n_REASSIGN") >= detectors.MIN_REASSIGNMENTS)
    why = F.when(loop["flagged"], "flagged as a loop").when(loop["is_loop"], "every handover is a shift change").otherwise("no analyst comes back")
    excess = rows.where(rules.out_of_bound(few)).select("cse_id", "case_id", F.lit("EXCESSIVE_REASSIGNMENT_CARDINALITY").alias("finding_type"), why.alias("reason"))
    return excess.union(rows.where(loop["is_loop"] & loop["justified"]).select("cse_id", "case_id", F.lit("REASSIGNMENT_LOOP"), F.lit("every handover is a shift change")))


def evidence(log: Log, concerns: DataFrame) -> DataFrame:
    """What each concern rests on, a row for each: cse_id, finding_id, finding_type, primary_id, kind, ref_id.

    kind object: what it is about. kind case: the case itself; the cases of an asset's alerts, an analyst's present cases
    or a queue's escalated ones. kind event: the events of the concern's own type in its case. Rows and not lists, as an
    analyst or queue may have any number of cases.
    """
    about = ["cse_id", "finding_id", "finding_type", "primary_id"]
    out = lambda df, kind, ref: df.select(*about, F.lit(kind).alias("kind"), F.col(ref).alias("ref_id"))
    of = lambda *kinds: concerns.where(F.col("finding_type").isin(*kinds)).select(*about)
    owned = concerns.where("event_type is not null").select(*about, "event_type")
    events = case_events(log).where(F.col("type").isin(*CASE_EVENTS)).select("cse_id", F.col("case_id").alias("primary_id"), F.col("type").alias("event_type"), "event_id")
    chain = asset_chain(log).where("case_id is not null").select("cse_id", F.col("asset_id").alias("primary_id"), "case_id").distinct()
    edge = lambda qualifier: log.object_object("Case").where(F.col("qualifier") == qualifier).select("cse_id", F.col("source_id").alias("case_id"), F.col("target_id").alias("primary_id"))
    raised = case_profile(log).where("n_ESCALATE > 0").select("cse_id", "case_id")
    key = ["cse_id", "primary_id"]
    parts = [
        out(concerns, "object", "primary_id"),
        out(owned, "case", "primary_id"),
        out(owned.join(events, [*key, "event_type"]), "event", "event_id"),
        out(of("REPEATED_ALERT_NO_REMEDIATION").join(chain, key), "case", "case_id"),
        out(of("INVESTIGATION_WORKLOAD_INCONSISTENT").join(edge("current_assignee"), key), "case", "case_id"),
        out(of("ESCALATION_WORKLOAD_INCONSISTENT").join(edge("current_queue").join(raised, ["cse_id", "case_id"], "left_semi"), key), "case", "case_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def packages(concerns: DataFrame, refs: DataFrame, source_system: str = "caselens", batch_id: str = "") -> DataFrame:
    """Concerns, best a selection of them, as evidence packages: scores, rule, the lists of what they rest on, what was
    assumed, and where it came from. refs: rows of evidence()."""
    some = refs.join(concerns.select("finding_id").distinct(), "finding_id", "left_semi")
    listed = some.groupBy("finding_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("ref_id")))).alias(name) for kind, name in (("object", "affected_objects"), ("case", "supporting_cases"), ("event", "supporting_events"))))
    rule = lookup(RULES, F.col("finding_type"))
    doubt = F.when(F.col("evidence_quality") != "HIGH", F.lit("an event of this case was not recognised, so its trace may be incomplete"))
    known = F.concat_ws(" ", label(F.col("finding_type")), F.when(F.col("detail").isNotNull(), F.concat(F.lit("("), F.col("detail"), F.lit(")"))))
    source = F.struct(F.lit(source_system).alias("source_system"), F.lit("").alias("source_file"), F.col("primary_id").alias("source_record_id"), F.lit(batch_id).alias("ingestion_batch_id"), F.lit("").alias("ingestion_timestamp"), F.lit(VERSION).alias("schema_version"))
    return concerns.join(listed, "finding_id", "left").withColumns({
        "rule_id": rule, "rule_version": F.when(rule.isNotNull(), VERSION), "anomaly_score": F.lit(1.0), "finding_score": lookup(QUALITY_WEIGHT, F.col("evidence_quality")), "confidence": F.lit(1.0),
        "assumptions": F.array_compact(F.array(known, doubt)), "provenance": source,
    })


def fuse(log: Log, low_confidence: DataFrame | None = None, uniform_threshold: float = 0.15, few: rules.Rule = rules.FEW_REASSIGNMENTS) -> Fusion:
    """All concerns of all entities: ten finding types with score and expected minutes.

    low_confidence: cse_id, case_id whose evidence is of MEDIUM quality. A concern counts the events of its own type in
    its case. An excess of reassignments is reported only where no reassignment signal covers the case, and justified
    loops not at all; both are listed in `suppressed` with the reason.
    """
    people, queues = analyst_peers(log), queue_peers(log)
    found = [
        case_findings(log, few),
        _concern(detectors.asset_recurrence(log).where("flagged"), "REPEATED_ALERT_NO_REMEDIATION", "asset_id", "Incident Response", supporting=F.col("n_cases")),
        _concern(telemetry(log).where("flagged"), "LOW_TELEMETRY_CRITICAL_ASSET", "group_id", "Threat Detection", detail=_z()),
        _concern(detectors.investigation_uniformity(log, threshold=uniform_threshold).where("flagged"), "REPETITIVE_INVESTIGATION_PATTERN", "analyst_id", "Investigation"),
        _concern(people.where(F.col("abstain").isNull() & two_sided()), "INVESTIGATION_WORKLOAD_INCONSISTENT", "group_id", "Investigation", supporting=F.col("exposure"), detail=_z()),
        _concern(queues.where(F.col("abstain").isNull() & two_sided()), "ESCALATION_WORKLOAD_INCONSISTENT", "group_id", "Escalation", supporting=F.col("observed"), detail=_z()),
    ]
    rows = reduce(DataFrame.unionByName, found)
    if low_confidence is None:
        rows = rows.withColumn("evidence_quality", F.lit("HIGH"))
    else:
        doubt = low_confidence.select("cse_id", F.col("case_id").alias("primary_id"), F.lit(True).alias("_low")).distinct()
        rows = rows.join(doubt, ["cse_id", "primary_id"], "left").withColumn("evidence_quality", F.when(F.col("_low"), "MEDIUM").otherwise("HIGH")).drop("_low")
    rows = rows.withColumns({
        "finding_id": finding_id("cse_id", "finding_type", "primary_id"),
        "concern_score": concern_score(F.col("evidence_quality"), F.col("authority"), F.col("capability")),
        "minutes": review_minutes(F.col("n_events"), F.col("evidence_quality"), F.col("authority")),
    })
    return Fusion(rows, suppressions(log, few))


def by_capability(concerns: DataFrame) -> DataFrame:
    return concerns.groupBy("cse_id", "capability").agg(F.count("*").alias("n"), F.sum("concern_score").alias("score"))
