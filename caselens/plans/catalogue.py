"""Every registered query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.expressions import event_type
from caselens.operators import causal, detectors, drift, fusion, ingest, paging, peers, portfolio, review, rules, selection
from caselens.operators import log as views
from caselens.operators.log import Log
from caselens.sources.scratch import held, new_folder

from . import projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CO_EXISTENCE = rules.Rule("COEX-001", "NOT_CO_EXISTENCE", "Operational Discipline", "OPTIONAL", {"a": "ESCALATE", "b": "EVIDENCE_COLLECT"})
TWO_ARE_MANY = rules.Rule("REASSIGN-CARD-001", "CARDINALITY", "Operational Discipline", "OPTIONAL", {"event": "REASSIGN", "op": "<=", "bound": 1})
FAST = 60.0 * 24 * 30  # minutes; ship dates are days apart
UNIFORM = 0.65
FINDING = ["cse_id", "finding_type", "primary_id"]
SHOWN = [*FINDING, "capability", "authority", "n_events", "concern_score", "minutes"]
TO_SELECT = [*FINDING, "finding_id", "capability", "concern_score", "minutes"]  # what selectors ask of a concern


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: str) -> Column:
    return (F.round(F.col(c), 6) + F.lit(0.0)).alias(c)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def log_held(spark: SparkSession, sf_dir: str, strained: bool = False, numbered: bool = True) -> AbstractContextManager[Log]:
    """The whole log with its views held, for as long as the block lasts; not numbered: for who asks for no event ids."""
    return projection.log(spark, sf_dir, keep=True, strained=strained, numbered=numbered).held()


def fused(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """All or some columns of the concerns, which are few beside the log and read several times by what follows, so they
    are written."""
    # The detail of a loop goes by the event ids; nothing else of a concern does.
    with log_held(spark, sf_dir, numbered=not columns or "detail" in columns) as log:
        return held(fusion.fuse(log).concerns.select(*(columns or ("*",))))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity and year: cases, and those that aren't unjustified loops."""
    years = projection.cases(spark, sf_dir).select("cse_id", "case_id", F.year("opened").alias("year"))
    loops = detectors.reassignment_loops(projection.log(spark, sf_dir)).where("flagged").select("cse_id", "case_id", F.lit(1).alias("_f"))
    return years.join(loops, ["cse_id", "case_id"], "left").groupBy("cse_id", "year").agg(F.count("*").alias("exposure"), F.count_if(F.col("_f").isNull()).alias("observed"))


@query
def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.case_events(projection.log(spark, sf_dir)).select("cse_id", "case_id", "event_id", "type", "time")


@query
def case_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.case_context(projection.log(spark, sf_dir))


@query
def case_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.case_trace(projection.log(spark, sf_dir))


@query
def attr_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.attr_snapshot(projection.log(spark, sf_dir)).drop("name")


@query
def raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.raw_objects(projection.log(spark, sf_dir), "Asset")
    return rows.select("cse_id", "object_id", "type", F.col("attrs")["criticality"].alias("criticality"), F.col("attrs")["asset_type"].alias("asset_type"))


@query
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_events(projection.log(spark, sf_dir), "INVESTIGATE")


@query
def weekly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly rates of a log whose escalations stand for its assignments too, as the tables have none."""
    log = projection.log(spark, sf_dir)
    first = log.event.where("type = 'INVESTIGATE'").withColumn("type", F.lit("ASSIGN"))
    return rounded(peers.weekly_rates(replace(log, event=log.event.unionByName(first)), within=60.0 * 24 * 30))


@query
def log_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir) as log:
        return held(ingest.validate_log(log))


# Two versions of the time to escalate, one that ends, and rules on every kind of event.
RULE_BOOK = [
    replace(rules.ESCALATE_CRITICAL, within=("<=", 30, "days"), effective_to="1998-01-01"), replace(rules.ESCALATE_CRITICAL, version="2.0", within=("<=", 60, "days"), effective_from="1998-01-01"),
    rules.ENRICH_FIRST, replace(rules.FEW_REASSIGNMENTS, effective_to="2000-06-15"), CO_EXISTENCE,
]


@query
def rule_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one pass, each case by the versions in force when it began."""
    return rounded(rules.evaluate_all(projection.log(spark, sf_dir), RULE_BOOK))


def _violations(spark: SparkSession, sf_dir: str, rule: rules.Rule) -> DataFrame:
    return rounded(rules.evaluate(projection.log(spark, sf_dir), rule))


@query
def rule_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, rules.ESCALATE_CRITICAL)


@query
def rule_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, rules.ENRICH_FIRST).drop("measure")


@query
def rule_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, rules.FEW_REASSIGNMENTS)


@query
def rule_not_coexist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir, CO_EXISTENCE).drop("measure")


@query
def reassignment_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.reassignment_loops(projection.log(spark, sf_dir)).drop("sequence")


@query
def fast_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detectors.fast_close(projection.log(spark, sf_dir), FAST).select("cse_id", "case_id", "minutes", "is_fast"))


@query
def asset_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.asset_recurrence(projection.log(spark, sf_dir))


@query
def asset_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.asset_alerts(projection.log(spark, sf_dir))


@query
def investigation_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(detectors.investigation_uniformity(projection.log(spark, sf_dir), threshold=UNIFORM))


@query
def analyst_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.analyst_workload(projection.log(spark, sf_dir))


@query
def queue_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.queue_escalations(projection.log(spark, sf_dir))


@query
def negspace_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.fast_close_by_severity(projection.log(spark, sf_dir), FAST)[1])


@query
def negspace_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.telemetry(projection.log(spark, sf_dir)))


@query
def negspace_analyst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.analyst_peers(projection.log(spark, sf_dir)))


@query
def negspace_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.queue_peers(projection.log(spark, sf_dir)))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift(projection.daily(spark, sf_dir).withColumn("k", F.lit(1)), ["k"], "day", "mean_value", k=0.25, h=1.0)


@query
def ewma_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_drift(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "ewma"))


@query
def cusum_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drift(spark, sf_dir).withColumn("at", F.col("at").cast("int"))
    return rows.where("up").select("at", F.lit("up").alias("side")).union(rows.where("down").select("at", F.lit("down")))


@query
def displacement_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = projection.daily(spark, sf_dir).withColumn("k", F.lit(1))
    return drift.displacement(rows, ["k"], "day", "n_events", "mean_value", k=0.25, h=1.0).select(F.col("at").cast("int").alias("at"), "signal")


@query
def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every single event as a period: a long series for each event type, cut into pieces."""
    rows = drift.drift(projection.read(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", k=0.25, h=3.0, piece=2_000)
    return rounded(rows.select("event_type", "event_id", "at", "ewma", "up", "down"))


@query
def concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fused(spark, sf_dir, *SHOWN))


@query
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir) as log:
        return held(fusion.fuse(log).suppressed)


@query
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir) as log:
        return held(fusion.evidence(log, held(fusion.fuse(log).concerns)).drop("finding_id"))


def _strain(log: Log) -> DataFrame:
    return fusion.fuse(log, uniform_threshold=UNIFORM, few=TWO_ARE_MANY).concerns


@query
def strained_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten finding types."""
    with log_held(spark, sf_dir, strained=True, numbered=False) as log:
        return held(rounded(_strain(log).select(*SHOWN)))


@query
def strained_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir, strained=True) as log:
        return held(fusion.evidence(log, held(_strain(log))).drop("finding_id"))


def _compared(log: Log, concerns: DataFrame) -> DataFrame:
    return portfolio.peer_comparison(portfolio.case_counts(log), portfolio.flagged_counts(concerns))


@query
def strained_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir, strained=True, numbered=False) as log:
        return held(rounded(portfolio.entity_risk(_compared(log, _strain(log)))))


def _strained_flags(spark: SparkSession, sf_dir: str) -> tuple[Log, DataFrame]:
    log = projection.log(spark, sf_dir, keep=True, strained=True)
    return log, rules.precedence_cases(log, rules.ENRICH_FIRST)


@query
def strained_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of missing enrichment: better, worse and neither."""
    flagged = _strained_flags(spark, sf_dir)[1].withColumn("_f", F.lit(1))
    years = projection.cases(spark, sf_dir).select("cse_id", "case_id", F.year("opened").alias("year"))
    rows = years.join(flagged, ["cse_id", "case_id"], "left").groupBy("cse_id", "year").agg(F.count("*").alias("exposure"), F.count_if(F.col("_f").isNull()).alias("observed"))
    return rounded(portfolio.classify_trend(portfolio.last_two(rows, ["cse_id"], "year")))


@query
def strained_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on missing enrichment: to act and to look further."""
    rows = causal.opportunities(causal.outcome_frame(*_strained_flags(spark, sf_dir)), ["cse_id"])
    return rounded(rows.select("cse_id", "n", "effect", "se", "robustness", "decision"))


@query
def concern_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir, numbered=False) as log:
        return held(rounded(fusion.fuse(log).concerns.groupBy("cse_id", "finding_type").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"), F.sum("n_events").alias("n_events"))))


@query
def concerns_by_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.by_capability(fused(spark, sf_dir)))


@query
def topk_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.topk(fused(spark, sf_dir)).select(*FINDING, "concern_score", "rank"))


@query
def interleaved_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.interleaved(fused(spark, sf_dir, *FINDING, "capability", "concern_score")).select(*FINDING, "turn", "position")


@query
def findings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.search(fused(spark, sf_dir), "Loop", cse_id="BUILDING").select(*FINDING)


@query
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.page(fused(spark, sf_dir), 1).select(*FINDING)


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir, numbered=False) as log:
        return held(_compared(log, fusion.fuse(log).concerns))


@query
def page_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first 25 concerns, found by the key of the 25th in files that are sorted and cut by range."""
    pages = paging.Pages.write(fused(spark, sf_dir), new_folder(spark), paging.by_score(), per_part=500)
    return pages.after(pages.cursor(pages.page(0), paging.by_score())).select(*FINDING)


@query
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = paging.SearchIndex.write(fused(spark, sf_dir), new_folder(spark), portfolio.shown, ["finding_type", "cse_id", "primary_id"], per_block=500)
    return index.search("Escalation_SLA").select(*FINDING)


@query
def peer_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_peers(spark, sf_dir))


@query
def entity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.entity_risk(_peers(spark, sf_dir)))


@query
def trend_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.classify_trend(portfolio.last_two(cycles(spark, sf_dir), ["cse_id"], "year")))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = projection.log(spark, sf_dir)
    return causal.outcome_frame(log, detectors.reassignment_loops(log).where("flagged"))


@query
def causal_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query
def ols_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(causal.slope(_outcomes(spark, sf_dir), ["cse_id"]))


@query
def ols_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect with the case's urgency and year held, and the decision that it leads to."""
    about = projection.cases(spark, sf_dir).select("cse_id", "case_id", F.col("severity").isin("CRITICAL", "HIGH").cast("int").alias("urgent"), F.year("opened").alias("year"))
    rows = _outcomes(spark, sf_dir).join(about, ["cse_id", "case_id"])
    return rounded(causal.adjusted(rows, ["cse_id"], ["urgent", "year"]))


@query
def robustness_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = causal.slope(_outcomes(spark, sf_dir), ["cse_id"])
    out = rows.withColumn("robustness", causal.robustness(F.col("t_stat"), F.col("df"))).withColumn("wide", F.lit(1.96) * F.col("se"))
    return rounded(out.select("cse_id", "robustness", causal.decide(F.col("effect") - F.col("wide"), F.col("effect") + F.col("wide"), F.col("robustness")).alias("decision")))


@query
def intervention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir, numbered=False) as log:
        return held(rounded(causal.entity_report(log, held(fusion.fuse(log).concerns)).drop("finding_id")))


def _budgeted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = fused(spark, sf_dir, *TO_SELECT)
    return rows, selection.budgets(rows, ["cse_id"], 0.3)


@query
def baseline_top_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_score(*_budgeted(spark, sf_dir), ["cse_id"]).groupBy("cse_id", "finding_type").agg(F.count("*").alias("n"))


@query
def baseline_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stratified(*_budgeted(spark, sf_dir), ["cse_id"]).select(*FINDING)


@query
def baseline_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.random_pick(*_budgeted(spark, sf_dir), ["cse_id"]).select(*FINDING)


@query
def submodular_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.submodular(*_budgeted(spark, sf_dir), ["cse_id"]).select(*FINDING)


@query
def risk_fraction_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the minutes from a tenth to nine tenths, against the concerns that a review would confirm."""
    rows = fused(spark, sf_dir, *TO_SELECT)
    truth = projection.verdicts(rows).where("verdict = 'TRUE_SUPERVISORY_FINDING'")
    return rounded(selection.sweep(rows, truth, ["cse_id"], [0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9]))


@query
def allocation_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, budget = _budgeted(spark, sf_dir)
    return rounded(selection.explain(rows, selection.submodular(rows, budget, ["cse_id"]), budget, ["cse_id"]))


@query
def beta_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.feedback(projection.verdicts(fused(spark, sf_dir))))


@query
def debiased_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.debiased(review.feedback(projection.verdicts(fused(spark, sf_dir)))))


@query
def agreement_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(review.agreement(projection.verdicts(fused(spark, sf_dir))))


@query
def quality_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users that are no customer, as events of no known case."""
    known = projection.read(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).cast("string").alias("case_id"))
    return ingest.orphan_events(projection.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("case_id"), "event_id"), known)


@query
def unrecognised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.unrecognised(projection.read(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("case_id")))


@query
def recognised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event words of line items by ship month: what the alias table makes of them."""
    words = F.when(F.col("l_returnflag") == "R", F.lit(" Transferred ")).when(F.col("l_returnflag") == "A", F.lit("closed")).otherwise(F.lit("mystery"))
    return projection.read(spark, sf_dir, "lineitem").groupBy(event_type(words).alias("type"), F.month("l_shipdate").alias("month")).agg(F.count("*").alias("n"))


@query
def standin_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = projection.read(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("asset_id"))
    return ingest.stand_ins(declared, projection.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("asset_id")), "asset_id")


@query
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    with log_held(spark, sf_dir) as log:
        found = held(fusion.fuse(log).concerns)
        return held(portfolio.totals(log, found, portfolio.entity_risk(_compared(log, found))))
