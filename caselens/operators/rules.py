"""Declarative process rules: four templates, each compiled to one plan over all cases of all entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselens.functions.expressions import COMPARE, minutes
from caselens.functions.vocabulary import AUTHORITY_WEIGHT, CASE_QUALIFIER

from .log import Log, case_context, case_events, case_profile

UNIT_MINUTES = {"minutes": 1, "hours": 60, "days": 1440}


@dataclass(frozen=True)
class Rule:
    """template: RESPONSE, PRECEDENCE, CARDINALITY or NOT_CO_EXISTENCE.

    expect: RESPONSE event; PRECEDENCE before, after; CARDINALITY event, op, bound; NOT_CO_EXISTENCE a, b.
    within: RESPONSE (op, value, unit) on the time since the case's first event, or None.
    effective_from, effective_to: the dates from which on and before which a version holds, or None.
    """

    rule_id: str
    template: str
    capability: str
    authority: str
    expect: dict
    applies_when: dict = field(default_factory=dict)
    within: tuple[str, float, str] | None = None
    version: str = "1.0"
    effective_from: str | None = None
    effective_to: str | None = None

    def __post_init__(self) -> None:
        if self.template not in TEMPLATES:
            raise ValueError(f"unknown template {self.template}")
        if self.authority not in AUTHORITY_WEIGHT:
            raise ValueError(f"unknown authority {self.authority}")


def predicate(conditions: dict) -> Column:
    """Equality, or membership for a list, of every named column; no condition holds always."""
    out = F.lit(True)
    for name, value in conditions.items():
        out = out & (F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return out


def scope(log: Log, rule: Rule, about: dict[str, Column] | None = None) -> DataFrame:
    """cse_id, case_id of the cases that a RESPONSE rule is about, each once; with what is asked about their profile,
    which cases without a profile have no part in."""
    key = ["cse_id", "case_id"]
    if about and "judged_context" in log.views:
        return log.views["judged_context"].where(predicate(rule.applies_when)).select(*key, *(c.alias(n) for n, c in about.items())).distinct()
    due = case_context(log).where(predicate(rule.applies_when)).select(*key).distinct()
    return due.join(case_profile(log).select(*key, *(c.alias(n) for n, c in about.items())), key) if about else due


def answer(rule: Rule) -> tuple[Column, Column]:
    """Over the case profile: `never` or `late` where a RESPONSE rule is broken, else null; the minutes that it took."""
    answered = F.col(f"first_{rule.expect['event']}")
    took = minutes(F.col("opened"), answered)
    fits = COMPARE[rule.within[0]](took, F.lit(float(rule.within[1] * UNIT_MINUTES[rule.within[2]]))) if rule.within else F.lit(True)
    return F.when(answered.isNull(), "never").when(~fits, "late"), took


def response(log: Log, rule: Rule) -> DataFrame:
    """Cases in scope, each once, where the expected event never comes or comes at the wrong time."""
    detail, took = answer(rule)
    return scope(log, rule, {"detail": detail, "measure": took}).where("detail is not null")


def precedence(log: Log, rule: Rule) -> DataFrame:
    """Every `after` event with no `before` event of its case at its time or earlier."""
    first = F.min(F.when(F.col("type") == rule.expect["before"], F.col("time"))).over(W.partitionBy("cse_id", "case_id"))
    rows = case_events(log).where(F.col("type").isin(rule.expect["before"], rule.expect["after"])).withColumn("_first", first)
    return rows.where((F.col("type") == rule.expect["after"]) & (F.col("_first").isNull() | (F.col("_first") > F.col("time")))).select("cse_id", "case_id", F.col("event_id").alias("detail"), F.lit(None).cast("double").alias("measure"))


def precedence_cases(log: Log, rule: Rule) -> DataFrame:
    """Cases with such an event, each once: their first `after` comes before any `before`."""
    return case_profile(log).where(out_of_order(rule)).select("cse_id", "case_id")


def out_of_order(rule: Rule) -> Column:
    """Over the case profile: whether a PRECEDENCE rule is broken by the first events."""
    before, after = (F.col(f"first_{rule.expect[k]}") for k in ("before", "after"))
    return after.isNotNull() & (before.isNull() | (before > after))


def out_of_bound(rule: Rule) -> Column:
    """Over the case profile: whether a CARDINALITY rule is broken."""
    n = F.col(f"n_{rule.expect['event']}")
    return (n > 0) & ~COMPARE[rule.expect["op"]](n.cast("double"), F.lit(float(rule.expect["bound"])))


def cardinality(log: Log, rule: Rule) -> DataFrame:
    """Cases with the event whose count is out of bounds."""
    return case_profile(log).where(out_of_bound(rule)).select("cse_id", "case_id", F.lit("count").alias("detail"), F.col(f"n_{rule.expect['event']}").cast("double").alias("measure"))


def not_co_existence(log: Log, rule: Rule) -> DataFrame:
    """Cases with both events."""
    both = [F.col(f"n_{rule.expect[k]}") > 0 for k in "ab"]
    return case_profile(log).where(both[0] & both[1]).select("cse_id", "case_id", F.lit("both").alias("detail"), F.lit(None).cast("double").alias("measure"))


TEMPLATES: dict[str, Callable[[Log, Rule], DataFrame]] = {"RESPONSE": response, "PRECEDENCE": precedence, "CARDINALITY": cardinality, "NOT_CO_EXISTENCE": not_co_existence}


def evaluate(log: Log, rule: Rule) -> DataFrame:
    """rule_id, cse_id, case_id, capability, authority, detail, measure of every violation."""
    return TEMPLATES[rule.template](log, rule).select(F.lit(rule.rule_id).alias("rule_id"), "cse_id", "case_id", F.lit(rule.capability).alias("capability"), F.lit(rule.authority).alias("authority"), "detail", "measure")


# The rules that come with the engine.
ESCALATE_CRITICAL = Rule("ESC-CRIT-001", "RESPONSE", "Escalation", "MANDATORY", {"event": "ESCALATE"}, {"alert_severity": "CRITICAL", "asset_criticality": ["HIGH", "CRITICAL"]}, ("<=", 30, "minutes"))
ENRICH_FIRST = Rule("ENR-PREC-001", "PRECEDENCE", "Investigation", "EXPECTED", {"before": "ENRICH", "after": "INVESTIGATE"})
FEW_REASSIGNMENTS = Rule("REASSIGN-CARD-001", "CARDINALITY", "Operational Discipline", "OPTIONAL", {"event": "REASSIGN", "op": "<=", "bound": 2})


_IN_FORCE = "rule_id: string, version: string, template: string, capability: string, authority: string, first: string, second: string, op: string, bound: double, scope: map<string,array<string>>"


def _in_force(rule: Rule) -> tuple:
    """A version as a row: its events, and the bound that the number or the minutes of its template must keep."""
    e = rule.expect
    first, second = {"RESPONSE": (e.get("event"), None), "CARDINALITY": (e.get("event"), None), "PRECEDENCE": (e.get("before"), e.get("after")), "NOT_CO_EXISTENCE": (e.get("a"), e.get("b"))}[rule.template]
    op, bound = (e["op"], float(e["bound"])) if rule.template == "CARDINALITY" else (rule.within[0], float(rule.within[1] * UNIT_MINUTES[rule.within[2]])) if rule.within else (None, None)
    scope = {k: [str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])] for k, v in rule.applies_when.items()} if rule.template == "RESPONSE" else {}
    return rule.rule_id, rule.version, rule.template, rule.capability, rule.authority, first, second, op, bound, scope


def periods(rules: list[Rule]) -> list[tuple[date | None, list[Rule]]]:
    """Stretches of time in which the same versions hold: when each begins (None: before all), and what holds. Of the
    versions of a rule that would hold at once the one that came into force last does."""
    names = [(r.rule_id, r.version) for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("a version of a rule occurs twice")
    day = lambda text, none: date.fromisoformat(text) if text else none
    starts = sorted({day(x, None) for r in rules for x in (r.effective_from, r.effective_to) if x})
    out = []
    for start in [None, *starts]:
        at = start or date.min
        held: dict[str, Rule] = {}
        for r in sorted(rules, key=lambda r: (day(r.effective_from, date.min), r.version)):
            if day(r.effective_from, date.min) <= at < day(r.effective_to, date.max):
                held[r.rule_id] = r
        out.append((start, list(held.values())))
    return out


def evaluate_all(log: Log, rules: list[Rule]) -> DataFrame:
    """rule_id, version, cse_id, case_id, capability, authority, detail, measure of every violation of all rules, each
    case by the versions in force on the day of its first event.

    Rules are rows and not plans: one aggregate over the events makes the profile of a case, its first day says in which
    period it falls, and the period's versions are laid beside it, of which the violated ones stay. The periods are as
    many as the rules have dates, so they are broadcast. Equal to evaluate() rule by rule where no version has dates.
    """
    spark = log.event.sparkSession
    spans = periods(rules)
    table = spark.createDataFrame([(i, [_in_force(r) for r in held]) for i, (_, held) in enumerate(spans)], f"_period int, _rules array<struct<{_IN_FORCE}>>")
    afters = sorted({r.expect["after"] for r in rules if r.template == "PRECEDENCE"})
    profile = case_profile(log, afters)
    some = F.create_map(*(x for k in CASE_QUALIFIER for x in (F.lit(k), F.struct(F.col(f"n_{k}").alias("n"), F.col(f"first_{k}").alias("first")))))
    starts = F.array(*(F.lit(start) for start, _ in spans[1:])).cast("array<date>")
    period = F.size(F.filter(starts, lambda d: d <= F.to_date("opened")))
    cases = profile.select("cse_id", "case_id", "opened", some.alias("_of"), "steps", period.alias("_period"))
    if any(r.template == "RESPONSE" for r in rules):
        scopes = case_context(log).groupBy("cse_id", "case_id").agg(F.collect_set(F.struct("alert_severity", "asset_criticality")).alias("_c"))
        scopes = scopes.select("cse_id", "case_id", F.transform("_c", lambda c: F.map_from_arrays(F.array(F.lit("alert_severity"), F.lit("asset_criticality")), F.array(c["alert_severity"], c["asset_criticality"]))).alias("_contexts"))
        cases = cases.join(scopes, ["cse_id", "case_id"], "left")
    else:
        cases = cases.withColumn("_contexts", F.lit(None).cast("array<map<string,string>>"))
    rows = cases.join(F.broadcast(table), "_period").select(*cases.columns, F.explode("_rules").alias("r")).select(*cases.columns, "r.*")
    first, second = F.col("_of")[F.col("first")], F.col("_of")[F.col("second")]
    is_ = lambda t: F.col("template") == t
    keeps = lambda x: F.coalesce(*(F.when(F.col("op") == op, f(x, F.col("bound"))) for op, f in COMPARE.items()))
    due = F.exists("_contexts", lambda c: F.forall(F.map_entries("scope"), lambda s: F.coalesce(F.array_contains(s["value"], c[s["key"]]), F.lit(False))))
    took = minutes(F.col("opened"), first["first"])
    early = F.filter("steps", lambda e: (e["type"] == F.col("second")) & (first["first"].isNull() | (first["first"] > e["time"])))
    none = F.lit(None).cast("double")
    hit = lambda detail, measure: F.array(F.struct(detail.alias("detail"), measure.alias("measure")))
    broken = (
        F.when(is_("RESPONSE") & F.coalesce(due, F.lit(False)), F.when(first["first"].isNull(), hit(F.lit("never"), took)).when(F.col("op").isNotNull() & ~keeps(took), hit(F.lit("late"), took)))
        .when(is_("PRECEDENCE"), F.transform(early, lambda e: F.struct(e["event_id"].alias("detail"), none.alias("measure"))))
        .when(is_("CARDINALITY") & (first["n"] > 0) & ~keeps(first["n"].cast("double")), hit(F.lit("count"), first["n"].cast("double")))
        .when(is_("NOT_CO_EXISTENCE") & (first["n"] > 0) & (second["n"] > 0), hit(F.lit("both"), none))
    )
    out = rows.select("rule_id", "version", "cse_id", "case_id", "capability", "authority", F.explode(broken).alias("v"))
    return out.select("rule_id", "version", "cse_id", "case_id", "capability", "authority", "v.detail", "v.measure")
