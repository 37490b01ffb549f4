"""From exported tables to the event log: mapping, quality gate, canonical build."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselens.functions.expressions import epoch, event_type, filled, parsed_time
from caselens.functions.vocabulary import CASE_QUALIFIER, FIELD_ALIASES, REQUIRED_FIELDS, REQUIRED_TABLES, TABLES

from .log import RELS, Log

Tables = dict[str, DataFrame]
Mapping = dict[str, dict[str, str | None]]


def suggest(table: str, columns: list[str]) -> dict[str, str | None]:
    """Canonical field to exported column: the first alias that is there, whatever its case; None to be filled in."""
    lower = {c.lower(): c for c in columns}
    return {f: next((lower[a] for a in FIELD_ALIASES.get(f, (f,)) if a in lower), None) for f in TABLES.get(table, ())}


def apply_mapping(tables: Tables, mapping: Mapping) -> Tables:
    """Canonical columns in canonical order, null where unmapped or missing; other tables go. Keeps an input position."""
    out = {}
    for t, df in tables.items():
        if t in TABLES:
            m = mapping.get(t, {})
            cols = [(F.col(f"`{m[f]}`") if m.get(f) in df.columns else F.lit(None)).cast("string").alias(f) for f in TABLES[t]]
            out[t] = df.select(*cols, F.monotonically_increasing_id().alias("_position"))
    return out


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def orphan_events(case_events: DataFrame, cases: DataFrame) -> DataFrame:
    return case_events.join(cases.select("case_id").distinct(), "case_id", "left_anti")


def unrecognised(case_events: DataFrame) -> DataFrame:
    """Distinct event texts that name no event type, and the cases that hold them."""
    return case_events.where(event_type(F.col("event")).isNull() & ~_blank("event")).select("event", "case_id").distinct()


@dataclass(frozen=True)
class Gate:
    status: str  # OK or ABSTAIN
    errors: list[str]
    notes: list[str]
    low_confidence: DataFrame | None  # case_id


def quality_gate(tables: Tables) -> Gate:
    """ABSTAIN if a required table or field is missing or an event's case is; texts that name no event are noted."""
    errors, notes = [], []
    for t in REQUIRED_TABLES:
        if t not in tables or tables[t].isEmpty():
            errors.append(f"{t}: missing or empty")
    for t, fields in REQUIRED_FIELDS.items():
        if t in tables:
            n = tables[t].agg(*(F.count_if(_blank(f)).alias(f) for f in fields)).first()
            errors += [f"{t}.{f}: {n[f]} empty" for f in fields if n[f]]
    low = None
    if all(t in tables for t in REQUIRED_TABLES):
        if n := orphan_events(tables["case_events"], tables["cases"]).count():
            errors.append(f"case_events: {n} of no known case")
        found = unrecognised(tables["case_events"])
        low = found.select("case_id").distinct()
        words = [r["event"] for r in found.select("event").distinct().orderBy("event").limit(50).collect()]  # a report
        notes += [f"unrecognised events: {', '.join(words)}"] if words else []
    notes += [f"{t} absent: what depends on it is reduced" for t in TABLES if t not in REQUIRED_TABLES and t not in tables]
    return Gate("ABSTAIN" if errors else "OK", errors, notes, low)


def _rel(target: Column, qualifier: str) -> Column:
    return F.when(F.coalesce(target, F.lit("")) != "", F.struct(target.cast("string").alias("target_id"), F.lit(qualifier).alias("qualifier")))


def _rels(*rels: Column) -> Column:
    return F.filter(F.array(*rels), lambda r: r.isNotNull()).cast(RELS) if rels else F.array().cast(RELS)


def stand_ins(declared: DataFrame, referenced: DataFrame, key: str) -> DataFrame:
    """Ids that are referred to and never declared, once each."""
    return referenced.where(~_blank(key)).select(key).distinct().join(declared.select(key).distinct(), key, "left_anti")


def build_log(tables: Tables, cse_id: str) -> Log:
    """The canonical log of one entity. An ASSIGN is made at opening for a case with an analyst or queue; events are
    named TYPE::case::k by their order among the case's recognised events; unreadable times become the epoch."""
    spark = tables["cases"].sparkSession
    blank = {t: spark.createDataFrame([], ", ".join(f"{f} string" for f in fs) + ", _position long") for t, fs in TABLES.items()}
    t = blank | tables
    cases, events, alerts = t["cases"], t["case_events"], t["alerts"]
    spoken = events.withColumn("_type", event_type(F.col("event"))).where("_type is not null")
    when_ = lambda c: F.coalesce(parsed_time(F.col(c)), epoch())
    who = reduce(DataFrame.union, [cases.select("analyst_id"), spoken.where("_type in ('REASSIGN', 'INVESTIGATE', 'ASSIGN')").select(F.col("actor").alias("analyst_id"))])
    assets = t["assets"].select("asset_id", "criticality", "asset_type").unionByName(stand_ins(t["assets"], alerts.select("asset_id"), "asset_id"), allowMissingColumns=True).where(~_blank("asset_id"))
    analysts = t["analysts"].select("analyst_id", "tier").unionByName(stand_ins(t["analysts"], who, "analyst_id"), allowMissingColumns=True).where(~_blank("analyst_id"))
    queues = t["queues"].select("queue_id", "name").unionByName(stand_ins(t["queues"], cases.select("queue_id"), "queue_id"), allowMissingColumns=True).where(~_blank("queue_id"))
    known = alerts.select("alert_id", F.lit(True).alias("_known")).distinct()
    cases = cases.join(known, "alert_id", "left").withColumn("_alert", F.when(F.col("_known"), F.col("alert_id")))

    def obj(df: DataFrame, key: str, kind: str, *rels: Column) -> DataFrame:
        return df.select(F.lit(cse_id).alias("cse_id"), F.col(key).alias("object_id"), F.lit(kind).alias("type"), _rels(*rels).alias("rels")).dropDuplicates(["object_id"])

    objs = [
        obj(assets, "asset_id", "Asset"),
        obj(alerts, "alert_id", "Alert", _rel(F.col("asset_id"), "raised_on_asset")),
        obj(cases, "case_id", "Case", _rel(F.col("_alert"), "case_for_alert"), _rel(F.col("analyst_id"), "current_assignee"), _rel(F.col("queue_id"), "current_queue")),
        obj(analysts, "analyst_id", "Analyst"),
        obj(queues, "queue_id", "Queue"),
    ]

    def attr(df: DataFrame, key: str, name: str, value: Column, at: Column | None = None) -> DataFrame:
        return df.select(F.lit(cse_id).alias("cse_id"), F.col(key).alias("object_id"), F.lit(name).alias("name"), value.alias("value"), (epoch() if at is None else at).alias("time"))

    attrs = [
        attr(assets, "asset_id", "criticality", filled("criticality")), attr(assets, "asset_id", "asset_type", filled("asset_type")),
        attr(alerts, "alert_id", "severity", filled("severity")), attr(alerts, "alert_id", "category", filled("category")),
        attr(cases, "case_id", "status", filled("status", "OPEN")), attr(cases.where(parsed_time(F.col("closed_at")).isNotNull()), "case_id", "status", F.lit("CLOSED"), parsed_time(F.col("closed_at"))),
        attr(analysts, "analyst_id", "tier", filled("tier")), attr(queues, "queue_id", "name", F.coalesce(F.nullif("name", F.lit("")), F.col("queue_id"))),
        *(attr(df, key, "cse_id", F.lit(cse_id)) for df, key in ((assets, "asset_id"), (alerts, "alert_id"), (cases, "case_id"), (analysts, "analyst_id"), (queues, "queue_id"))),
    ]

    def event(df: DataFrame, name: Column, kind: Column, at: Column, rels: Column, attributes: Column | None = None) -> DataFrame:
        empty = F.create_map().cast("map<string,string>")
        return df.select(F.lit(cse_id).alias("cse_id"), name.alias("event_id"), kind.alias("type"), at.alias("time"), (empty if attributes is None else attributes).alias("attrs"), rels.alias("rels"))

    case, kind = F.col("case_id"), F.col("_type")
    order = F.row_number().over(W.partitionBy("case_id").orderBy("_position"))
    numbered = spoken.withColumn("_k", order)
    to_case = F.coalesce(*(F.when(kind == k, _rel(case, q)) for k, q in CASE_QUALIFIER.items()))
    to_actor = F.coalesce(*(F.when(kind == k, _rel(F.col("actor"), q)) for k, q in (("REASSIGN", "reassigned_to"), ("INVESTIGATE", "investigated_by"), ("ASSIGN", "assigned_to"))))
    reason = F.when((kind == "REASSIGN") & ~_blank("handover_reason"), F.create_map(F.lit("handover_reason"), F.col("handover_reason")))
    opened = cases.where(~_blank("analyst_id") | ~_blank("queue_id"))
    events = [
        event(alerts, F.concat(F.lit("ALERT_RAISED::"), "alert_id"), F.lit("ALERT_RAISED"), when_("raised_at"), _rels(_rel(F.col("asset_id"), "alert_on_asset"))),
        event(cases, F.concat(F.lit("OPEN_CASE::"), case), F.lit("OPEN_CASE"), when_("opened_at"), _rels(_rel(F.col("_alert"), "opened_from_alert"))),
        event(opened, F.concat(F.lit("ASSIGN::"), case), F.lit("ASSIGN"), when_("opened_at"), _rels(_rel(case, "assignment_for_case"), _rel(F.col("analyst_id"), "assigned_to"), _rel(F.col("queue_id"), "routed_via"))),
        event(numbered, F.concat_ws("::", kind, case, F.col("_k").cast("string")), kind, when_("ts"), _rels(to_case, to_actor), F.coalesce(reason, F.create_map().cast("map<string,string>"))),
    ]
    union = lambda xs: reduce(DataFrame.unionByName, xs)
    return Log(union(events), union(objs), union(attrs).dropDuplicates(["object_id", "name", "time"]))


@dataclass(frozen=True)
class Ingested:
    gate: Gate
    log: Log | None
    low_confidence: DataFrame | None


def ingest(tables: Tables, cse_id: str, overrides: Mapping | None = None) -> Ingested:
    """Map (suggestions, then the confirmed overrides), gate, build."""
    mapping = {t: suggest(t, df.columns) | (overrides or {}).get(t, {}) for t, df in tables.items()}
    mapped = apply_mapping(tables, mapping)
    gate = quality_gate(mapped)
    if gate.status != "OK":
        return Ingested(gate, None, None)
    low = gate.low_confidence.select(F.lit(cse_id).alias("cse_id"), "case_id")
    return Ingested(gate, build_log(mapped, cse_id), low)


def validate_log(log: Log) -> DataFrame:
    """check, n of everything that a well-formed log has none of; a pass is n = 0 throughout.

    Every row is laid out as what it defines and what it points to, and one aggregate by these names answers all checks,
    so each table is read once and edges that lead to one object are summed up before they move.
    """
    fields = ("kind", "id", "name", "time", "defined", "from_event", "from_object", "from_attr", "bad", "unqualified")
    none = {"name": F.lit(None).cast("string"), "time": F.lit(None).cast("timestamp")}

    def item(kind: str, id_: Column, **more: Column) -> Column:
        at = {"kind": F.lit(kind), "id": id_} | none | {f: F.lit(0) for f in fields[4:]} | more
        return F.struct(*(at[f].alias(f) for f in fields))

    lacks = lambda c: c.isNull() | (c == "")
    one = F.lit(1)
    bad = lambda *cs: F.coalesce(reduce(lambda a, b: a | b, cs), F.lit(False)).cast("int")
    edges = F.coalesce("rels", F.array().cast(RELS))
    unqualified = F.size(F.filter(edges, lambda r: lacks(r["qualifier"])))
    targets = lambda name: F.transform(edges, lambda r: item("object", r["target_id"], **{name: one}))
    event, kind = F.col("event_id"), F.col("type")
    laid = [
        log.event.select("cse_id", F.explode(F.concat(F.array(item("event", event, defined=one, bad=bad(lacks(event), kind.isNull(), F.col("time").isNull()), unqualified=unqualified)), targets("from_event"))).alias("i")),
        log.object.select("cse_id", F.explode(F.concat(F.array(item("object", F.col("object_id"), defined=one, bad=bad(lacks(F.col("object_id")), kind.isNull()), unqualified=unqualified)), targets("from_object"))).alias("i")),
        log.object_attr.select("cse_id", F.explode(F.array(item("attr", F.col("object_id"), name=F.col("name"), time=F.col("time"), defined=one), item("object", F.col("object_id"), from_attr=one))).alias("i")),
    ]
    rows = reduce(DataFrame.unionByName, laid).select("cse_id", "i.*")
    names = rows.groupBy("cse_id", *fields[:4]).agg(*(F.sum(f).alias(f) for f in fields[4:]))
    of = lambda k: F.col("kind") == k
    nowhere = of("object") & ((F.col("defined") == 0) | F.col("cse_id").isNull() | F.col("id").isNull())
    total = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    found = {
        "event without id, type or time": total(of("event"), "bad"),
        "object without id or type": total(of("object"), "bad"),
        "duplicate event id": F.count_if(of("event") & (F.col("defined") > 1)),
        "duplicate object id": F.count_if(of("object") & (F.col("defined") > 1)),
        "duplicate attribute change": F.count_if(of("attr") & (F.col("defined") > 1)),
        "event edge without qualifier": total(of("event"), "unqualified"),
        "object edge without qualifier": total(of("object"), "unqualified"),
        "event edge to no object": total(nowhere, "from_event"),
        "object edge to no object": total(nowhere, "from_object"),
        "attribute of no object": total(nowhere, "from_attr"),
    }
    sums = names.agg(*(n.alias(f"n{i}") for i, n in enumerate(found.values())))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("n")) for i, name in enumerate(found)))).alias("x")).select("x.check", "x.n")
