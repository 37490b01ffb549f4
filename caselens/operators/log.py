"""The event log as tables, and the views that rules and detectors read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.expressions import epoch
from caselens.functions.vocabulary import CASE_QUALIFIER, FOR_CASE
from caselens.sources.scratch import drop_held

NOBODY = "∅"  # stands for a reassignment to no one, which counts as someone

RELS = "array<struct<target_id:string,qualifier:string>>"
EVENT = f"cse_id string, event_id string, type string, time timestamp, attrs map<string,string>, rels {RELS}"
OBJECT = f"cse_id string, object_id string, type string, rels {RELS}"
OBJECT_ATTR = "cse_id string, object_id string, name string, value string, time timestamp"
TYPE_ATTRIBUTE = "kind string, type_name string, attr_name string, attr_type string"


@dataclass(frozen=True)
class Log:
    """Events and objects carry their own qualified edges, so a view of an edge is an explode and no join.

    Every table leads with cse_id, the entity that the rows belong to; any number of entities share the tables.
    """

    event: DataFrame
    object: DataFrame
    object_attr: DataFrame
    by_type: dict[str, DataFrame] = field(default_factory=dict)  # rows of `object` of a type, where they are known apart
    by_name: dict[str, DataFrame] = field(default_factory=dict)  # rows of `object_attr` of a name, likewise
    cases_known: bool = False  # every edge that ends in `_for_case` leads to a case of the log
    views: dict[str, DataFrame] = field(default_factory=dict)  # views of the log that are held, or plain reads of what is
    folders: tuple[str, ...] = ()  # where what the tables are made from is held

    @staticmethod
    def of(spark: SparkSession, event: list, object: list, object_attr: list = ()) -> Log:  # noqa: A002
        """A log of literal rows."""
        return Log(spark.createDataFrame(list(event), EVENT), spark.createDataFrame(list(object), OBJECT), spark.createDataFrame(list(object_attr), OBJECT_ATTR))

    def map(self, f) -> Log:  # noqa: ANN001
        return Log(f(self.event), f(self.object), f(self.object_attr), {k: f(v) for k, v in self.by_type.items()}, {k: f(v) for k, v in self.by_name.items()}, self.cases_known, folders=self.folders)

    def union(self, other: Log) -> Log:
        return Log(*(getattr(self, n).unionByName(getattr(other, n)) for n in ("event", "object", "object_attr")))

    def of_type(self, kind: str) -> DataFrame:
        return self.by_type[kind] if kind in self.by_type else self.object.where(F.col("type") == kind)

    def of_name(self, *names: str) -> DataFrame:
        """Attribute rows of some names."""
        if all(n in self.by_name for n in names):
            return reduce(DataFrame.unionByName, [self.by_name[n] for n in names])
        return self.object_attr.where(F.col("name").isin(*names))

    def persist(self) -> Log:
        """The same log with its tables and the views that nearly every operator reads held, for plans that read them
        many times. release() lets go of them. A log that is made from held tables has its views from them."""
        if self.folders:
            return self
        hold = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
        for df in (self.event, *(self.by_type.values() or [self.object]), *(self.by_name.values() or [self.object_attr])):
            hold(df)
        views = {"case_profile": case_profile(self), "reassignments": reassignments(self), "case_alerts": case_alerts(self), "alert_assets": alert_assets(self)}
        views |= {f"{kind}.{name}": objects(self, kind, name) for kind, name in (("Alert", "severity"), ("Asset", "criticality"))}
        return replace(self, views={k: hold(v) for k, v in views.items()})

    @contextmanager
    def held(self) -> Iterator[Log]:
        """The log as persist() gives it, released at the end: what is to outlive it is written before."""
        log = self.persist()
        try:
            yield log
        finally:
            log.release()

    def release(self) -> None:
        """Let go of all that is held of this log."""
        for at in self.folders:
            drop_held(self.event.sparkSession, at)
        for df in (*self.views.values(), self.event, self.object, self.object_attr, *self.by_type.values(), *self.by_name.values()):
            df.unpersist()

    def where(self, condition: Column | str) -> Log:
        """The same log for some entities; the condition is about cse_id."""
        return self.map(lambda df: df.where(condition))

    def event_object(self) -> DataFrame:
        return self.event.select("cse_id", "event_id", "type", "time", F.explode("rels").alias("r")).select("cse_id", "event_id", "type", "time", "r.target_id", "r.qualifier")

    def object_object(self, kind: str | None = None) -> DataFrame:
        """Edges from objects, of one type or all."""
        return (self.of_type(kind) if kind else self.object).select("cse_id", F.col("object_id").alias("source_id"), F.col("type").alias("source_type"), F.explode("rels").alias("r")).select("cse_id", "source_id", "source_type", "r.target_id", "r.qualifier")


def first_target(qualifier: str, rels: str = "rels") -> Column:
    """The target of the first edge with this qualifier, or null."""
    return F.try_element_at(F.filter(rels, lambda r: r["qualifier"] == qualifier), F.lit(1))["target_id"]


def objects(log: Log, kind: str, *attributes: str) -> DataFrame:
    """cse_id, object_id, rels of one type of object, with the initial values of some attributes."""
    if len(attributes) == 1 and f"{kind}.{attributes[0]}" in log.views:
        return log.views[f"{kind}.{attributes[0]}"]
    rows = log.of_type(kind).select("cse_id", "object_id", "rels")
    if not attributes:
        return rows
    first = log.of_name(*attributes).where(F.col("time") == epoch())
    wide = first.groupBy("cse_id", "object_id").agg(*(F.min(F.when(F.col("name") == a, F.col("value"))).alias(a) for a in attributes))
    return rows.join(wide, ["cse_id", "object_id"], "left")


def attr_snapshot(log: Log) -> DataFrame:
    """Initial values: one row for each object, a column for each attribute."""
    names = ("severity", "criticality", "status", "tier", "name")
    first = log.object_attr.where(F.col("time") == epoch())
    return first.groupBy("cse_id", "object_id").agg(*(F.min(F.when(F.col("name") == a, F.col("value"))).alias(a) for a in names))


def case_events(log: Log) -> DataFrame:
    """cse_id, case_id, event_id, type, time, attrs, rels: an event for each edge that ends in `_for_case` at a case."""
    edge = F.explode(F.filter("rels", lambda r: r["qualifier"].endswith(FOR_CASE)))
    rows = log.event.select("cse_id", edge.alias("_e"), "event_id", "type", "time", "attrs", "rels").select("cse_id", F.col("_e.target_id").alias("case_id"), "event_id", "type", "time", "attrs", "rels")
    if log.cases_known:
        return rows
    cases = log.of_type("Case").select("cse_id", F.col("object_id").alias("case_id"))
    return rows.join(cases, ["cse_id", "case_id"], "left_semi")


def case_alerts(log: Log) -> DataFrame:
    """cse_id, case_id, alert_id for every edge from a case to its alert."""
    if "case_alerts" in log.views:
        return log.views["case_alerts"]
    return log.object_object("Case").where("qualifier = 'case_for_alert'").select("cse_id", F.col("source_id").alias("case_id"), F.col("target_id").alias("alert_id"))


def alert_assets(log: Log) -> DataFrame:
    """cse_id, alert_id, asset_id for every edge from an alert to its asset."""
    if "alert_assets" in log.views:
        return log.views["alert_assets"]
    return log.object_object("Alert").where("qualifier = 'raised_on_asset'").select("cse_id", F.col("source_id").alias("alert_id"), F.col("target_id").alias("asset_id"))


def case_context(log: Log) -> DataFrame:
    """cse_id, case_id, alert_severity, asset_criticality over case, alert and asset; no alerts or assets: no rows."""
    if "case_context" in log.views:
        return log.views["case_context"]
    alerts = objects(log, "Alert", "severity").select("cse_id", F.col("object_id").alias("alert_id"), F.col("severity").alias("alert_severity"))
    assets = objects(log, "Asset", "criticality").select("cse_id", F.col("object_id").alias("asset_id"), F.col("criticality").alias("asset_criticality"))
    return case_alerts(log).join(alerts, ["cse_id", "alert_id"]).join(alert_assets(log), ["cse_id", "alert_id"]).join(assets, ["cse_id", "asset_id"]).select("cse_id", "case_id", "alert_severity", "asset_criticality")


def case_trace(log: Log) -> DataFrame:
    """Events of each object by any edge, with the other edges written out; order by time, event_id to read it."""
    edge = log.event.select("cse_id", F.explode("rels").alias("_e"), "event_id", "type", "time", "rels")
    others = F.transform(F.filter("rels", lambda r: r["target_id"] != F.col("_e.target_id")), lambda r: F.concat(r["qualifier"], F.lit("->"), r["target_id"]))
    return edge.select("cse_id", F.col("_e.target_id").alias("object_id"), "event_id", "type", "time", F.concat_ws("; ", F.sort_array(others)).alias("others")).distinct()


def raw_objects(log: Log, kind: str | None = None) -> DataFrame:
    """cse_id, object_id, type and initial values (a map) of the objects of one type or all."""
    rows = log.of_type(kind) if kind else log.object
    first = log.object_attr.where(F.col("time") == epoch()).groupBy("cse_id", "object_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("name", "value")))).alias("attrs"))
    return rows.select("cse_id", "object_id", "type").join(first, ["cse_id", "object_id"], "left")


def raw_events(log: Log, kind: str | None = None) -> DataFrame:
    """cse_id, event_id, type, time and edges written out of the events of one type or all."""
    rows = log.event.where(F.col("type") == kind) if kind else log.event
    edges = F.concat_ws(", ", F.array_sort(F.transform("rels", lambda r: F.concat(r["qualifier"], F.lit("->"), r["target_id"]))))
    return rows.select("cse_id", "event_id", "type", "time", edges.alias("relationships"))


def case_profile(log: Log, events_of: list[str] | None = None) -> DataFrame:
    """What rules and detectors ask of a case, in one pass: `opened` (first event), `closed` (last CLOSE), the number and
    first time of each type of event (`n_<type>`, `first_<type>`); if events_of is given, also `steps`, the events of
    these types. What takes part is of a fixed size without them, so map-side sums stay small."""
    if events_of is None and "case_profile" in log.views:
        return log.views["case_profile"]
    steps = [F.collect_list(F.when(F.col("type").isin(*events_of), F.struct("type", "time", "event_id"))).alias("steps")] if events_of is not None else []
    return case_events(log).groupBy("cse_id", "case_id").agg(*(c.alias(name) for name, c in profile_columns().items()), *steps)


def profile_columns(is_: Callable[[str], Column] = lambda kind: F.col("type") == kind) -> dict[str, Column]:
    """Aggregates over the type and time of a case's events, by name. is_: whether an event is of a type."""
    numbers = {f"n_{k}": F.count_if(is_(k)) for k in CASE_QUALIFIER}
    times = {f"first_{k}": F.min(F.when(is_(k), F.col("time"))) for k in CASE_QUALIFIER}
    return {"opened": F.min("time"), "closed": F.max(F.when(is_("CLOSE"), F.col("time"))), **numbers, **times}


def reassignments(log: Log) -> DataFrame:
    """cse_id, case_id, n_REASSIGN, reassigned (in order) of the cases with any; only these events move."""
    if "reassignments" in log.views:
        return log.views["reassignments"]
    step = F.struct("time", "event_id", F.coalesce(first_target("reassigned_to"), F.lit(NOBODY)).alias("to"), F.coalesce(F.col("attrs")["handover_reason"] == "SHIFT_CHANGE", F.lit(False)).alias("shift"))
    return case_events(log).where("type = 'REASSIGN'").groupBy("cse_id", "case_id").agg(F.count("*").alias("n_REASSIGN"), F.array_sort(F.collect_list(step)).alias("reassigned"))


def assignees(log: Log) -> DataFrame:
    """cse_id, case_id, analyst_id for every edge from a case to the one who has it now."""
    if "assignees" in log.views:
        return log.views["assignees"]
    return log.object_object("Case").where("qualifier = 'current_assignee'").select("cse_id", F.col("source_id").alias("case_id"), F.col("target_id").alias("analyst_id"))


def investigators(log: Log) -> DataFrame:
    """cse_id, analyst_id for every edge from an investigation to who did it."""
    if "investigators" in log.views:
        return log.views["investigators"]
    return log.event_object().where("type = 'INVESTIGATE' and qualifier = 'investigated_by'").select("cse_id", F.col("target_id").alias("analyst_id"))


def closed_investigations(log: Log) -> DataFrame:
    """cse_id, case_id, analyst_id, time, closed of the investigations of closed cases that have an analyst."""
    if "closed_investigations" in log.views:
        return log.views["closed_investigations"]
    closed = case_profile(log).where("closed is not null").select("cse_id", "case_id", "closed")
    looked = case_events(log).where("type = 'INVESTIGATE'").select("cse_id", "case_id", first_target("investigated_by").alias("analyst_id"), "time").where("analyst_id is not null")
    return looked.join(closed, ["cse_id", "case_id"])


def routed_cases(log: Log) -> DataFrame:
    """cse_id, case_id, queue_id, n_up: the escalations of each case, by the queue that it is in."""
    if "routed_cases" in log.views:
        return log.views["routed_cases"]
    routed = log.object_object("Case").where("qualifier = 'current_queue'").select("cse_id", F.col("source_id").alias("case_id"), F.col("target_id").alias("queue_id"))
    return routed.join(case_profile(log).select("cse_id", "case_id", F.col("n_ESCALATE").alias("n_up")), ["cse_id", "case_id"], "left")


def asset_chain(log: Log) -> DataFrame:
    """cse_id, asset_id, alert_id, case_id, deep: an asset's alerts, their cases, and whether these were looked into."""
    if "asset_chain" in log.views:
        return log.views["asset_chain"]
    depth = case_profile(log).select("cse_id", "case_id", (F.col("n_INVESTIGATE") + F.col("n_EVIDENCE_COLLECT") > 0).alias("deep"))
    return alert_assets(log).join(case_alerts(log), ["cse_id", "alert_id"], "left").join(depth, ["cse_id", "case_id"], "left")
