"""Synthetic submissions with planted pathologies and their ground truth, drawn row by row from seeded hashes.

Every draw is a hash of the seed, the row's number and the draw's name, so rows need no order, no window and no driver:
any number of cases of any number of entities is one job, and each run gives the same log.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.expressions import epoch
from caselens.functions.vocabulary import CASE_QUALIFIER
from caselens.operators.log import EVENT, OBJECT, OBJECT_ATTR, RELS, Log

# Start and length of the time that cases open in, and how much of it the end with gamed metrics takes.
START = "2026-01-01 00:00:00"
HOURS = 24 * 60
SINGLE_SHARE, CHAIN_SHARE, EVIDENCE_SHARE = 0.10, 0.05, 0.7
ASSET_TYPES = ("Server", "Database", "Endpoint", "NetworkDevice")
CATEGORIES = (("MALWARE", 0.30), ("PHISHING", 0.25), ("INTRUSION_ATTEMPT", 0.20), ("POLICY_VIOLATION", 0.15), ("DATA_EXFILTRATION", 0.10))


@dataclass(frozen=True)
class Profile:
    """What an entity is like. criticality and severity: weights of LOW, MEDIUM, HIGH, CRITICAL."""

    cse_id: str
    seed: int
    cases: int
    assets: int
    analysts: int
    queues: int
    criticality: tuple[float, float, float, float] = (0.35, 0.35, 0.20, 0.10)
    severity: tuple[float, float, float, float] = (0.30, 0.35, 0.25, 0.10)
    compliance: float = 0.75  # mandatory escalations in time
    enrichment: float = 0.85  # cases enriched before they are looked into
    coverage: float = 0.90  # assets that raise alerts
    loops: int = 6
    justified_loops: int = 6  # alike but for a shift change at every handover
    gaming: float = 0.0  # share of the time, at its end, in which escalation looks better and enrichment falls
    gaming_boost: float = 0.20
    gaming_drop: float = 0.35


# The profiles.
MATURE_DEV = Profile("MATURE_DEV", 20260925, 300, 50, 15, 4)
MATURE = Profile("MATURE", 20260925, 2200, 180, 40, 6, loops=25, justified_loops=25)
SMALL = Profile("SMALL", 20260926, 2000, 60, 6, 2, (0.30, 0.30, 0.25, 0.15), (0.25, 0.30, 0.30, 0.15), 0.45, 0.55, 0.55, 20, 20)
MATURE_GAMING = replace(MATURE, cse_id="MATURE_GAMING", gaming=0.30)
MATURE_DEV_GAMING = replace(MATURE_DEV, cse_id="MATURE_DEV_GAMING", gaming=0.30)  # too few due alerts a week for an alarm
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def siblings(profile: Profile, n: int) -> list[Profile]:
    """The profile and n - 1 more entities like it, with seeds of their own."""
    return [profile, *(replace(profile, cse_id=f"{profile.cse_id}_{chr(65 + k)}", seed=profile.seed + 2 * k) for k in range(1, n))]


def named() -> dict[str, Profile]:
    """Every entity that comes with the generator by its name: the three profiles, ten siblings, two with gamed metrics."""
    every = [*siblings(MATURE_DEV, 3), *siblings(MATURE, 5), *siblings(SMALL, 5), MATURE_DEV_GAMING, MATURE_GAMING]
    return {p.cse_id: p for p in every}


def _draw(seed: Column, name: str, *of: str) -> Column:
    """Uniform in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(name), seed, *of), 11) / F.lit(float(1 << 53))


def weighted_choice(draw: Column, weights: Sequence[tuple[str, Column | float]]) -> Column:
    """The name at which the running sum of weights, taken as shares, passes the draw."""
    total = sum((w for _, w in weights[1:]), weights[0][1])
    out, so_far = None, 0.0
    for name, weight in weights[:-1]:
        so_far = so_far + weight
        hit = draw * total < so_far
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def _pick(draw: Column, n: Column) -> Column:
    return F.floor(draw * n).cast("long")


def _name(prefix: str, width: int, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad((number + 1).cast("string"), width, "0"))


def _rel(target: Column, qualifier: str) -> Column:
    return F.struct(target.alias("target_id"), F.lit(qualifier).alias("qualifier"))


def _profiles(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """One row for each profile; a step that is coprime to the number of cases walks them in a shuffled order."""
    rows = []
    for p in profiles:
        step = next(s for s in range(int(0.618 * p.cases) + p.seed % 97 + 1, 1 << 40) if math.gcd(s, p.cases) == 1)
        rows.append((p.cse_id, p.seed, p.cases, p.assets, p.analysts, p.queues, list(p.criticality), list(p.severity), p.compliance, p.enrichment, p.coverage, p.loops, p.justified_loops, p.gaming, p.gaming_boost, p.gaming_drop, step % p.cases or 1))
    return spark.createDataFrame(rows, "cse_id string, seed long, cases long, assets long, analysts long, queues long, criticality array<double>, severity array<double>, compliance double, enrichment double, coverage double, loops long, justified_loops long, gaming double, gaming_boost double, gaming_drop double, step long")


def _numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each profile once for every number below `count`; blocks of numbers first, so that no task makes them all."""
    block = 10_000
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / block))).alias("_k")).repartition("cse_id", "_k")
    inside = F.sequence(F.col("_k") * block, F.least((F.col("_k") + 1) * block, F.col(count)) - 1)
    return blocks.select("*", F.explode(inside).alias(name)).drop("_k")


def _weights(col: str) -> list[tuple[str, Column]]:
    return [(level, F.get(col, F.lit(i))) for i, level in enumerate(LEVELS)]


def _cases(known: DataFrame) -> DataFrame:
    """A row for each case with all its draws, before they become events."""
    seed = F.col("seed")
    draw = lambda name: _draw(seed, name, "i")
    span = lambda name, low, high: low + draw(name) * (high - low)  # noqa: E731  in minutes
    asset = _numbered(known, "assets", "a").select("cse_id", "a", F.struct(_name("AST", 4, F.col("a")).alias("id"), weighted_choice(_draw(seed, "criticality", "a"), _weights("criticality")).alias("criticality")).alias("asset"), (_draw(seed, "exposed", "a") < F.col("coverage")).alias("exposed"))
    reach = asset.groupBy("cse_id").agg(F.array_sort(F.collect_list(F.when(F.col("exposed"), F.col("asset")))).alias("_some"), F.array_sort(F.collect_list("asset")).alias("_all"))
    reach = reach.select("cse_id", F.when(F.size("_some") > 0, F.col("_some")).otherwise(F.col("_all")).alias("reach"))  # as long as an entity has assets
    rows = _numbered(known.join(reach, "cse_id"), "cases", "i")
    hours = span("opened", 0, HOURS)
    place = (F.col("i") * F.col("step") + F.col("seed") % F.col("cases")) % F.col("cases")
    special = F.col("loops") + F.col("justified_loops")
    single, chain = F.floor(F.col("cases") * SINGLE_SHARE), F.floor(F.col("cases") * CHAIN_SHARE)
    rows = rows.withColumns({
        "case_id": _name("CASE", 5, F.col("i")), "alert_id": _name("ALRT", 5, F.col("i")), "target": F.get("reach", _pick(draw("asset"), F.size("reach"))), "level": weighted_choice(draw("severity"), _weights("severity")),
        "category": weighted_choice(draw("category"), CATEGORIES), "hours": hours, "place": place, "first": _pick(draw("analyst"), F.col("analysts")), "queue_id": _name("QUE", 2, _pick(draw("queue"), F.col("queues"))),
    }).drop("reach")
    gamed = (F.col("gaming") > 0) & (F.col("hours") >= HOURS * (1 - F.col("gaming")))
    kind = F.when(F.col("place") < F.col("loops"), "loop").when(F.col("place") < special, "justified").when(F.col("place") < special + single, "single").when(F.col("place") < special + single + chain, "chain")
    rows = rows.withColumns({
        "kind": kind, "escalates": (F.col("level") == "CRITICAL") & F.col("target.criticality").isin("HIGH", "CRITICAL"),
        "in_time": F.when(gamed, F.least(F.lit(0.99), F.col("compliance") + F.col("gaming_boost"))).otherwise(F.col("compliance")),
        "enriched": draw("enriched") < F.when(gamed, F.greatest(F.lit(0.0), F.col("enrichment") - F.col("gaming_drop"))).otherwise(F.col("enrichment")),
        "evidenced": draw("evidenced") < EVIDENCE_SHARE,
    })
    # Others than the first analyst, all different: steps round the ring of analysts.
    other = lambda k: (F.col("first") + 1 + (_pick(draw("other"), F.col("analysts") - 1) + k) % (F.col("analysts") - 1)) % F.col("analysts")
    one, two = _pick(draw("one"), F.col("analysts")), None
    two = (one + 1 + _pick(draw("two"), F.col("analysts") - 1)) % F.col("analysts")
    to = F.when(F.col("kind").isin("loop", "justified"), F.array(one, two, one, two)).when(F.col("kind") == "single", F.array(other(0))).when(F.col("kind") == "chain", F.array(other(0), other(1), other(2))).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("to", to)
    minute = {"raised": F.col("hours") * 60}
    minute["opened"] = minute["raised"] + span("open", 1, 30)
    minute["assigned"] = minute["opened"] + span("assign", 1, 15)
    roll = draw("escalation")
    late = F.col("in_time") + (1 - F.col("in_time")) / 2
    minute["escalated"] = F.when(F.col("escalates") & (roll < F.col("in_time")), minute["assigned"] + span("soon", 5, 25)).when(F.col("escalates") & (roll < late), minute["assigned"] + span("late", 35, 180))
    wait = lambda k: F.when(F.col("kind") == "justified", F.lit(8 * 60.0)).otherwise(span(f"handover{k}", 5, 45))
    moved = [minute["assigned"] + sum((wait(j) for j in range(1, k + 1)), wait(0)) for k in range(4)]
    minute["moved"] = F.slice(F.array(*moved), F.lit(1), F.size("to"))
    rows = rows.withColumns(minute)
    rows = rows.withColumn("settled", F.coalesce(F.try_element_at("moved", F.lit(-1)), F.col("assigned")) + F.when(F.col("enriched"), span("enrich", 10, 60)).otherwise(0.0))
    rows = rows.withColumn("looked", F.col("settled") + span("investigate", 15, 120))
    rows = rows.withColumn("found", F.col("looked") + F.when(F.col("evidenced"), span("evidence", 10, 90)).otherwise(0.0))
    return rows.withColumn("closed", F.col("found") + span("close", 15, 60))


def generate(spark: SparkSession, profiles: Sequence[Profile]) -> tuple[Log, DataFrame]:
    """The log of all profiles, and the ground truth: cse_id, case_id, pathology, is_hard_negative, analysts_involved,
    reassignment_count of every case with a reassignment."""
    known = F.broadcast(_profiles(spark, profiles))
    rows = _cases(known)
    at = lambda minutes: F.timestamp_micros((F.unix_micros(F.lit(START).cast("timestamp")) + F.round(minutes * 60_000_000)).cast("long"))
    who = lambda n: _name("ANL", 3, n)
    none = F.create_map().cast("map<string,string>")
    case = F.col("case_id")

    def event(kind: str, minutes: Column, *rels: Column, when: Column | None = None, number: Column | None = None, attrs: Column = none) -> Column:
        name = F.concat_ws("::", F.lit(kind), case, *([number.cast("string")] if number is not None else []))
        edges = [_rel(case, CASE_QUALIFIER[kind])] if kind in CASE_QUALIFIER else []
        made = F.struct(name.alias("event_id"), F.lit(kind).alias("type"), at(minutes).alias("time"), attrs.alias("attrs"), F.array(*edges, *rels).cast(RELS).alias("rels"))
        return made if when is None else F.when(when, made)

    shift = F.when(F.col("kind") == "justified", F.create_map(F.lit("handover_reason"), F.lit("SHIFT_CHANGE"))).otherwise(none)
    owner = F.coalesce(F.try_element_at("to", F.lit(-1)), F.col("first"))
    fixed = F.array(
        event("ALERT_RAISED", F.col("raised"), _rel(F.col("target.id"), "alert_on_asset")), event("OPEN_CASE", F.col("opened"), _rel(F.col("alert_id"), "opened_from_alert")),
        event("ASSIGN", F.col("assigned"), _rel(who(F.col("first")), "assigned_to"), _rel(F.col("queue_id"), "routed_via")), event("ESCALATE", F.col("escalated"), when=F.col("escalated").isNotNull()),
        event("ENRICH", F.col("settled"), when=F.col("enriched")), event("INVESTIGATE", F.col("looked"), _rel(who(owner), "investigated_by")),
        event("EVIDENCE_COLLECT", F.col("found"), when=F.col("evidenced")), event("CLOSE", F.col("closed")),
    )
    handovers = F.transform(F.arrays_zip("to", "moved"), lambda x, k: event("REASSIGN", x["moved"], _rel(who(x["to"]), "reassigned_to"), number=k + 1, attrs=shift))
    events = rows.select("cse_id", F.explode(F.array_compact(F.concat(fixed, handovers))).alias("e")).select("cse_id", "e.*")
    objects = rows.select("cse_id", F.explode(F.array(
        F.struct(case.alias("object_id"), F.lit("Case").alias("type"), F.array(_rel(F.col("alert_id"), "case_for_alert"), _rel(who(F.col("first")), "current_assignee"), _rel(F.col("queue_id"), "current_queue")).cast(RELS).alias("rels")),
        F.struct(F.col("alert_id").alias("object_id"), F.lit("Alert").alias("type"), F.array(_rel(F.col("target.id"), "raised_on_asset")).cast(RELS).alias("rels")),
    )).alias("o")).select("cse_id", "o.*")
    seed = F.col("seed")
    plain = lambda count, kind, prefix, width: _numbered(known, count, "n").select("cse_id", "seed", "criticality", "n", _name(prefix, width, F.col("n")).alias("object_id"), F.lit(kind).alias("type"))
    assets, analysts, queues = plain("assets", "Asset", "AST", 4), plain("analysts", "Analyst", "ANL", 3), plain("queues", "Queue", "QUE", 2)
    bare = lambda df: df.select("cse_id", "object_id", "type", F.array().cast(RELS).alias("rels"))
    attr = lambda df, name, value, time=None: df.select("cse_id", "object_id", F.lit(name).alias("name"), value.alias("value"), (epoch() if time is None else time).alias("time"))
    of_case, of_alert = rows.withColumn("object_id", case), rows.withColumn("object_id", F.col("alert_id"))
    attrs = attr(of_case, "status", F.lit("OPEN")).unionByName(attr(of_case, "status", F.lit("CLOSED"), at(F.col("closed"))))
    for more in (
        attr(of_alert, "severity", F.col("level")), attr(of_alert, "category", F.col("category")), attr(assets, "criticality", weighted_choice(_draw(seed, "criticality", "n"), _weights("criticality"))),
        attr(assets, "asset_type", weighted_choice(_draw(seed, "asset_type", "n"), [(t, 1.0) for t in ASSET_TYPES])), attr(analysts, "tier", weighted_choice(_draw(seed, "tier", "n"), [("JUNIOR", 1.0), ("SENIOR", 1.0)])), attr(queues, "name", F.col("object_id")),
    ):
        attrs = attrs.unionByName(more)
    log = Log(_as(events, EVENT), _as(objects.unionByName(bare(assets)).unionByName(bare(analysts)).unionByName(bare(queues)), OBJECT), _as(attrs, OBJECT_ATTR), cases_known=True)
    pathology = F.when(F.col("kind").isin("loop", "justified"), "REASSIGNMENT_LOOP").when(F.col("kind") == "single", "SINGLE_REASSIGNMENT").otherwise("REASSIGNMENT_CHAIN_NO_LOOP")
    involved = F.transform(F.array_distinct("to"), who)
    truth = rows.where("kind is not null").select("cse_id", "case_id", pathology.alias("pathology"), (F.col("kind") == "justified").alias("is_hard_negative"), involved.alias("analysts_involved"), F.size("to").cast("long").alias("reassignment_count"))
    return log, truth


def write_truth(truth: DataFrame, path: str) -> None:
    """The ground truth beside a log: a folder of JSON lines, a line for each planted case."""
    truth.write.mode("overwrite").json(path)


def _as(df: DataFrame, schema: str) -> DataFrame:
    from pyspark.sql.types import StructType

    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def sample_portfolio(spark: SparkSession, tier: str = "dev") -> tuple[Log, DataFrame]:
    """Several entities of a tier in one call: dev (three small ones), scaled (five of each full-size profile) or drift (a
    small and a full-size one with gamed metrics at the end)."""
    tiers = {"dev": siblings(MATURE_DEV, 3), "scaled": siblings(MATURE, 5) + siblings(SMALL, 5), "drift": [MATURE_DEV_GAMING, MATURE_GAMING]}
    return generate(spark, tiers[tier])
