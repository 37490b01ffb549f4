"""Object-centric event logs as files for exchange, in the layouts of the OCEL 2.0 standard: JSON and SQLite.

A file holds one entity's log and is made for other tools to read; logs at rest are in the store. JSON documents are made
and read by Spark; a SQLite file can only be written by one process, so its rows stream through the driver, table by table.
"""

from __future__ import annotations

import re
import sqlite3
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.expressions import epoch
from caselens.functions.vocabulary import EVENT_TYPES, OBJECT_ATTRIBUTES
from caselens.operators.log import RELS, Log

from .exports import Sqlite, sqlite_tables

_NAMES = "array<struct<name:string,type:string>>"
_REL = "array<struct<objectId:string,qualifier:string>>"
_TYPES = f"array<struct<name:string,attributes:{_NAMES}>>"
DOCUMENT = f"eventTypes {_TYPES}, objectTypes {_TYPES}, events array<struct<id:string,type:string,time:string,attributes:array<struct<name:string,value:string>>,relationships:{_REL}>>, objects array<struct<id:string,type:string,attributes:array<struct<name:string,value:string,time:string>>,relationships:{_REL}>>"
# The tables of the standard that every file has, and the columns that aren't attributes.
TABLES = ("event_map_type", "object_map_type", "event", "object", "event_object", "object_object")
OWN_COLUMNS = ("ocel_id", "ocel_time", "ocel_changed_field")


def declared(log: Log) -> DataFrame:
    """kind (event or object), type_name, attr_name: every type of a log with its attributes; none: a null attribute."""
    events = log.event.select("cse_id", F.lit("event").alias("kind"), F.col("type").alias("type_name"), F.explode_outer(F.map_keys("attrs")).alias("attr_name"))
    names = log.object_attr.select("cse_id", "object_id", "name").distinct()
    objects = log.object.join(names, ["cse_id", "object_id"], "left").select("cse_id", F.lit("object"), F.col("type"), "name")
    return events.union(objects).distinct()


def _stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def log_json(log: Log) -> DataFrame:
    """cse_id, document: one JSON document for each entity."""
    rels = F.transform("rels", lambda r: F.struct(r["target_id"].alias("objectId"), r["qualifier"].alias("qualifier")))
    attrs = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    events = log.event.groupBy("cse_id").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), "type", _stamp(F.col("time")).alias("time"), attrs.alias("attributes"), rels.alias("relationships")))).alias("events"))
    history = log.object_attr.groupBy("cse_id", "object_id").agg(F.array_sort(F.collect_list(F.struct("name", "value", _stamp(F.col("time")).alias("time")))).alias("attributes"))
    objects = log.object.join(history, ["cse_id", "object_id"], "left").groupBy("cse_id").agg(F.array_sort(F.collect_list(F.struct(F.col("object_id").alias("id"), "type", F.coalesce("attributes", F.array()).alias("attributes"), rels.alias("relationships")))).alias("objects"))
    each = declared(log).groupBy("cse_id", "kind", F.col("type_name").alias("name")).agg(F.array_sort(F.collect_list(F.when(F.col("attr_name").isNotNull(), F.struct(F.col("attr_name").alias("name"), F.lit("string").alias("type"))))).alias("attributes"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "attributes"))))
    types = each.groupBy("cse_id").agg(of("event").alias("eventTypes"), of("object").alias("objectTypes"))
    none = F.array()
    return events.join(objects, "cse_id", "full").join(types, "cse_id").select("cse_id", F.to_json(F.struct("eventTypes", "objectTypes", F.coalesce("events", none).alias("events"), F.coalesce("objects", none).alias("objects"))).alias("document"))


def read_documents(spark: SparkSession, path: str, cse_id: str) -> DataFrame:
    """Parsed documents of one entity; text that is no JSON of this shape stops the read."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("cse_id", F.lit(cse_id))


def document_problems(doc: DataFrame) -> DataFrame:
    """check, n of what the standard's schema asks of a document and it lacks: top-level parts, ids, types, times, names."""
    part = lambda name: doc.select(F.explode(name).alias("x")).select("x.*")
    lacks = lambda *names: reduce(lambda a, b: a | b, (F.col(n).isNull() | (F.col(n) == "") for n in names))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    undeclared = lambda rows, types: part(rows).select(F.col("type").alias("name")).join(part(types).select("name"), "name", "left_anti")
    deep = lambda rows, name: part(rows).select(F.explode(name).alias("y")).select("y.*")
    found = [count(f"{name} lacking", doc.where(F.col(name).isNull())) for name in ("eventTypes", "objectTypes", "events", "objects")]
    found += [count(f"{name} without a name", part(name).where(lacks("name"))) for name in ("eventTypes", "objectTypes")]
    found += [count("event without id, type or time", part("events").where(lacks("id", "type", "time") | F.col("time").try_cast("timestamp").isNull())), count("object without id or type", part("objects").where(lacks("id", "type")))]
    found += [count(f"{rows}: a type that isn't declared", undeclared(rows, types)) for rows, types in (("events", "eventTypes"), ("objects", "objectTypes"))]
    for rows in ("events", "objects"):
        found += [count(f"{rows}: edge without target or qualifier", deep(rows, "relationships").where(lacks("objectId", "qualifier"))), count(f"{rows}: attribute without a name", deep(rows, "attributes").where(lacks("name")))]
    return reduce(DataFrame.unionByName, found)


def read_log_json(spark: SparkSession, path: str, cse_id: str) -> Log:
    return log_of_documents(read_documents(spark, path, cse_id))


def log_of_documents(doc: DataFrame) -> Log:
    """The log of parsed documents: columns cse_id, events, objects."""
    rels = lambda c: F.coalesce(F.transform(c, lambda r: F.struct(r["objectId"].alias("target_id"), r["qualifier"].alias("qualifier"))), F.array().cast(RELS))
    e = doc.select("cse_id", F.explode("events").alias("e"))
    o = doc.select("cse_id", F.explode("objects").alias("o"))
    attrs = F.coalesce(F.map_from_entries(F.col("e.attributes")), F.create_map().cast("map<string,string>"))
    return Log(
        e.select("cse_id", F.col("e.id").alias("event_id"), F.col("e.type").alias("type"), F.col("e.time").cast("timestamp").alias("time"), attrs.alias("attrs"), rels(F.col("e.relationships")).alias("rels")),
        o.select("cse_id", F.col("o.id").alias("object_id"), F.col("o.type").alias("type"), rels(F.col("o.relationships")).alias("rels")),
        o.select("cse_id", F.col("o.id").alias("object_id"), F.explode("o.attributes").alias("a")).select("cse_id", "object_id", "a.name", "a.value", F.col("a.time").cast("timestamp").alias("time")),
    )


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _table_of(kind: str, type_name: str) -> str:
    return f"{kind}_{re.sub(r'[^0-9A-Za-z_]', '', type_name)}"


def write_log_sqlite(log: Log, path: str) -> None:
    """One entity's log as a new SQLite file: the general tables and one for each type. An object's first values are one
    row at the epoch; each later value is a row that names its field. Times keep their microseconds."""
    types: dict[str, dict[str, list[str]]] = {"event": {}, "object": {}}
    for r in declared(log).select("kind", "type_name", "attr_name").distinct().collect():  # types and names, not rows
        types[r.kind].setdefault(r.type_name, []).extend([r.attr_name] if r.attr_name is not None else [])
    for kind, known in (("event", {t: () for t in EVENT_TYPES}), ("object", OBJECT_ATTRIBUTES)):
        for t in types[kind]:
            types[kind][t] = sorted({*types[kind][t], *known.get(t, ())})
    rows = lambda df: (tuple(r) for r in df.toLocalIterator())
    put = lambda db, table, df: db.executemany(f"INSERT INTO {_q(table)} VALUES ({', '.join('?' * len(df.columns))})", rows(df))
    with sqlite3.connect(path) as db:
        for kind in types:
            db.execute(f"CREATE TABLE {kind}_map_type (ocel_type TEXT PRIMARY KEY, ocel_type_map TEXT NOT NULL)")
            db.executemany(f"INSERT INTO {kind}_map_type VALUES (?, ?)", [(t, _table_of("", t)[1:]) for t in sorted(types[kind])])
            db.execute(f"CREATE TABLE {kind} (ocel_id TEXT PRIMARY KEY, ocel_type TEXT NOT NULL REFERENCES {kind}_map_type(ocel_type))")
        db.execute("CREATE TABLE event_object (ocel_event_id TEXT NOT NULL REFERENCES event(ocel_id), ocel_object_id TEXT NOT NULL REFERENCES object(ocel_id), ocel_qualifier TEXT NOT NULL, PRIMARY KEY (ocel_event_id, ocel_object_id, ocel_qualifier))")
        db.execute("CREATE TABLE object_object (ocel_source_id TEXT NOT NULL REFERENCES object(ocel_id), ocel_target_id TEXT NOT NULL REFERENCES object(ocel_id), ocel_qualifier TEXT NOT NULL, PRIMARY KEY (ocel_source_id, ocel_target_id, ocel_qualifier))")
        put(db, "event", log.event.select("event_id", "type"))
        put(db, "object", log.object.select("object_id", "type"))
        put(db, "event_object", log.event_object().select("event_id", "target_id", "qualifier").distinct())
        put(db, "object_object", log.object_object().select("source_id", "target_id", "qualifier").distinct())
        for t, names in types["event"].items():
            db.execute(f"CREATE TABLE {_q(_table_of('event', t))} (ocel_id TEXT PRIMARY KEY REFERENCES event(ocel_id), ocel_time TEXT NOT NULL{''.join(f', {_q(n)} TEXT' for n in names)})")
            put(db, _table_of("event", t), log.event.where(F.col("type") == t).select("event_id", _stamp(F.col("time")), *(F.col("attrs")[n] for n in names)))
        for t, names in types["object"].items():
            db.execute(f"CREATE TABLE {_q(_table_of('object', t))} (ocel_id TEXT NOT NULL REFERENCES object(ocel_id), ocel_time TEXT NOT NULL{''.join(f', {_q(n)} TEXT' for n in names)}, ocel_changed_field TEXT)")
            own = log.of_type(t).select("cse_id", "object_id").join(log.object_attr, ["cse_id", "object_id"], "left")
            value = lambda n: F.when(F.col("name") == n, F.col("value"))
            first = own.where(F.col("time").isNull() | (F.col("time") == epoch())).groupBy("object_id").agg(F.lit(1), *(F.max(value(n)).alias(n) for n in names))
            put(db, _table_of("object", t), first.select("object_id", _stamp(epoch()), *(F.col(f"`{n}`") for n in names), F.lit(None).cast("string")))
            put(db, _table_of("object", t), own.where(F.col("time") != epoch()).select("object_id", _stamp(F.col("time")), *(value(n) for n in names), "name"))


def sqlite_problems(path: str) -> list[str]:
    """What a file lacks of the standard: tables, primary keys, rows that foreign keys point at."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        out = [f"no table {t}" for t in TABLES if t not in sqlite_tables(path)]
        keyed = {t for t in TABLES[:4] for c in db.execute(f"PRAGMA table_info({_q(t)})") if c[5]}
        out += [f"{t} has no primary key" for t in TABLES[:4] if t not in keyed and f"no table {t}" not in out]
        return out + [f"{r[0]}: row {r[1]} points at no {r[2]}" for r in db.execute("PRAGMA foreign_key_check")]


def problems(spark: SparkSession, json_path: str, sqlite_path: str, cse_id: str) -> list[str]:
    """What a log's two files and the log itself lack; empty if nothing."""
    from caselens.operators.ingest import validate_log

    doc = read_documents(spark, json_path, cse_id)
    found = document_problems(doc).unionByName(validate_log(log_of_documents(doc))).where("n > 0")
    return [f"{r['check']}: {r['n']}" for r in found.collect()] + sqlite_problems(sqlite_path)


def read_log_sqlite(spark: SparkSession, path: str, cse_id: str) -> Log:
    """The log of a file that every executor can open. A file without the standard's tables stops the read."""
    spark.dataSource.register(Sqlite)
    have = set(sqlite_tables(path))
    if lacking := set(TABLES) - have:
        raise ValueError(f"tables lacking: {sorted(lacking)}")
    t = lambda name: spark.read.format("sqlite_table").option("path", path).option("dbtable", name).load()
    rels = F.collect_list(F.struct(F.col("_t").alias("target_id"), F.col("ocel_qualifier").alias("qualifier"))).cast(RELS).alias("rels")
    to = t("event_object").select(F.col("ocel_event_id").alias("ocel_id"), F.col("ocel_object_id").alias("_t"), "ocel_qualifier").groupBy("ocel_id").agg(rels)
    of = t("object_object").select(F.col("ocel_source_id").alias("ocel_id"), F.col("ocel_target_id").alias("_t"), "ocel_qualifier").groupBy("ocel_id").agg(rels)
    cse = F.lit(cse_id).alias("cse_id")

    def typed(kind: str) -> DataFrame:
        """ocel_id, ocel_time, ocel_changed_field, attrs of all tables of a kind. Attributes without a value are left out."""
        parts = []
        for r in t(f"{kind}_map_type").collect():  # one row for each type
            rows = t(f"{kind}_{r.ocel_type_map}")
            names = [c for c in rows.columns if c not in OWN_COLUMNS]
            attrs = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"`{c}`")))), lambda _, v: v.isNotNull()) if names else F.create_map()
            changed = F.col("ocel_changed_field") if "ocel_changed_field" in rows.columns else F.lit(None).cast("string")
            parts.append(rows.select("ocel_id", F.col("ocel_time").cast("timestamp").alias("time"), changed.alias("changed"), attrs.cast("map<string,string>").alias("attrs")))
        return reduce(DataFrame.unionByName, parts)

    none = F.array().cast(RELS)
    event = t("event").join(typed("event"), "ocel_id").join(to, "ocel_id", "left")
    obj = t("object").join(of, "ocel_id", "left").select(cse, F.col("ocel_id").alias("object_id"), F.col("ocel_type").alias("type"), F.coalesce("rels", none).alias("rels"))
    values = typed("object").select("ocel_id", "time", "changed", F.explode("attrs").alias("name", "value")).where("changed is null or changed = name")
    return Log(event.select(cse, F.col("ocel_id").alias("event_id"), F.col("ocel_type").alias("type"), "time", "attrs", F.coalesce("rels", none).alias("rels")), obj, values.select(cse, F.col("ocel_id").alias("object_id"), "name", "value", "time"))
