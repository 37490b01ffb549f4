import json
import sqlite3
import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from caselens.operators import detectors, fusion, ingest, portfolio, review
from caselens.sources import exchange, exports, synthetic
from caselens.sources.exchange import log_json, read_log_json, read_log_sqlite, write_log_sqlite
from caselens.sources.store import Store, evidence_bundle, worse_prior
from tests.logs import case_log

CASES = "case_id,assigned_to,assignment_group,status,opened_at,closed_at,alert_id\nC1,ann,q1,CLOSED,2024-01-01T00:00:00Z,2024-01-02T00:00:00Z,A1\nC2,bob,q1,OPEN,bad,,A9\n"
EVENTS = "case_id,event,actor,ts,handover_reason\nC1,Assigned,ann,2024-01-01T00:00:00Z,\nC1, REASSIGN ,bob,2024-01-01T01:00:00Z,\nC1,transfer,ann,2024-01-01T02:00:00Z,\nC1,reassigned,bob,2024-01-01T03:00:00Z,\nC2,wobble,bob,2024-01-01T00:00:00Z,\n"
ALERTS = "alert_id,severity,category,asset_id,raised_at\nA1,HIGH,x,S1,2024-01-01T00:00:00Z\n"


def rows_of(log):
    """Rows as text; the edges of a row have no order."""
    return {n: sorted(str(r.asDict() | ({"rels": sorted(r.rels)} if "rels" in r else {})) for r in getattr(log, n).collect()) for n in ("event", "object", "object_attr")}


@pytest.fixture
def folder(tmp_path):
    for name, text in (("cases", CASES), ("case_events", EVENTS), ("alerts", ALERTS), ("other", "a\n1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_csv_to_log(spark, folder):
    tables = exports.read_csv(spark, folder)
    assert set(tables) == {"cases", "case_events", "alerts"}
    got = ingest.ingest(tables, "E")
    assert got.gate.status == "OK" and any("wobble" in n for n in got.gate.notes)
    assert [r.case_id for r in got.low_confidence.collect()] == ["C2"]
    names = {r.event_id for r in got.log.event.collect()}
    assert {"REASSIGN::C1::2", "REASSIGN::C1::4", "ASSIGN::C1", "ASSIGN::C1::1", "OPEN_CASE::C2", "ALERT_RAISED::A1"} <= names
    assert [(r.case_id, r.flagged) for r in detectors.reassignment_loops(got.log).collect()] == [("C1", True)]
    kinds = {(r.type, r.object_id) for r in got.log.object.collect()}
    assert {("Asset", "S1"), ("Analyst", "bob"), ("Queue", "q1")} <= kinds
    assert sum(r.n for r in ingest.validate_log(got.log).collect()) == 0


def test_gate_abstains(spark, folder, tmp_path):
    tables = exports.read_csv(spark, folder)
    assert ingest.ingest({"cases": tables["cases"]}, "E").gate.status == "ABSTAIN"
    orphan = spark.createDataFrame([("C9", "closed", "2024-01-01", None, None)], "case_id string, event string, ts string, actor string, handover_reason string")
    assert ingest.ingest(tables | {"case_events": orphan}, "E").gate.status == "ABSTAIN"
    (tmp_path / "cases.json").write_text('{"a": 1}')
    with pytest.raises(ValueError, match="not an array"):
        exports.read_json(spark, paths={"cases": str(tmp_path / "cases.json")})


def test_rest_scan(spark):
    """One table is served, one isn't there, one is broken; the token is sent, and no other scheme is asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append((self.path, self.headers["Authorization"]))
            body = {"/x/cases": '[{"case_id": 1, "state": "open"}, {"case_id": 2, "owner": null}]', "/x/alerts": "{", "/y/queues": "{}"}.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = exports.read_rest(spark, f"{at}/x", "secret")
    assert {t: sorted(map(tuple, df.collect()), key=str) for t, df in got.items()} == {"cases": [("1", None, "open"), ("2", None, None)]} and got["cases"].columns == ["case_id", "owner", "state"]
    assert len(asked) == len(exports.TABLES) and {a for _, a in asked} == {"Bearer secret"}
    with pytest.raises(ValueError, match="not an array"):
        exports.read_rest(spark, f"{at}/y")
    with pytest.raises(ValueError, match="http"):
        exports.read_rest(spark, "file:///tmp")
    server.shutdown()


def test_json_and_sqlite_scans(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"incident_number": 1, "owner": "ann", "queue": "q", "state": "open", "created": "2024-01-01", "resolved_at": None}]))
    got = exports.read_json(spark, str(tmp_path))["cases"]
    assert dict(got.dtypes)["incident_number"] == "string"
    assert ingest.suggest("cases", got.columns)["case_id"] == "incident_number"
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE cases(case_id TEXT, handler TEXT, n INTEGER); INSERT INTO cases VALUES ('1', 'ann', 3); CREATE TABLE case_events(case_id, event, ts); CREATE TABLE zzz(a)")
    tables = exports.read_sqlite(spark, path)
    assert set(tables) == {"cases", "case_events"} and tuple(tables["cases"].first()) == ("1", "ann", "3")


def test_round_trips_and_history(spark, tmp_path):
    log = case_log(spark, {"C1": [("REASSIGN", 0, "a"), ("REASSIGN", 1, "b"), ("REASSIGN", 2, "a", "LUNCH")]}, severity={"C1": "HIGH"}, assets={"C1": "S"}, owner={"C1": "a"})
    write_log_sqlite(log, str(tmp_path / "l.db"))
    assert rows_of(read_log_sqlite(spark, str(tmp_path / "l.db"), "E")) == rows_of(log)
    assert exchange.sqlite_problems(str(tmp_path / "l.db")) == []
    (tmp_path / "l.json").write_text(log_json(log).first().document)
    assert rows_of(read_log_json(spark, str(tmp_path / "l.json"), "E")) == rows_of(log)
    store = Store(spark, str(tmp_path / "store"))
    found = fusion.fuse(log).concerns
    store.submit(log, found, "b1", "2024-03-05 00:00:00", spark.createDataFrame([("E", "C1")], "cse_id string, case_id string"))
    assert rows_of(store.read_log("E", "b1")) == rows_of(log)
    seed = worse_prior(store.manifest()).first()
    assert seed.per_type["REASSIGNMENT_LOOP"].flagged_count == 1 and str(seed.submitted_at).startswith("2024-02-29")
    loop = found.where("finding_type = 'REASSIGNMENT_LOOP'").first().finding_id
    store.record_verdicts(spark.createDataFrame([(loop, "INCONCLUSIVE", None, None, None, None, None, 1)], review.VERDICT))
    with pytest.raises(ValueError, match="unknown verdict"):
        store.record_verdicts(spark.createDataFrame([(loop, "NO", None, None, None, None, None, 1)], review.VERDICT))
    back = store.load_batch("E", "b1").where("finding_type = 'REASSIGNMENT_LOOP'").first()
    assert back.verdict == "INCONCLUSIVE" and back.evidence_quality == "MEDIUM" and back.finding_id == loop
    worse = seed.asDict() | {"per_type": {k: v.asDict() for k, v in seed.per_type.items()}}
    history = store.manifest().unionByName(spark.createDataFrame([worse], store.manifest().schema))
    told = {r.finding_type: r for r in portfolio.briefing(history).collect()}["REASSIGNMENT_LOOP"]
    assert (told.batches, told.prior_flagged_count, told.flagged_count, told.trend) == (2, 1, 1, "INSUFFICIENT_EVIDENCE")
    assert portfolio.briefing(store.manifest()).first().trend is None and store.history("E").first().batch_id == "b1"
    refs = fusion.evidence(log, found)
    one = fusion.packages(found, refs).where("finding_type = 'REASSIGNMENT_LOOP'").first()
    assert one.supporting_cases == one.affected_objects == ["C1"] and one.supporting_events == [f"REASSIGN::C1::{k}" for k in range(3)]
    assert one.rule_id is None and one.provenance.source_record_id == "C1" and one.assumptions == ["Reassignment loop (a>b>a)"]
    bundle = json.loads(evidence_bundle(found).first().bundle)
    assert bundle["finding_count"] == len(bundle["findings"]) == found.count()


def test_a_batch_is_written_once(spark, tmp_path):
    """A submission that dies midway leaves nothing that is read; repeated, there is one batch."""
    log = case_log(spark, {"C1": [("REASSIGN", 0, "a"), ("REASSIGN", 1, "b"), ("REASSIGN", 2, "a", "LUNCH")]}, severity={"C1": "HIGH"}, assets={"C1": "S"}, owner={"C1": "a"})
    found, doubt = fusion.fuse(log).concerns, spark.createDataFrame([("E", "C1")], "cse_id string, case_id string")
    store = Store(spark, str(tmp_path / "store"))
    dies = replace(log, object_attr=log.object_attr.withColumn("value", F.raise_error(F.lit("killed"))))
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            store.submit(dies, found, "b1", "2024-03-05 00:00:00", doubt)
    assert store.manifest().isEmpty() and store.read_log("E", "b1").event.isEmpty() and store.low_confidence("E", "b1").isEmpty()
    for _ in range(3):
        store.submit(log, found, "b1", "2024-03-05 00:00:00", doubt)
    assert rows_of(store.read_log("E", "b1")) == rows_of(log) and store.low_confidence("E", "b1").count() == 1
    assert store.manifest().count() == 1 and portfolio.briefing(store.manifest()).first().batches == 1
    assert store.vacuum() >= 2 and store.vacuum() == 0
    assert rows_of(store.read_log("E", "b1")) == rows_of(log) and store.low_confidence("E", "b1").count() == 1
    smaller = case_log(spark, {"C2": [("REASSIGN", 0, "a")]})
    store.submit(smaller, fusion.fuse(smaller).concerns, "b1", "2024-03-06 00:00:00")
    assert rows_of(store.read_log("E", "b1")) == rows_of(smaller) and store.manifest().first().n_cases == 1


def test_verdicts_are_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for k in range(5):
        store.record_verdicts(spark.createDataFrame([(f"f{k % 3}", "INCONCLUSIVE", None, None, None, None, None, k)], review.VERDICT))
    store.record_verdicts(spark.createDataFrame([("f1", "INCONCLUSIVE", None, None, None, None, None, 4)], review.VERDICT))  # again
    before = rows(store.verdicts())
    assert len(before) == 5
    store.compact_verdicts()
    assert rows(store.verdicts()) == before and len(list((tmp_path / "store" / "verdicts").iterdir())) == 1
    store.compact_verdicts()
    assert rows(store.verdicts()) == before and rows(review.latest(store.verdicts()).select("finding_id")) == [("f0",), ("f1",), ("f2",)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exchange_of_a_planted_log(spark, tmp_path):
    """Attribute history, microseconds and every edge come back from both formats; what a file lacks is told."""
    log = synthetic.generate(spark, [replace(synthetic.MATURE_DEV, cases=40)])[0]
    want = rows_of(log)
    write_log_sqlite(log, str(tmp_path / "l.db"))
    assert exchange.sqlite_problems(str(tmp_path / "l.db")) == []
    assert rows_of(read_log_sqlite(spark, str(tmp_path / "l.db"), "MATURE_DEV")) == want
    document = log_json(log).first().document
    (tmp_path / "l.json").write_text(document)
    assert rows_of(read_log_json(spark, str(tmp_path / "l.json"), "MATURE_DEV")) == want
    told = {t["name"]: [a["name"] for a in t["attributes"]] for t in json.loads(document)["objectTypes"]}
    assert told["Alert"] == ["category", "severity"] and told["Case"] == ["status"]
    assert exchange.problems(spark, str(tmp_path / "l.json"), str(tmp_path / "l.db"), "MATURE_DEV") == []
    bad = {"eventTypes": [{"name": "A"}], "events": [{"id": "e", "type": "B", "time": "never", "relationships": [{"objectId": "x"}]}], "objects": [{"type": "T"}]}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    found = {r.check for r in exchange.document_problems(exchange.read_documents(spark, str(tmp_path / "bad.json"), "E")).collect() if r.n}
    assert found == {"objectTypes lacking", "event without id, type or time", "object without id or type", "events: a type that isn't declared", "objects: a type that isn't declared", "events: edge without target or qualifier"}
    with sqlite3.connect(str(tmp_path / "l.db")) as db:
        db.executescript("DROP TABLE event_object; DELETE FROM event_map_type")
    assert "no table event_object" in exchange.sqlite_problems(str(tmp_path / "l.db")) and len(exchange.sqlite_problems(str(tmp_path / "l.db"))) > 1
