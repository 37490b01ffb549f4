from datetime import timedelta

import pytest

from caselens.operators import detectors as D
from caselens.operators import fusion, ingest, rules
from tests.logs import case_log


def ids(df, key="case_id"):
    return sorted(r[key] for r in df.collect())


def test_response_never_late_and_in_time(spark):
    log = case_log(
        spark, {"C1": [("ASSIGN", 0)], "C2": [("ASSIGN", 0), ("ESCALATE", 31)], "C3": [("ASSIGN", 0), ("ESCALATE", 30)], "C4": [("ASSIGN", 0)], "C5": []},
        severity=dict.fromkeys(("C1", "C2", "C3", "C5"), "CRITICAL") | {"C4": "LOW"}, assets=dict.fromkeys(("C1", "C2", "C3", "C4", "C5"), "A"), criticality={"A": "HIGH"},
    )
    got = {r.case_id: r.detail for r in rules.evaluate(log, rules.ESCALATE_CRITICAL).collect()}
    assert got == {"C1": "never", "C2": "late"}


def test_precedence_counts_each_event_and_ties_comply(spark):
    log = case_log(spark, {"C1": [("INVESTIGATE", 1), ("INVESTIGATE", 2), ("ENRICH", 3), ("INVESTIGATE", 4)], "C2": [("ENRICH", 5), ("INVESTIGATE", 5)], "C3": [("INVESTIGATE", 1)]})
    assert ids(rules.evaluate(log, rules.ENRICH_FIRST)) == ["C1", "C1", "C3"]


def test_cardinality_and_not_co_existence(spark):
    log = case_log(spark, {"C1": [("REASSIGN", i) for i in range(3)], "C2": [("REASSIGN", 1), ("ESCALATE", 2), ("CLOSE", 3)], "C3": [("ESCALATE", 1)]})
    assert ids(rules.evaluate(log, rules.FEW_REASSIGNMENTS)) == ["C1"]
    rule = rules.Rule("X", "NOT_CO_EXISTENCE", "Escalation", "OPTIONAL", {"a": "ESCALATE", "b": "CLOSE"})
    assert ids(rules.evaluate(log, rule)) == ["C2"]


def test_no_context_gives_no_rows(spark):
    assert rules.evaluate(case_log(spark, {"C1": [("ASSIGN", 0)]}), rules.ESCALATE_CRITICAL).isEmpty()


def test_loops(spark):
    back = lambda *who, why=None: [("REASSIGN", i, w, *([why] if why else [])) for i, w in enumerate(who)]
    log = case_log(spark, {"loop": back("a", "b", "a", "b"), "shift": back("a", "b", "a", why="SHIFT_CHANGE"), "chain": back("a", "b", "c"), "hop": back("a", "b")})
    got = {r.case_id: (r.is_loop, r.justified, r.flagged) for r in D.reassignment_loops(log).collect()}
    assert got == {"loop": (True, False, True), "shift": (True, True, False), "chain": (False, False, False)}


def test_fast_close_and_recurrence(spark):
    log = case_log(spark, {"C1": [("ASSIGN", 0), ("CLOSE", 10)], "C2": [("ASSIGN", 0), ("CLOSE", 120)], "C3": [("ASSIGN", 0)]})
    assert {r.case_id: r.is_fast for r in D.fast_close(log).collect()} == {"C1": True, "C2": False}
    cases = {c: [("ASSIGN", 0)] for c in ("1", "2", "3", "4", "5", "6", "7")} | {"6": [("INVESTIGATE", 1)]}
    log = case_log(spark, cases, severity=dict.fromkeys(cases, "LOW"), assets={"1": "A", "2": "A", "3": "A", "4": "B", "5": "B", "6": "B", "7": "C"}, criticality={"D": "HIGH"})
    assert {r.asset_id: r.flagged for r in D.asset_recurrence(log).collect()} == {"A": True, "B": False, "C": False}
    assert {r.asset_id: r.n_alerts for r in D.asset_alerts(log).collect()} == {"A": 3, "B": 3, "C": 1, "D": 0}


def test_uniformity(spark):
    def steps(times, who):
        return {f"{who}{i}": [("INVESTIGATE", 0, who), ("CLOSE", m)] for i, m in enumerate(times)}

    log = case_log(spark, steps([60, 61] * 3, "same") | steps([20, 45, 90, 200, 15, 300], "varied") | steps([60, 60, 60], "few"))
    got = {r.analyst_id: (r.cov is None, r.flagged) for r in D.investigation_uniformity(log).collect()}
    assert got == {"same": (False, True), "varied": (False, False), "few": (True, False)}


def test_fusion_suppresses_and_scores(spark):
    log = case_log(spark, {"C1": [("REASSIGN", 0, "a"), ("REASSIGN", 1, "b"), ("REASSIGN", 2, "a")], "C2": [("INVESTIGATE", 1, "a")]})
    low = spark.createDataFrame([("E", "C2")], "cse_id string, case_id string")
    got = fusion.fuse(log, low)
    rows = {r.finding_type: r for r in got.concerns.collect()}
    assert set(rows) >= {"REASSIGNMENT_LOOP", "MISSING_ENRICHMENT"} and "EXCESSIVE_REASSIGNMENT_CARDINALITY" not in rows
    assert abs(rows["REASSIGNMENT_LOOP"].concern_score - 0.35) < 1e-9 and abs(rows["REASSIGNMENT_LOOP"].minutes - (20 + 6) * 1.2) < 1e-9
    assert rows["MISSING_ENRICHMENT"].evidence_quality == "MEDIUM" and abs(rows["MISSING_ENRICHMENT"].minutes - (20 + 2 + 20) * 1.2) < 1e-9
    assert [r.reason for r in got.suppressed.collect()] == ["flagged as a loop"]
    assert sum(r.n for r in ingest.validate_log(log).collect()) == 0


def violations(df, version=True):
    return sorted(((r.rule_id, *([r.version] if version else []), r.case_id, r.capability, r.authority, r.detail, r.measure) for r in df.collect()), key=str)


def test_all_rules_in_one_pass_equal_each_alone(spark):
    kinds = ("ASSIGN", "ESCALATE", "ENRICH", "INVESTIGATE", "REASSIGN", "CLOSE")
    log = case_log(
        spark, {f"C{i}": [(kinds[(i * 7 + j * j) % 6], (j * 13 + i) % 50) for j in range(i % 9)] for i in range(60)},
        severity={f"C{i}": ("CRITICAL", "LOW")[i % 2] for i in range(60) if i % 5}, assets={f"C{i}": "AB"[i % 2] for i in range(60) if i % 7}, criticality={"A": "HIGH", "B": "LOW"},
    )
    book = [rules.ESCALATE_CRITICAL, rules.ENRICH_FIRST, rules.FEW_REASSIGNMENTS]
    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            book.append(rules.Rule(f"P-{a}-{b}", "PRECEDENCE", "Investigation", "EXPECTED", {"before": a, "after": b}))
            book.append(rules.Rule(f"N-{a}-{b}", "NOT_CO_EXISTENCE", "Escalation", "OPTIONAL", {"a": a, "b": b}))
        for op, n in (("<=", 1), (">", 1), ("==", 2)):
            book.append(rules.Rule(f"K-{a}-{op}", "CARDINALITY", "Escalation", "OPTIONAL", {"event": a, "op": op, "bound": n}))
        book.append(rules.Rule(f"R-{a}", "RESPONSE", "Escalation", "MANDATORY", {"event": a}, {"alert_severity": ["LOW", "CRITICAL"]} if i % 2 else {}, (">=", 0.5, "hours") if i % 3 else None))
    assert len(book) >= 50
    got = rules.evaluate_all(log, book)
    want = [v for r in book for v in violations(rules.evaluate(log, r), version=False)]
    assert sorted(str(v[:1] + v[2:]) for v in violations(got)) == sorted(map(str, want))
    assert len(want) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [cse_id") <= 8  # however many rules there are


def test_versions_hold_by_the_day_a_case_begins(spark):
    at = lambda day, *kinds: [(k, day * 1440 + i) for i, k in enumerate(kinds)]
    log = case_log(spark, {"old": at(0, "REASSIGN", "REASSIGN"), "edge": at(10, "REASSIGN", "REASSIGN"), "new": at(11, "REASSIGN"), "late": at(20, "REASSIGN", "REASSIGN"), "none": []})
    first = log.event.selectExpr("min(to_date(time)) AS d").first().d
    day = lambda n: str(first + timedelta(days=n))
    rule = lambda version, bound, start, end: rules.Rule("K", "CARDINALITY", "Escalation", "OPTIONAL", {"event": "REASSIGN", "op": "<=", "bound": bound}, version=version, effective_from=start, effective_to=end)
    book = [rule("1", 1, None, day(10)), rule("2", 0, day(10), day(20)), rule("1b", 5, day(11), day(12))]
    assert [(v[1], v[2]) for v in violations(rules.evaluate_all(log, book))] == [("1", "old"), ("2", "edge")]
    assert [s for s, _ in rules.periods(book)] == [None, *(first + timedelta(days=n) for n in (10, 11, 12, 20))]
    assert rules.evaluate_all(log, [rule("9", 0, day(500), None)]).isEmpty()
    with pytest.raises(ValueError, match="twice"):
        rules.periods([book[0], book[0]])
