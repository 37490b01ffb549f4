"""What the plans over large logs move: each table read once, sums of a fixed size, no meeting by a hot key."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from caselens.operators import causal, detectors, fusion, ingest, paging, rules
from caselens.operators import log as views_of_log
from caselens.operators.log import Log, case_profile, reassignments
from caselens.plans import projection
from caselens.sources.scratch import held
from tests.logs import EPOCH, case_log

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_validation_counts_every_fault_in_one_aggregate(spark):
    at = datetime(2024, 1, 1)
    events = [
        ("E", "e1", "CLOSE", at, {}, [("c1", "close_for_case"), ("gone", "x"), ("gone", "")]), ("E", "e1", "CLOSE", at, {}, [(None, "x")]),
        ("E", "", "CLOSE", at, {}, []), ("E", "e2", None, at, {}, None), ("E", "e3", "CLOSE", None, {}, [("c1", None)]),
        ("F", "e1", "CLOSE", at, {}, [("c1", "close_for_case")]),
    ]
    objects = [("E", "c1", "Case", [("gone", "y"), ("c1", "")]), ("E", "c1", "Case", []), ("E", None, "Case", []), ("E", "c2", None, None)]
    attrs = [("E", "c1", "a", "1", EPOCH), ("E", "c1", "a", "2", EPOCH), ("E", "nobody", "a", "1", EPOCH), ("E", None, "a", "1", EPOCH), ("E", "c1", "a", "1", at)]
    found = ingest.validate_log(Log.of(spark, events, objects, attrs))
    assert [r.n for r in found.collect()] == [3, 2, 1, 1, 1, 2, 1, 4, 1, 2]
    assert plan(found).count("Join") == 0 and plan(found).count("LogicalRDD") == 3


def test_profile_is_of_a_fixed_size(spark):
    log = case_log(spark, {"C1": [("REASSIGN", 0, "a"), ("REASSIGN", 1, "b", "SHIFT_CHANGE"), ("CLOSE", 5)], "C2": [("CLOSE", 1)]})
    assert "collect" not in plan(case_profile(log)) and "REASSIGN" in plan(reassignments(log))
    row = reassignments(log).first()
    assert reassignments(log).count() == 1 and row.n_REASSIGN == 2 and [(r["to"], r.shift) for r in row.reassigned] == [("a", False), ("b", True)]


def test_case_findings_of_a_held_log_join_only_what_is_due(spark):
    with projection.log(spark, SMALL, keep=True).held() as log:  # needs the driver tables
        assert all(os.path.exists(at) for at in log.folders) and len(log.folders) == 3
        assert plan(fusion.case_findings(log)).count("Join") <= 4  # parts, due, rates, odd ones
        views = {name: held(view) for name, view in log.views.items()}
    assert not any(os.path.exists(at) for at in log.folders)
    whole = projection.log(spark, SMALL)
    for name in ("case_context", "asset_chain", "routed_cases", "judged_cases"):
        want = getattr(fusion if hasattr(fusion, name) else views_of_log, name)(whole).select(views[name].columns)
        assert sorted(map(str, want.collect())) == sorted(map(str, views[name].collect())), name


def test_outcomes_join_tiers_by_their_size(spark):
    log = case_log(spark, {"C1": [("CLOSE", 1)], "C2": [("CLOSE", 1)]}, owner={"C1": "ann", "C2": "bob"}, tiers={"ann": "SENIOR", "bob": "JUNIOR"})
    out = causal.outcome_frame(log, log.of_type("Case").selectExpr("cse_id", "object_id as case_id").where("case_id = 'C2'"))
    assert sorted((r.case_id, r.t, r.y) for r in out.collect()) == [("C1", 1, 1), ("C2", 0, 0)]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_a_held_log_asks_without_moving_lines_again(spark):
    with projection.log(spark, SMALL, keep=True).held() as log:  # needs the driver tables
        shapes = {"uniform": detectors.investigation_uniformity(log), "assets": detectors.asset_alerts(log), "recurring": detectors.asset_recurrence(log), "due": rules.scope(log, rules.ESCALATE_CRITICAL, {"n": F.col("n_CLOSE")})}
        assert [plan(df).count("Join") for df in shapes.values()] == [0, 0, 0, 1] and "Aggregate" not in plan(shapes["recurring"])
        many = plan(detectors.reassignment_loops(log))
        assert "n_REASSIGN" in many[many.index("Aggregate") :].split("Filter", 1)[1]  # cases with few are left out before they move
        got = {name: held(df) for name, df in (shapes | {"loops": detectors.reassignment_loops(log), "work": detectors.analyst_workload(log)}).items()}
    whole = projection.log(spark, SMALL)
    want = {"uniform": detectors.investigation_uniformity(whole), "assets": detectors.asset_alerts(whole), "recurring": detectors.asset_recurrence(whole), "due": rules.scope(whole, rules.ESCALATE_CRITICAL, {"n": F.col("n_CLOSE")}), "loops": detectors.reassignment_loops(whole), "work": detectors.analyst_workload(whole)}
    rows = lambda df, like: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in df.select(like.columns).collect())
    for name, df in want.items():
        assert rows(df, df) == rows(got[name], df), name


def test_copies_of_an_order_stay_apart(spark, tmp_path):
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows = rows.where("o_orderkey < 40").union(rows.where("o_orderkey < 20")) if name == "orders" else rows.where("l_orderkey < 40") if name == "lineitem" else rows
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    for strained in (False, True):
        whole = projection.log(spark, str(tmp_path), strained=strained)
        with projection.log(spark, str(tmp_path), keep=True, strained=strained).held() as log:
            for view in (views_of_log.case_events, views_of_log.case_alerts, views_of_log.alert_assets, views_of_log.case_profile, reassignments):
                want = view(whole).drop("attrs")
                rows = lambda df: sorted(map(str, df.select(want.columns).distinct().collect()))  # noqa: B023, E731
                assert rows(want) == rows(view(log)), view.__name__
            assert log.event.count() == whole.event.count() and log.of_type("Case").count() == whole.of_type("Case").count()


def test_outcomes_are_counted_as_the_frame_has_them(spark):
    cases = {f"C{i}": [("CLOSE", 1)] for i in range(12)}
    log = case_log(spark, cases, owner={c: ("ann", "bob")[i % 2] for i, c in enumerate(cases)}, tiers={"ann": "SENIOR", "bob": "JUNIOR"})
    some = log.of_type("Case").selectExpr("cse_id", "object_id as case_id", "'REASSIGNMENT_LOOP' as finding_type").where("case_id in ('C0', 'C2', 'C4', 'C3')")
    frame = causal.outcome_frame(log, some)
    counts = causal.outcome_counts(log, some.union(some), ["REASSIGNMENT_LOOP", "MISSING_ENRICHMENT"])
    assert sorted(map(tuple, frame.groupBy("t", "y").count().collect())) == sorted((r.t, r.y, r.n) for r in counts.where("finding_type = 'REASSIGNMENT_LOOP'").collect())
    want, got = causal.opportunities(frame, []).first(), causal.opportunities(counts.where("finding_type = 'REASSIGNMENT_LOOP'"), [], weight="n").first()
    assert all(abs(want[c] - got[c]) < 1e-9 for c in ("n", "effect", "se", "t_stat", "ci_low", "robustness")) and want.decision == got.decision
    assert not causal.opportunities(counts.where("finding_type = 'MISSING_ENRICHMENT'"), [], weight="n").first().sufficient


def test_pages_of_few_rows_share_files(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id")
    pages = paging.Pages.write(rows, str(tmp_path / "p"), [F.col("id")], per_part=20)
    assert pages.index.count() == 250 and pages.rows.select("_part").distinct().count() == 1
    assert [r.id for r in pages.page(7, 33).collect()] == list(range(231, 264)) == [r.id for r in pages.after((230,), 33).collect()]
    assert [r.id for r in pages.after((-5,), 2).collect()] == [0, 1] and pages.after((4999,), 2).isEmpty()


def test_facts_are_held_narrow_and_copies_are_one_case(spark, tmp_path):
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")  # needs the driver tables
        rows = rows.where("o_orderkey < 40").union(rows.where("o_orderkey < 20")) if name == "orders" else rows.where("l_orderkey < 40") if name == "lineitem" else rows
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    whole = projection.log(spark, str(tmp_path))
    with projection.log(spark, str(tmp_path), keep=True).held() as log:
        kinds = dict(spark.read.parquet(log.folders[0]).dtypes)
        assert "timestamp" not in kinds.values() and not {"opened", "_n", "n_ASSIGN"} & set(kinds)
        for f in (detectors.asset_recurrence, detectors.analyst_workload):
            want = f(whole)
            rows = lambda df: sorted(map(str, df.select(want.columns).collect()))  # noqa: B023, E731
            assert rows(want) == rows(f(log)), f.__name__


def test_cases_are_summed_up_without_ranking_lines(spark):
    for strained in (False, True):
        facts = plan(projection._facts(spark, SMALL, strained))  # needs the driver tables
        assert facts.count("l_extendedprice") == 1 and "collect" not in facts  # in the table alone
        with projection.log(spark, SMALL, keep=True, strained=strained).held() as log, projection.log(spark, SMALL, keep=True, strained=strained, numbered=False).held() as plainer:
            assert plainer.event.count() == log.event.count()
            both = [held(fusion.fuse(x, uniform_threshold=0.65).concerns.drop("detail")) for x in (log, plainer)]
        assert both[0].count() and both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()
