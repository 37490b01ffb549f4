import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import causal, peers, portfolio, review, selection


def observe(spark, *rows):
    return spark.createDataFrame([("k", *r) for r in rows], "k string, group_id string, exposure long, observed long")


def test_pooled_rate_and_degenerate_inputs(spark):
    R = random.Random(1)
    rows = [(f"g{i}", 200, sum(R.random() < 0.8 for _ in range(200))) for i in range(8)]
    got = peers.negative_space(observe(spark, *rows), "k").collect()
    assert all(abs(r.expected - 160) < 15 and r.ci_low < r.expected < r.ci_high for r in got)
    shrunk = peers.negative_space(observe(spark, *((f"g{i}", 500, 450 + i) for i in range(7)), ("small", 3, 2)), "k")
    assert 0.67 < shrunk.where("group_id = 'small'").first().expected / 3 <= 0.95
    one = peers.negative_space(observe(spark, ("a", 10, 5)), "k").first()
    none = peers.negative_space(observe(spark, ("a", 10, 0), ("b", 10, 0)), "k").first()
    assert one.abstain == none.abstain == "INSUFFICIENT_EVIDENCE" and one.z is None and one.expected is None
    idle = {r.group_id: r.abstain for r in peers.negative_space(observe(spark, ("a", 10, 5), ("b", 10, 5), ("c", 0, 0)), "k").collect()}
    assert idle == {"a": None, "b": None, "c": "INSUFFICIENT_EXPOSURE"}


def test_workload_z(spark):
    ten = [(f"p{i}", 20, 10) for i in range(10)]
    for value, low, high in ((2, -math.inf, -2), (18, 2, math.inf), (10, -2, 2)):
        z = peers.negative_space(observe(spark, *ten, ("x", 20, value)), "k").where("group_id = 'x'").first().z
        assert low <= z <= high


def test_trends(spark):
    cycles = {(1000, 700, 1000, 950): "VERIFIED_IMPROVEMENT", (1000, 950, 1000, 600): "REGRESSED", (5, 4, 5, 5): "INSUFFICIENT_EVIDENCE", (100, 90, 100, 91): "INSUFFICIENT_EVIDENCE"}
    rows = spark.createDataFrame([(*k, 1000, 1000, 900, 500) for k in cycles], "prior_exposure long, prior_observed long, exposure long, observed long, p0 long, p1 long, q0 long, q1 long")
    got = {r[:4]: r.trend for r in portfolio.classify_trend(rows).collect()}
    assert got == cycles
    assert portfolio.classify_trend(rows, proxy=("p0", "p1", "q0", "q1")).where("prior_observed = 700").first().trend == "POTENTIAL_DISPLACEMENT"


def test_peer_entities(spark):
    cases = spark.createDataFrame([(f"E{i}", 100) for i in range(4)], "cse_id string, n_cases long")
    flagged = spark.createDataFrame([(f"E{i}", "REASSIGNMENT_LOOP", n) for i, n in enumerate((2, 2, 2, 40))], "cse_id string, finding_type string, n_flagged long")
    risk = portfolio.entity_risk(portfolio.peer_comparison(cases, flagged)).collect()
    assert risk[0].cse_id == "E3" and risk[0].risk > 0 and all(r.risk == 0 for r in risk[1:])
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.7,), (1.5,)], "r double").select(portfolio.tier(F.col("r"))).collect()] == ["LOW", "MEDIUM", "CRITICAL"]


def test_causal(spark):
    strong = causal.opportunities(causal.scenario(spark, 4000, 7, 4.0), []).first()
    weak = causal.opportunities(causal.scenario(spark, 4000, 7, 0.5, 4.0, -4.0), []).first()
    assert strong.decision == "ACT" and strong.effect > 0 and strong.robustness >= causal.MIN_ROBUSTNESS
    # The confounder is withheld and turns the sign: no decision to act, and little robustness.
    assert weak.effect < 0 and weak.robustness < causal.MIN_ROBUSTNESS and weak.decision == "INVESTIGATE_MORE"
    assert causal.regression(causal.scenario(spark, 4000, 7, 0.5, 4.0, -4.0), ["c"])["effect"] > 0
    rows = causal.scenario(spark, 500, 3, 1.0)
    one, many = causal.opportunities(rows, []).first(), causal.regression(rows, [])
    assert abs(one.effect - many["effect"]) < 1e-9 and abs(one.ci_low - many["ci_low"]) < 1e-6
    assert not causal.opportunities(spark.createDataFrame([(1, 1)] * 5, "t int, y int"), []).first().sufficient


def test_adjusted_effects_of_many_keys(spark):
    """Against least squares on the whole design matrix, key by key."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for key, n in (("a", 400), ("b", 60), ("few", 5), ("same", 30), ("tied", 40), ("exact", 20)):
        c, d = rng.normal(1e6, 3, n), rng.integers(0, 2, n).astype(float)
        t = (rng.random(n) < 1 / (1 + np.exp(-(c - 1e6) / 2))).astype(float) if key != "same" else np.ones(n)
        d = 2 * c - 7 if key == "tied" else d
        y = 0.5 * t + 0.3 * (c - 1e6) - d + (0 if key == "exact" else rng.normal(0, 1, n))
        rows += [(key, *map(float, r), "x") for r in zip(t, y, c, d, strict=True)]
        if key in ("a", "b", "exact"):
            x = np.column_stack([t, c - 1e6, d, np.ones(n)])
            beta = np.linalg.lstsq(x, y, rcond=None)[0]
            rest = y - x @ beta
            want[key] = beta[0], math.sqrt(rest @ rest / (n - 4) * np.linalg.inv(x.T @ x)[0, 0]), n - 4
    rows += [("a", None, 1.0, 1.0, 1.0, "x"), ("a", 1.0, 1.0, None, 1.0, "x")]
    got = {r.k: r for r in causal.adjusted(spark.createDataFrame(rows, "k string, t double, y double, c double, d double, n string"), ["k"], ["d", "c", "c"]).collect()}
    assert {k for k, r in got.items() if r.sufficient} == set(want)
    for k, (effect, se, df) in want.items():
        assert got[k].effect == pytest.approx(effect, abs=1e-6) and got[k].se == pytest.approx(se, abs=1e-5) and got[k].df == df
    one = causal.adjusted(causal.scenario(spark, 3000, 7, 0.5, 4.0, -4.0), [], ["c"]).first()
    many = causal.regression(causal.scenario(spark, 3000, 7, 0.5, 4.0, -4.0), ["c"])
    assert one.effect == pytest.approx(many["effect"]) and one.se == pytest.approx(many["se"]) and one.effect > 0
    assert causal.opportunities(causal.scenario(spark, 3000, 7, 2.0), [], ["c"]).first().decision in ("ACT", "INVESTIGATE_MORE")


def concerns(spark, n=14):
    rows = [("E", f"T{i % 3}", f"p{i}", "Cap", "EXPECTED", f"f{i:02}", 1.0 + i % 2, 4.0 + i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "cse_id string, finding_type string, primary_id string, capability string, authority string, finding_id string, concern_score double, minutes double")


def test_selection_is_near_the_optimum_and_within_budget(spark):
    rows = concerns(spark)
    budget = spark.createDataFrame([("E", 25.0)], "cse_id string, budget double")
    got = selection.submodular(rows, budget, ["cse_id"]).collect()
    assert sum(r.minutes for r in got) <= 25
    items = [(r.finding_type, r.minutes) for r in rows.collect()]
    best = 0.0
    for m in range(1 << len(items)):
        chosen = [x for i, x in enumerate(items) if m >> i & 1]
        if sum(c for _, c in chosen) <= 25:
            counts = {}
            for b, _ in chosen:
                counts[b] = counts.get(b, 0) + 1
            best = max(best, sum(map(math.log1p, counts.values())))
    counts = {}
    for r in got:
        counts[r.finding_type] = counts.get(r.finding_type, 0) + 1
    assert sum(map(math.log1p, counts.values())) >= best * (1 - 1 / math.e - 0.1) - 0.15
    for f in (selection.top_score, selection.stratified, selection.random_pick):
        assert 0 < sum(r.minutes for r in f(rows, budget, ["cse_id"]).collect()) <= 25


def test_zero_cost_items_end(spark):
    rows = concerns(spark, 4).withColumn("minutes", F.when(F.col("primary_id") == "p0", 0.0).otherwise(F.col("minutes")))
    budget = spark.createDataFrame([("E", 5.0)], "cse_id string, budget double")
    assert "p0" in {r.primary_id for r in selection.submodular(rows, budget, ["cse_id"]).collect()}


def test_verdicts_and_feedback(spark):
    rows = [("f", "TRUE_SUPERVISORY_FINDING", None, None, None, None), ("f", "DUPLICATE_OF_EXISTING_FINDING", None, None, None, None), ("f", "WHATEVER", None, None, None, None), ("f", "TRUE_SUPERVISORY_FINDING", "c", "a", "GOVERNANCE_GAP", None), ("f", "INCONCLUSIVE", None, None, None, None)]
    df = spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], review.VERDICT)
    assert [r.problem is None for r in review.validate(df).orderBy("seq").collect()] == [False, False, False, True, True]
    out = spark.createDataFrame([("b", "risk_selected", "TRUE_SUPERVISORY_FINDING")] * 20 + [("b", "random_calibration", "FALSE_POSITIVE")] * 10 + [("n", "risk_selected", "INCONCLUSIVE")] * 4, "bucket string, sample string, verdict string")
    post = review.feedback(out)
    assert {(r.bucket, r["sample"]): (r.alpha, r.beta) for r in post.collect()} == {("b", "risk_selected"): (21, 1), ("b", "random_calibration"): (1, 11), ("n", "risk_selected"): (1, 1)}
    assert {r.bucket: r.source for r in review.debiased(post).collect()} == {"b": "random_calibration", "n": "risk_selected"}


def test_stratified_walks_as_told(spark):
    """Against the walk written down: rounds over types, what doesn't fit is passed over, an empty round ends it."""
    R = np.random.default_rng(3)
    rows = [(e, f"T{R.integers(4)}", f"f{i:04}", float(R.choice([0.0, 7.0, 20.0, 35.0], p=[0.02, 0.3, 0.4, 0.28]))) for e in "AB" for i in range(400)]
    df = spark.createDataFrame(rows, "cse_id string, finding_type string, finding_id string, minutes double")
    for spent in (0.0, 30.0, 900.0, 4000.0, 1e6):
        want = set()
        for e in "AB":
            by = {}
            for x in sorted(r for r in rows if r[0] == e):
                by.setdefault(x[1], []).append(x)
            spare, k = spent, 0
            while True:
                now = [by[t][k] for t in sorted(by) if k < len(by[t])]
                took = 0
                for x in now:
                    if x[3] <= spare:
                        spare, took = spare - x[3], took + 1
                        want.add((e, x[2]))
                k += 1
                if not took:
                    break
        got = {(r.cse_id, r.finding_id) for r in selection.stratified(df, df.select("cse_id").distinct().withColumn("budget", F.lit(spent)), ["cse_id"]).collect()}
        assert got == want, spent


def test_random_pick_samples_concerns(spark):
    rows = spark.createDataFrame([("A", f"{t}{i:03}", "x", t, 10.0 + 20 * (t == "q"), 1.0) for t in "pq" for i in range(200)], "cse_id string, finding_id string, capability string, finding_type string, minutes double, concern_score double")
    got = selection.random_pick(rows, selection.budgets(rows, ["cse_id"], 0.3), ["cse_id"]).collect()
    per = {t: sorted(r.finding_id for r in got if r.finding_type == t) for t in "pq"}
    assert all(35 <= len(x) <= 85 for x in per.values()) and 2370 < sum(r.minutes for r in got) <= 2400
    assert all(x != [f"{t}{i:03}" for i in range(len(x))] for t, x in per.items())
    costs, counts = np.array([1.0, 5.0]), np.array([6, 3])
    means = np.mean([selection._shuffled_fill(costs, counts, 9.0, s) for s in range(3000)], axis=0)
    R, want = np.random.default_rng(1), np.zeros(2)
    for _ in range(3000):
        spare = 9.0
        for k in R.permutation(np.repeat([0, 1], counts)):
            if costs[k] <= spare:
                spare -= costs[k]
                want[k] += 1 / 3000
    assert np.abs(means - want).max() < 0.1


def test_explanation_keeps_the_selection(spark):
    kinds = [("p", "a", 30.0, 3), ("p", "b", 45.0, 2), ("q", "c", 50.0, 2), ("r", "d", 90.0, 2)]
    rows = spark.createDataFrame([("A", f"{t}{i}", c, t, m, 1.0) for c, t, m, n in kinds for i in range(n)], "cse_id string, finding_id string, capability string, finding_type string, minutes double, concern_score double")
    budget = spark.createDataFrame([("A", 90.0)], "cse_id string, budget double")
    chosen = rows.where("finding_id in ('a0', 'a1', 'a2')")  # 90 minutes, and not what a new selection would hold
    got = {r.capability: r for r in selection.explain(rows, chosen, budget, ["cse_id"]).collect()}
    assert {c: (r.n_selected, r.n_with_more) for c, r in got.items()} in ({"p": (3, 3), "q": (0, 1)}, {"p": (3, 4)})
    assert all(abs(r.coverage - math.log1p(3)) < 1e-9 and abs(r.marginal_gain - math.log1p(1)) < 1e-9 for r in got.values())


def test_ranks_by_ranges_of_ids_that_begin_alike(spark):
    from caselens.operators.ranking import ranked_by_range

    rows = [(e, float(i % 3), f"INC{i:07}") for e in "AB" for i in range(700)]
    got = {(r.e, r.i): r.n for r in ranked_by_range(spark.createDataFrame(rows, "e string, s double, i string"), ["e"], [-F.col("s"), F.col("i")], "n", per_range=90).collect()}
    for e in "AB":
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (-r[1], r[2]))
        assert [got[e, r[2]] for r in mine] == list(range(1, 701))
