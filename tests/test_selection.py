"""Selection against walks written down concern by concern."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselens.operators import selection
from caselens.plans import catalogue
from caselens.sources.scratch import drop_held

DATA = "/root/testdata/sf0.001"


def gain(n):
    return math.log1p(1 / (n + 1))


def walk(items, budget, start=(), epsilon=0.1):
    """items: (bucket, cost) in input order; start: places. Every bar looks at every item."""
    taken, counts = set(start), {}
    taken |= {i for i, (_, c) in enumerate(items) if c <= 0}
    for i in taken:
        counts[items[i][0]] = counts.get(items[i][0], 0) + 1
    spare = budget - sum(items[i][1] for i in taken)
    able = [i for i in range(len(items)) if i not in taken and items[i][1] <= spare]
    bar = top = max((gain(counts.get(items[i][0], 0)) / items[i][1] for i in able), default=0.0)
    while able and bar >= top * epsilon / len(able):
        for i, (b, c) in enumerate(items):
            if i not in taken and c <= spare and gain(counts.get(b, 0)) / c >= bar:
                taken.add(i)
                spare -= c
                counts[b] = counts.get(b, 0) + 1
        bar /= 1 + epsilon
    return taken


def by_class(items, places):
    out = {}
    for i in places:
        out[items[i]] = out.get(items[i], 0) + 1
    return out


def coverage(counts):
    buckets = {}
    for (b, _), n in counts.items():
        buckets[b] = buckets.get(b, 0) + n
    return sum(map(math.log1p, buckets.values()))


def best(items, budget):
    pool = [i for i in sorted(range(len(items)), key=lambda i: (items[i][1], items[i][0])) if 0 < items[i][1] <= budget][:12]
    found, seen = (-1.0, {}), set()
    for size in range(4):
        for start in combinations(pool, size):
            name = tuple(sorted(items[i] for i in start))
            if name in seen or sum(items[i][1] for i in start) > budget:
                continue
            seen.add(name)
            got = by_class(items, walk(items, budget, start))
            if coverage(got) > found[0] + 1e-12:
                found = coverage(got), got
    return found[1]


def classes_of(items):
    return by_class(items, range(len(items)))


@pytest.mark.parametrize("seed", range(12))
def test_closed_form_equals_the_walk(seed):
    rng = np.random.default_rng(seed)
    costs = rng.choice([0.0, 0.25, 1.0, 1.5, 4.0, 4.125, 9.0, 60.0, 333.0], rng.integers(1, 7), replace=False)
    items = sorted(((f"b{rng.integers(5)}", float(rng.choice(costs))) for _ in range(rng.integers(1, 250))), key=lambda x: (x[1], x[0]))
    total = sum(c for _, c in items)
    budgets = [total * f for f in (0.0, 0.03, 0.1, 0.3, 0.55, 0.9, 1.0, 2.0)]
    want = [by_class(items, walk(items, b)) for b in budgets]
    for got, expected in zip(selection.complete_all(classes_of(items), budgets, {}), want, strict=True):
        assert {k: n for k, n in got.items() if n} == expected
    few = budgets[1:4]
    assert [{k: n for k, n in t.items() if n} for t in selection.choose_all(classes_of(items), few)] == [best(items, b) for b in few]


def test_time_does_not_follow_the_number_of_concerns():
    steps = []
    for n in (1_000, 1_000_000, 10**12):
        walked = 0

        class Counting(selection._Descent):
            def next(self):
                nonlocal walked
                walked += 1
                return super().next()

        plain, selection._Descent = selection._Descent, Counting
        try:
            left = {(f"b{i}", 1.0 + i + j / 4): n for i in range(4) for j in range(3)}
            selection.complete(left, 0.3 * sum(c * k for (_, c), k in left.items()), {})
        finally:
            selection._Descent = plain
        steps.append(walked)
    assert steps[2] < 5 * steps[0]


def frame(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(e, f"T{rng.integers(4)}", f"p{rng.integers(n // 2)}", "Cap", f"f{i:05}", float(rng.integers(1, 3)), float(rng.choice([2.0, 3.5, 8.0, 30.0]))) for e in "AB" for i in range(n)]
    return spark.createDataFrame(rows, "cse_id string, finding_type string, primary_id string, capability string, finding_id string, concern_score double, minutes double")


def test_sweep_equals_separate_runs(spark):
    rows = frame(spark)
    truth = rows.where("cse_id = 'A' and hash(primary_id) % 3 = 0").select("cse_id", "primary_id").distinct()
    shares = [0.05, 0.3, 0.6, 1.0]
    got = {(r.cse_id, r.fraction): r for r in selection.sweep(rows, truth, ["cse_id"], shares).collect()}
    true = {r.primary_id for r in truth.collect()}
    for share in shares:
        one = selection.submodular(rows, selection.budgets(rows, ["cse_id"], share), ["cse_id"]).collect()
        for e in "AB":
            mine = [r for r in one if r.cse_id == e]
            assert got[e, share].n_selected == len(mine)
            assert got[e, share].coverage == pytest.approx(sum(math.log1p(sum(r.finding_type == t for r in mine)) for t in {r.finding_type for r in mine}))
            if e == "A":
                assert got[e, share].recall == pytest.approx(len(true & {r.primary_id for r in mine}) / len(true))
            else:
                assert math.isnan(got[e, share].recall)
    assert got["A", 1.0].recall == 1


def test_registered_selection_by_brute_force(spark):
    rows = [r for r in catalogue.QUERIES["concerns"](spark, DATA).collect()]
    name = lambda r: (r.cse_id, r.finding_type, r.primary_id)
    of = {name(r): r for r in rows}
    chosen = [of[name(r)] for r in catalogue.QUERIES["submodular_selection"](spark, DATA).collect()]
    swept = {(r.cse_id, r.fraction): r for r in catalogue.QUERIES["risk_fraction_sweep"](spark, DATA).collect()}
    for e in {r.cse_id for r in rows}:
        items = sorted(((f"{r.capability}|{r.finding_type}", r.minutes) for r in rows if r.cse_id == e), key=lambda x: (x[1], x[0]))
        total = sum(c for _, c in items)
        want = best(items, total * 0.3)
        assert by_class([(f"{r.capability}|{r.finding_type}", r.minutes) for r in chosen if r.cse_id == e], range(sum(r.cse_id == e for r in chosen))) == want
        for share in (0.1, 0.3, 0.7):
            want = best(items, total * share)
            assert swept[e, share].n_selected == sum(want.values()) and swept[e, share].coverage == pytest.approx(coverage(want), abs=1e-5)
    assert all(0 <= r.recall <= 1 for r in swept.values())


@pytest.mark.parametrize("name", ["concerns", "evidence", "strained_risk", "peer_comparison", "portfolio_totals", "intervention_report", "baseline_stratified", "allocation_explanation"])
def test_queries_let_go_of_what_they_hold(spark, name):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    drop_held(spark)
