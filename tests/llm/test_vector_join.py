import numpy as np
import pytest

from caselens.llm import vector_join
from caselens.llm.vector_join import near_duplicates


def brute(rows, cosine=0.9):
    """All pairs; ids by union."""
    width = max([len(v) for _, v in rows if v] or [1])
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    u = [np.array([*v, *[0.0] * (width - len(v))], float) if fine(v) else None for _, v in rows]
    u = [None if v is None else (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for v in u]
    n, of = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and u[i] @ u[j] >= cosine:
                n[i] += 1
                n[j] += 1
                of[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return [(k, n[i], least.get(top(i)), (k == least.get(top(i))) if k is not None else least.get(top(i)) is None) for i, (k, _) in enumerate(rows)]


def order(rows):
    return sorted(tuple(r) for r in rows if r[0] is not None), sorted(str(tuple(r)) for r in rows if r[0] is None)


def run(spark, rows, kind="float", **more):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, n string").repartition(3)
    return near_duplicates(frame, **more).collect()


@pytest.mark.parametrize(("size", "run_size"), [(None, 256), (20, 8), (7, 4), (1000, 16)])
def test_against_all_pairs(spark, monkeypatch, size, run_size):
    monkeypatch.setattr(vector_join, "RUN", run_size)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [centres[rng.integers(6)] + rng.normal(size=12) * rng.choice([0.01, 0.2, 0.5]) for _ in range(150)] + [*rng.normal(size=(60, 12))]
    rows += [rows[0]] * 60 + [rows[0] * 2.5, rows[0] * 2.5] + [rows[0] + rng.normal(size=12) * 1e-3 for _ in range(40)]  # copies and a dense group
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [None, [], [0.0] * 12, [float("nan")] * 12, [1.0] * 11 + [float("inf")], [1.0] * 11 + [None], [1.0, 2.0], [1.0, 2.0, 0.1], [-0.0] * 12]
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(None, rows[0][1]), (None, rows[100][1]), (None, None), (None, [9.0] + [0.0] * 11), (5, rows[70][1]), (5, rows[5][1])]
    rng.shuffle(rows)
    got, want = run(spark, rows, block_size=size), brute(rows)
    assert order(got) == order(want)
    assert max(w[1] for w in want) > 100


def test_a_chain_is_one_component(spark):
    angle = np.arange(80) * 0.4  # neighbours alone are within the cosine
    rows = [(100 - i, [float(np.cos(a)) * 3, float(np.sin(a)) * 3, float(i) * 0]) for i, a in enumerate(angle[:8])]
    got = run(spark, rows, "double", block_size=2)
    assert order(got) == order(brute(rows)) and {r.component_id for r in got} == {93}


def test_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [-1.0, 1.0])]
    assert order(run(spark, rows, "double")) == order(brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, None), (1, None), (2, [])], [(4, [1.0]), (4, [2.0]), (3, [-1.0])]])
def test_few_rows(spark, rows):
    assert order(run(spark, rows)) == order(brute(rows))


def test_distant_blocks_are_skipped(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(8) * 5
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.05).tolist()) for i in range(800)]
    frame = spark.createDataFrame(rows, "node long, vector array<double>").selectExpr("node", "1L AS n", "vector")
    cut = vector_join.blocks(frame, 8, 0.9, 25)
    pairs = vector_join.block_pairs(cut.select("block", "lo", "hi"), 0.9).collect()
    assert cut.count() == 32 and len(pairs) < 32 * 33 // 2 // 4
    assert order(run(spark, rows, "double", block_size=25)) == order(brute(rows))

