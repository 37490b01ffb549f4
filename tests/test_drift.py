"""Series cut into pieces against the fold over the whole of them."""

import numpy as np
import pytest

from caselens.operators import drift


def fold(xs, rate, k, h):
    """ewma, up and down of one series, period by period."""
    mean, sd = np.mean(xs), np.std(xs) or 1.0
    y, hi, lo, out = None, 0.0, 0.0, []
    for x in xs:
        y = x if y is None else rate * x + (1 - rate) * y
        z = (x - mean) / sd
        hi, lo = max(0.0, hi + z - k), min(0.0, lo + z + k)
        up, down = hi > h, lo < -h
        hi, lo = 0.0 if up else hi, 0.0 if down else lo
        out.append((y, up, down))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_a_piece_is_a_function_of_what_comes_in(seed):
    rng = np.random.default_rng(seed)
    steps = (rng.normal(rng.choice([-0.5, 0.0, 0.4]), rng.choice([0.2, 1.0, 3.0]), rng.integers(1, 60))).tolist()
    h = float(rng.choice([0.7, 2.0, 5.0]))
    of = drift.side(steps, h)
    for s in [0.0, h, *(rng.random(40) * h)]:
        assert of(float(s)) == pytest.approx(drift.walk(steps, float(s), h)[1], abs=1e-9)


@pytest.mark.parametrize("piece", [1, 7, 64, 10_000])
def test_equal_to_the_fold(spark, piece):
    rng = np.random.default_rng(piece)
    series = {"walk": np.cumsum(rng.normal(size=300)), "steady": rng.normal(size=211), "flat": np.ones(40), "one": np.array([5.0]), "jump": np.r_[np.zeros(100), np.full(100, 9.0)]}
    rows = [(k, i, float(x), "extra") for k, xs in series.items() for i, x in enumerate(xs)] + [("steady", 1000, None, "no period"), ("nothing", 1, None, ""), (None, 1, 2.0, "")]
    frame = spark.createDataFrame(rows, "k string, t long, x double, at string").repartition(3)
    if piece == 1:
        frame = frame.where("k in ('flat', 'one') or t < 20")
        series = {k: (xs if k in ("flat", "one") else xs[:20]) for k, xs in series.items()}
    got = {}
    for r in drift.drift(frame, ["k"], "t", "x", k=0.25, h=1.5, piece=piece).collect():
        got.setdefault(r.k, []).append((r["at"], r.t, r.ewma, r.up, r.down))
    assert set(got) == set(series)
    for k, xs in series.items():
        want = fold(xs.tolist(), 0.3, 0.25, 1.5)
        mine = sorted(got[k])
        assert [m[0] for m in mine] == [m[1] for m in mine] == list(range(len(xs)))
        assert np.allclose([m[2] for m in mine], [w[0] for w in want])
        assert [m[3:] for m in mine] == [w[1:] for w in want], k
    assert piece > 64 or any(m[3] or m[4] for m in got["walk"]) or piece == 1


def test_a_long_series_by_many_tasks(spark):
    n = 1_000_000
    rows = spark.range(n).selectExpr("0 AS k", "id AS t", "cast(pmod(xxhash64(id), 1000) as double) / 1000 + id / 4e6 AS x")
    out = drift.drift(rows, ["k"], "t", "x", k=0.5, h=8.0)
    xs = np.array([r.x for r in rows.orderBy("t").select("x").toLocalIterator()])
    want = fold(xs.tolist(), 0.3, 0.5, 8.0)
    got = out.orderBy("at").toPandas()
    assert len(got) == n and np.allclose(got["ewma"], [w[0] for w in want])
    assert got["up"].tolist() == [w[1] for w in want] and got["down"].tolist() == [w[2] for w in want]
    assert got["up"].sum() > 100


def test_displacement(spark):
    kpi, flat, fell = [0.5] * 10 + [0.9] * 5, [0.5] * 15, [0.8] * 10 + [0.3] * 5
    rows = [("k", i, a, b) for i, (a, b) in enumerate(zip(kpi, fell, strict=True))] + [("flat", i, a, b) for i, (a, b) in enumerate(zip(flat, fell, strict=True))]
    frame = spark.createDataFrame(rows, "k string, t int, kpi double, inv double")
    got = {}
    for r in drift.displacement(frame, ["k"], "t", "kpi", "inv", k=0.5, h=3.0).collect():
        got.setdefault(r.k, set()).add(r.signal)
    assert "POTENTIAL_DISPLACEMENT" in got["k"] and got["flat"] == {"POTENTIAL_EXECUTION_GAP"}
    with pytest.raises(Exception, match="unequal length"):
        drift.displacement(spark.createDataFrame([("k", 1, 1.0, None)], frame.schema), ["k"], "t", "kpi", "inv").collect()


def test_no_rows(spark):
    assert drift.drift(spark.createDataFrame([], "k string, t int, x double"), ["k"], "t", "x").collect() == []
