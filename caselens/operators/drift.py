"""Drift statistics over series of any length: each is cut into pieces whose effect on what follows is a small function.

A piece turns the average that comes in into one that goes out by an affine map. It turns a cumulative sum that comes in
into one that goes out by a function with few steps: a sum that is large enough alarms at a certain place and goes on
from zero there, so all that alarm at one place go out alike; one that never alarms is max(in + a, b). Pieces are summed
up by as many tasks as there are, the functions are applied one after the other for each series, and then each piece is
walked with what comes in.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.sources.scratch import held

ROWS_PER_PIECE = 50_000


@dataclass
class Side:
    """What a piece makes of an incoming one-sided cumulative sum."""

    above: list[float]  # ascending: an incoming sum over above[i] alarms at the i-th place or, if over the next too, there
    out: list[float]  # what goes out then
    alarms: bool  # whether a sum of zero alarms, or any other that isn't over above[0]
    last: float  # what goes out then
    shift: float  # else max(in + shift, floor) goes out
    floor: float

    def __call__(self, s: float) -> float:
        i = bisect_left(self.above, s)
        if i:
            return self.out[i - 1]
        return self.last if self.alarms else max(s + self.shift, self.floor)


def walk(steps: list[float], s: float, h: float) -> tuple[list[int], float]:
    """Places where max(0, sum + step) exceeds h, whereupon it restarts at zero; and the sum at the end."""
    places = []
    for i, d in enumerate(steps):
        s = max(0.0, s + d)
        if s > h:
            places.append(i)
            s = 0.0
    return places, s


def side(steps: list[float], h: float) -> Side:
    """The function of a piece. Of the places where an incoming sum can alarm first, only those of a new highest partial
    sum count, up to where zero alarms by itself."""
    known: dict[int, float] = {}  # the sum at the end, from zero before a place

    def end(i: int) -> float:
        path, s = [i], 0.0
        while i < len(steps):
            if s == 0.0 and i in known:
                s = known[i]
                break
            if s == 0.0:
                path.append(i)
            s = max(0.0, s + steps[i])
            s = 0.0 if s > h else s
            i += 1
        known.update(dict.fromkeys(path, s))
        return s

    total = top = zero = 0.0
    first = None
    records: list[tuple[float, int]] = []
    for i, d in enumerate(steps):
        total += d
        if total > top:
            top = total
            records.append((h - total, i))
        zero = max(0.0, zero + d)
        if zero > h:
            first = i
            break
    records = [(a, i) for a, i in records if first is None or i < first][::-1]  # the highest sums need the least
    return Side([a for a, _ in records], [end(i + 1) for _, i in records], first is not None, end(first + 1) if first is not None else 0.0, total, zero)


def smooth(xs: list[float], rate: float, y: float | None) -> list[float]:
    """rate * x + (1 - rate) * the last y; the first of a series is x itself."""
    start = [] if y is None else [y]
    return list(accumulate([*start, *xs], lambda y, x: rate * x + (1 - rate) * y))[len(start) :]


def drift(rows: DataFrame, keys: list[str], order: str, value: str, rate: float = 0.3, k: float = 0.5, h: float = 4.0, piece: int = ROWS_PER_PIECE) -> DataFrame:
    """keys, order, value, at (place in the series, from 0), ewma, up, down: the exponential average, and whether the
    two-sided cumulative sum alarms there, whereupon that side restarts.

    Target and scale are the series' own mean and population deviation (1 if it has none); k and h are in deviations.
    Null values are no periods and rows with a null key of no series. Equal values of `order` go by value. No rows: none.
    """
    some = rows.dropna(subset=[*keys, value]).select(*keys, F.col(order).alias("_order"), F.col(value).cast("double").alias("_x"))
    parts = max(1, -(-some.count() // piece))
    whole = some.groupBy(*keys).agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_sd"))
    by = [*keys, "_order", "_x"]
    order_of = some.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    cut = held(order_of.withColumn("_part", F.shiftright("_at", 33)))
    kinds = {n: t for n, t in cut.dtypes}
    cut = cut.join(whole, keys)
    name = ", ".join(f"{c} {kinds[c]}" for c in keys)

    def pieces(pdf: pd.DataFrame) -> list[tuple[tuple, pd.DataFrame]]:
        pdf = pdf.sort_values("_at")
        return [(of, part) for of, part in pdf.groupby(keys, sort=False, dropna=False)]

    def steps(part: pd.DataFrame) -> list[list[float]]:
        """Of the upper and the lower side, which is the upper one of the negated series."""
        sd = float(part["_sd"].iloc[0])
        z = (part["_x"].to_numpy() - float(part["_mean"].iloc[0])) / (sd or 1.0)
        return [(z - k).tolist(), (-z - k).tolist()]

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for of, part in pieces(pdf):
            xs = part["_x"].tolist()
            both = [side(s, h) for s in steps(part)]
            out.append((*of, int(part["_part"].iloc[0]), len(xs), smooth(xs, rate, None)[-1], smooth(xs, rate, 0.0)[-1], [[s.above, s.out] for s in both], [[float(s.alarms), s.last, s.shift, s.floor] for s in both]))
        return pd.DataFrame(out, columns=[*keys, "_part", "_n", "_fresh", "_own", "_steps", "_rest"])

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        """What comes into each piece of a series; it has a piece for each task at most."""
        out, n, y, sums = [], 0, None, [0.0, 0.0]
        for r in pdf.sort_values("_part").to_dict("records"):
            out.append((*(r[c] for c in keys), r["_part"], n, y, *sums))
            y = float(r["_fresh"]) if y is None else float(r["_own"]) + (1 - rate) ** int(r["_n"]) * y
            sums = [Side([*s[0]], [*s[1]], bool(e[0]), *map(float, e[1:]))(x) for s, e, x in zip(r["_steps"], r["_rest"], sums, strict=True)]
            n += int(r["_n"])
        return pd.DataFrame(out, columns=[*keys, "_part", "_first", "_y", "_up", "_down"])

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pieces(pdf):
            y = part["_y"].iloc[0]
            up, down = (np.isin(np.arange(len(part)), walk(s, float(part[c].iloc[0]), h)[0]) for s, c in zip(steps(part), ("_up", "_down"), strict=True))
            at = np.arange(len(part)) + int(part["_first"].iloc[0])
            out.append(part[[*keys, "_order", "_x"]].assign(at=at, ewma=smooth(part["_x"].tolist(), rate, None if pd.isna(y) else float(y)), up=up, down=down))
        return pd.concat(out)

    one = cut.groupBy("_part").applyInPandas(summed, f"{name}, _part long, _n long, _fresh double, _own double, _steps array<array<array<double>>>, _rest array<array<double>>")
    comes_in = held(one.groupBy(*keys).applyInPandas(carried, f"{name}, _part long, _first long, _y double, _up double, _down double"))
    out = cut.join(comes_in, [*keys, "_part"]).groupBy("_part").applyInPandas(walked, f"{name}, _order {kinds['_order']}, _x double, at long, ewma double, up boolean, down boolean")
    return out.withColumnsRenamed({"_order": order, "_x": value})


def displacement(rows: DataFrame, keys: list[str], order: str, kpi: str, invariant: str, tolerance: int = 1, k: float = 0.5, h: float = 4.0) -> DataFrame:
    """keys, at, signal: alarms where the invariant falls: POTENTIAL_DISPLACEMENT if the KPI rises within `tolerance`
    periods, else POTENTIAL_EXECUTION_GAP. A period with but one of the two fails, as places would no longer agree."""
    fits = F.assert_true(F.col(kpi).isNull() == F.col(invariant).isNull(), "series of unequal length")
    rows = rows.where(fits.isNull())
    fell = drift(rows, keys, order, invariant, k=k, h=h).where("down").select(*keys, "at")
    rose = drift(rows, keys, order, kpi, k=k, h=h).where("up").select(*keys, F.explode(F.sequence(F.col("at") - tolerance, F.col("at") + tolerance)).alias("at"), F.lit(True).alias("_near")).distinct()
    return fell.join(rose, [*keys, "at"], "left").select(*keys, "at", F.when(F.col("_near"), "POTENTIAL_DISPLACEMENT").otherwise("POTENTIAL_EXECUTION_GAP").alias("signal"))
