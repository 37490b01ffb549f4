"""Which concerns to review within a budget of minutes.

Concerns of one bucket and cost are alike to every selector here, so what a selector walks through is a table of
(bucket, cost) classes, whose size follows from how many costs there are and not from how many concerns. The walk yields
how many of each class to take; the concerns themselves are ranked and cut in Spark. Input order is cost, bucket, id.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from copy import copy
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselens.sources.scratch import held

from .ranking import ranked, start_of

Class = tuple[str, float]  # bucket, cost
EPSILON = 0.1
SEED_POOL = 12
SEED_SIZE = 3
ROUNDS = 1000  # rounds of the stratified baseline that are added up as one block


def bucket() -> Column:
    return F.concat_ws("|", "capability", "finding_type")


def coverage_score(selected: DataFrame, *keys: str, concave: Callable[[Column], Column] = F.log1p) -> DataFrame:
    """Sum over buckets of a concave function of the bucket's count."""
    n = selected.groupBy(*keys, bucket().alias("_b")).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.sum(concave(F.col("_n"))).alias("coverage"))


def _gain(n: int) -> float:
    return math.log1p(1 / (n + 1))  # log1p(n + 1) - log1p(n)


def admitted(cost: float, bar: float, above: int) -> int:
    """The largest count of a bucket, above or not by much, at which a further item of this cost clears the bar; -1 if none.

    gain / cost >= bar where count <= 1 / expm1(bar * cost) - 1. The last bit is settled by the comparison itself.
    """
    if _gain(0) / cost < bar:
        return -1
    exact = 1 / math.expm1(bar * cost) - 1
    if exact > above:
        return above
    n = max(0, int(exact))
    while n and _gain(n) / cost < bar:
        n -= 1
    while _gain(n + 1) / cost >= bar:
        n += 1
    return n


class _Descent:
    """Threshold greedy below one start: a falling bar on gain per minute, and whatever clears it and fits.

    Of a bucket only its cheapest class that isn't used up can be next: a dearer one clears a bar after it, and fits
    where it does. So a heap with one class of each bucket, by the bar that it clears next and its place in the input
    order, says what comes next, and how many of it is in closed form.
    """

    def __init__(self, left: dict[Class, int], taken: dict[Class, int], bars: list[float]):
        self.bars = bars  # negated, so ascending
        self.taken, self.counts, self.spent = dict(taken), {}, sum(c * n for (_, c), n in taken.items())
        for (b, _), n in taken.items():
            self.counts[b] = self.counts.get(b, 0) + n
        self.queues: dict[str, list[tuple[int, float, int]]] = {}
        for place, ((b, c), n) in enumerate(left.items()):
            if n and c > 0:
                self.queues.setdefault(b, []).append((place, c, n))
        for queue in self.queues.values():
            queue.sort(key=lambda x: (-x[1], -x[0]))  # the cheapest at the end
        self.heap: list[tuple[int, int, str]] = []
        for b in self.queues:
            self._push(b, 0)

    def fork(self) -> _Descent:
        out = copy(self)
        out.taken, out.counts, out.heap = dict(self.taken), dict(self.counts), list(self.heap)
        out.queues = {b: list(q) for b, q in self.queues.items()}
        return out

    def _push(self, b: str, bar: int) -> None:
        if self.queues[b]:
            place, c, _ = self.queues[b][-1]
            heappush(self.heap, (max(bar, bisect_left(self.bars, -_gain(self.counts.get(b, 0)) / c)), place, b))

    def next(self) -> tuple[int, str, float, int] | None:
        """Bar, bucket, cost and number of what is taken next if it fits."""
        while self.heap and self.heap[0][0] < len(self.bars):
            bar, _, b = self.heap[0]
            _, c, n = self.queues[b][-1]
            have = self.counts.get(b, 0)
            k = min(n, admitted(c, -self.bars[bar], have + n) - have + 1)
            if k > 0:
                return bar, b, c, k
            heappop(self.heap)
            self._push(b, bar + 1)
        return None

    def take(self, bar: int, b: str, c: float, k: int, fits: bool) -> None:
        """Take k of it; where that isn't all that clears the bar (`fits` is false) neither it nor a dearer one of its
        bucket ever fits again."""
        if k:
            self.counts[b] = self.counts.get(b, 0) + k
            self.taken[b, c] = self.taken.get((b, c), 0) + k
            self.spent += c * k
        heappop(self.heap)
        place, c, n = self.queues[b].pop()
        if not fits:
            self.queues[b] = []
        elif n > k:
            self.queues[b].append((place, c, n - k))
        self._push(b, bar)


def _bars(top: float, least: float, epsilon: float) -> list[float]:
    out = []
    while top > 0 and top >= least:
        out.append(-top)
        top /= 1 + epsilon
    return out


def complete_all(left: dict[Class, int], budgets: list[float], taken: dict[Class, int], epsilon: float = EPSILON) -> list[dict[Class, int]]:
    """Threshold greedy from a start, for several budgets at once.

    left: classes in input order with what's left of each. Zero-cost classes are taken first, as no bar ranks them.
    Budgets with the same first bar go down together; one leaves with a copy of the state where something doesn't fit it.
    """
    taken, left = dict(taken), dict(left)
    for key in [k for k, n in left.items() if k[1] <= 0 and n]:
        taken[key] = taken.get(key, 0) + left.pop(key)
    spent = sum(c * n for (_, c), n in taken.items())
    counts: dict[str, int] = {}
    for (b, _), n in taken.items():
        counts[b] = counts.get(b, 0) + n
    out: list[dict[Class, int]] = [taken] * len(budgets)
    together: dict[float, dict[int, float]] = {}
    for i, budget in enumerate(budgets):
        able = [(b, c, n) for (b, c), n in left.items() if n and c <= budget - spent]
        if able:
            top = max(_gain(counts.get(b, 0)) / c for b, c, _ in able)
            together.setdefault(top, {})[i] = top * epsilon / sum(n for *_, n in able)
    for top, least in together.items():
        todo = [(_Descent(left, taken, _bars(top, min(least.values()), epsilon)), least)]
        while todo:
            state, members = todo.pop()
            last = {i: bisect_right(state.bars, -low) for i, low in members.items()}  # bars of each budget
            while members:
                step = state.next()
                for i in [i for i in members if step is None or step[0] >= last[i]]:
                    out[i] = dict(state.taken)
                    del members[i]
                if not members:
                    break
                bar, b, c, k = step
                short = {i: low for i, low in members.items() if state.spent + c * k > budgets[i] + 1e-9}
                if short:
                    members = {i: low for i, low in members.items() if i not in short}
                    fits = {i: min(k, int((budgets[i] - state.spent + 1e-9) // c)) for i in short}
                    for n in sorted(set(fits.values())):
                        own = state.fork()
                        own.take(bar, b, c, n, False)
                        todo.append((own, {i: low for i, low in short.items() if fits[i] == n}))
                if members:
                    state.take(bar, b, c, k, True)
    return out


def complete(left: dict[Class, int], budget: float, taken: dict[Class, int], epsilon: float = EPSILON) -> dict[Class, int]:
    return complete_all(left, [budget], taken, epsilon)[0]


def score(taken: dict[Class, int]) -> float:
    counts: dict[str, int] = {}
    for (b, _), n in taken.items():
        counts[b] = counts.get(b, 0) + n
    return sum(math.log1p(n) for n in counts.values())


def _starts(classes: dict[Class, int], budget: float) -> list[tuple[Class, ...]]:
    """All different starts of up to SEED_SIZE of the densest SEED_POOL affordable items, in order."""
    pool: list[Class] = []
    for key in sorted((k for k in classes if 0 < k[1] <= budget), key=lambda k: (k[1], k[0])):
        pool += [key] * min(classes[key], SEED_POOL - len(pool))
    every = (tuple(sorted(seed)) for size in range(SEED_SIZE + 1) for seed in combinations(pool, size))
    return [s for s in dict.fromkeys(every) if sum(c for _, c in s) <= budget]


def choose_all(classes: dict[Class, int], budgets: list[float]) -> list[dict[Class, int]]:
    """For each budget the best completion over all starts; the first one wins. A start that several budgets have is
    walked once for all of them."""
    starts = [dict.fromkeys(_starts(classes, b)) for b in budgets]
    best: list[tuple[float, dict[Class, int]]] = [(-1.0, {})] * len(budgets)
    for seed in dict.fromkeys(s for some in starts for s in some):
        mine = [i for i, some in enumerate(starts) if seed in some]
        start: dict[Class, int] = {}
        for key in seed:
            start[key] = start.get(key, 0) + 1
        for i, taken in zip(mine, complete_all({k: n - start.get(k, 0) for k, n in classes.items()}, [budgets[i] for i in mine], start), strict=True):
            if score(taken) > best[i][0] + 1e-12:
                best[i] = score(taken), taken
    return [taken for _, taken in best]


def choose(classes: dict[Class, int], budget: float) -> dict[Class, int]:
    return choose_all(classes, [budget])[0]


def _walk(concerns: DataFrame, budget: DataFrame, keys: list[str], order: list[str], f: Callable[[dict, float], dict], by: Column | None = None) -> DataFrame:
    """Apply f to the classes of each scope; returns the concerns that it takes, the first ones of each class by `by` and id."""
    rows = concerns.withColumn("_bucket", bucket())
    classes = rows.groupBy(*keys, "_bucket", "minutes", "concern_score").agg(F.count("*").alias("_n")).join(budget, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        taken = f(pdf, float(pdf["budget"].iloc[0]))
        return pdf.assign(_take=[taken.get(i, 0) for i in range(len(pdf))])[[*keys, "_bucket", "minutes", "concern_score", "_take"]]

    kinds = {name: kind for name, kind in rows.dtypes}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_bucket string, minutes double, concern_score double, _take long"])
    take = classes.groupBy(*keys).applyInPandas(run, schema).where("_take > 0")
    lead = start_of("finding_id") if by is None else F.shiftright(by, 52)
    named = ranked(rows, [*keys, "_bucket", "minutes", "concern_score"], [lead], [*([] if by is None else [by]), F.col("finding_id")], "_r")
    return named.join(take, [*keys, "_bucket", "minutes", "concern_score"]).where("_r <= _take").drop("_r", "_take", "_bucket")


def budgets(concerns: DataFrame, keys: list[str], fraction: float = 0.3) -> DataFrame:
    """A share of each scope's total minutes."""
    return concerns.groupBy(*keys).agg((F.sum("minutes") * fraction).alias("budget"))


def _classes(pdf: pd.DataFrame) -> dict[Class, int]:
    """Classes by bucket and cost alone, in order."""
    out: dict[Class, int] = {}
    for b, c, n in zip(pdf["_bucket"], pdf["minutes"], pdf["_n"], strict=True):
        out[b, float(c)] = out.get((b, float(c)), 0) + int(n)
    return out


def _dealt(pdf: pd.DataFrame, taken: dict[Class, int]) -> dict[int, int]:
    """What is taken of classes by bucket and cost, dealt back to the rows in order."""
    taken, out = dict(taken), {}
    for i, (b, c, n) in enumerate(zip(pdf["_bucket"], pdf["minutes"], pdf["_n"], strict=True)):
        out[i] = min(int(n), taken.get((b, float(c)), 0))
        taken[b, float(c)] = taken.get((b, float(c)), 0) - out[i]
    return out


def submodular(concerns: DataFrame, budget: DataFrame, keys: list[str]) -> DataFrame:
    """Selection with diminishing returns within a bucket (capability and finding type)."""
    return _walk(concerns, budget, keys, ["minutes", "_bucket", "concern_score"], lambda pdf, b: _dealt(pdf, choose(_classes(pdf), b)))


def _fill(pdf: pd.DataFrame, budget: float) -> dict[int, int]:
    """In order, whatever still fits; what doesn't is skipped."""
    out = {}
    for i, (c, n) in enumerate(zip(pdf["minutes"], pdf["_n"], strict=True)):
        k = int(n) if c <= 0 else min(int(n), int((budget + 1e-9) // c))
        out[i], budget = k, budget - k * c
    return out


def top_score(concerns: DataFrame, budget: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline: highest score first, cheaper first among equals."""

    def run(pdf: pd.DataFrame, b: float) -> dict[int, int]:
        order = pdf.sort_values(["concern_score", "minutes", "_bucket"], ascending=[False, True, True], kind="stable").index.tolist()
        return {order[i]: k for i, k in _fill(pdf.loc[order], b).items()}

    return _walk(concerns, budget, keys, ["minutes", "_bucket", "concern_score"], run)


def _shuffled_fill(costs: np.ndarray, counts: np.ndarray, budget: float, seed: int) -> np.ndarray:
    """How many of each class a shuffle of all concerns, filled with skipping, takes.

    A block is a stretch of the shuffle of which only the classes' counts are drawn. Where all that may still fit does
    so together, their order doesn't matter; else the block is drawn apart into halves. What is too dear once stays so.
    """
    rng, taken, spare, blocks = np.random.default_rng(seed), np.zeros_like(counts), budget, [counts]
    while blocks:
        block = np.where(costs <= spare + 1e-9, blocks.pop(), 0)
        need = float((block * costs).sum())
        if need <= spare + 1e-9:
            taken, spare = taken + block, spare - need
        else:
            half = rng.multivariate_hypergeometric(block, int(block.sum()) // 2, method="marginals")
            blocks += [block - half, half]
    return taken


def random_pick(concerns: DataFrame, budget: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Baseline: concerns in a seeded shuffle, filled with skipping. The classes' counts are drawn as the shuffle of the
    concerns would give them; which ones of a class go is by a seeded hash of their ids."""

    def run(pdf: pd.DataFrame, b: float) -> dict[int, int]:
        taken = _shuffled_fill(pdf["minutes"].to_numpy(float), pdf["_n"].to_numpy(np.int64), b, seed)
        return dict(enumerate(taken.tolist()))

    return _walk(concerns, budget, keys, ["minutes", "_bucket", "concern_score"], run, F.xxhash64(F.lit(seed), "finding_id"))


def stratified(concerns: DataFrame, budget: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline: rounds over finding types, one of each type by id; what doesn't fit is passed over, and a round that
    adds nothing ends it.

    All rounds before the first that doesn't fit whole are taken; which one that is follows from the rounds' sums, added
    up in blocks. From there what's left is less than one round, and every further round but the last takes a concern, so
    only as many rounds are walked as the cheapest concern goes into a round's worth.
    """
    light = concerns.select(*keys, "finding_id", "finding_type", "minutes")
    rows = held(ranked(light, [*keys, "finding_type"], [start_of("finding_id")], [F.col("finding_id")], "_round").withColumn("_block", F.floor(F.col("_round") / ROUNDS)))
    facts = rows.groupBy(*keys).agg(F.min(F.when(F.col("minutes") > 0, F.col("minutes"))).alias("_least"), F.count_if(F.col("minutes") <= 0).alias("_free"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("minutes").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    first = F.min(F.when(F.col("_before") + F.col("_sum") > F.col("budget"), F.struct("_block", "_before")))
    limit = blocks.join(budget, keys).groupBy(*keys, "budget").agg(first.alias("_at")).join(facts, keys)
    limit = held(limit.select(*keys, "budget", "_least", "_free", F.col("_at._block").alias("_full"), F.coalesce("_at._before", F.lit(0.0)).alias("_spent")))
    sums = rows.join(limit, keys).where("_block = _full").groupBy(*keys, "budget", "_spent", "_round").agg(F.sum("minutes").alias("_sum"))
    upto = F.col("_spent") + F.sum("_sum").over(W.partitionBy(*keys).orderBy("_round"))
    crossing = sums.withColumn("_upto", upto).where("_upto > budget").groupBy(*keys).agg(F.min(F.struct("_round", (F.col("_upto") - F.col("_sum")).alias("spent"))).alias("_c"))
    further = F.floor((F.col("budget") - F.col("_c.spent")) / F.col("_least")) + F.col("_free") + 1
    # One row for each scope: rounds below `_last` are taken whole, those up to `_until` are walked. No `_last`: all fit.
    plan = held(limit.join(crossing, keys, "left").select(*keys, "budget", F.col("_c._round").alias("_last"), F.col("_c.spent").alias("_gone"), (F.col("_c._round") + further).alias("_until")))
    rows = rows.join(plan, keys).where("_last is null or _round <= _until")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spare, kept = float(pdf["budget"].iloc[0] - pdf["_gone"].iloc[0]), []
        for _, part in pdf.sort_values(["_round", "finding_type"], kind="stable").groupby("_round", sort=True):
            before = len(kept)
            for i, c in zip(part["finding_id"], part["minutes"], strict=True):
                if c <= spare:
                    kept.append(i)
                    spare -= c
            if len(kept) == before:
                break
        return pdf[pdf["finding_id"].isin(kept)][[*keys, "finding_id"]]

    kinds = dict(concerns.dtypes)
    walked = rows.where("_round >= _last").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "finding_id"]))
    taken = held(rows.where("_last is null or _round < _last").select(*keys, "finding_id").union(walked))
    return concerns.join(taken, [*keys, "finding_id"], "left_semi")


def split_budget(total: float, risk: float, calibration: float, exploration: float) -> dict[str, float]:
    """Three shares of a budget; they must add up to one."""
    if abs(risk + calibration + exploration - 1) > 1e-6:
        raise ValueError("the shares don't add up to 1")
    return {"risk": total * risk, "calibration": total * calibration, "exploration": total * exploration}


def recall(selected: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the truth that was selected; NaN where there is none."""
    hit = truth.join(selected.select(*keys, "finding_id").withColumn("_hit", F.lit(1)), [*keys, "finding_id"], "left")
    return hit.groupBy(*keys).agg(F.when(F.count("*") == 0, F.lit(float("nan"))).otherwise(F.count("_hit") / F.count("*")).alias("recall"))


def sweep(concerns: DataFrame, truth: DataFrame, keys: list[str], fractions: list[float]) -> DataFrame:
    """keys, fraction, budget, n_selected, recall and coverage of the selection at each share of a scope's total minutes.

    truth: keys, primary_id of what should be found, each once; found is what a selected concern is about. NaN where a
    scope has none. All shares are chosen in one descent and concerns are ranked once.
    """
    shares = sorted(set(fractions))
    rows = concerns.withColumn("_bucket", bucket())
    of = [*keys, "_bucket", "minutes", "concern_score"]
    classes = rows.groupBy(*of).agg(F.count("*").alias("_n")).join(concerns.groupBy(*keys).agg(F.sum("minutes").alias("_total")), keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["minutes", "_bucket", "concern_score"], kind="stable").reset_index(drop=True)
        taken = [_dealt(pdf, t) for t in choose_all(_classes(pdf), [float(pdf["_total"].iloc[0]) * f for f in shares])]
        return pdf[of].assign(_take=[[t[i] for t in taken] for i in range(len(pdf))])

    kinds = dict(rows.dtypes)
    take = held(classes.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in of), "_take array<long>"])))
    named = ranked(rows.select(*of, "finding_id", "primary_id"), of, [start_of("finding_id")], [F.col("finding_id")], "_r").join(take, of)
    each = [F.max(F.col("_r") <= F.col("_take")[i]).alias(f"_in{i}") for i in range(len(shares))]
    about = named.groupBy(*keys, "primary_id").agg(*each)
    hits = truth.select(*keys, "primary_id").distinct().join(about, [*keys, "primary_id"], "left").groupBy(*keys).agg(F.array(*(F.count_if(f"_in{i}") / F.count("*") for i in range(len(shares)))).alias("_recall"))
    by_bucket = take.groupBy(*keys, "_bucket").agg(*(F.sum(F.col("_take")[i]).alias(f"_k{i}") for i in range(len(shares))))
    sums = by_bucket.groupBy(*keys).agg(F.array(*(F.struct(F.sum(f"_k{i}").alias("n"), F.sum(F.log1p(f"_k{i}")).alias("coverage")) for i in range(len(shares)))).alias("_sums"))
    total = concerns.groupBy(*keys).agg(F.sum("minutes").alias("_total"))
    wide = sums.join(total, keys).join(hits, keys, "left").select(*keys, "_total", "_sums", "_recall", F.posexplode(F.array(*map(F.lit, shares))).alias("_i", "fraction"))
    at = lambda c: F.col(c)[F.col("_i")]
    return wide.select(*keys, "fraction", (F.col("_total") * F.col("fraction")).alias("budget"), at("_sums")["n"].alias("n_selected"), F.coalesce(at("_recall"), F.lit(float("nan"))).alias("recall"), at("_sums")["coverage"].alias("coverage"))


def explain(concerns: DataFrame, selected: DataFrame, budget: DataFrame, keys: list[str], increment: float = 60.0) -> DataFrame:
    """Per capability: selected count and score, the coverage, and what `increment` more minutes would add to the
    selection, which itself stays: n_added is above 0 for the capabilities that the added minutes reach."""
    of = [*keys, "capability", "_bucket", "minutes"]
    count = lambda df, name: df.withColumn("_bucket", bucket()).groupBy(*of).agg(F.count("*").alias(name))
    mine = count(selected, "_k").select(*(F.col(c).alias(f"_s_{c}") for c in of), "_k")
    every = count(concerns, "_n")
    same = [every[c].eqNullSafe(mine[f"_s_{c}"]) for c in of]
    classes = every.join(mine, same, "left").select(*of, "_n", F.coalesce("_k", F.lit(0)).cast("long").alias("_k")).join(budget, keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["minutes", "_bucket"], kind="stable").reset_index(drop=True)
        names = list(zip(pdf["_bucket"], pdf["minutes"].astype(float), strict=True))
        start = {k: int(n) for k, n in zip(names, pdf["_k"], strict=True) if n}
        left = {k: int(n - t) for k, n, t in zip(names, pdf["_n"], pdf["_k"], strict=True)}
        taken = complete(left, float(pdf["budget"].iloc[0]) + increment, start)
        return pdf.assign(_more=[taken.get(k, 0) for k in names])[[*keys, "capability", "_bucket", "_k", "_more"]]

    kinds = dict(concerns.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "capability"]), "_bucket string, _k long, _more long"])
    counts = classes.groupBy(*keys).applyInPandas(run, schema).groupBy(*keys, "capability", "_bucket").agg(F.sum("_k").alias("_k"), F.sum("_more").alias("_more"))
    then = counts.groupBy(*keys, "capability").agg(F.sum("_more").alias("n_with_more")).where("n_with_more > 0")
    now = selected.groupBy(*keys, "capability").agg(F.count("*").alias("n_selected"), F.sum("concern_score").alias("score"))
    cover = counts.groupBy(*keys).agg(F.sum(F.log1p("_k")).alias("coverage"), F.sum(F.log1p("_more")).alias("coverage_with_more"))
    out = now.join(then, [*keys, "capability"], "full").join(cover, keys, "left").withColumn("marginal_gain", F.col("coverage_with_more") - F.col("coverage")).fillna(0, ["n_selected", "n_with_more"])
    return out.withColumn("n_added", F.col("n_with_more") - F.col("n_selected"))
