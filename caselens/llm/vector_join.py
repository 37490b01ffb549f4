"""Near-duplicate vectors: a self-join under a cosine threshold in epsilon grid order.

Unit vectors are within a cosine of each other where they are within a distance (`radius`). Vectors are sorted by the
cells, as wide as that distance, that they have on the leading principal dimensions. Pieces of the sorted sequence are
blocks with a bounding box; pairs of intervals of blocks are joined from the whole sequence downwards, and pairs whose
boxes are further apart than the radius go. Inside a pair of blocks the same goes on down to small runs, whose vectors
are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts_for, skewed_join
from .components import components
from .simhash import _star_edges

DIMS = 8  # leading principal dimensions that have cells
SAMPLE = 4096  # vectors that the dimensions are fitted on; they decide what is skipped and no result
BLOCK_BYTES = 16_000_000  # most bytes of vectors in a block
LEAST_BLOCK = 512  # vectors, where there are few
BLOCKS = 8  # at least, where a block would hold over LEAST_BLOCK vectors
FAN = 16  # intervals of an interval
RUN = 256  # vectors that are compared at once with as many
SLACK = 1e-7  # of rounding, in the distance between boxes


def radius(cosine: float) -> float:
    """The distance of unit vectors at this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by the largest component first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: str) -> Column:
    """Vectors that can link: not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _axes(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal dimensions of a bounded sample; dimensions of zeros where there are fewer than DIMS."""
    rows = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").toPandas()
    u = unit(_matrix(rows["vector"], width))
    mean = u.mean(0)
    found = np.linalg.svd(u - mean, full_matrices=False)[2][:DIMS].T
    return mean, np.pad(found, ((0, 0), (0, DIMS - found.shape[1])))


def _placed(classes: DataFrame, width: int, cosine: float) -> DataFrame:
    """node, n, vector and `place`: cells on the principal dimensions, coordinates there, and the length of the rest."""
    mean, axes = _axes(classes, width)
    side = radius(cosine) or 1.0

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            off = unit(_matrix(pdf["vector"], width)) - mean
            at = off @ axes
            rest = np.sqrt(np.maximum(0, (off * off).sum(1) - (at * at).sum(1)))
            yield pdf.assign(cells=list(np.floor(at / side).astype(np.int32)), place=list(np.column_stack([at, rest])))

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("node", "n", "vector").mapInPandas(place, f"node long, n long, vector {kind}, cells array<int>, place array<double>")


def blocks(classes: DataFrame, width: int, cosine: float, size: int) -> DataFrame:
    """block, lo, hi and `rows` (node, n, vector, place in grid order): the sorted sequence cut after every `size`."""
    total = classes.count()
    keys = [F.col("cells"), F.col("place"), F.col("node")]
    order = _placed(classes, width, cosine).repartitionByRange(parts_for(total, size), *keys).sortWithinPartitions(*keys)
    order = materialise(order.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = order.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # As many rows as the sort had partitions: a count for each.
    before = counts.selectExpr("_part", "coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    numbered = order.withColumn("_part", part).join(before, "_part").withColumn("_i", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = numbered.select(F.floor(F.col("_i") / size).cast("long").alias("block"), F.struct("_i", "node", "n", "vector", "place").alias("r"))
    bound = lambda f: F.array(*(f(F.col("r.place")[k]) for k in range(DIMS + 1)))
    return rows.groupBy("block").agg(bound(F.min).alias("lo"), bound(F.max).alias("hi"), F.array_sort(F.collect_list("r")).alias("rows"))


def _gap(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """The squared distance of two boxes."""
    apart = F.zip_with(F.zip_with(a[0], b[1], lambda x, y: x - y), F.zip_with(b[0], a[1], lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def block_pairs(boxes: DataFrame, cosine: float) -> DataFrame:
    """boxes: block, lo, hi. Pairs a <= b of blocks that aren't provably further apart than the radius.

    Intervals of FAN blocks, of FAN such intervals and so on have boxes of their own. Pairs of intervals go down together
    from the whole sequence, and only pairs that may be near have kids.
    """
    levels = [boxes]
    top = boxes.agg(F.max("block")).first()[0] or 0
    while top > 0:
        up = levels[-1].groupBy(F.floor(F.col("block") / FAN).cast("long").alias("block"))
        bound = lambda f, name: F.array(*(f(F.col(name)[k]) for k in range(DIMS + 1))).alias(name)
        levels.append(materialise(up.agg(bound(F.min, "lo"), bound(F.max, "hi"))))
        top //= FAN
    limit = (radius(cosine) + SLACK) ** 2
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for boxes in reversed(levels[:-1]):
        side = lambda name: boxes.select(F.col("block").alias(f"_{name}"), F.col("lo").alias(f"lo_{name}"), F.col("hi").alias(f"hi_{name}"), F.floor(F.col("block") / FAN).cast("long").alias(name))  # noqa: B023, E731
        kids = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("_a") <= F.col("_b")).where(_gap(("lo_a", "hi_a"), ("lo_b", "hi_b")) <= limit)
        pairs = materialise(kids.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return pairs


class _Block:
    """A block's vectors, and the boxes of its runs of RUN vectors, of two of them, of four and so on."""

    def __init__(self, rows: list, width: int):
        self.node = np.array([r["node"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.unit = unit(_matrix([r["vector"] for r in rows], width))
        self.place = np.array([r["place"] for r in rows])
        starts = np.arange(0, len(rows), RUN)
        self.boxes = [(np.minimum.reduceat(self.place, starts), np.maximum.reduceat(self.place, starts))]
        while len(self.boxes[-1][0]) > 1:
            lo, hi = self.boxes[-1]
            pairs = np.arange(0, len(lo), 2)
            self.boxes.append((np.minimum.reduceat(lo, pairs), np.maximum.reduceat(hi, pairs)))


def _runs(a: _Block, b: _Block, limit: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs that may be near, by going down both blocks' boxes together."""
    depth = max(len(a.boxes), len(b.boxes)) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth, -1, -1):
        (alo, ahi), (blo, bhi) = a.boxes[min(level, len(a.boxes) - 1)], b.boxes[min(level, len(b.boxes) - 1)]
        if level < depth:
            ai = [2 * i, 2 * i + 1] if level < len(a.boxes) - 1 else [i]
            bj = [2 * j, 2 * j + 1] if level < len(b.boxes) - 1 else [j]
            i, j = np.concatenate([x for x in ai for _ in bj]), np.concatenate([y for _ in ai for y in bj])
        real = (i < len(alo)) & (j < len(blo))
        if same:
            real &= i <= j
        i, j = i[real], j[real]
        apart = np.maximum(0, np.maximum(alo[i] - bhi[j], blo[j] - ahi[i]))
        near = (apart * apart).sum(1) <= limit
        i, j = i[near], j[near]
    return i, j


def pair_links(a: _Block, b: _Block, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, how many rows of other classes it is linked with here, and the least node that it reaches over links here."""
    node = a.node if same else np.concatenate([a.node, b.node])
    off = 0 if same else len(a.node)
    counts, ends = np.zeros(len(node), np.int64), []
    for i, j in zip(*_runs(a, b, (radius(cosine) + SLACK) ** 2, same), strict=True):
        s, t = slice(i * RUN, (i + 1) * RUN), slice(j * RUN, (j + 1) * RUN)
        near = a.unit[s] @ b.unit[t].T >= cosine
        own = same and i == j
        if own:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        counts[i * RUN : i * RUN + near.shape[0]] += near @ b.n[t]
        if not own:
            counts[off + j * RUN : off + j * RUN + near.shape[1]] += a.n[s] @ near
        x, y = np.nonzero(near)
        at = np.unique(np.concatenate([x + i * RUN, y + j * RUN + off]))
        moved, least = _star_edges(len(at), np.searchsorted(at, x + i * RUN), np.searchsorted(at, y + j * RUN + off), node[at])
        ends.append((moved, least))
    label = node.copy()
    if ends:
        u, v = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        names, order = np.sort(node), np.argsort(node)
        moved, least = _star_edges(len(names), np.searchsorted(names, u), np.searchsorted(names, v), names)
        label[order[np.searchsorted(names, moved)]] = least
    hit = counts > 0
    return node[hit], counts[hit], label[hit]


def links(classes: DataFrame, cosine: float, block_size: int | None = None) -> DataFrame:
    """classes: node (long), n (rows that share the vector), vector. Returns node, n_links (rows of other classes within
    `cosine`), least: a row for each pair of blocks that the node has links in; edges node-least connect what links do."""
    width, total = classes.agg(F.max(F.size("vector")), F.count("*")).first()
    if not total:
        return classes.select("node", F.col("n").alias("n_links"), F.col("node").alias("least"))
    size = block_size or max(1, min(max(LEAST_BLOCK, math.ceil(total / BLOCKS)), BLOCK_BYTES // (8 * width)))
    cut = materialise(blocks(classes, width, cosine, size))
    pairs = block_pairs(cut.select("block", "lo", "hi"), cosine)
    one = lambda name: cut.select(F.col("block").alias(name), F.col("rows").alias(f"rows_{name}"))
    met = pairs.where("a <> b").join(one("a"), "a").join(one("b"), "b").unionByName(pairs.where("a = b").join(one("a"), "a").withColumn("rows_b", F.lit(None).cast(cut.schema["rows"].dataType)))

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for ra, rb in zip(pdf["rows_a"], pdf["rows_b"], strict=True):
                a = _Block(ra, width)
                b = a if rb is None else _Block(rb, width)
                node, n, least = pair_links(a, b, cosine, rb is None)
                yield pd.DataFrame({"node": node, "n_links": n, "least": least})

    dealt = met.repartition(parts_for(pairs.count(), 4, 12), F.xxhash64("a", "b"))
    return dealt.select("rows_a", "rows_b").mapInPandas(compare, "node long, n_links long, least long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_size: int | None = None) -> DataFrame:
    """id_col, n_links (other rows within `cosine`), component_id (the least id reachable over links, itself included),
    kept (id = component_id).

    Equal vectors are one class and meet once; their rows count as linked with each other. Vectors that are null, empty,
    zero or hold a null or non-finite component link with nothing: 0, their own id, kept. Vectors of other lengths count
    as ending in zeros. Null ids count as linked rows and name no component: such a row is kept if nothing it reaches
    has an id. Repeated rows link with each other and return as often as they came. Empty table: no rows. Other columns
    are ignored, whatever their names.
    """
    kind = vectors.schema[id_col].dataType
    key = [F.xxhash64("_v").alias("_k1"), F.xxhash64(F.lit(1), "_v").alias("_k2")]
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).withColumn("_ok", usable("_v"))
    good = rows.where("_ok")
    classes = good.groupBy(*key).agg(F.count("*").alias("n"), F.min("_id").alias("_first"), F.first("_v").alias("vector"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    found = materialise(links(classes.select("node", "n", "vector"), cosine, block_size))
    groups = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    others = found.groupBy("node").agg(F.sum("n_links").alias("_others"))
    facts = classes.select("node", "_k1", "_k2", "n", "_first").join(others, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    facts = materialise(facts)
    least = facts.groupBy("component").agg(F.min("_first").alias("component_id"), F.count("*").alias("_in"))
    n_classes, total = facts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    named = skewed_join(facts, least, ["component"], "_in", n_classes, ["node"])
    named = named.select("_k1", "_k2", "n", (F.coalesce("_others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = skewed_join(good.select("_id", *key), named, ["_k1", "_k2"], "n", total, ["_id"]).select("_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined.unionByName(alone).select(F.col("_id").cast(kind).alias(id_col), "n_links", "component_id", kept.alias("kept"))
