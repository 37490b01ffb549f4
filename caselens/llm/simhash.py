"""SimHash fingerprints and their self-join under a Hamming budget by traversing a binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, mix64, parts_for, skewed_join, utf8, with_ids
from .components import components

BITS = 64
GROUP_LIMIT = 1024  # fingerprints that one trie may hold; larger groups are split by more bits
ROWS_PER_TASK = 100_000
BLOCK = 1 << 16  # hashes whose bits are unpacked at once
SHINGLE = 5  # words
SIMILAR = (4, 5)  # as a fraction: the least Jaccard similarity of near-duplicates
SHINGLES_PER_TASK = 2_000_000
CROWD = 16  # sets near one from which on it is held against all others
SLOW = 16  # a round of pivots that lets go of fewer sets than one in SLOW isn't worth another
PIVOTS = 8  # sets that those of a large group are compared with in a round


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is set if it is set in over half the shingles' XXH64 values. No word: 0."""
    words = utf8(text).lower().split()  # on bytes, lower() touches A-Z alone and split() cuts at 0x20, 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    one = xxhash.xxh64_intdigest
    hashes = [one(joined[s : e - 1], 42) for s, e in zip([0, *ends], ends[width - 1 :])]  # noqa: B905  the starts are longer
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the values; a block of them is unpacked at a time."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and fp (a signed long) of every row."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            values = [fingerprint(t if isinstance(t, str) else None, width) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "fp": np.array(values, np.uint64).view(np.int64)})

    return with_ids(docs, id_col, text_col).mapInPandas(batches, "_id string, fp long").withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType))


def trie_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `values` within `budget` bits of each other, each range [start, end) being a trie of its own.

    values: uint64, ascending within every range. A trie node is a range of values that agree on the bits so far; pairs
    of nodes go down together, one bit at a time, and a pair is dropped once its differing bits exceed the budget.
    """
    a0, a1, b0, b1 = starts.copy(), ends.copy(), starts.copy(), ends.copy()
    off = np.zeros(len(starts), np.int64)
    for bit in range(BITS - 1, -1, -1):
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the bit turns 1
        same = a0 == b0
        kids = [(a0, am, b0, bm, off, np.ones(len(off), bool)), (am, a1, bm, b1, off, np.ones(len(off), bool)), (a0, am, bm, b1, off + 1, np.ones(len(off), bool)), (am, a1, b0, bm, off + 1, ~same)]
        keep = [(x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget) & x[5] & ((x[0] != x[2]) | (x[1] - x[0] > 1)) for x in kids]  # one value alone has no partner
        a0, a1, b0, b1, off = (np.concatenate([x[i][k] for x, k in zip(kids, keep, strict=True)]) for i in range(5))
        if not len(off):
            break
    return a0, b0


def _star_edges(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value with a link, its id and the least id that it reaches here."""
    label = ids.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (before == label).all():
            moved = label != ids
            return ids[moved], label[moved]


def _partition_links(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    fp = pdf["fp"].to_numpy().view(np.uint64)
    mask, ids = pdf["mask"].to_numpy(), pdf["rep"].to_numpy()
    prefix, seed = fp & mask.view(np.uint64), pdf["seed"].to_numpy()
    order = np.lexsort((fp, prefix, mask, seed))
    fp, mask, prefix, ids, seed = fp[order], mask[order], prefix[order], ids[order], seed[order]
    cut = np.flatnonzero((mask[1:] != mask[:-1]) | (prefix[1:] != prefix[:-1]) | (seed[1:] != seed[:-1])) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
    big = ends - starts > 1
    starts, ends = starts[big], ends[big]
    out = []
    chunk = np.cumsum((ends - starts) ** 2) // 2_000_000  # bounds the node pairs held at once
    for c in np.unique(chunk):
        s, e = starts[chunk == c], ends[chunk == c]
        lo, hi = s[0], e[-1]
        a, b = trie_pairs(fp[lo:hi], s - lo, e - lo, budget)
        if len(a):
            out.append(pd.DataFrame(dict(zip("ab", _star_edges(hi - lo, a, b, ids[lo:hi]), strict=True))))
    return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})


def _masks(free: int, n: int) -> list[int]:
    """The bits set in `free`, dealt into n runs: a pair within n - 1 differing bits agrees on one run at least."""
    bits = [i for i in range(BITS) if free >> i & 1]
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << i for i in bits[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, budget: int) -> DataFrame:
    """fps: seed, distinct fp and a long rep. Edges (a, b) between reps that connect whatever lies within `budget` bits
    under one seed.

    The bits are dealt into budget + 1 runs, and values that agree on a run share a trie below it. A group over
    GROUP_LIMIT is dealt again by runs of its free bits, as often as needed: with few bits free a group is small by
    itself, as the fingerprints are distinct. So no task holds an unbounded group and no link is lost.
    """
    total = fps.count()
    full = (1 << BITS) - 1
    level = [0]  # masks of the groups to split next
    rows = fps.select("seed", "fp", "rep", F.lit(0).cast("long").alias("mask"))
    edges: DataFrame | None = None
    while level:
        split = {m: [m | x for x in _masks(full & ~m, budget + 1)] for m in level}
        deeper = F.coalesce(*(F.when(F.col("mask") == _signed(m), F.array(*(F.lit(_signed(x)).cast("long") for x in xs))) for m, xs in split.items()))
        rows = rows.select("seed", "fp", "rep", F.explode(deeper).alias("mask"))
        key = [F.col("seed"), F.col("mask"), F.col("fp").bitwiseAND(F.col("mask")).alias("prefix")]
        hot = rows.groupBy(*key).count().where(F.col("count") > GROUP_LIMIT).drop("count")
        level = [r["mask"] & full for r in hot.select("mask").distinct().collect()]  # masks are few whatever the rows
        keyed = rows.withColumn("prefix", key[2])
        here = keyed.join(hot, ["seed", "mask", "prefix"], "left_anti") if level else keyed
        tasks = parts_for(total * sum(map(len, split.values())), ROWS_PER_TASK, 96)
        dealt = here.withColumn("_p", F.pmod(F.xxhash64("seed", "mask", "prefix"), F.lit(tasks)))
        found = dealt.select("_p", "seed", "fp", "rep", "mask").groupBy("_p").applyInPandas(lambda pdf: _partition_links(pdf, budget), "a long, b long")
        edges = found if edges is None else edges.union(found)
        if level:
            rows = materialise(keyed.join(hot, ["seed", "mask", "prefix"], "left_semi").select("seed", "fp", "rep", "mask"))
    return edges


def near_duplicates(docs: DataFrame, budget: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (the least id reachable over links of up to `budget` bits).

    Equal fingerprints count as linked and meet once, by their least id, before the join. Null or wordless text:
    fingerprint zero, linked like any other. Null ids take part in no minimum; a group of null ids alone has a null
    component_id. Repeated rows return as often as they came. Empty table: no rows. Other columns are ignored.
    """
    rows = materialise(fingerprints(docs, width, id_col, text_col))
    fps = materialise(rows.groupBy("fp").agg(F.min("_id").cast("long").alias("rep"), F.count("*").alias("n")))
    found = components(links(fps.where("rep is not null").select("fp", "rep").withColumn("seed", F.lit(0)), budget))
    of = fps.join(found, fps.rep == found.node, "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return skewed_join(rows, of, ["fp"], "n", rows.count(), ["_id"]).select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_fingerprints(text: str | None, seeds: int) -> list[int]:
    """A fingerprint for each seed over the distinct words, whatever the text's length."""
    held = set(utf8(text).lower().split())
    if not held:
        return [0] * seeds
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held))
    return [majority(mix64(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << BITS) - 1))) for seed in range(seeds)]


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of all runs of SHINGLE words, ascending; a shorter text is one run, a wordless one the empty run."""
    words = utf8(text).lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    one = xxhash.xxh64_intdigest
    return np.unique(np.array([one(joined[s : e - 1], 42) for s, e in zip([0, *ends], ends[SHINGLE - 1 :])], np.uint64))  # noqa: B905  the starts are longer


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def prefix_size(size: np.ndarray) -> np.ndarray:
    """How many of its rarest members a set must be known by: two sets of Jaccard similarity SIMILAR share one of them."""
    return size + (-size * SIMILAR[0] // SIMILAR[1]) + 1


def similar(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Index pairs of Jaccard similarity SIMILAR or more that connect all sets which such pairs connect.

    Sets leave one after the other, each held against those that share one of its rarest members and are about as large.
    Where many are near it, it is held against all others: a set near it leaves too if no set that isn't near can be near
    to it: 1 - Jaccard is a metric, so the two are at least as far apart as their distances to the first differ. So the
    work follows the sets that share a rare member, and of a crowd of near ones only a few are held against the others.
    """
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    if n < 2:
        return
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    start = np.cumsum(size) - size
    rare = np.lexsort((codes, counts[codes], np.repeat(np.arange(n), size)))  # within each set, the rarest first
    known = prefix_size(size)
    tokens, owners = codes[rare[_ranges(start, known)]], np.repeat(np.arange(n), known)
    by_token = np.argsort(tokens, kind="stable")
    holders, ends = owners[by_token], np.cumsum(np.bincount(tokens, minlength=len(counts)))
    first_known, mark, live, others = np.cumsum(known) - known, np.zeros(len(counts), bool), np.ones(n, bool), None
    for first in range(n):
        if not live[first]:
            continue
        live[first] = False
        mine = tokens[first_known[first] : first_known[first] + known[first]]
        width = ends[mine] - np.concatenate(([0], ends))[mine]
        found = np.unique(holders[_ranges(ends[mine] - width, width)])
        found = found[live[found] & (np.minimum(size[found], size[first]) * SIMILAR[1] >= np.maximum(size[found], size[first]) * SIMILAR[0])]
        if not len(found):
            continue
        mark[codes[start[first] : start[first] + size[first]]] = True
        near = found[_apart(first, found, codes, start, size, mark)[0]]
        yield from ((first, int(i)) for i in near)
        if len(near) > CROWD:
            if others is None or live.sum() * 2 < len(others):
                others = np.flatnonzero(live)
            others = others[live[others]]
            close, apart = _apart(first, others, codes, start, size, mark)
            least = apart[~close].min(initial=np.inf)
            live[others[close & (apart < least - (1 - SIMILAR[0] / SIMILAR[1]) - 1e-9)]] = False
        mark[codes[start[first] : start[first] + size[first]]] = False


def _apart(first: int, others: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the other sets are near the first, whose members are marked, and 1 - Jaccard of each."""
    ends = np.cumsum(size[others])
    both = np.add.reduceat(mark[codes[_ranges(start[others], size[others])]], ends - size[others], dtype=np.int64)
    either = size[first] + size[others] - both
    return both * SIMILAR[1] >= either * SIMILAR[0], 1 - both / either


def _true_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links by `similar` within each candidate group."""
    out = []
    for _, part in pdf.sort_values(["_c", "_node"], kind="stable").drop_duplicates(["_c", "_node"]).groupby("_c", sort=False):
        nodes = part["_node"].to_numpy()
        out += [(nodes[i], nodes[j]) for i, j in similar([np.asarray(s, np.int64).view(np.uint64) for s in part["_set"]])]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _compared(held: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """_c, _node, pivot, near, apart: each set of the groups in `sizes` against PIVOTS sets of its group."""
    keyed = held.withColumn("_h", F.pmod(F.xxhash64("_node"), F.lit(PIVOTS)))
    ends = keyed.groupBy("_c", "_h").agg(F.min_by(F.struct("_node", "_set"), "_node").alias("_p"))
    facts = sizes.join(ends.groupBy("_c").agg(F.collect_list("_p").alias("_pivots")), "_c").select("_c", "_n", "_pivots")
    met = skewed_join(held, facts, ["_c"], "_n", total, ["_node"]).select("_c", "_node", "_set", F.explode("_pivots").alias("_p"))
    met = met.select("_c", "_node", F.col("_p._node").alias("pivot"), F.size(F.array_intersect("_set", "_p._set")).alias("_both"), (F.size("_set") + F.size("_p._set")).alias("_sum"))
    either = F.col("_sum") - F.col("_both")
    return met.select("_c", "_node", "pivot", (F.col("_both") * SIMILAR[1] >= either * SIMILAR[0]).alias("near"), (1 - F.col("_both") / either).alias("apart"))


def _by_rare_members(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets that share one of the rarest members of both in their group, where few share it; and the sets again
    in groups of their own where more do. No pair of similarity SIMILAR is lost."""
    members = held.select("_c", "_node", F.size("_set").alias("_s"), F.explode("_set").alias("_m"))
    counts = members.groupBy("_c", "_m").agg(F.count("*").alias("_f"))
    total = held.agg(F.sum(F.size("_set"))).first()[0] or 0
    ranked = skewed_join(members, counts.withColumn("_n", F.col("_f")), ["_c", "_m"], "_n", total, ["_node"])
    rare = materialise(ranked.where("_f > 1").groupBy("_c", "_node", "_s").agg(F.array_sort(F.collect_list(F.struct("_f", "_m"))).alias("_rare"))
        .join(ranked.where("_f = 1").groupBy("_c", "_node").agg(F.count("*").alias("_own")), ["_c", "_node"], "left")
        .withColumn("_left", F.col("_s") - F.ceil(F.col("_s") * SIMILAR[0] / SIMILAR[1]).cast("int") + 1 - F.coalesce("_own", F.lit(0)))
        .where("_left > 0").select("_c", "_node", "_s", F.explode(F.slice("_rare", F.lit(1), F.col("_left").cast("int"))).alias("_r")).select("_c", "_node", "_s", F.col("_r._m").alias("_m")))
    shared = materialise(rare.groupBy("_c", "_m").agg(F.count("*").alias("_n")).where("_n > 1"))
    few = rare.join(shared.where(f"_n <= {CROWD}").select("_c", "_m"), ["_c", "_m"])
    ids = few.groupBy("_c", "_m").agg(F.collect_list(F.struct("_node", "_s")).alias("_ids"))
    met = ids.select(F.explode("_ids").alias("x"), "_ids").select("x", F.explode("_ids").alias("y")).where(f"x._node < y._node and least(x._s, y._s) * {SIMILAR[1]} >= greatest(x._s, y._s) * {SIMILAR[0]}")
    pairs = met.select(F.col("x._node").alias("a"), F.col("y._node").alias("b")).distinct()
    side = lambda name: held.select(F.col("_node").alias(name), F.col("_set").alias(f"_set_{name}")).dropDuplicates([name])
    both = F.size(F.array_intersect("_set_a", "_set_b"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("_both", both).where(F.col("_both") * SIMILAR[1] >= (F.size("_set_a") + F.size("_set_b") - F.col("_both")) * SIMILAR[0])
    many = rare.join(shared.where(f"_n > {CROWD}").select("_c", "_m"), ["_c", "_m"]).select("_node", F.xxhash64("_c", "_m").alias("_c")).join(held.select("_node", "_set").dropDuplicates(["_node"]), "_node")
    return near.select("a", "b"), many.select("_node", "_c", "_set")


def true_links(held: DataFrame, limit: int = SHINGLES_PER_TASK) -> DataFrame:
    """held: _node, _c (candidate group), _set. Pairs (a, b) of Jaccard similarity SIMILAR or more that connect whatever
    such pairs connect within a group.

    Groups of up to `limit` shingles are each compared in one task. The sets of larger ones, wherever they are, are
    compared with some pivots of their group, round after round: a set near a pivot leaves once nothing that isn't near
    that pivot can be near the set (the bound of `similar`), and the pivots leave in any case. Where a round lets go of
    less than 1 / SLOW of the sets, what is left is paired by the rarest members that sets share, and where many share
    one, they are a group of their own. A group that this doesn't make smaller goes on with pivots alone.
    """
    found, last = None, None
    while True:
        sizes = materialise(held.groupBy("_c").agg(F.count("*").alias("_n"), F.sum(F.size("_set")).alias("_s")))
        total, shingled, n_big, most, in_big = sizes.agg(F.sum("_n"), F.sum(F.when(F.col("_s") <= limit, F.col("_s"))), F.count_if(F.col("_s") > limit), F.max("_n"), F.sum(F.when(F.col("_s") > limit, F.col("_n")))).first()
        tasks = parts_for(shingled, limit, 24)
        small = skewed_join(held, sizes, ["_c"], "_n", total or 0, ["_node"]).where(f"_s <= {limit}") if n_big else held
        here = small.withColumn("_p", F.pmod(F.xxhash64("_c"), F.lit(tasks))).groupBy("_p").applyInPandas(lambda pdf: _true_links(pdf), "a long, b long")
        found = here if found is None else found.union(here)
        if not n_big:
            return found
        big = sizes.where(f"_s > {limit}")
        met = materialise(_compared(held, big, total))
        found = materialise(found.union(met.where("near and _node <> pivot").select(F.col("_node").alias("a"), F.col("pivot").alias("b"))))
        least = met.groupBy("_c", "pivot").agg(F.min(F.when(~F.col("near"), F.col("apart"))).alias("_least"), F.count("*").alias("_n"))
        judged = skewed_join(met.where("near"), least, ["_c", "pivot"], "_n", total * PIVOTS, ["_node"])
        bound = 1 - SIMILAR[0] / SIMILAR[1] + 1e-9
        done = judged.where((F.col("_node") == F.col("pivot")) | F.col("_least").isNull() | (F.col("apart") < F.col("_least") - bound)).select("_c", "_node").distinct()
        held = materialise(skewed_join(held, big, ["_c"], "_n", total, ["_node"]).drop("_s").join(done, ["_c", "_node"], "left_anti"))
        left = held.count()
        if (in_big - left) * SLOW < in_big and most != last:
            last = most
            near, held = _by_rare_members(held)
            found, held = found.union(near), materialise(held)


def one_of_each(docs: DataFrame, budget: int = 3, seeds: int = 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of least id of each near-duplicate group; every column stays.

    Texts are linked where their sets of five-word shingles (ASCII lower case) have a Jaccard similarity of 0.8 or more.
    Candidates are texts whose fingerprints differ by up to `budget` bits under one seed at least, over distinct words:
    with shingles, texts that share 0.8 of them differ by 11 of 64 bits in the median, further than any budget that
    still prunes; over words it's 3, and the seeds find the rest. All pairs of a group of candidates are then verified
    on their shingles before they count as links. Null or wordless texts are one group. Null ids are in no group and
    stay. Rows that repeat an id are judged by their own texts; rows that repeat a kept row stay. Very long texts: held
    one at a time, in blocks of words. Empty table: no rows. Extra columns stay, whatever their names.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[["_id", "_n1", "_n2"]].assign(_fps=[np.array(word_fingerprints(t if isinstance(t, str) else None, seeds), np.uint64).view(np.int64) for t in pdf["_text"]])

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[["_node", "_c"]].assign(_set=[shingles(t if isinstance(t, str) else None).view(np.int64) for t in pdf["_text"]])

    text = F.coalesce(F.col(text_col), F.lit(""))
    name = [F.xxhash64(text).alias("_n1"), F.xxhash64(F.lit(1), text).alias("_n2")]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *name)
    # Equal texts share all fingerprints, so each is one node. What moves is the fingerprints and not the texts.
    named = materialise(rows.mapInPandas(batches, "_id long, _n1 long, _n2 long, _fps array<long>"))
    texts = named.groupBy("_n1", "_n2").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"), F.first("_fps").alias("_fps"))
    texts = materialise(texts.withColumn("_node", F.monotonically_increasing_id()))
    marks = texts.select("_node", F.posexplode("_fps").alias("seed", "fp"))
    fps = materialise(marks.groupBy("seed", "fp").agg(F.min("_node").alias("rep")))
    same = marks.join(fps, ["seed", "fp"]).where("_node <> rep").select(F.col("_node").alias("a"), F.col("rep").alias("b"))
    maybe = materialise(components(same.union(links(fps, budget))).select(F.col("node").alias("_node"), F.col("component").alias("_c")))
    near = texts.join(maybe, "_node").select(F.col("_first").alias("_id"), "_n1", "_n2", "_node", "_c")
    held = materialise(rows.join(near, ["_id", "_n1", "_n2"]).select("_node", "_c", "_text").mapInPandas(sets, "_node long, _c long, _set array<long>"))
    of = texts.join(components(true_links(held)).select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn("_group", F.coalesce("component", "_node"))
    best = of.groupBy("_group").agg(F.min(F.struct("_first", "_node")).alias("_best"))
    judged = of.join(best, "_group").where("_n > 1 or _node <> _best._node").select("_n1", "_n2", "_first", "_n", (F.col("_node") == F.col("_best._node")).alias("_stays"))
    judged = materialise(judged)
    total = judged.agg(F.sum("_n")).first()[0] or 0
    met = skewed_join(named.drop("_fps"), judged, ["_n1", "_n2"], "_n", total, ["_id"])
    key, other = fresh(docs, "_name"), fresh(docs, "_other")
    gone = met.where(~F.col("_stays") | (F.col("_id") != F.col("_first"))).select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("_n1").alias(key), F.col("_n2").alias(other)).distinct()
    return docs.withColumns({key: name[0], other: name[1]}).join(gone, [id_col, key, other], "left_anti").select(*docs.columns)
