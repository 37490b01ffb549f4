"""Large candidate groups of sets that aren't near: the work follows the pairs that share a rare member."""

import random
import time

import numpy as np

from caselens.llm import simhash


def reach(ids, pairs):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def unlike(n, size, words, seed=4):
    """Sets that share part of their members with all others and few with any one, two in a hundred with a near copy."""
    R = np.random.default_rng(seed)
    common = R.integers(0, 1 << 40, size // 3)
    sets = []
    for i in range(n):
        if i % 100 == 1:
            near = sets[-1].copy()
            near[-3:] = R.integers(0, 1 << 40, 3)
            sets.append(np.unique(near))
        else:
            sets.append(np.unique(np.concatenate([common, R.integers(0, words, size - len(common))])))
    return sets


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_twenty_thousand_unlike_sets():
    sets = [s.astype(np.uint64) for s in unlike(20_000, 100, 1 << 40)]
    began = time.process_time()
    pairs = set(simhash.similar(sets))
    assert time.process_time() - began < 60  # against each other they would be 200 million comparisons
    assert pairs == {(i - 1, i) for i in range(1, 20_000, 100)}


def test_prefixes_lose_no_pair():
    R = random.Random(9)
    for size in (1, 2, 4, 5, 9, 10, 100):
        assert simhash.prefix_size(np.array([size]))[0] == size - -(-size * 4 // 5) + 1
    for _ in range(30):
        base = R.sample(range(10_000), R.randint(1, 60))
        sets = [np.array(sorted(set(base[: R.randint(1, len(base))] + R.sample(range(60), R.randint(0, 8)))), np.uint64) for _ in range(R.randint(2, 120))]
        near = [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
        got = list(simhash.similar(sets))
        assert set(got) <= set(near) and reach(range(len(sets)), got) == reach(range(len(sets)), near)


def test_groups_over_a_task_are_paired_by_rare_members(spark, monkeypatch):
    """Rounds of pivots alone would be a round for every eight sets."""
    rounds = []
    plain = simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda *a: rounds.append(1) or plain(*a))
    sets = [s.astype(np.int64) for s in unlike(300, 30, 1 << 40)] + [s.astype(np.int64) for s in unlike(120, 20, 60, 5)]
    copies = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 50))
    for i in range(60):
        one = copies.copy()
        one[i % 50] = i
        sets.append(np.unique(one))
    rows = [(i, 7, s.tolist()) for i, s in enumerate(sets)]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    held = spark.createDataFrame(rows, "_node long, _c long, _set array<long>")
    got = [(r.a, r.b) for r in simhash.true_links(held, 2500).collect()]
    assert {(min(p), max(p)) for p in got} <= set(near)
    assert reach(range(len(sets)), got) == reach(range(len(sets)), near) and len(near) > 1000
    assert len(rounds) < 20
