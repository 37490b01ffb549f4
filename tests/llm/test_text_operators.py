import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import xxhash

from pyspark.sql import functions as F

from caselens.llm import common as common_helpers
from caselens.llm import decontamination, exact_dedup, host_rules, language_id, line_dedup, quality_model, sharding, simhash


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def frame(spark, rows):
    """Rows of (doc_id, text) with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in rows], "doc_id long, text string, source string, shard int, h1 string")


ODD = [(5000, None), (5001, ""), (5002, "a" * 500), (5003, "a" * 120), (5004, "a" * 49), (5005, " \n\t "), (5006, "é" * 70)]


# --- exact repeats -------------------------------------------------------------------------------------------------


def brute_repeats(docs):
    first, out = {}, {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49 if i is not None else 0):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, t in docs:
        b = (t or "").encode()
        off = [False] * len(b)
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k : k + 50]] < i:
                off[k : k + 50] = [True] * 50
        kept = bytes(x for x, o in zip(b, off, strict=True) if not o)
        out.setdefault(i, []).append((len(b), sum(off), sum(o and (k == 0 or not off[k - 1]) for k, o in enumerate(off)), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def repeat_docs(R):
    pool = ["".join(R.choice("abcd é\n") for _ in range(R.randint(30, 200))) for _ in range(12)]
    doc = lambda: "".join(R.choice(pool)[R.randint(0, 40) : R.randint(40, 200)] if R.random() < 0.7 else "".join(R.choice("xyz") for _ in range(R.randint(1, 60))) for _ in range(R.randint(0, 7))) * R.choice([1, 1, 2])
    docs = [(i, doc()) for i in R.sample(range(1000), 100)] + ODD
    return docs + docs[:5], pool


def test_exact_repeats(spark):
    docs, pool = repeat_docs(random.Random(3))
    docs += [(None, pool[0] * 2), (docs[0][0], docs[1][1])]
    got = {}
    for r in exact_dedup.repeat_digest(frame(spark, docs), batch_bytes=2000).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(docs)


@pytest.mark.parametrize(("block", "hot", "chunk"), [(1 << 16, 1024, 1 << 20), (37, 1, 500), (1 << 16, 3, 2000), (200, 0, 1)])
def test_exact_repeats_by_letters(monkeypatch, block, hot, chunk):
    """The steps that tasks take, in one process, at other sizes of blocks, chunks and hot samples."""
    for name, value in (("BLOCK", block), ("HOT_RUNS", hot), ("CHUNK", chunk)):
        monkeypatch.setattr(exact_dedup, name, value)
    docs, _ = repeat_docs(random.Random(block + hot))
    batches = [pd.DataFrame(docs[k::5], columns=["_id", "_text"]) for k in range(5)]
    reply = lambda letters, rule: pd.concat([rule(g) for _, g in pd.concat(letters).groupby("part")])
    made = [exact_dedup.Batch(b) for b in batches]
    first = reply([exact_dedup._sample_letters(k, 3, *b.ask_samples()) for k, b in enumerate(made)], exact_dedup._answer_samples)
    asked = [b.entries(b.state(exact_dedup._replies(first[first.batch == k], 1, np.int8), b.ask_samples()[0]), 3) for k, b in enumerate(made)]
    second = reply([exact_dedup._entry_letters(k, e) for k, e in enumerate(asked)], exact_dedup._answer_entries)
    got = {}
    for k, (b, e) in enumerate(zip(made, asked, strict=True)):
        for r in exact_dedup._settle(b, e, exact_dedup._replies(second[second.batch == k], 2, np.uint32)).itertuples():
            got.setdefault(r._1, []).append((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(docs)


def test_refined_buckets():
    """Buckets are those of equal 50 bytes, in their order."""
    R = random.Random(4)
    entries = ["".join(R.choice("ab") for _ in range(R.choice([50, 55, 75]))) for _ in range(40)]
    entries += [e[:30] + "z" * 20 for e in entries] + [e + "q" for e in entries]
    joined = "".join(entries).encode()
    left = np.concatenate([np.arange(len(e), 0, -1) for e in entries])
    at, pointer = exact_dedup.refine_buckets(np.frombuffer(joined, np.uint8), left)
    strings = [joined[a : a + 50] for a in at.tolist()]
    assert at.tolist() == [a for a in range(len(joined)) if left[a] >= 50]
    order = np.argsort(pointer, kind="stable")
    assert all((strings[a] == strings[b]) == (pointer[a] == pointer[b]) for a in range(0, len(at), 3) for b in range(len(at)))
    assert [strings[k] for k in order] == sorted(strings)


def test_exact_repeats_of_nothing(spark):
    assert exact_dedup.repeat_digest(frame(spark, [])).isEmpty()


# --- lines ---------------------------------------------------------------------------------------------------------


def test_edit_distance():
    R = random.Random(1)
    for _ in range(5000):
        a, b = ("".join(R.choice("ab") for _ in range(R.randint(0, 9))) for _ in range(2))
        k = R.randint(1, 3)
        assert line_dedup.within(a, b, k) == (edits(a, b) <= k)


@pytest.mark.parametrize("hot", [16, 2])
def test_lines(spark, monkeypatch, hot):
    R = random.Random(1)
    base = ["".join(R.choice("abcdefgh ") for _ in range(R.randint(24, 40))).strip().ljust(24, "z") for _ in range(6)]

    def changed(s):
        s = list(s)
        for _ in range(R.choice([0, 1, 1, 2])):
            o, i = R.random(), R.randrange(len(s))
            if o < 0.4:
                s[i] = R.choice("abcdefgh")
            elif o < 0.7:
                s.insert(i, R.choice("abcdefgh"))
            else:
                del s[i]
        return "".join(s)

    docs = [(i, "\n".join(changed(R.choice(base)) if R.random() < 0.8 else "x" for _ in range(R.randint(1, 6)))) for i in range(80)] + ODD + [(None, base[0])]
    monkeypatch.setattr(line_dedup, "HOT_KEY", hot)
    df = frame(spark, docs)
    got = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
    texts = {r.doc_id: r.text for r in line_dedup.without_repeats(df).collect()}
    before = []
    for i, t in docs:
        if i is None:
            assert got[i].n_dropped == 0 and texts[i] == t
            continue
        lines, gone = t.split("\n") if t is not None else [], []
        for n, raw in enumerate(lines):
            line = raw.strip(" \t\r")
            if len(line) >= line_dedup.MIN_CHARS:
                if any(abs(len(line) - len(p)) < 2 and line_dedup.within(line, p) for p in before):
                    gone.append(n)
                before.append(line)
        assert (got[i].n_lines, got[i].dropped_lines) == (len(lines), ",".join(map(str, gone)))
        assert texts[i] == (None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone))


def test_short_lines_repeat(spark):
    docs = [(1, "All rights reserved.\nYes.\n* * *\nÀ é í\nOf, edti oner."), (2, " All rights reserved.\nYes.\n* * *\nÀ é í\nOf, edti onex."), (3, "x\nOf, edti oner.\t\nErheed. Titionly.\nErheed. Titionly.")]
    got = {r.doc_id: (r.dropped_lines, r.n_near) for r in line_dedup.line_report(frame(spark, docs)).collect()}
    assert got == {1: ("", 0), 2: ("0", 0), 3: ("1,3", 0)}


def test_lines_of_repeated_ids(spark):
    """Rows that repeat an id lose their own lines only; columns named like the operator's own stay."""
    a, b, c, d = ("The %s line is long enough to count here." % x * 2 for x in ("first", "second", "third", "fourth"))
    rows = [(1, a, "p"), (2, a + "\n" + b, "q"), (2, c + "\n" + d, "r"), (2, None, "s"), (3, c + "\n" + "x", "t"), (3, c + "\n" + "x", "t"), (None, a, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _dropped string").withColumns({"_lines": F.lit(1), "_name": F.lit(2)})
    got = sorted((r._dropped, r.text, r._lines, r._name) for r in line_dedup.without_repeats(df).collect())
    assert got == [("p", a, 1, 2), ("q", b, 1, 2), ("r", c + "\n" + d, 1, 2), ("s", None, 1, 2), ("t", "x", 1, 2), ("t", "x", 1, 2), ("u", a, 1, 2)]
    assert sorted((r.doc_id or 0, r.dropped_lines) for r in line_dedup.line_report(df).collect()) == [(0, ""), (1, ""), (2, ""), (2, ""), (2, "0"), (3, "0"), (3, "0")]


def test_a_long_text_and_a_common_line(spark, monkeypatch):
    common = "This very line is in all of the documents."
    monkeypatch.setattr(common_helpers, "SALTS", 2)
    docs = [(i, f"{common}\nline number {i} with its own words {'abcdefghij'[i % 10] * 30}") for i in range(300)] + [(900, "\n".join(f"{k} ordinary {k * 7919} words {k % 97}" for k in range(30_000)) + "\n" + common)]
    got = {r.doc_id: r for r in line_dedup.line_report(frame(spark, docs)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].dropped_lines.startswith("0") for i in range(1, 300)) and got[900].dropped_lines.endswith("30000")


def test_no_lines(spark):
    assert line_dedup.line_report(frame(spark, [])).isEmpty()


# --- fingerprints --------------------------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints, budget):
    label = {i: i for i, _ in prints}
    while True:
        before = dict(label)
        for i, a in prints:
            for j, b in prints:
                if bin(a ^ b).count("1") <= budget:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label


@pytest.mark.parametrize("limit", [1024, 3])
def test_simhash(spark, monkeypatch, limit):
    R = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(R.choice(words) for _ in range(R.randint(1, 12)))) for i in range(60)] + ODD
    docs += [(9000 + i, docs[i][1]) for i in range(10)]
    monkeypatch.setattr(simhash, "GROUP_LIMIT", limit)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, docs)).collect()}
    prints = [(i, brute_print(t)) for i, t in docs]
    label = groups(prints, 2)
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints}


@pytest.mark.parametrize("limit", [1024, 8])
def test_trie_join_of_close_values(spark, monkeypatch, limit):
    R = random.Random(4)
    centres = [R.getrandbits(64) for _ in range(5)]
    values = sorted({c ^ sum(1 << b for b in R.sample(range(64), R.randint(0, 4))) for c in centres for _ in range(40)})
    monkeypatch.setattr(simhash, "GROUP_LIMIT", limit)
    fps = spark.createDataFrame([(0, v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)], "seed int, fp long, rep long")
    from caselens.llm.components import components

    got = {r.node: r.component for r in components(simhash.links(fps, 2)).collect()}
    want = groups(list(enumerate(values)), 2)
    assert {i: got.get(i, i) for i in want} == want


def test_one_of_each(spark):
    R = random.Random(6)
    text = " ".join("".join(R.choice("abcdefgh") for _ in range(9)) for _ in range(60))
    other = " ".join("".join(R.choice("abcdefgh") for _ in range(9)) for _ in range(60))
    docs = [(3, text), (7, text), (5, text.replace(text.split()[5], "changedword")), (4, other), (None, text), (8, None), (9, "")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.one_of_each(frame(spark, docs)).collect()) == [(False, 3), (False, 4), (False, 8), (True, 0)]
    assert simhash.near_duplicates(frame(spark, [])).isEmpty()


def test_one_of_each_of_repeated_ids(spark):
    """Rows that repeat an id are judged by their own texts."""
    R = random.Random(26)
    a, b, c = (" ".join("".join(R.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(3))
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (2, near), (2, b), (3, b), (4, c), (4, c), (5, c), (6, None), (7, " "), (None, a)]
    got = sorted((r.doc_id or 0, r.text or "") for r in simhash.one_of_each(frame(spark, rows).withColumns({"_name": F.lit(1), "_n": F.lit(1)})).collect())
    assert got == sorted([(0, a), (1, a), (2, b), (4, c), (4, c), (6, "")])
    assert simhash.one_of_each(frame(spark, [])).isEmpty()


def test_links_of_large_groups(spark):
    """Groups too large for a task, compared by pivots, end up connected as all their pairs connect them."""
    R = random.Random(28)
    sets = []
    for c in range(3):
        base = [R.getrandbits(40) for _ in range(40)]
        for _ in range(45):
            changed = set(R.sample(range(40), R.randint(0, 12)))
            sets.append((len(sets), c, [R.getrandbits(40) if i in changed else x for i, x in enumerate(base)]))
    held = spark.createDataFrame(sets, "_node long, _c long, _set array<long>")
    near = [(a[0], b[0]) for a in sets for b in sets if a[0] < b[0] and 5 * len(set(a[2]) & set(b[2])) >= 4 * len(set(a[2]) | set(b[2]))]

    def reach(pairs):
        label = {x[0]: x[0] for x in sets}
        while True:
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                return label

    for limit in (10**6, 900):
        pairs = [(r.a, r.b) for r in simhash.true_links(held, limit).collect()]
        assert reach(pairs) == reach(near) and all((min(p), max(p)) in set(near) for p in pairs)
    assert len(set(reach(near).values())) > 5


def test_fingerprints_of_long_texts(monkeypatch):
    R = random.Random(27)
    text = " ".join(R.choice(["w%d" % i for i in range(5000)]) for _ in range(20_000))
    whole = simhash.fingerprint(text), simhash.word_fingerprints(text, 3)
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    assert (simhash.fingerprint(text), simhash.word_fingerprints(text, 3)) == whole
    assert whole[0] == brute_print(text)


def test_near_duplicates_share_shingles(spark):
    """Links are those of five-word shingles with a similarity of 0.8, on either side of that bound and for any words."""
    R = random.Random(16)
    short = lambda n: [R.choice("abcdefgh") + R.choice("aeiou") + R.choice("lmnr") + R.choice(["", "s", "t", "ing"]) for _ in range(n)]
    docs, long = [], ["".join(R.choice("abcdefgh") for _ in range(9)) for _ in range(40)]
    for k in range(12):
        words = short(R.choice([60, 120, 240]))
        docs += [(10 * k, words), (10 * k + 1, words[:30] + ["changed"] + words[31:]), (10 * k + 2, [w if i % 8 else "z" + w for i, w in enumerate(words)])]
    docs += [(500, [x for w in long for x in (w, "in", "the")]), (501, [x for w in long for x in (w, "or", "of")]), (502, long[::-1])]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in docs}
    near = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id for r in simhash.one_of_each(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()}
    assert got == {i for i in sets if label[i] == i} and {500, 501, 502, 2} <= got and 1 not in got
    names = [i for i, _ in docs]
    pairs = [(names[a], names[b]) for a, b in simhash.similar([simhash.shingles(" ".join(w)) for _, w in docs])]
    reach = {i: i for i in sets}
    for _ in sets:
        for a, b in pairs:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert reach == label


# --- counts, hosts -------------------------------------------------------------------------------------------------


def test_counts():
    R = random.Random(7)
    for _ in range(200):
        text = "".join(R.choice(["a", "b", "é", " ", "\n", "#", "|", "\x0b", "\xa0"]) for _ in range(R.randint(0, 120)))
        words = text.encode().split()
        at = {}
        for i in range(len(words) - 4):
            at.setdefault(tuple(words[i : i + 5]), []).append(i)
        hit = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert host_rules.counts(text) == want


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(20))
    rows = [(i, "short", "bad") for i in range(30)] + [(100, good, "bad"), (101, None, "ok"), (102, good, None)] + [(200 + i, good, "ok") for i in range(30)]
    got = {r.doc_id: r.kept for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[100] and not got[101] and got[102] and got[200] and not got[0]
    assert host_rules.judge(frame(spark, [])).isEmpty()


# --- shards --------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, f"t{i % 7}é", "big" if i % 3 else f"s{i % 5}") for i in range(500)] + [(500, None, None), (500, None, None), (None, "", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(df, 7, rows_per_bucket=20).collect()
    assert len(got) == len(rows)
    per = {s: [r for r in got if r.shard == s] for s in range(7)}
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for part in per.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    share = [sum(r.stratum == "big" for r in p) for p in per.values()]
    assert max(share) - min(share) <= 4  # of 47 on average; the five other strata round too
    texts = {i: t for i, t, _ in rows}
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert sharding.interleave(frame(spark, []), 7).isEmpty()


def test_shards_keep_copies_together(spark):
    R = random.Random(14)
    rows = [(i, f"text {R.randrange(150)}", R.choice("aab")) for i in range(900)]
    shards = {}
    for r, t in ((r, dict((i, t) for i, t, _ in rows)[r.doc_id]) for r in sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5).collect()):
        shards.setdefault(t, set()).add(r.shard)
    assert sum(len(s) == 1 for s in shards.values()) > 0.8 * len(shards)


def test_shards_against_brute_force(spark, monkeypatch):
    """The hashes are Spark's; ranks, fractions and the cut are made anew from exact fractions."""
    R = random.Random(12)
    rows = [(i, f"t{i}", R.choice("aaaab")) for i in range(400)] + [(999, "same", "a")] * 300 + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for per_bucket in (10, 10_000):
        buckets = max(128, -(-len(rows) // per_bucket))
        hashed = df.select("*", F.xxhash64(F.lit(17), F.coalesce("text", F.lit(""))).alias("h")).collect()
        order = []
        for source in {r.source for r in hashed}:
            own = sorted(((r.h % buckets, r.text == "same", r.h), r.doc_id or 0) for r in hashed if r.source == source)
            order += [(Fraction(2 * k + 1, 2 * len(own)), "-" if source is None else f"+{source}", k, i) for k, (_, i) in enumerate(own)]
        want = [i for *_, i in sorted(order)]
        got = sorted((r.shard, r.slot, r.doc_id or 0) for r in sharding.interleave(df, 7, rows_per_bucket=per_bucket).collect())
        assert len(got) == len(rows) and [i for *_, i in got] == want
        assert [g[:2] for g in got] == [(s, k) for s in range(7) for k in range((len(rows) * (s + 1) + 6) // 7 - (len(rows) * s + 6) // 7)]


# --- models --------------------------------------------------------------------------------------------------------


def spoken(R, letters, n):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 7))) for _ in range(n))


def test_languages(spark):
    R = random.Random(8)
    alphabets = {"en": "abcdefgh", "de": "abcdefgz", "fr": "mnopqrst", "es": "mnopqrsy"}
    rows = [(i, spoken(R, alphabets[k], 30), k) for i in range(400) for k in [R.choice(list(alphabets))]]
    rows += [(900, None, "en"), (901, "123 !", "en"), (902, "", None), (None, "abcz abz", None)]
    got = {r.doc_id: r for r in language_id.predict_all(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 60).collect()}
    held = [(got[i], k) for i, t, k in rows[:400] if got[i].held_out]
    assert {i for i in got if i is not None and i < 400 and got[i].held_out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == k for r, k in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values()) and {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language_id.predict_all(spark.createDataFrame([], "doc_id long, text string, lang string")).isEmpty()


def test_grades(spark):
    R = random.Random(9)
    make = {0: lambda: spoken(R, "abcde", 20).replace(" ", "*** "), 1: lambda: spoken(R, "abcde", 15) + " nasty " + spoken(R, "abcde", 5), 2: lambda: spoken(R, "abcde", 20)}
    kinds = [R.choice([0, 1, 2, 2]) for _ in range(600)]
    docs = spark.createDataFrame([*((i, make[k]()) for i, k in enumerate(kinds)), (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k > 0), int(k == 1)) for i, k in enumerate(kinds) if i < 400] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.classify(docs, labels).collect()}
    assert np.mean([got[i].kept == (k == 2) for i, k in enumerate(kinds) if i >= 400]) > 0.9
    assert not got[1000].kept and got[1000].p_clean is None and got[1001].p_clean is not None
    assert all(r.p_good >= r.p_clean for r in got.values() if r.p_clean is not None)
    none = quality_model.classify(docs, labels.limit(0)).collect()
    assert len(none) == 602 and not any(r.kept for r in none)


# --- benchmark -----------------------------------------------------------------------------------------------------


def test_leaks(spark):
    item = "A train travels 60 km in 2 hours and then another 60 km in 3 hours, so what is its average speed for Alice overall?"
    again = "A train travels 75 km in 4 hours and then another 75 km in 5 hours, so what is its average speed for Bella overall?"
    wrong = "A train travels 75 km in 4 hours and then another 90 km in 5 hours, so what is its average speed for Bella overall?"
    docs = [(1, "Words before. " + item + " Words after."), (2, again), (3, wrong), (4, "nothing of the sort is told here at all"), (5, None), (6, ""), (None, item)]
    bench = spark.createDataFrame([(0, item), (1, "a b"), (2, None), (None, item), (3, ""), (4, " \n")], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.n_changed) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got[1] == (0, 0) and got[2][0] == 0 and got[2][1] > 0 and 3 not in got and None in got and 4 not in got
    assert {r.doc_id for r in decontamination.clean(frame(spark, docs), bench).collect()} == {3, 4, 5, 6, None}
    assert decontamination.leaks(frame(spark, docs), bench.limit(0)).isEmpty() and decontamination.leaks(frame(spark, []), bench).isEmpty()


def test_leaks_of_short_items(spark):
    items = ["12 + 30 = 42", "If Alice gives Bob 5 kg", "Did Marie Curie Win The Nobel Prize?", "What is the capital of France?", "Alice sold every apple on the old market"]
    docs = [(1, "Now 12 + 30 = 42."), (2, "so IF alice gives Bob 5 kg, then"), (3, "Quiz: Did Marie Curie\nWin The Nobel Prize?"), (4, "Quiz A\nWhat is the capital of France?"), (5, "as What is the capital of\nFrance?")]
    docs += [(6, "12 + 30 = 43"), (7, "If Alice gives Bob 6 kg"), (8, "yesterday Bella sold every apple on the old market"), (9, "What is the weather of France?")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_changed) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 3, 0), (8, 4, 1)}


def test_leaks_of_very_short_items(spark):
    items = ["2 + 2 =", "1 2 3 4 5 6", "Prove Fermat's theorem", "Why?"]
    docs = [(1, "so 2 + 2 = what"), (2, "a 1 2 3 4 5 6 b"), (3, "Exercise\n prove Fermat's Theorem. \nnext"), (4, "we prove Fermat's theorem here"), (5, "Why?"), (6, "why not"), (6, "WHY"), (7, "2 + 3 =")]
    bench = spark.createDataFrame([*enumerate(items), (9, "Why?")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (5, 3), (5, 9), (6, 3), (6, 9)}
    kept = sorted((r.doc_id, r.text) for r in decontamination.clean(frame(spark, docs).withColumn("_name", F.lit(1)), bench).collect())
    assert kept == [(4, "we prove Fermat's theorem here"), (6, "why not"), (7, "2 + 3 =")]


def brute_leaks(docs, items):
    """Every item held against every text, window by window, without hashes, bitmap or joins."""
    canon, exact, out = decontamination.Canon(), decontamination.Exact(), set()
    for i, text in docs:
        readings = decontamination.templates(text, canon)
        for k, item_text in items:
            item = decontamination.item_of(item_text, canon, exact)
            ours, met = item.template, set()
            same = lambda a, b: all(x == y for x, y in zip(a, b, strict=True))
            for j in sorted({j for _, j in item.windows}):
                for t in readings:
                    for at in range(len(t.words) - item.width + 1):
                        tail = same(ours.hashes[j + 1 : j + item.width], t.hashes[at + 1 : at + item.width])
                        if tail and {int(ours.hashes[j]), int(ours.other[j])} & {int(t.hashes[at]), int(t.other[at])}:
                            met.add((j, at, b" ".join(t.words[at : at + item.width])))
            if decontamination.judge(item, sorted(met)):
                out.add((i, k))
    return out


def test_leaks_against_brute_force(spark):
    """Items share an opening and differ behind it; texts hold them whole, cut, re-parameterised and inconsistently."""
    R = random.Random(17)
    word = lambda: R.choice(["apple", "river", "stone", "cloud", "paper", "green", "seven", "often"])
    opening = "Read the question below and answer with care as well as you can"
    items = [(k, f"{opening}: {word()} {word()} Alice has {R.randint(2, 99)} {word()} {word()} and {word()} {word()} {R.randint(2, 99)} km {word()} {word()} {word()}") for k in range(25)]
    docs = []
    for i in range(120):
        words = R.choice(items)[1].split()
        lo, hi = sorted(R.sample(range(len(words) + 1), 2)) if R.random() < 0.5 else (0, len(words))
        cut = [str(R.randint(2, 99)) if w.isdigit() and R.random() < 0.5 else R.choice(["Bella", "Alice"]) if w == "Alice" else w for w in words[lo:hi]]
        docs.append((i, " ".join([word(), *cut, word()]) + R.choice(["", "\n" + opening])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 30


# --- very long texts, empty tables ---------------------------------------------------------------------------------


def test_long_texts_in_blocks(monkeypatch):
    """What is read in blocks gives the same as what is read at once."""
    R = random.Random(31)
    text = " ".join(spoken(R, "abcdefghé", 3) + R.choice([".", "", "\n", " 12"]) for _ in range(4000))
    model = language_id.Model({"a": ["x", "y"]}, np.random.default_rng(1).normal(size=(language_id.SIZE, 2)).astype(np.float32), np.zeros(2), {"a": [("x", "y", 1)]})
    grades = quality_model.Model(np.random.default_rng(2).normal(size=quality_model.WORDS + quality_model.GRAMS).astype(np.float32), np.array([0.0, 1.0]))
    seen = lambda: (language_id.features(text), model.predict(text)[0], quality_model.features(text, quality_model._Buckets()), grades.score(text, quality_model._Buckets()))
    whole = seen()
    for module in (language_id, quality_model):
        monkeypatch.setattr(module, "BLOCK", 5000)
    parts = seen()
    assert parts[1] == whole[1] and abs(parts[3] - whole[3]) < 1e-2
    assert np.array_equal(parts[2][0], whole[2][0]) and np.allclose(parts[2][1], whole[2][1])
    # A gap of other characters that a block cuts counts twice at most.
    assert len(np.setxor1d(parts[0][0], whole[0][0])) <= 40 and abs(parts[0][1].sum() - 1) < 1e-3
    item = "seven green apples rolled down the long hill past Alice and 12 other people"
    canon, exact = decontamination.Canon(), decontamination.Exact()
    shape = decontamination.item_of(item, canon, exact)
    bitmap = np.zeros(1 << 21, np.uint8)
    for h, _ in shape.windows:
        bitmap[h >> 43] |= 1 << (h >> 40 & 7)
    found = decontamination.Scan([(shape.kind, shape.width)], bitmap).windows(f"{text} {item} {text}")
    assert decontamination.judge(shape, [(j, at, w.encode()) for at, h, w in found for g, j in shape.windows if g == h])
    words = text.encode().split()
    assert host_rules.counts(text * 3)[0] == 3 * len(words) - 2 * (not text[-1:].isspace() and not text[:1].isspace())


def test_letters():
    assert [language_id.has_letter(x) for x in ("²½Ⅷ 12 _", "a", "日", "é", "", "ʰ")] == [False, True, True, True, False, True]


def test_samples_of_repeated_rows(spark):
    """A row that is repeated often counts once, so the bounds hold; null ids take part."""
    rows = [(7, "en", "one two three")] * 500 + [(i, "en", f"text {i}") for i in range(40)] + [(None, "de", "drei vier")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").select("doc_id", "lang", F.xxhash64("text").alias("_t"))
    got = language_id.sample(df, 10).collect()
    assert sorted(r.lang for r in got) == ["de"] + ["en"] * 10 and len({tuple(r) for r in got}) == 11
    order = sorted({(r.h, r.doc_id) for r in df.where("lang = 'en'").select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 52).alias("b"), F.xxhash64("doc_id").alias("x")).select(F.struct("b", "x").alias("h"), "doc_id").collect()})
    assert {r.doc_id for r in got if r.lang == "en"} == {i for _, i in order[:10]}


def test_grades_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(docs, labels).isEmpty()
