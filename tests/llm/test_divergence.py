import re
from collections import Counter

import numpy as np
import pytest

from caselens.llm import divergence
from caselens.llm.divergence import SCALE, audit, tally

SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs):
    """Every cell of every pair of sources, with Python's integers."""
    rows = [(lang or "", source or "", Counter(TERM.findall(lower(text or "")))) for text, lang, source in docs]
    out = set()
    for lang in {r[0] for r in rows}:
        docs_of = Counter(t for la, _, c in rows if la == lang for t in c)
        kept = {t for t, n in docs_of.items() if n >= 3}
        of = {}
        for la, s, c in rows:
            if la == lang:
                of.setdefault(s, Counter()).update({t: n for t, n in c.items() if t in kept})
        whole = sum(of.values(), Counter())
        v = len(kept)
        p = lambda c, t: 1 + SCALE * (c[t] + 1) // (sum(c.values()) + v)  # noqa: B023, E731
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in of.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), o.encode()) for o, d in of.items() if o != s]
            terms = [(-f(p(c, t), p(whole, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                out |= {(lang, s, part, i.decode(), -value, r) for r, (value, i) in enumerate(sorted(items)[:most], 1)}
    return out


def run(spark, docs):
    rows = [(i, *d, "x", "y") for i, d in enumerate(docs)]
    return [tuple(r) for r in audit(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_against_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ärger", "ärger", "ÄRGER", "日本", "x" * 30_000]
    docs = []
    for _ in range(160):
        lang = ["en", "de", None][rng.integers(3)]
        source = ["a", "a", "a", "b", "c", "é", "", None][rng.integers(8)]
        docs.append((" ".join(words[int(len(words) * x**2)].upper() if x > 0.7 else words[int(len(words) * x**2)] for x in rng.random(rng.integers(0, 60))), lang, source))
    docs += [docs[0]] * 5 + [(None, "en", "no text"), ("", "xx", "lonely"), ("1 2 3 _ [ ]", "yy", "p"), (None, "yy", "q"), ("a b", "zz", "r"), ("b a", "zz", "s")]
    docs += [(f"term{chr(97 + i // 26)}{chr(97 + i % 26)} " * 2, "many", f"s{i < 250}") for i in range(500) for _ in range(3)]
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "ROWS_PER_PART", 40)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    got, want = run(spark, docs), brute(docs)
    assert len(got) == len(set(got)) and set(got) == want
    assert max(r[5] for r in got if r[2] == "term") == 200  # cut there
    assert ("yy", "p", "pair", "q", 0, 1) in want  # no kept term


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_counts_are_exact(spark):
    big = 9_000_000_000_000
    row = spark.createDataFrame([(big, 10 * big, 7)], "c long, n long, v long").select(divergence.share("c", "n", "v").alias("p")).first()
    assert row.p == 1 + SCALE * (big + 1) // (10 * big + 7)
    row = spark.createDataFrame([(SCALE + 1, 1)], "p long, q long").select(divergence.gap("p", "q").alias("f")).first()
    assert row.f == SCALE**2


def test_tally():
    source, count = np.array([0, 1, 3, 1, 3, 2, 1, 3]), np.array([5, 2, 2, 9, 9, 1, 9, 9])
    got = {tuple(r) for r in tally(source, count, np.array([0, 3, 5, 6, 8])).to_numpy()}
    assert got == {(0, 1, 5, 2, 1), (0, 3, 5, 2, 1), (1, 3, 2, 2, 1), (1, 3, 9, 9, 2)}
    assert tally(np.zeros(0, int), np.zeros(0, int), np.zeros(1, int)).empty


@pytest.mark.parametrize("text", ["AbC déF", "a1b2_c", "\x00x\x7fy", "ｆｕｌｌ", "", "İI"])
def test_terms_follow_the_pattern(text):
    assert [t.decode() for t in divergence.terms(text.encode())] == TERM.findall(lower(text))


def test_few_texts_at_a_time(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    write = divergence.materialise
    monkeypatch.setattr(divergence, "materialise", lambda df: seen.append(spark.conf.get(name)) or write(df))
    assert run(spark, [("a b", "zz", "r")]) == []
    assert seen[0] == str(divergence.BATCH) and spark.conf.get(name) == before
