"""How the words of a source differ from those of other sources and of its language, in exact integers.

For each pair of sources a joint histogram says how many terms have which two counts, zeros included; what is to be
summed over terms is evaluated once for each such combination and multiplied.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of, materialise, parts_for

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
HELD = 250_000  # different (lang, source, term) that a task sums up before it sends them on
BATCH = 500  # texts a task holds at once
ROWS_PER_PART = 200_000  # counts whose pairs one task tallies
PAIRS = 2_000_000  # pairs of counts it holds at once

# Bytes of a term as they are, A-Z in lower case, all others as blanks.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII; only A-Z lose their case. On UTF-8, where bytes do as well."""
    return text.translate(_BYTES).split()


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, docs, count: sums over the documents of a task, sent on whenever HELD are held."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), of in held.items():
            items = list(of.items())
            for s in range(0, len(items), 50_000):
                part = items[s : s + 50_000]
                text = pa.array([t for t, _ in part], pa.binary()).cast(pa.string())
                docs, count = (pa.array([c[k] for _, c in part], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), text, docs, count], ["lang", "source", "term", "docs", "count"])

    for batch in it:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            of = held.setdefault((lang, source), {})
            before = len(of)
            for t, k in Counter(terms(text)).items():
                at = of.get(t)
                if at is None:
                    of[t] = [1, k]
                else:
                    at[0] += 1
                    at[1] += k
            n += len(of) - before
            if n >= HELD:
                yield from flush()
                held, n = {}, 0
    yield from flush()


def tally(source: np.ndarray, count: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """a, b, ca, cb, m: how many terms have count ca in source a and cb in source b, for a < b and counts above 0.

    Terms are the ranges between `start`s; sources ascend within a term. Pairs are formed for a bounded stretch of terms
    at a time and summed up at once.
    """
    size = np.diff(start)
    steps = np.cumsum(size * (size - 1) // 2) // PAIRS
    out = []
    for step in np.unique(steps):
        of = np.flatnonzero(steps == step)
        lo, hi = start[of[0]], start[of[-1] + 1]
        ends = np.repeat(start[of + 1], size[of])  # for each count, where its term ends
        later = ends - np.arange(lo, hi) - 1
        first = np.repeat(np.arange(lo, hi), later)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(later) - later, later)
        if len(first):
            out.append(_summed(pd.DataFrame({"a": source[first], "b": source[second], "ca": count[first], "cb": count[second], "m": 1})))
    return _summed(pd.concat(out)) if out else pd.DataFrame({k: pd.Series(dtype="int64") for k in ("a", "b", "ca", "cb", "m")})


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby(["a", "b", "ca", "cb"], sort=False, as_index=False)["m"].sum()


def _tallies(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tally of the terms of one part of a language."""
    lang = pdf["lang"].iloc[0]
    pdf = pdf.sort_values(["term", "sid"], kind="stable")
    names = pdf["term"].to_numpy()
    start = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]))
    return tally(pdf["sid"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), start).assign(lang=lang)[["lang", "a", "b", "ca", "cb", "m"]]


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); the product may exceed a long, so it is a decimal."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div nullif({n} + {v}, 0)")


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of longs up to SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source) of docs, and the counts of kept terms: lang, source, term, count, all (the term's count in
    the language)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), blank("text"))
    groups = rows.select("lang", "source").distinct()
    sums = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_sums, "lang string, source string, term string, docs long, count long")
    # One shuffle by term serves the sums of a source, those of the language and their join.
    sums = sums.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    of_term = W.partitionBy("lang", "term")
    whole = sums.withColumns({"all": F.sum("count").over(of_term), "docs": F.sum("docs").over(of_term)})
    return groups, whole.where(F.col("docs") >= LEAST_DOCS).drop("docs")


def _histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, ca, cb, m for every pair a < b of a language's sources: the whole joint histogram.

    What is tallied are the cells of two counts above 0. Those with a zero are implied: of the terms with count ca in a,
    the ones that are in no cell with b, and of all terms the ones that are in neither. The sum of the parts is m.
    """
    total = kept.count()
    part = F.pmod(F.xxhash64("term"), F.lit(parts_for(total, ROWS_PER_PART, 8)))
    cells = materialise(kept.withColumn("_part", part).groupBy("lang", "_part").applyInPandas(_tallies, "lang string, a long, b long, ca long, cb long, m long").groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m")))
    zero = F.lit(0).cast("long")
    at = lambda df, ca, cb, m: df.select("lang", "a", "b", ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
    own = kept.groupBy("lang", "sid", "count").agg(F.count("*").alias("m"))  # each source's own histogram
    left = own.join(groups.select("lang", F.col("sid").alias("b")), "lang").where("sid < b").withColumnRenamed("sid", "a")
    right = own.join(groups.select("lang", F.col("sid").alias("a")), "lang").where("a < sid").withColumnRenamed("sid", "b")
    pairs = groups.select("lang", F.col("sid").alias("a"), "v").join(groups.select("lang", F.col("sid").alias("b")), "lang").where("a < b")
    parts = [
        at(cells, ca, cb, m), at(cells, ca, zero, -m), at(cells, zero, cb, -m), at(cells, zero, zero, m),
        at(left, F.col("count"), zero, m), at(left, zero, zero, -m), at(right, zero, F.col("count"), m), at(right, zero, zero, -m), at(pairs, zero, zero, F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other source of its language (`pair`), and
    the terms that it uses more than its language (`term`, the TOP first ones).

    A term counts for a language if LEAST_DOCS of its documents hold it. Null text, lang and source are ''. Rows are
    documents, also where they repeat; ids aren't read. A language without kept terms: its pairs have value 0. A lone
    source has no pairs. Ties: items in the order of their UTF-8. Very long texts: one at a time. Empty table: no rows.
    Other columns are ignored. Pairs of sources are what is asked for, so rows grow with the square of a language's
    sources; terms are dealt by hash, so that the sources that share one never meet as more than one term's counts.
    """
    groups, kept = counts(docs)
    with batches_of(docs.sparkSession, BATCH):
        kept = materialise(kept)
    groups = materialise(groups.withColumn("sid", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long")))
    of_group = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    of_lang = materialise(kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("n_lang"), F.count("*").alias("v")))
    zero = F.lit(0).cast("long")
    facts = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    facts = materialise(facts.withColumns({c: F.coalesce(c, zero) for c in ("n", "n_lang", "v")}))
    held = kept.join(facts.select("lang", "source", "sid"), ["lang", "source"])
    cells = _histograms(held.select("lang", "term", "sid", "count"), facts.select("lang", "sid", "v"))
    side = lambda x: facts.select("lang", F.col("sid").alias(x), F.col("source").alias(f"source_{x}"), F.col("n").alias(f"n_{x}"), *([F.col("v")] if x == "a" else []))
    evaluated = cells.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).withColumns({"p": share("ca", "n_a", "v"), "q": share("cb", "n_b", "v")})
    value = lambda p, q: F.sum(F.when(F.col("m") > 0, gap(p, q) * F.col("m")).otherwise(0))
    sums = evaluated.groupBy("lang", "source_a", "source_b").agg(value("p", "q").alias("ab"), value("q", "p").alias("ba"))
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("value"))))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "x.value").withColumn("rank", F.row_number().over(order))
    used = kept.join(facts.select("lang", "source", "n", "n_lang", "v"), ["lang", "source"]).withColumns({"p": share("count", "n", "v"), "q": share("all", "n_lang", "v")}).where("p > q")
    top = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(top)
