"""Removal of lines that repeat an earlier line of the corpus within one edit, by a segment-partition edit join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, skewed_join

EDITS = 1  # so a line has EDITS + 1 = 2 segments
MIN_CHARS = 24  # shorter lines are only dropped for an equal one, as an edit makes another line of them
MIN_WORDS = 2  # words of two letters or more that a shorter line needs; "Yes." and "* * *" repeat by chance and stay
WORDS = r"(\p{L}\p{M}*){2}([^\n]*[^\p{L}\p{M}](\p{L}\p{M}*){2}){%d}" % (MIN_WORDS - 1)
HOT_KEY = 16  # lines that share a segment and are still paired with each other
BROADCAST_ROWS = 500_000  # candidate pairs (32 bytes each) that may be broadcast


def within(a: str, b: str, k: int = EDITS) -> bool:
    """Whether the edit distance is at most k. Bit i of level e: i - k + j characters of `a` match the first j of `b`
    with at most e edits; only the 2k + 1 cells around the diagonal exist, and all are moved at once."""
    if abs(len(a) - len(b)) > k:
        return False
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    band = (1 << (2 * k + 1)) - 1
    rows = [sum(1 << i for i in range(k, k + e + 1)) for e in range(k + 1)]
    for j, c in enumerate(b):
        fit = sum(1 << i for i in range(2 * k + 1) if 0 <= (q := j - k + i) < len(a) and a[q] == c)
        new: list[int] = []
        for e, row in enumerate(rows):
            now = row & fit
            if e:
                now |= rows[e - 1] | rows[e - 1] >> 1
                now |= new[e - 1] << 1
            new.append(now & band)
        rows = new
        if not rows[k]:
            return False
    return bool(rows[k] >> (len(a) - len(b) + k) & 1)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _t (of the row's text), line_no, line (trimmed) and its 128-bit name in h1, h2, of every line with enough to it."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "_raw"))
    rows = rows.select("_id", "_t", "line_no", F.expr("trim(both ' \\t\\r' from _raw)").alias("line")).where((F.char_length("line") >= MIN_CHARS) | F.col("line").rlike(WORDS))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _nodes(distinct: DataFrame) -> DataFrame:
    """Each line as one of its own length (probe 0) and as one that a line shorter by one may match (probe 1), with
    nothing agreed at its front (a characters) or back (b) yet. `length` is the shorter line's."""
    n = F.char_length("line")
    roles = F.array(F.struct(n.alias("length"), F.lit(0).alias("probe")), F.struct((n - 1).alias("length"), F.lit(1).alias("probe")))
    return distinct.select("h1", "line", "_id", "line_no", F.explode(roles).alias("r")).select("h1", "line", "_id", "line_no", "r.length", "r.probe", F.lit(0).alias("a"), F.lit(0).alias("b"))


def _split(rows: DataFrame) -> DataFrame:
    """What is open of a line is cut into EDITS + 1 segments; of lines within the edits one segment agrees, at the front
    or, aligned to the end, at the back. A row and key for each."""
    left = F.col("length") - F.col("a") - F.col("b")
    half = F.when(left <= 1, left).otherwise(F.floor(left / 2)).cast("int")
    rest = F.when(left <= 1, left).otherwise(left - F.floor(left / 2)).cast("int")
    kids = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + rest).alias("b")))
    out = rows.select("h1", "line", "_id", "line_no", "length", "probe", F.explode(kids).alias("k")).select("h1", "line", "_id", "line_no", "length", "probe", "k.a", "k.b")
    n = F.char_length("line")
    return out.withColumn("key", F.xxhash64("length", "a", "b", F.substring("line", F.lit(1), F.col("a")), F.substring(F.col("line"), n - F.col("b") + 1, F.col("b"))))


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _ends(rows: DataFrame) -> DataFrame:
    """Pairs where keys leave a character open, or none: each line and the earliest that the key itself puts within one
    edit. Lines of one length that differ in the open character are substitutions; with none open, the longer ones hold
    one more character than the shorter. A group's earliest is all that's needed, so no pairs are made within it."""
    who = F.struct("_id", "line_no", "h1")
    left = F.col("length") - F.col("a") - F.col("b")
    of = lambda probe: F.min(F.when(F.col("probe") == probe, who)).alias(f"m{probe}")
    met = rows.join(rows.groupBy("key").agg(of(0), of(1)), "key")
    other = F.when(left == 0, F.when(F.col("probe") == 0, F.col("m1")).otherwise(F.col("m0"))).when(F.col("probe") == 0, F.col("m0"))
    return met.select("h1", other["h1"].alias("o")).where("o is not null and h1 <> o").select(*_ordered(F.col("h1"), F.col("o")))


def _candidates(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of line names (h1) that may be within one edit.

    Lines that share a key are paired while they are few. Keys that more share are split again by what they leave open,
    until few share them or nothing is left; a line gets four keys a round, so the work follows the lines and not their
    pairs, however many share a segment.
    """
    rows, found = _nodes(distinct), []
    while True:
        keys = _split(rows)
        met = materialise(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("probe").alias("probe")).where("n > 1 and probe = 0 and lo <> hi").drop("probe"))
        found.append(met.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        some = keys.join(met.where(f"n > 2 and n <= {HOT_KEY}").select("key"), "key").groupBy("key").agg(F.collect_set("h1").alias("ids"))
        found.append(some.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b"))
        hot = met.where(f"n > {HOT_KEY}").select("key")
        if hot.isEmpty():
            break
        shared = materialise(keys.join(hot, "key"))
        left = F.col("length") - F.col("a") - F.col("b")
        found.append(_ends(shared.where(left <= 1)))
        rows = shared.where(left >= 1).drop("key")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def near_lines(distinct: DataFrame) -> DataFrame:
    """h1, h2 and `near` (the earliest position of another line within one edit) of every line that has one."""
    found = materialise(_candidates(distinct))
    small = found.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda x: x
    side = distinct.select("h1", "h2", "line", F.struct("_id", "line_no").alias("pos"))
    first = side.join(hint(found), side.h1 == found.a).select("b", *(F.col(c).alias(f"{c}_a") for c in side.columns))
    ends = side.join(hint(found.select("b").distinct()), side.h1 == F.col("b"), "left_semi").select(*(F.col(c).alias(f"{c}_b") for c in side.columns))
    pairs = materialise(first.join(ends, F.col("b") == F.col("h1_b")).where(F.pandas_udf(_near, "boolean")("line_a", "line_b")).select("h1_a", "h2_a", "pos_a", "h1_b", "h2_b", "pos_b"))
    both = pairs.select(F.col("h1_a").alias("h1"), F.col("h2_a").alias("h2"), F.col("pos_b").alias("near")).union(pairs.select("h1_b", "h2_b", "pos_a"))
    return both.groupBy("h1", "h2").agg(F.min("near").alias("near"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _t, dropped (ascending line numbers from 0) and n_near (those with no equal earlier line) of rows that lose
    lines. A row is known by its id and text, so rows that repeat an id lose their own lines alone."""
    lines = _lines(docs, id_col, text_col)
    distinct = materialise(lines.groupBy("h1", "h2").agg(F.min(F.struct("_id", "line_no")).alias("pos"), F.count("*").alias("n"), F.first("line").alias("line")).select("h1", "h2", "n", "pos._id", "pos.line_no", "line"))
    own = distinct.select("h1", "h2", "n", F.struct("_id", "line_no").alias("pos"))
    first = own.join(near_lines(distinct.where(F.char_length("line") >= MIN_CHARS)), ["h1", "h2"], "left").where("n > 1 or near is not null").select("h1", "h2", "n", "pos", "near")
    first = materialise(first)
    total = first.agg(F.sum("n")).first()[0] or 0
    at = F.struct("_id", "line_no")
    found = skewed_join(lines.select("_id", "_t", "line_no", "h1", "h2"), first, ["h1", "h2"], "n", total, ["_id", "line_no"])
    return found.where((at > F.col("pos")) | (at > F.col("near"))).groupBy("_id", "_t").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"), F.count_if(~(at > F.col("pos"))).alias("n_near"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_lines, n_dropped, n_near, dropped_lines (their numbers from 0, comma-separated).

    A line (spaces, tabs and returns at its ends aside) of at least MIN_CHARS characters or MIN_WORDS words is dropped if
    a line at an earlier (id, line number) is equal to it, whether that line stays or not; one of at least MIN_CHARS
    characters also if such a line is one edit away. Null text: no lines.
    Empty text: one line, which stays. Null ids neither give nor lose lines. Repeated rows lose the same lines, rows that
    repeat an id with another text their own, and equal positions aren't earlier than each other. Very long texts: lines
    are rows, so their number isn't bounded. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"), F.coalesce(F.size(F.split(text_col, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = rows.join(dropped_lines(docs, id_col, text_col), ["_id", "_t"], "left")
    return out.select(
        F.col("_id").alias(id_col), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.concat_ws(",", F.coalesce(F.col("dropped").cast("array<string>"), F.array().cast("array<string>"))).alias("dropped_lines"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines taken out of the text; every row and every other column stays."""
    lines, name, gone = (fresh(docs, c) for c in ("_lines", "_name", "_dropped"))
    lost = dropped_lines(docs, id_col, text_col).select(F.col("_id").alias(id_col), F.col("_t").alias(name), F.col("dropped").alias(gone))
    # Text travels as its lines, so they are split once; array_except() looks the dropped ones up in a set.
    rows = docs.withColumns({lines: F.split(text_col, "\n", -1), name: F.xxhash64(text_col)}).drop(text_col)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return rows.join(lost, [id_col, name], "left").withColumn(text_col, text).select(*docs.columns)
