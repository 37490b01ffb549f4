"""Quality rules that count per document, judge per host and join the verdict back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skewed_join, utf8, with_ids

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10  # of the characters in words
MAX_DUP_LINES = 3
MAX_HOST_RATE = 0.5
PRIOR_STRENGTH = (1.0, 1000.0)  # least and most pseudo-documents of the prior
WINDOW = 5
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)
RULES = ("short", "repetitive", "symbols", "dup_lines")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that the text holds at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        x = h[i : i + n] * _MULT[i]
        keys += x ^ (x >> np.uint64(29))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n + 1, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(found[:n])
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = utf8(text)
    words = data.split()  # bytes split at 0x20 and 0x09-0x0D alone
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for pdf in batches:
        out = pd.DataFrame([counts(t if isinstance(t, str) else None) for t in pdf.pop("_text")], columns=names, index=pdf.index, dtype="int64")
        yield pd.concat([pdf, out], axis=1)


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document with its host, the five counts and whether it breaks each rule."""
    out = with_ids(docs, id_col, text_col, F.col(host_col).cast("string").alias("_host")).mapInPandas(_count_batches, "_id string, _host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumns({
        "_id": F.col("_id").cast(docs.schema[id_col].dataType),
        "short": F.col("n_words") < MIN_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": F.col("n_dup_lines") > MAX_DUP_LINES,
    })


def host_rates(counted: DataFrame) -> DataFrame:
    """Per host and rule: documents, failures, and the failure rate shrunk towards the prior of all hosts.

    The prior is a beta distribution fitted to the hosts' rates by moments; with no spread it has the most strength.
    """
    sums = counted.where("_host is not null").groupBy("_host").agg(F.count("*").alias("n"), *(F.count_if(r).alias(r) for r in RULES))
    long = sums.unpivot(["_host", "n"], list(RULES), "rule", "failed")
    rate = F.col("failed") / F.col("n")
    prior = long.groupBy("rule").agg((F.sum("failed") / F.sum("n")).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"))
    strength = F.when(F.col("spread") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1).otherwise(PRIOR_STRENGTH[1])
    prior = prior.withColumn("strength", F.greatest(F.lit(PRIOR_STRENGTH[0]), F.least(F.lit(PRIOR_STRENGTH[1]), strength)))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return long.join(F.broadcast(prior), "rule").withColumn("rate", shrunk)  # the prior has one row per rule


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per document: the counts, base_failed, the host's highest shrunk rate, and kept.

    kept is false if base_failed, or if a rule's shrunk rate on the document's host is above MAX_HOST_RATE.
    Null or empty text: no words, base_failed. Null host: no host verdict, so the base rules decide. Repeated rows each
    count and each return. Very long texts: read whole by one task. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    counted = materialise(document_counts(docs, id_col, text_col, host_col))
    hosts = materialise(host_rates(counted).groupBy("_host").agg(F.max("rate").alias("host_rate"), F.max("n").alias("_n")))
    known = skewed_join(counted.where("_host is not null"), hosts, ["_host"], "_n", counted.count(), ["_id"])  # a host may have a third of all documents
    rows = known.unionByName(counted.where("_host is null").withColumn("host_rate", F.lit(None).cast("double")))
    base = F.col("short") | F.col("repetitive")
    return rows.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.coalesce("host_rate", F.lit(0.0)) <= MAX_HOST_RATE)).alias("kept"), "host_rate",
    )
