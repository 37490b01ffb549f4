"""Ordinal cumulative-link regression of graded ratings on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .linear import Rows, fit

WORD_BITS, GRAM_BITS = 17, 15
WORDS, GRAMS = 1 << WORD_BITS, 1 << GRAM_BITS
GRAM_SCALE = 20.0  # a text's trigram shares add up to this
GRAM_SMOOTH = 60  # trigrams without weight that every text is taken to have, so that short texts stay near the prior
STEM = 5  # letters of a word that give a bucket of their own
SAMPLE = 8000  # labelled documents that the model is fitted on, at most
MIN_SEEN = 4  # sampled documents that must hold a word bucket before it gets a weight
MIN_Z = 3.5  # standard errors that their mean grade must be off by
CACHE = 200_000  # words a task remembers the bucket of
BLOCK = 1 << 20


class _Buckets(dict):
    """Word -> the bucket of the word and, above it, of its stem; remembered for speed alone."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = re.sub(r"^\W+|\W+$", "", word) or word
        buckets = self[word] = zlib.crc32(utf8(bare)) & (WORDS - 1) | (zlib.crc32(utf8(bare[:STEM]), 1) & (WORDS - 1)) << WORD_BITS
        return buckets


def word_buckets(text: str, cache: dict) -> np.ndarray:
    """The buckets that the text's words and stems fall into, each once."""
    words = set(text.lower().split())
    both = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    return np.unique(np.concatenate((both & (WORDS - 1), both >> WORD_BITS)))


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams, in blocks of bounded size."""
    data = np.frombuffer(utf8(text), np.uint8)
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        part = data[at : at + BLOCK + 2].astype(np.uint32)
        yield ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def features(text: str, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    grams = np.zeros(GRAMS, np.int64)
    for block in gram_blocks(text):
        grams += np.bincount(block, minlength=GRAMS)
    held = np.flatnonzero(grams)
    words = word_buckets(text, cache)
    return np.concatenate((words, WORDS + held)).astype(np.int32), np.concatenate((np.ones(len(words)), grams[held] * (GRAM_SCALE / (grams.sum() + GRAM_SMOOTH)))).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k - 1]); the thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str, cache: dict) -> float:
        total, n = 0.0, 0
        for block in gram_blocks(text):
            total, n = total + float(self.weights[WORDS + block.astype(np.int64)].sum()), n + len(block)
        return float(self.weights[word_buckets(text, cache)].sum()) + GRAM_SCALE * total / (n + GRAM_SMOOTH)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def live_columns(cols: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Word buckets that enough documents hold and whose mean grade is clearly off, and all trigram buckets."""
    seen, off = np.zeros(WORDS), np.zeros(WORDS)
    for col, grade in zip(cols, grades - grades.mean(), strict=True):
        words = col[col < WORDS]  # each once
        seen[words] += 1
        off[words] += grade
    z = np.abs(off) / np.sqrt(np.maximum(seen, 1)) / max(grades.std(), 1e-9)
    return np.concatenate(((seen >= MIN_SEEN) & (z >= MIN_Z), np.ones(GRAMS, bool)))


def fit_ordinal(rows: Rows, live: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float = 2e-4) -> Model:
    """Maximum likelihood with a ridge; later thresholds are the first plus positive steps, so they stay ordered."""
    size = WORDS + GRAMS
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(0.01, 0.99)
    cuts = -np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(cuts), 0.05))
    ends = lambda p: np.concatenate(([p[size]], p[size] + np.cumsum(np.exp(p[size + 1 :]))))

    def gradient(p: np.ndarray) -> np.ndarray:
        z, cut = rows.dot(p[:size]), ends(p)
        tail = np.column_stack((np.ones(rows.n), 1 / (1 + np.exp(-np.clip(z[:, None] - cut, -30, 30))), np.zeros(rows.n)))
        a, b = tail[np.arange(rows.n), grades], tail[np.arange(rows.n), grades + 1]
        gap = np.maximum(a - b, 1e-9)
        out = np.zeros_like(p)
        out[:size] = (rows.back(-(1 - a - b) / rows.n, size) + ridge * p[:size]) * live
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, a * (1 - a) / gap)
        np.add.at(by_cut, grades + 1, -b * (1 - b) / gap)
        by_cut = by_cut[1:n_grades] / rows.n
        out[size] = by_cut.sum()
        out[size + 1 :] = np.exp(p[size + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
        return out

    p = fit(np.concatenate((np.zeros(size), cuts[:1], steps)), gradient, steps=200, rate=0.1)
    return Model((p[:size] * live).astype(np.float32), ends(p))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 poor, 1 good but toxic, 2 good and clean. Of several ratings the lowest counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.where("doc_id is not null").select("doc_id", grade.alias("grade")).where("grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE, text_col: str = "text") -> Model | None:
    """Fit on at most `sample` rated documents, taken by a hash of their id. None where nothing is rated.

    Features are made where the texts are; one task then fits the bounded sample, and the driver gets the weights alone.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(chosen), "doc_id")  # at most `sample` ids

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Buckets()
        for pdf in batches:
            made = [features(t, cache) for t in pdf["_text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "col": [c.tobytes() for c, _ in made], "val": [v.tobytes() for _, v in made]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        grades = pdf["grade"].to_numpy(np.int64)
        cols, vals = [np.frombuffer(c, np.int32) for c in pdf["col"]], [np.frombuffer(v, np.float32) for v in pdf["val"]]
        live = live_columns(cols, grades)
        kept = [live[c] for c in cols]  # most words go before the rows are joined, which halves what is held
        rows = Rows([c[k] for c, k in zip(cols, kept, strict=True)], [v[k] for v, k in zip(vals, kept, strict=True)])
        model = fit_ordinal(rows, live, grades, n_grades)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "thresholds": [model.thresholds.tolist()]})

    # An id counts once however often it comes, so the task's bound holds.
    texts = texts.groupBy("doc_id", "grade").agg(F.min("_text").alias("_text"))
    made = texts.mapInPandas(vectors, "doc_id long, grade int, col binary, val binary")
    got = made.groupBy().applyInPandas(learn, "weights binary, thresholds array<double>").collect()
    return Model(np.frombuffer(got[0]["weights"], np.float32), np.array(got[0]["thresholds"])) if got else None


def grade_scores(docs: DataFrame, model: Model | None, tails_col: str = "_tails", text_col: str = "text") -> DataFrame:
    """docs plus `tails_col` (P(grade >= k) for k from 1), null where there is no model or text."""
    if model is None:
        return docs.withColumn(tails_col, F.lit(None).cast("array<double>"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.pandas_udf("array<double>")
    def tails(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, cache = held.value, _Buckets()
        for texts in batches:
            z = np.array([model.score(t, cache) if isinstance(t, str) else np.nan for t in texts])
            out = model.tails(z)
            yield pd.Series([None if np.isnan(s) else row for s, row in zip(z, out.tolist(), strict=True)])

    return docs.withColumn(tails_col, tails(F.col(text_col)))


def keeps(least_tail: float = 0.5, tails_col: str = "_tails") -> Column:
    """Selection by the probability of the best grade; without a model or a text nothing speaks for the row."""
    return F.coalesce(F.element_at(tails_col, -1) >= least_tail, F.lit(False))


def expected_grade(tails_col: str = "_tails") -> Column:
    return F.aggregate(tails_col, F.lit(0.0), lambda a, x: a + x)


def classify(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_good (grade 1 or more), p_clean (grade 2), kept (p_clean >= least_tail).

    Null text: null scores, not kept. Empty text: the thresholds alone decide. No usable label: null scores, nothing
    kept. Repeated rows each return; of rows that repeat a rated id the least text is learned from. Very long texts: read
    whole, trigrams in blocks. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    scored = grade_scores(docs.select("doc_id", "text"), train(docs, rated(labels), sample=sample))
    return scored.select("doc_id", expected_grade().alias("expected_grade"), F.element_at("_tails", 1).alias("p_good"), F.element_at("_tails", 2).alias("p_clean"), keeps(least_tail).alias("kept"))
