"""Language identification: a family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Rows, fit
from .sharding import with_rank

# Families of common language codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "baltic": ("lt", "lv"),
    "malayic": ("id", "jv", "ms", "su"),
    "sinitic": ("yue", "zh"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
BITS = 16
SIZE = 1 << BITS
PER_LANG = 1200  # training documents of a language, at most
RANK_BITS = 12  # of the hash that a language's rows are ranked by in one task
BLOCK = 1 << 20
SCALE = 30.0
UNKNOWN = "und"


def family_of(lang: str) -> str:
    """A code outside the table is a family of its own."""
    code = re.split(r"[-_]", lang.lower())[0]
    return _FAMILY.get(code, code)


def has_letter(text: str) -> bool:
    """Whether a character is of the categories L*; superscripts and number forms aren't."""
    return any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))


def gram_blocks(text: str) -> Iterator[np.ndarray]:
    """Buckets of the letter pairs and triples (other characters count as one gap), in blocks of bounded size."""
    whole = f" {text.lower()} "
    for at in range(0, len(whole), BLOCK):
        part = re.sub(r"[\W\d_]+", " ", whole[max(at - 2, 0) : at + BLOCK])
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        two = (x[:-1] * np.uint32(0x9E3779B1)) ^ (x[1:] * np.uint32(0x85EBCA77))
        three = two[:-1] * np.uint32(5) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        both = np.concatenate((two, three))
        both ^= both >> np.uint32(15)
        yield (both * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    grams = np.zeros(SIZE, np.int64)
    for block in gram_blocks(text):
        grams += np.bincount(block, minlength=SIZE)
    held = np.flatnonzero(grams)
    return held.astype(np.int32), (grams[held] / max(grams.sum(), 1)).astype(np.float32)


@dataclass
class Model:
    """Weights of all families, then of all language pairs, as columns of one matrix, so a text is read once."""

    families: dict[str, list[str]]
    weights: np.ndarray
    bias: np.ndarray
    pairs: dict[str, list[tuple[str, str, int]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(self.weights.shape[1]), 0
        for block in gram_blocks(text):
            total += self.weights[block].sum(axis=0, dtype=np.float64)
            n += len(block)
        z = total / max(n, 1)
        names = list(self.families)
        log = z[: len(names)] * min(n, 200) + self.bias[: len(names)]
        share = np.exp(log - log.max())
        best = int(np.argmax(share))
        p = float(share[best] / share.sum())
        langs = self.families[names[best]]
        if len(langs) == 1:
            return langs[0], p
        votes = dict.fromkeys(langs, 0.0)
        for a, b, at in self.pairs[names[best]]:
            side = 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 * (SCALE * z[at] + self.bias[at])))))
            votes[a] += side
            votes[b] += 1 - side
        lang = max(votes, key=lambda k: (votes[k], k))
        return lang, p * votes[lang] / (len(langs) - 1)


def family_weights(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial log-probabilities of the grams under each family, every document weighing the same, no prior.

    sums: the summed gram shares of each family's documents; sizes: how many there are.
    """
    counts = sums / np.maximum(sizes, 1)[:, None]
    smooth = counts + 0.02 * counts.mean(axis=0) + 1e-7
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return (logs - logs.mean(axis=0)).T, np.zeros(len(sums))


def svm(rows: Rows, side: np.ndarray, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss; both sides weigh the same whatever their numbers."""
    weight = np.where(side > 0, 0.5 / max((side > 0).sum(), 1), 0.5 / max((side < 0).sum(), 1))

    def gradient(p: np.ndarray) -> np.ndarray:
        slack = np.maximum(0, 1 - side * (SCALE * rows.dot(p[:SIZE]) + p[SIZE]))
        g = -2 * weight * side * slack
        return np.append(SCALE * rows.back(g, SIZE) + ridge * p[:SIZE], g.sum())

    p = fit(np.zeros(SIZE + 1), gradient, steps=120, rate=0.3)
    return p[:SIZE], float(p[SIZE])


def _rows(pdf: pd.DataFrame) -> Rows:
    return Rows([np.frombuffer(c, np.int32) for c in pdf["col"]], [np.frombuffer(v, np.float32) for v in pdf["val"]])


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """At most per_lang of each language's different rows (doc_id, lang, _t), those of the least hashes. Ranked in ranges
    of the hash, so that no task ranks a language's rows."""
    name = F.xxhash64("doc_id")
    dealt = rows.distinct().withColumn("_b", F.shiftrightunsigned(name, 64 - RANK_BITS))
    return with_rank(dealt, ["lang"], "_b", [name, F.col("doc_id"), F.col("_t")], "_r").where(F.col("_r") <= per_lang).drop("_r", "_b")


def train(docs: DataFrame, learnable: Column, per_lang: int = PER_LANG) -> Model:
    """Learn from the rows where `learnable` holds and lang isn't null: at most per_lang documents of each language,
    taken by a hash of their id. Each language pair of a family is fitted by a task of its own, and so are the sums of
    each family."""
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("text").alias("_t"), "text")
    chosen = sample(usable.drop("text"), per_lang)
    held = chosen.select(*(F.col(c).alias(f"_{c}_") for c in ("doc_id", "lang", "_t")))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id_")) & (F.col("lang") == F.col("_lang_")) & (F.col("_t") == F.col("__t_"))
    texts = usable.join(F.broadcast(held), same, "left_semi")  # per_lang rows of each language
    texts = texts.groupBy("doc_id", "lang", "_t").agg(F.min("text").alias("text"))  # a repeated row counts once

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"name": pdf["name"], "lang": pdf["lang"], "col": [c.tobytes() for c, _ in made], "val": [v.tobytes() for _, v in made]})

    made = texts.select(F.concat_ws(" ", "doc_id", "_t").alias("name"), "lang", "text").mapInPandas(vectors, "name string, lang string, col binary, val binary")
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    pairs = [(a, b) for members in families.values() for a, b in combinations(members, 2)]
    if not families:
        return Model({}, np.zeros((SIZE, 0), np.float32), np.zeros(0))
    names = list(families)
    tasks = {lang: [f"{a}|{b}" for a, b in pairs if lang in (a, b)] + [f"|{family_of(lang)}"] * (len(names) > 1) for lang in langs}
    to = F.coalesce(*(F.when(F.col("lang") == lang, F.array(*map(F.lit, ts)) if ts else F.array().cast("array<string>")) for lang, ts in tasks.items()))

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["name", "lang"], kind="stable")
        rows, labels = _rows(pdf), pdf["lang"].to_numpy()
        if key[0].startswith("|"):
            w, b = np.bincount(rows.col, rows.val, SIZE), len(pdf)
        else:
            w, b = svm(rows, np.where(labels == key[0].split("|")[0], 1.0, -1.0))
        return pd.DataFrame({"task": [key[0]], "w": [w.tobytes()], "b": [float(b)]})

    got = {r["task"]: (np.frombuffer(r["w"]), r["b"]) for r in made.withColumn("task", F.explode(to)).groupBy("task").applyInPandas(learn, "task string, w binary, b double").collect()}
    none = np.zeros(SIZE), 0.0
    sums, sizes = zip(*(got.get(f"|{f}", none) for f in names), strict=True)
    columns = [family_weights(np.array(sums), np.array(sizes)), *((w[:, None], [b]) for w, b in (got.get(f"{a}|{b}", none) for a, b in pairs))]
    at = {pair: len(names) + i for i, pair in enumerate(pairs)}
    return Model(families, np.hstack([w for w, _ in columns]).astype(np.float32), np.concatenate([b for _, b in columns]), {f: [(a, b, at[a, b]) for a, b in combinations(m, 2)] for f, m in families.items()})


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred and score, from the whole text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each family and pair

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_p", predict(F.col("text"))).select("*", "_p.lang_pred", "_p.score").drop("_p")


def predict_all(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; held-out rows take no part in the learning.

    Null text or a text without a letter: `und` with score 0; so is every text where nothing can be learned. Null lang:
    predicted like any other. Null id: not held out. Repeated rows each return, and count once in the learning. Very long
    texts: read whole, in blocks. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(docs, ~F.col("held_out"), per_lang)
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
