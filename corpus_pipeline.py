"""From raw documents to packed sequences, a stage at a time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.llm import decontamination, line_dedup, packing, quality_model, simhash
from caselens.llm.common import fresh, materialise, table

LEAST_P_CLEAN = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is LEAST_P_CLEAN or more.

    Null texts go; empty ones are judged by the thresholds alone. Null ids are judged but not learned from. Repeated rows
    share their fate. No labels: nothing speaks for a document, so none stays. Empty table: none.
    """
    model = quality_model.train(docs, quality_model.rated(table(spark, sf_dir, "labels")))
    tails = fresh(docs, "_tails")
    return quality_model.grade_scores(docs, model, tails).where(quality_model.keeps(LEAST_P_CLEAN, tails)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds within an edit; n_chars follows the text.

    Null and empty texts and null ids stay as they are. Rows are judged one by one, also where they repeat an id.
    """
    return line_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group. Null and wordless texts are one group; null ids stay; rows that repeat an
    id are judged by their own texts."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and null ids stay; rows that repeat an id are judged by
    their own texts."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens. Null or wordless text: the id 0 alone.
    Every row is packed, also where it repeats an id or has none."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's rows written as Parquet before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else materialise(docs)
    return docs


ORACLE_SQL = None  # a trained model, edit distances and a tokenizer are beyond SQL
