"""Proportional stratified interleaving into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_SHARE, SALTS, materialise, parts_for


def with_rank(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], out: str) -> DataFrame:
    """1-based rank within `keys` by (bucket, order): ranks inside a bucket plus the rows of earlier buckets.

    No window ever spans more than one bucket of rows, so a key with a third of all rows is ranked by many tasks.
    """
    sums = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(sums), F.lit(0))).drop("_n")
    inside = rows.withColumn("_in", F.row_number().over(W.partitionBy(*keys, bucket).orderBy(*order)))
    return inside.join(before, [*keys, bucket]).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before")


def interleave(docs: DataFrame, n_shards: int = 40, seed: int = 17, stratum: str = "source", id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 20_000) -> DataFrame:
    """Assign every row to a shard and a slot so that each shard mirrors the mixture of `stratum`.

    Rows are shuffled by a seeded hash of their text within each stratum and ranked; the fractional rank (rank - 1/2) / rows of the
    stratum orders all rows, and the order is cut into shards whose row counts differ by at most one. Law: `rows`.
    Copies of one text follow each other in a stratum, and at about the same fraction in all strata, so a group stays
    in one shard unless a cut falls into it; it can't always, as counts differ by at most one.

    Null stratum: a stratum of its own. Null text: 0 bytes, CRC-32 of nothing (0). Null or repeated ids, repeated rows:
    each row is placed once. Empty table: no rows. Other columns are ignored, whatever their names.
    Returns id_col, size, text_crc32, law, shard, slot, grown_shard (null) and stratum.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(stratum).alias("_stratum"),
        F.when(F.col(stratum).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(stratum).cast("string"))).alias("_key"),
        (F.octet_length(text) + 16).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        text.alias("_text"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), "_text")).drop("_text")
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    total = rows.count()
    buckets = parts_for(total, rows_per_bucket, 128)
    # Texts with very many copies (fewer than HOT_SHARE) follow the others of their bucket, in parts of their own.
    hot = rows.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > max(total // HOT_SHARE, SALTS)).select("_h", F.lit(True).alias("_hot"))
    part = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(0)
    rows = rows.join(F.broadcast(hot), "_h", "left").withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)) * (SALTS + 1) + part).drop("_hot")
    ranked = with_rank(rows, ["_key"], "_b", [F.col("_h"), F.col("_id"), F.col("_size"), F.col("_row")], "_rank")
    sizes = rows.groupBy("_key").agg(F.count("*").alias("_rows"))
    ranked = materialise(ranked.join(sizes, "_key").withColumn("_f", F.expr(f"((2 * _rank - 1) * {buckets}) div (2 * _rows)")).drop("_b", "_h", "_row"))
    # (2 rank - 1) / (2 rows) as the remainder within its bucket keeps the comparison exact for any number of rows.
    inside = F.expr(f"((2 * _rank - 1) * {buckets}) % (2 * _rows)") / (2 * F.col("_rows"))
    placed = with_rank(ranked.withColumn("_one", F.lit(0)), ["_one"], "_f", [inside, F.col("_key"), F.col("_rank")], "_at")
    at = F.col("_at") - 1
    shard = F.floor(at * n_shards / F.lit(max(total, 1))) if total == 0 else F.expr(f"((_at - 1) * {n_shards}) div {total}")
    first = F.expr(f"(_shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("_shard", shard.cast("long")).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (at - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_stratum").alias("stratum"),
    )
