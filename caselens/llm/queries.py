"""The registered queries of this folder and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, divergence, exact_dedup, host_rules, language_id, line_dedup, packing, quality_model, sharding, simhash, vector_join, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_all(table(spark, sf_dir, "documents"))


def op2_bucket_pointer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.repeat_digest(table(spark, sf_dir, "documents"))


def op3_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), n_shards=40)


def op8_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), budget=2, width=3)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_bucket_pointer_dedup, op3_quality_ordinal, op4_warc_zstd, op5_best_two_fit, op6_template_decontamination, op7_stratified_interleaving, op8_segment_line_dedup, op9_simhash_trie, op10_host_rules, op11_source_divergence, op12_tokenizer_alignment, op13_epsilon_grid_join)}


_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM q"""

_OP10 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i+4] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS k FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 100 * n_symbols > 10 * word_chars AS r3, n_dup_lines > 3 AS r4 FROM m),
h AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule, unnest([count(*) FILTER (r1), count(*) FILTER (r2), count(*) FILTER (r3), count(*) FILTER (r4)]) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT rule, sum(f) / sum(n) AS mean, coalesce(var_pop(f / n), 0) AS v FROM h GROUP BY rule),
s AS (SELECT rule, mean, greatest(1.0, least(1000.0, CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE 1000.0 END)) AS k FROM p),
x AS (SELECT source, max((f + mean * k) / (n + k)) AS rate FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed, NOT (r1 OR r2) AND coalesce(rate, 0) <= 0.5 AS kept FROM b LEFT JOIN x USING (source)"""


_OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, term, count(*) AS docs, sum(n) AS c FROM (SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL) GROUP BY ALL),
k AS (SELECT lang, term, sum(c) AS c_all FROM t GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(c_all) AS n_lang FROM k GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, k.c_all, coalesce(t.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.c, 1 + (1000000000::HUGEINT * (x.c::HUGEINT + 1)) // (n.n::HUGEINT + l.v) AS p, 1 + (1000000000::HUGEINT * (x.c_all::HUGEINT + 1)) // (l.n_lang::HUGEINT + l.v) AS ql FROM x JOIN n USING (lang, source) JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - ql) * (p - ql)) // ql AS value FROM p WHERE c > 0 AND p > ql)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200"""

_OP13 = """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT i, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e)) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
l AS (SELECT a.i, a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.i <> b.i AND list_dot_product(a.e, b.e) >= 0.9),
r AS (WITH RECURSIVE r AS (SELECT DISTINCT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b) SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, v.vec_id = r.component_id AS kept FROM v LEFT JOIN n USING (i) JOIN r ON r.a = v.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_zstd": _OP4, "op10_host_rules": _OP10, "op11_source_divergence": _OP11, "op13_epsilon_grid_join": _OP13}
