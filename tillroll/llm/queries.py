"""The registered queries of the operators, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import (automaton_bpe, compact_windows, count_rtree, heap_bpe, id_shards, itq_dups, ngram_trie, nn_descent, pareto_mix,
                          prefix_table, turn_repair, turn_trie, weak_labels)
from tillroll.llm.common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix.mix(read(spark, sf_dir, "documents"))


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_shards.encode_and_read(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(read(spark, sf_dir, "documents"), k=5, least=50, percent=80)


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest_rows(read(spark, sf_dir, "embeddings"), every=20, count=20)


def op6_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_bpe.count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_count_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.jaccard_components(read(spark, sf_dir, "documents"), k=5, percent=80)


def op8_itq_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dups.near_duplicates(read(spark, sf_dir, "embeddings"), least=0.95)


def op9_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_bpe.encode_texts(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op10_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score(read(spark, sf_dir, "documents"))


def op11_run_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_conversations(read(spark, sf_dir, "conversations"))


def op12_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_table.encode_texts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op13_bitmap_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_pareto_mix, op2_weak_labels, op3_id_shards, op4_compact_windows, op5_nn_descent, op6_heap_bpe, op7_count_rtree,
                                    op8_itq_dups, op9_automaton_bpe, op10_ngram_trie, op11_run_repair, op12_prefix_table, op13_bitmap_trie)}

#: The mix without bins: every source ranked as a whole. Other operators hash, encode or search: tests/llm holds
#: them against brute force, round trips, the libraries themselves or measured recall.
ORACLE: dict[str, str] = {"op1_pareto_mix": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))) AS draw
  FROM documents),
drawn AS (SELECT *, (CAST(CAST('0x' || substr(draw, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM d),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, source_size * CAST(2.0 AS DOUBLE) AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN CAST(5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w
  FROM sized),
levels AS (
  SELECT *, most / w AS ratio,
    (CAST((SELECT sum(source_size) FROM sized) AS DOUBLE) * CAST(1.5 AS DOUBLE)
      - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN most ELSE (SELECT max(level) FROM levels WHERE level < ratio) * w END AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate FROM targets),
parts AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS p, target - floor(rate) * source_size AS rest FROM rates),
ranked AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.p, t.rest,
    CASE WHEN t.p > 0 THEN d.u / (1 - d.u) / (t.p / (1 - t.p)) ELSE CAST('inf' AS DOUBLE) END AS rnk
  FROM drawn d JOIN parts t ON d.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, u, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached,
    sum(size) OVER (PARTITION BY source, rnk, u, doc_id, size) AS step FROM ranked),
decided AS (
  SELECT *, CAST(whole AS BIGINT) + CASE WHEN p > 0 AND size > 0 AND reached - step < rest AND (reached <= rest OR reached - rest <= rest - (reached - step))
    THEN 1 ELSE 0 END AS copies FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, source, draw FROM decided
"""}
