"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.llm import exact_dedup, html_extract, language_id, lm_bloom, mixing, packing, pii_crf, quality_cascade, secret_scan, simhash_gray

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query
def op2_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score(_documents(spark, sf_dir))


@_query
def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(_documents(spark, sf_dir))


@_query
def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(_documents(spark, sf_dir))


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_documents(spark, sf_dir))
    return got.select("doc_id", "source", F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").cast("long").alias("copies"), F.col("mix_copy").cast("long").alias("copy"), "mix_key", "text")


@_query
def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(_documents(spark, sf_dir))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_documents(spark, sf_dir))


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


ORACLE["op6_exact_dedup"] = exact_dedup.ORACLE
ORACLE["op7_mixing"] = mixing.oracle()
#: Verdict of the quality rules: the conjunction of all rules, whatever order the cascade runs them in.
ORACLE["op4_quality_cascade"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
u AS (SELECT k, i, ws[i] AS word, ws[i:i+7] AS win, len(ws) AS n FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
v AS (SELECT k, i, word, n, lag(word) OVER (PARTITION BY k ORDER BY i) AS before, count(*) OVER (PARTITION BY k, win) AS c FROM u),
x AS (SELECT *, max(CASE WHEN i <= n - 7 AND c > 1 THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM v),
rep AS (SELECT k, count(hit) AS n_repeat_words, sum(length(word)) AS word_chars, sum(CASE WHEN word = before THEN 1 ELSE 0 END) AS doubled FROM x GROUP BY k),
l AS (SELECT k, line FROM d, unnest(string_split(t, chr(10))) AS s(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ll AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY k),
m AS (SELECT d.k, d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(rep.word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(ll.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  coalesce(ll.n_lines, 0) AS n_lines, coalesce(rep.doubled, 0) AS doubled,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
  FROM d JOIN w ON w.k = d.k LEFT JOIN rep ON rep.k = d.k LEFT JOIN ll ON ll.k = d.k),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (letters >= 50 AND 10 * caps > 7 * letters)
    OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 5 * doubled > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""
