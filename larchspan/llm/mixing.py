"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson variable says whose mean is its source's repetition rate, target tokens
over available tokens (here: code points).  The variable is the inverse distribution function at a uniform number hashed
from seed and document, so a rerun repeats the same documents.  The copies are exploded and shuffled globally: each
carries a hashed key, rows go to partitions by that key and lie in its order there.

Rates: `weights` (source -> weight, sources left out get 0) or, by default, available shares to the power `alpha`.  Of a
rate over `piece` the variable is the sum of several hashed Poisson variables, so tables stay short and exact.

Everything is DataFrame functions.  Counts are pre-aggregated, the table of rates has one row a source; it is broadcast
up to `broadcast_sources` sources and joined with a shuffle (which adaptive execution splits where skewed) beyond.

Defined cases: null text counts 0 code points but is repeated like others; a null source is a source of its own; repeated
rows draw alike unless their identifiers differ; a source without code points has rate 0 under any weights; an empty
table gives an empty result.  Where `docs` has a column of an output's name, that column stays and the output's name gets
a "_" behind it (or more, until it is free).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchspan.llm.common import free_names
from larchspan.session import checkpointed

SEED = "mix-1"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of an md5 over the parts; the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column, most: int) -> Column:
    """P(X <= 0), P(X <= 1) ... P(X <= most) of a Poisson variable, as an array."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["all"])


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict | None = None, alpha: float = 0.5, total_ratio: float = 1.0, piece: float = 8.0) -> DataFrame:
    """source, docs, chars, target, rate, pieces, cdf: one row a source, over all rows of `docs`."""
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    # one pass over the rows; its result has a row a source and is used three times
    per = checkpointed(docs.groupBy(docs[source_col].cast("string").alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(size).alias("chars")))
    share = F.col("chars") / F.col("all_chars")
    if weights is None:
        weight = F.when(F.col("chars") > 0, F.pow(share, F.lit(alpha))).otherwise(F.lit(0.0))
    elif weights:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in ("" if k is None else f"={k}", float(v))])
        weight = F.when(F.col("chars") > 0, F.coalesce(table[F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))], F.lit(0.0))).otherwise(F.lit(0.0))
    else:
        weight = F.lit(0.0)
    # one row a source from here on: the total of the weights goes back to each by a join with a one-row table
    with_share = per.join(F.broadcast(per.agg(F.sum("chars").alias("all_chars"))), how="cross").withColumn("weight", weight)
    totals = with_share.agg(F.sum("weight").alias("all_weight"))
    target = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(F.lit(0.0))
    rate = F.when(F.col("chars") > 0, F.col("target") * F.col("all_chars") * F.lit(total_ratio) / F.col("chars")).otherwise(F.lit(0.0))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(piece))).cast("int")
    most = int(piece + 12 * math.sqrt(piece) + 24)
    return (
        with_share.join(F.broadcast(totals), how="cross")
        .withColumn("target", target).withColumn("rate", rate).withColumn("pieces", pieces)
        .select("source", "docs", "chars", "target", "rate", "pieces", cumulative(F.col("rate") / F.col("pieces"), most).alias("cdf"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, alpha: float = 0.5, total_ratio: float = 1.0, seed: str = SEED, piece: float = 8.0, broadcast_sources: int = 50_000, shuffle: bool = True) -> DataFrame:
    """All columns of `docs`, then `mix_rate`, `mix_copies`, `mix_copy` (from 0) and `mix_key`: one row per copy, shuffled."""
    rate, copies, copy, key, source, pieces, cdf = free_names(docs, "mix_rate", "mix_copies", "mix_copy", "mix_key", "_mix_source", "_mix_pieces", "_mix_cdf")
    table = checkpointed(rates(docs, source_col, text_col, weights, alpha, total_ratio, piece).select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("pieces").alias(pieces), F.col("cdf").alias(cdf)))
    if table.count() <= broadcast_sources:
        table = F.broadcast(table)
    joined = docs.join(table, docs[source_col].cast("string").eqNullSafe(F.col(source)), "inner")
    numbers = F.transform(F.sequence(F.lit(0), F.col(pieces) - 1), lambda i: uniform(seed, joined[id_col], i))  # one digest a piece
    drawn = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    counted = joined.withColumn(copies, drawn).where(F.col(copies) > 0)
    each = counted.select(*[counted[c] for c in docs.columns], rate, copies, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy))
    keyed = each.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(each[id_col].cast("string"), F.lit("")), F.col(copy).cast("string"))))
    if not shuffle:
        return keyed
    return keyed.repartition(F.col(key)).sortWithinPartitions(key)


def oracle(weights: str = "CASE WHEN chars > 0 THEN pow(chars / sum(chars) OVER (), 0.5) ELSE 0 END", seed: str = SEED, piece: float = 8.0) -> str:
    """The same rows in DuckDB SQL."""
    most = int(piece + 12 * math.sqrt(piece) + 24)
    return f"""
WITH RECURSIVE per AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS chars FROM documents GROUP BY source),
w AS (SELECT source, chars, sum(chars) OVER () AS total, {weights} AS weight FROM per),
r AS (SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * total / chars ELSE 0 END AS rate FROM w),
q AS (SELECT source, rate, greatest(1, ceil(rate / {piece})) AS pieces FROM r),
cdf AS (SELECT source, 0 AS k, rate / pieces AS l, exp(-rate / pieces) AS p, exp(-rate / pieces) AS c FROM q
  UNION ALL SELECT source, k + 1, l, p * l / (k + 1), c + p * l / (k + 1) FROM cdf WHERE k < {most}),
d AS (SELECT row, doc_id, d.source, text, rate, i,
    CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM (SELECT *, row_number() OVER () AS row FROM documents) d JOIN q ON d.source IS NOT DISTINCT FROM q.source, unnest(range(0, CAST(pieces AS BIGINT))) AS t(i)),
n AS (SELECT row, any_value(doc_id) AS doc_id, any_value(d.source) AS source, any_value(d.text) AS text, any_value(rate) AS rate, count(*) AS copies
  FROM d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY row)
SELECT doc_id, source, round(rate, 6) AS rate, copies, CAST(copy AS BIGINT) AS copy,
  md5('{seed}-order|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy) AS mix_key, text
FROM n, unnest(range(0, copies)) AS t(copy)
"""
