"""Projections from digital numbers to indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.functions import indices as ix
from larchspan.plans.kit import IDX, OBS, query
from larchspan.sources import domain


@query("SELECT px, ts, round(ndvi, 6) AS ndvi, round(ndre, 6) AS ndre, round(ndmi, 6) AS ndmi FROM idx", OBS, IDX)
def norm_diff_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ix.with_indices(domain.obs(spark, sf_dir), ["ndvi", "ndre", "ndmi"])
    return df.select("px", "ts", *[F.round(c, 6).alias(c) for c in ("ndvi", "ndre", "ndmi")])


@query("SELECT px, ts, round(crswir, 6) AS crswir FROM idx", OBS, IDX)
def continuum_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ix.with_indices(domain.obs(spark, sf_dir), ["crswir"])
    return df.select("px", "ts", F.round("crswir", 6).alias("crswir"))


@query("""
SELECT o_orderkey AS scene, CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN CAST(-0.05 AS DOUBLE)
    WHEN coalesce(TRY_CAST(CASE WHEN o_custkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey % 6 AS VARCHAR) END AS DOUBLE), 0) >= 4 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS offset_used,
  round(CASE WHEN CAST(o_totalprice AS BIGINT) % 10 <> 0 THEN floor(o_totalprice / 100) * CAST(0.0001 AS DOUBLE) + CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) WHEN o_orderkey % 7 = 0 THEN CAST(-0.05 AS DOUBLE)
    WHEN coalesce(TRY_CAST(CASE WHEN o_custkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey % 6 AS VARCHAR) END AS DOUBLE), 0) >= 4 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END, 6) AS refl
FROM (SELECT *, 1 AS one FROM orders)
""".replace("CAST(o_totalprice AS BIGINT) % 10 <> 0", "floor(o_totalprice / 100) <> 0 AND o_orderkey % 10 <> 0"))
def harmonize_offset_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders")
    baseline = F.when(F.col("o_custkey") % 11 == 0, "n/a").otherwise((F.col("o_custkey") % 6).cast("string"))
    offset = ix.offset_rule(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 7 == 0, F.lit(-0.05)), baseline)
    dn = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0.0)).otherwise(F.floor(F.col("o_totalprice") / 100).cast("double"))
    return o.select(F.col("o_orderkey").alias("scene"), offset.alias("offset_used"), F.round(ix.harmonize(dn, F.lit(1e-4), offset), 6).alias("refl"))


@query("""
SELECT px, ts, CAST(coalesce(round_even(b08 * 10000, 0), -32768) AS INTEGER) AS stored, round(CASE WHEN b08 IS NOT NULL THEN round_even(b08 * 10000, 0) * CAST(0.0001 AS DOUBLE) END, 6) AS restored,
  valid FROM (SELECT px, ts, CASE WHEN valid THEN b08 END AS b08, valid FROM obs)
""", OBS)
def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = domain.obs(spark, sf_dir).select("px", "ts", "valid", F.when(F.col("valid"), F.col("b08")).alias("b08")).withColumn("q", ix.quantise(F.col("b08")))
    return df.select("px", "ts", F.col("q").cast("int").alias("stored"), F.round(ix.dequantise(F.col("q")), 6).alias("restored"), "valid")


@query("""
SELECT px, name AS index, round(avg(v), 6) AS mean_value, count(v) AS n FROM (
  SELECT px, unnest(['ndvi','ndre','ndmi','crswir']) AS name, unnest([ndvi, ndre, ndmi, crswir]) AS v FROM idx WHERE valid) GROUP BY 1, 2
""", OBS, IDX)
def index_registry_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered indices in long form."""
    names = ["ndvi", "ndre", "ndmi", "crswir"]
    df = ix.with_indices(domain.obs(spark, sf_dir).where("valid"), names).select("px", *names)
    return df.unpivot("px", names, "index", "v").groupBy("px", "index").agg(F.round(F.avg("v"), 6).alias("mean_value"), F.count("v").alias("n"))
