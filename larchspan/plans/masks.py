"""Validity, haze and forest masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.functions import indices as ix
from larchspan.operators import series
from larchspan.plans.kit import GRID, IDX, OBS, query
from larchspan.sources import domain


@query("""
SELECT ts, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction FROM obs JOIN grid USING (px) WHERE in_aoi GROUP BY ts
""", GRID, OBS)
def scl_valid_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = domain.grid(spark, sf_dir).where("in_aoi").select("px")
    df = domain.obs(spark, sf_dir).select("px", "ts", "valid").join(g, "px")
    return df.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("valid_fraction"))


@query("""
WITH f AS (SELECT ts FROM obs GROUP BY ts HAVING avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) >= 0.6)
SELECT px, ts, round(b08, 6) AS b08 FROM obs SEMI JOIN f USING (ts) WHERE valid AND strftime(ts, '%m-%d') BETWEEN '05-01' AND '09-30' AND year IN (1998, 1999, 2000, 2001)
""", OBS)
def season_valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the season on dates whose valid share reaches 0.6."""
    o = domain.obs(spark, sf_dir).select("px", "ts", "year", "valid", "b08")
    good = o.groupBy("ts").agg(F.avg(F.col("valid").cast("double")).alias("share")).where("share >= 0.6").select("ts")
    season = o.where(F.col("valid") & F.date_format("ts", "MM-dd").between("05-01", "09-30") & F.col("year").isin(1998, 1999, 2000, 2001))
    return season.join(good, "ts", "left_semi").select("px", "ts", F.round("b08", 6).alias("b08"))


@query("SELECT px, round(median(ndvi), 6) AS summer_ndvi, count(ndvi) AS n FROM idx WHERE valid AND strftime(ts, '%m-%d') BETWEEN '06-01' AND '08-31' AND year < 2001 GROUP BY px", OBS, IDX)
def summer_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where(F.col("valid") & (F.col("year") < 2001) & F.date_format("ts", "MM-dd").between("06-01", "08-31")), ["ndvi"])
    return o.groupBy("px").agg(F.round(F.median("ndvi"), 6).alias("summer_ndvi"), F.count("ndvi").alias("n"))


@query("SELECT px, round(quantile_cont(ndvi, 0.9) - quantile_cont(ndvi, 0.1), 6) AS seasonal_range FROM idx WHERE valid GROUP BY px", OBS, IDX)
def seasonal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where("valid"), ["ndvi"])
    p = F.percentile("ndvi", F.array(F.lit(0.1), F.lit(0.9)))
    return o.groupBy("px").agg(p.alias("p")).select("px", F.round(F.col("p")[1] - F.col("p")[0], 6).alias("seasonal_range"))


@query("""
SELECT CAST(floor(row / 4) AS BIGINT) AS brow, CAST(floor(col / 4) AS BIGINT) AS bcol, round(avg(CASE WHEN level > 3000 THEN 1.0 ELSE 0.0 END), 6) AS forest_fraction, count(*) AS n,
  arg_max(region, c) AS unused FROM (SELECT *, 1 AS c FROM grid) GROUP BY 1, 2
""".replace(",\n  arg_max(region, c) AS unused", ""), GRID)
def forest_fraction_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = domain.grid(spark, sf_dir)
    return g.groupBy(F.floor(F.col("row") / 4).alias("brow"), F.floor(F.col("col") / 4).alias("bcol")).agg(F.round(F.avg((F.col("level") > 3000).cast("double")), 6).alias("forest_fraction"), F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT floor(row / 4) AS brow, floor(col / 4) AS bcol, region, count(*) AS n FROM grid GROUP BY 1, 2, 3)
SELECT CAST(brow AS BIGINT) AS brow, CAST(bcol AS BIGINT) AS bcol, region AS mode_class FROM b QUALIFY row_number() OVER (PARTITION BY brow, bcol ORDER BY n DESC, region) = 1
""", GRID)
def coarse_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent class of each coarse cell, the smallest on ties."""
    n = domain.grid(spark, sf_dir).groupBy(F.floor(F.col("row") / 4).alias("brow"), F.floor(F.col("col") / 4).alias("bcol"), "region").count()
    return n.groupBy("brow", "bcol").agg(F.min(F.struct(-F.col("count"), F.col("region").alias("region"))).alias("m")).select("brow", "bcol", F.col("m.region").alias("mode_class"))


FOREST = """sm AS (SELECT px, median(ndvi) AS summer, count(ndvi) AS n FROM idx WHERE valid AND strftime(ts, '%m-%d') BETWEEN '06-01' AND '08-31' GROUP BY px),
rg AS (SELECT px, quantile_cont(ndvi, 0.9) - quantile_cont(ndvi, 0.1) AS amp FROM idx WHERE valid GROUP BY px),
forest AS (SELECT grid.px, CASE WHEN NOT in_aoi THEN 255 WHEN base <> 0 AND (col = 3) THEN 4 WHEN base = 1 AND amp > 0.42 THEN 5 ELSE base END AS code FROM (
  SELECT grid.px, CASE WHEN level < 0 THEN 0 WHEN sm.n IS NULL OR summer IS NULL THEN 3 WHEN summer < 0.62 THEN 2 ELSE 1 END AS base FROM grid LEFT JOIN sm USING (px)) b
  JOIN grid USING (px) LEFT JOIN rg USING (px))"""


def forest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, code: 0 no forest, 1 analysed, 2 low summer greenness, 3 no summer data, 4 linear, 5 high amplitude, 255 outside."""
    o = ix.with_indices(domain.obs(spark, sf_dir).where("valid"), ["ndvi"]).select("px", "ts", "ndvi")
    summer = F.when(F.date_format("ts", "MM-dd").between("06-01", "08-31"), F.col("ndvi"))
    p = F.percentile("ndvi", F.array(F.lit(0.1), F.lit(0.9)))
    per = o.groupBy("px").agg(F.median(summer).alias("summer"), p.alias("p")).withColumn("amp", F.col("p")[1] - F.col("p")[0])
    df = domain.grid(spark, sf_dir).join(per, "px", "left")
    base = F.when(F.col("level") < 0, 0).when(F.col("summer").isNull(), 3).when(F.col("summer") < 0.62, 2).otherwise(1)
    df = df.withColumn("base", base)
    code = F.when(~F.col("in_aoi"), 255).when((F.col("base") != 0) & (F.col("col") == 3), 4).when((F.col("base") == 1) & F.coalesce(F.col("amp") > 0.42, F.lit(False)), 5).otherwise(F.col("base"))
    return df.select("px", "row", "col", "in_aoi", "region", "width", code.cast("int").alias("code"))


@query("SELECT px, CAST(code AS INTEGER) AS code FROM forest", GRID, OBS, IDX, FOREST)
def forest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_table(spark, sf_dir).select("px", "code")


@query("""
SELECT k AS code, round(avg(CASE WHEN code = k THEN 1.0 ELSE 0.0 END), 6) AS share FROM forest JOIN grid USING (px), (SELECT unnest([0,1,2,3,4,5]) AS k) WHERE in_aoi GROUP BY k
""", GRID, OBS, IDX, FOREST)
def code_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each forest code inside the area, codes that do not occur included."""
    f = forest_table(spark, sf_dir).where("in_aoi").groupBy("code").count()
    codes = spark.range(6).select(F.col("id").cast("int").alias("code"))
    total = f.agg(F.sum("count").alias("total"))
    return codes.join(f, "code", "left").crossJoin(F.broadcast(total)).select("code", F.round(F.coalesce("count", F.lit(0)) / F.col("total"), 6).alias("share"))


HAZE = """r AS (SELECT px, doy, b02 FROM obs WHERE valid AND year BETWEEN 1998 AND 2000),
hz AS (SELECT o.px, o.ts, o.year, o.valid, CASE WHEN count(r.b02) >= 3 THEN o.b02 - median(r.b02) END AS excess FROM obs o LEFT JOIN r ON r.px = o.px
  AND least(abs(r.doy - o.doy), 365 - abs(r.doy - o.doy)) <= 30 GROUP BY o.px, o.ts, o.year, o.valid, o.b02),
cand AS (SELECT *, valid AND coalesce(excess > CAST(0.02 AS DOUBLE), false) AS candidate FROM hz),
nx AS (SELECT *, lead(candidate) OVER (PARTITION BY px, year, valid ORDER BY ts) AS nxt FROM cand),
haze AS (SELECT px, ts, year, valid, candidate, coalesce(candidate AND NOT nxt, false) AS hazy, candidate AND nxt IS NULL AS unresolved FROM nx)"""


def _haze(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.obs(spark, sf_dir).select("px", "ts", "year", "doy", "b02", "valid")
    return series.transient_haze(o, F.col("valid") & F.col("year").between(1998, 2000))


@query("SELECT px, ts, valid, candidate, hazy, unresolved FROM haze", OBS, HAZE)
def haze_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _haze(spark, sf_dir).select("px", "ts", "valid", "candidate", "hazy", "unresolved")


@query("""
SELECT px, ts, hazy OR (unresolved AND share >= 0.1) AS hazy_all, round(share, 6) AS scene_share
FROM (SELECT *, sum(CASE WHEN unresolved THEN 1 ELSE 0 END) OVER (PARTITION BY ts) / greatest(sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY ts), 1) AS share FROM haze)
""", OBS, HAZE)
def haze_scene_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.promote_scenes(_haze(spark, sf_dir)).select("px", "ts", "hazy_all", F.round("scene_share", 6).alias("scene_share"))


@query("""
SELECT ts, count(*) FILTER (valid) AS n_valid, count(*) FILTER (hazy) AS n_hazy, round(count(*) FILTER (hazy) / greatest(count(*) FILTER (valid), 1), 6) AS hazy_share,
  round(count(*) FILTER (valid) / count(*), 6) AS before_fraction, round(count(*) FILTER (valid AND NOT hazy) / count(*), 6) AS after_fraction, count(*) FILTER (valid AND NOT hazy) / count(*) < 0.5 AS dropped
FROM haze GROUP BY ts
""", OBS, HAZE)
def haze_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _haze(spark, sf_dir).groupBy("ts").agg(F.count_if("valid").alias("n_valid"), F.count_if("hazy").alias("n_hazy"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid") & ~F.col("hazy")).alias("left"))
    return df.select("ts", "n_valid", "n_hazy", F.round(F.col("n_hazy") / F.greatest("n_valid", F.lit(1)), 6).alias("hazy_share"), F.round(F.col("n_valid") / F.col("n"), 6).alias("before_fraction"), F.round(F.col("left") / F.col("n"), 6).alias("after_fraction"), (F.col("left") / F.col("n") < 0.5).alias("dropped"))
