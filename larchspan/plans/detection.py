"""Votes, persistent runs, features and status codes per location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.functions import indices as ix
from larchspan.operators import series
from larchspan.plans.baseline import NAMES, WINDOWS, Z, scored
from larchspan.plans.kit import GRID, IDX, OBS, query
from larchspan.plans.masks import FOREST, forest_table
from larchspan.sources import domain

K = 1.0
VOTE = f"""vote AS (SELECT *, (CASE WHEN z_ndre >= {K} THEN 1 ELSE 0 END) + (CASE WHEN z_ndmi >= {K} THEN 1 ELSE 0 END) + (CASE WHEN z_crswir >= {K} THEN 1 ELSE 0 END) AS n_agree FROM z),
an AS (SELECT *, z_ndvi IS NOT NULL AS has_z, coalesce(z_ndvi >= {K}, false) AND n_agree >= 1 AS anomalous,
  coalesce(ndvi <= 0.5 AND ndvi - ndvi_med <= CAST(-0.25 AS DOUBLE), false) OR coalesce(ndmi - ndmi_med <= CAST(-0.15 AS DOUBLE), false) AS cut FROM vote)"""


def runs_sql(flag: str, out: str, source: str = "an") -> str:
    """CTE `out`: px, hit, first, longest, pending of the runs of `flag` over the monitored year's valid rows."""
    return f"""{out}_v AS (SELECT px, ts, doy, {flag} AS a, row_number() OVER (PARTITION BY px ORDER BY ts) AS rn, count(*) OVER (PARTITION BY px) AS total FROM {source} WHERE year = 2001 AND has_z),
{out}_g AS (SELECT *, rn - sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY px ORDER BY ts) AS island FROM {out}_v),
{out}_i AS (SELECT px, island, count(*) FILTER (a) AS length, max(doy) FILTER (a) - min(doy) FILTER (a) AS span, min(ts) FILTER (a) AS t0, max(rn) FILTER (a) AS last, any_value(total) AS total FROM {out}_g GROUP BY px, island),
{out} AS (SELECT px, min(CASE WHEN length >= 2 AND span >= 7 THEN t0 END) IS NOT NULL AS hit, coalesce(min(CASE WHEN length >= 2 AND span >= 7 THEN t0 END), min(CASE WHEN last = total AND length >= 2 THEN t0 END)) AS first,
  max(length) AS longest, min(CASE WHEN length >= 2 AND span >= 7 THEN t0 END) IS NULL AND min(CASE WHEN last = total AND length >= 2 THEN t0 END) IS NOT NULL AS pending FROM {out}_i GROUP BY px)"""


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    has_z, agree, anomalous = series.vote(F.col("z_ndvi"), [F.col(f"z_{n}") for n in NAMES[1:]], K, 1)
    return df.withColumns({"has_z": has_z, "n_agree": agree, "anomalous": anomalous, "cut": series.cut_signature(F.col("ndvi"), F.col("ndvi_med"), F.col("ndmi"), F.col("ndmi_med"))})


def runs(df: DataFrame, flag: str = "anomalous") -> DataFrame:
    return series.persistent_runs(df.where("year = 2001 and has_z"), F.col(flag), ["px"])


@query("SELECT px, ts, has_z, CAST(n_agree AS INTEGER) AS n_agree, has_z AND anomalous AS anomalous FROM an", OBS, IDX, WINDOWS, Z, VOTE)
def anomaly_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voted(spark, sf_dir).select("px", "ts", "has_z", "n_agree", "anomalous")


@query("SELECT px, hit, first, longest, pending FROM runs", OBS, IDX, WINDOWS, Z, VOTE, runs_sql("anomalous", "runs"))
def persistent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: index, seasonal baseline, robust z, vote, persistent run per location."""
    return runs(voted(spark, sf_dir))


@query("SELECT px, hit, first, longest, pending FROM runs", OBS, IDX, WINDOWS, Z, VOTE, runs_sql("cut", "runs"))
def cut_signature_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(voted(spark, sf_dir), "cut")


FEATURES = """feat AS (SELECT a.px, any_value(r.hit OR r.pending) AS flag, any_value(r.first) AS first, any_value(r.longest) AS run_len, any_value(r.pending) AS pending,
  median(CASE WHEN a.year = 2001 AND a.anomalous AND a.ts >= r.first THEN a.n_agree END) AS n_agree, median(CASE WHEN a.year = 2001 AND a.anomalous AND a.ts >= r.first THEN a.z_ndvi END) AS z_primary,
  avg(CASE WHEN a.year = 2001 AND a.anomalous AND a.ts >= r.first THEN CASE WHEN a.cut THEN 1.0 ELSE 0.0 END END) >= 0.5 AS is_cut,
  max(CASE WHEN a.year = 2001 THEN a.z_ndvi END) AS max_z, count(CASE WHEN a.year BETWEEN 1998 AND 2000 THEN a.ndvi END) AS n_baseline,
  median(CASE WHEN a.year = 2000 AND a.doy >= 227 THEN a.z_ndvi END) AS prev_autumn_z FROM an a LEFT JOIN runs r USING (px) GROUP BY a.px)"""


def feature_table(df: DataFrame) -> DataFrame:
    """Per location: flag, first, run_len, pending, medians over the anomalous rows from the first on, share of cuts."""
    joined = series.with_runs(df, (F.col("year") == 2001) & F.col("has_z"), F.col("anomalous"), ["px"])
    late = (F.col("year") == 2001) & F.col("anomalous") & (F.col("ts") >= F.col("first"))
    return joined.groupBy("px").agg(
        F.first(F.col("hit") | F.col("pending")).alias("flag"), F.first("first").alias("first"), F.first("longest").alias("run_len"), F.first("pending").alias("pending"),
        F.median(F.when(late, F.col("n_agree"))).alias("n_agree"), F.median(F.when(late, F.col("z_ndvi"))).alias("z_primary"),
        (F.avg(F.when(late, F.col("cut").cast("double"))) >= 0.5).alias("is_cut"), F.max(F.when(F.col("year") == 2001, F.col("z_ndvi"))).alias("max_z"),
        F.count(F.when(F.col("year").between(1998, 2000), F.col("ndvi"))).alias("n_baseline"),
        F.median(F.when((F.col("year") == 2000) & (F.col("doy") >= 227), F.col("z_ndvi"))).alias("prev_autumn_z"),
    )


@query("SELECT px, flag, first, run_len, pending, round(n_agree, 6) AS n_agree, round(z_primary, 6) AS z_primary, is_cut, round(max_z, 6) AS max_z, n_baseline, round(prev_autumn_z, 6) AS prev_autumn_z FROM feat", OBS, IDX, WINDOWS, Z, VOTE, runs_sql("anomalous", "runs"), FEATURES)
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feature_table(voted(spark, sf_dir))
    return f.select("px", "flag", "first", "run_len", "pending", *[F.round(c, 6).alias(c) for c in ("n_agree", "z_primary", "max_z", "prev_autumn_z")], "is_cut", "n_baseline")


STATUS = """status AS (SELECT g.px, CASE WHEN NOT g.in_aoi THEN 255 WHEN fo.code = 5 AND NOT coalesce(is_cut, false) THEN 4 WHEN fo.code NOT IN (1, 5) THEN 4 WHEN n_baseline > 150 AND prev_autumn_z > 0.6 THEN 3
  WHEN flag AND is_cut THEN 2 WHEN flag THEN 1 WHEN flag = false THEN 0 ELSE 4 END AS code FROM grid g JOIN forest fo USING (px) LEFT JOIN feat USING (px))"""


@query("SELECT px, CAST(code AS INTEGER) AS code FROM status", GRID, OBS, IDX, FOREST, WINDOWS, Z, VOTE, runs_sql("anomalous", "runs"), FEATURES, STATUS)
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rule that applies wins, so the CASE lists them in reverse."""
    f = feature_table(voted(spark, sf_dir))
    df = forest_table(spark, sf_dir).withColumnRenamed("code", "forest").join(f, "px", "left")
    cut = F.coalesce("is_cut", F.lit(False))
    code = (
        F.when(~F.col("in_aoi"), 255).when((F.col("forest") == 5) & ~cut, 4).when(~F.col("forest").isin(1, 5), 4)
        .when((F.col("n_baseline") > 150) & (F.col("prev_autumn_z") > 0.6), 3).when(F.col("flag") & F.col("is_cut"), 2).when(F.col("flag"), 1).when(~F.col("flag"), 0).otherwise(4)
    )
    return df.select("px", code.cast("int").alias("code"))


@query("""
SELECT f.px, fo.code AS forest, CASE WHEN fo.code <> 5 OR (flag AND is_cut) THEN flag END AS flag, CASE WHEN fo.code <> 5 OR (flag AND is_cut) THEN run_len END AS run_len FROM feat f JOIN (SELECT px, CAST(code AS INTEGER) AS code FROM forest) fo USING (px)
""", GRID, OBS, IDX, FOREST, WINDOWS, Z, VOTE, runs_sql("anomalous", "runs"), FEATURES)
def cuts_only_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In high-amplitude locations only flagged cuts keep their features."""
    f = feature_table(voted(spark, sf_dir)).join(forest_table(spark, sf_dir).select("px", F.col("code").alias("forest")), "px")
    stay = (F.col("forest") != 5) | F.coalesce(F.col("flag") & F.col("is_cut"), F.lit(False))
    return f.select("px", "forest", F.when(stay, F.col("flag")).alias("flag"), F.when(stay, F.col("run_len")).alias("run_len"))


@query("""
SELECT px, round(-(median(ndvi) FILTER (year = 2001) - median(ndvi) FILTER (year BETWEEN 1998 AND 2000)), 6) AS summer_change FROM idx WHERE valid AND strftime(ts, '%m-%d') BETWEEN '06-01' AND '08-31' GROUP BY px
""", OBS, IDX)
def summer_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where(F.col("valid") & F.date_format("ts", "MM-dd").between("06-01", "08-31")), ["ndvi"])
    d = F.median(F.when(F.col("year") == 2001, F.col("ndvi"))) - F.median(F.when(F.col("year").between(1998, 2000), F.col("ndvi")))
    return o.groupBy("px").agg(F.round(d * ix.sign("ndvi"), 6).alias("summer_change"))


@query("SELECT ts, round(median(b04), 6) AS b04, round(median(b08), 6) AS b08, round(median(b11), 6) AS b11 FROM obs JOIN grid USING (px) WHERE region = 3 AND valid GROUP BY ts", GRID, OBS)
def reflectance_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = domain.grid(spark, sf_dir).where("region = 3").select("px")
    o = domain.obs(spark, sf_dir).where("valid").select("px", "ts", "b04", "b08", "b11").join(g, "px", "left_semi")
    return o.groupBy("ts").agg(*[F.round(F.median(b), 6).alias(b) for b in ("b04", "b08", "b11")])


@query("""
SELECT year, px, round(median(ndvi), 6) AS ndvi, round(median(ndmi), 6) AS ndmi FROM idx WHERE valid AND month(ts) BETWEEN 6 AND 8 GROUP BY year, px
""", OBS, IDX)
def yearly_index_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where(F.col("valid") & F.month("ts").between(6, 8)), ["ndvi", "ndmi"])
    return o.groupBy("year", "px").agg(F.round(F.median("ndvi"), 6).alias("ndvi"), F.round(F.median("ndmi"), 6).alias("ndmi"))
