"""Seasonal baselines, robust z-scores, regional normalisation, leave-one-year-out checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larchspan.functions import indices as ix
from larchspan.operators import harmonic, series
from larchspan.plans.kit import IDX, OBS, query
from larchspan.session import checkpointed
from larchspan.sources import domain

NAMES = ["ndvi", "ndre", "ndmi", "crswir"]
FLOORS = {"ndvi": 0.035, "ndre": 0.034, "ndmi": 0.047, "crswir": 0.061}


def in_baseline() -> Column:
    return F.col("year").between(1998, 2000)


def window_sql(name: str, targets: str = "valid", reference: str = "valid AND year BETWEEN 1998 AND 2000", least: int = 5, extra: str = "", match: str = "") -> str:
    """CTEs `b_<name>`: px, ts, med, mad, n of the day-of-year window."""
    return f"""r_{name} AS (SELECT px, doy, year, {name} AS x FROM idx WHERE {reference} AND {name} IS NOT NULL),
m_{name} AS (SELECT o.px, o.ts{extra}, count(r.x) AS n, median(r.x) AS med FROM (SELECT * FROM idx WHERE {targets}) o JOIN r_{name} r ON r.px = o.px
  AND least(abs(r.doy - o.doy), 365 - abs(r.doy - o.doy)) <= 30 {match} GROUP BY ALL),
b_{name} AS (SELECT m.px, m.ts, any_value(m.n) AS n, CASE WHEN any_value(m.n) >= {least} THEN any_value(m.med) END AS med, CASE WHEN any_value(m.n) >= {least} THEN median(abs(r.x - m.med)) END AS mad
  FROM m_{name} m JOIN idx o ON o.px = m.px AND o.ts = m.ts JOIN r_{name} r ON r.px = m.px AND least(abs(r.doy - o.doy), 365 - abs(r.doy - o.doy)) <= 30 GROUP BY m.px, m.ts)"""


WINDOWS = ",\n".join(window_sql(n) for n in NAMES)
Z = "z AS (SELECT o.px, o.ts, o.year, o.doy, o.ndvi, o.ndmi, b_ndvi.med AS ndvi_med, b_ndmi.med AS ndmi_med, b_ndvi.n AS n, " + ", ".join(f"{ix.sign(n)} * (o.{n} - b_{n}.med) / greatest(CAST(1.4826 AS DOUBLE) * b_{n}.mad, CAST({FLOORS[n]} AS DOUBLE)) AS z_{n}" for n in NAMES) + " FROM (SELECT * FROM idx WHERE valid) o " + " ".join(f"LEFT JOIN b_{n} ON b_{n}.px = o.px AND b_{n}.ts = o.ts" for n in NAMES) + ")"


def indexed(spark: SparkSession, sf_dir: str, names: list[str] = NAMES) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where("valid"), names)
    return o.select("px", "ts", "year", "doy", *names)


def scored(spark: SparkSession, sf_dir: str, method: str = "window", harmonics: int = 1) -> DataFrame:
    """px, ts, year, doy, indices, `<i>_med`, `<i>_n` and `z_<i>` of all valid rows against the baseline years.

    `method` is "window" (days of the year around the row's) or "harmonic" (a robust fit of the annual cycle)."""
    if method not in ("window", "harmonic"):
        raise ValueError(f"unknown baseline method {method!r}")
    o = indexed(spark, sf_dir)
    df = series.doy_window_baseline(o, NAMES, in_baseline()) if method == "window" else harmonic.baseline(o, NAMES, in_baseline(), harmonics)
    return df.withColumns({f"z_{n}": series.z_score(F.col(n), F.col(f"{n}_med"), F.col(f"{n}_mad"), ix.sign(n), FLOORS[n]) for n in NAMES})


@query("SELECT o.px, o.ts, coalesce(b.n, 0) AS n, round(b.med, 6) AS med, round(b.mad, 6) AS mad FROM (SELECT * FROM idx WHERE valid) o LEFT JOIN b_ndvi b ON b.px = o.px AND b.ts = o.ts", OBS, IDX, window_sql("ndvi"))
def doy_window_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.doy_window_baseline(indexed(spark, sf_dir, ["ndvi"]), ["ndvi"], in_baseline())
    return df.select("px", "ts", F.col("ndvi_n").alias("n"), F.round("ndvi_med", 6).alias("med"), F.round("ndvi_mad", 6).alias("mad"))


@query("SELECT px, ts, " + ", ".join(f"round(z_{n}, 6) AS z_{n}" for n in NAMES) + " FROM z", OBS, IDX, WINDOWS, Z)
def robust_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("px", "ts", *[F.round(f"z_{n}", 6).alias(f"z_{n}") for n in NAMES])


def irls_sql(rounds: int) -> str:
    out = ["h0 AS (SELECT px, ts, year, doy, ndvi, CASE WHEN year BETWEEN 1998 AND 2000 THEN ndvi END AS x, cos(CAST(doy AS DOUBLE) * CAST(2 * 3.141592653589793 / 365.25 AS DOUBLE)) AS c, sin(CAST(doy AS DOUBLE) * CAST(2 * 3.141592653589793 / 365.25 AS DOUBLE)) AS s, CASE WHEN year BETWEEN 1998 AND 2000 AND ndvi IS NOT NULL THEN CAST(1 AS DOUBLE) END AS w FROM idx WHERE valid)"]
    for r in range(rounds):
        p = f"h{r}" if r == 0 else f"w{r}"
        out.append(f"s{r} AS (SELECT px, sum(w) + 1e-8 AS a, sum(w*c) AS b, sum(w*s) AS g, sum(w*c*c) + 1e-8 AS d, sum(w*c*s) AS e, sum(w*s*s) + 1e-8 AS f, sum(w*x) AS x0, sum(w*x*c) AS y0, sum(w*x*s) AS z0, count(x) AS n FROM {p} GROUP BY px)")
        out.append(f"d{r} AS (SELECT *, a*(d*f-e*e) - b*(b*f-e*g) + g*(b*e-d*g) AS det FROM s{r})")
        out.append(f"k{r} AS (SELECT px, n, (x0*(d*f-e*e) - b*(y0*f-e*z0) + g*(y0*e-d*z0))/det AS b0, (a*(y0*f-e*z0) - x0*(b*f-e*g) + g*(b*z0-y0*g))/det AS b1, (a*(d*z0-y0*e) - b*(b*z0-y0*g) + x0*(b*e-d*g))/det AS b2 FROM d{r} WHERE abs(det) > 1e-12)")
        out.append(f"e{r} AS (SELECT h.* EXCLUDE (w), h.w, k.n, b0 + b1*c + b2*s AS expected, abs(x - (b0 + b1*c + b2*s)) AS r FROM {p} h LEFT JOIN k{r} k USING (px))")
        out.append(f"q{r} AS (SELECT px, CAST(1.4826 AS DOUBLE) * median(r) AS scale FROM e{r} GROUP BY px)")
        if r + 1 < rounds:
            out.append(f"w{r + 1} AS (SELECT px, ts, year, doy, ndvi, x, c, s, CASE WHEN x IS NOT NULL THEN CASE WHEN r / (greatest(scale, 1e-6) * CAST(1.345 AS DOUBLE)) <= 1 THEN CAST(1 AS DOUBLE) ELSE 1.0 / (r / (greatest(scale, 1e-6) * CAST(1.345 AS DOUBLE))) END END AS w FROM e{r} JOIN q{r} USING (px))")
    return "WITH " + ",\n".join(out) + f"\nSELECT px, ts, CAST(coalesce(n, 0) AS BIGINT) AS n, round(CASE WHEN n >= 5 THEN expected END, 6) AS expected, round(CASE WHEN n >= 5 THEN scale END, 6) AS scale FROM e{rounds - 1} JOIN q{rounds - 1} USING (px)"


def _harmonic(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    df = harmonic.fit(indexed(spark, sf_dir, ["ndvi"]), "ndvi", in_baseline(), rounds)
    return df.select("px", "ts", "n", F.round("expected", 6).alias("expected"), F.round("scale", 6).alias("scale"))


@query(irls_sql(1), OBS, IDX)
def harmonic_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonic(spark, sf_dir, 1)


@query(irls_sql(5), OBS, IDX)
def harmonic_irls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _harmonic(spark, sf_dir, 5)


@query(irls_sql(5).replace("round(CASE WHEN n >= 5 THEN expected END, 6) AS expected, round(CASE WHEN n >= 5 THEN scale END, 6) AS scale", "round(CASE WHEN n >= 5 THEN -(ndvi - expected) / greatest(scale, CAST(0.035 AS DOUBLE)) END, 5) AS z_ndvi"), OBS, IDX)
def harmonic_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against the harmonic baseline, the other method of the detection chain."""
    df = scored(spark, sf_dir, "harmonic")
    return df.select("px", "ts", F.col("ndvi_n").alias("n"), F.round("z_ndvi", 5).alias("z_ndvi"))


def offsets_sql(source: str) -> str:
    """Per index and date the offset of the rows of `source`."""
    return " UNION ALL ".join(f"SELECT '{n}' AS name, o.ts, CASE WHEN count(o.{n} - b.med) >= 3 THEN median(o.{n} - b.med) ELSE 0 END AS offset_value, count(o.{n} - b.med) AS n FROM ({source}) o LEFT JOIN b_{n} b ON b.px = o.px AND b.ts = o.ts GROUP BY o.ts" for n in NAMES)


OFFSETS = f"off AS (SELECT * FROM ({offsets_sql('SELECT * FROM idx WHERE valid')}))"


def offsets(df: DataFrame, names: list[str], least: int = 3) -> DataFrame:
    """ts, then `<i>_n` and `<i>_offset` per index: median over the region of each row's distance from its own
    expectation; 0 with few rows.  All indices in one aggregate."""
    d = {n: F.col(n) - F.col(f"{n}_med") for n in names}
    g = df.groupBy("ts").agg(*[x for n in names for x in (F.count(d[n]).alias(f"{n}_n"), F.median(d[n]).alias(f"{n}_m"))])
    return g.select("ts", *[x for n in names for x in (F.col(f"{n}_n"), F.when(F.col(f"{n}_n") >= least, F.col(f"{n}_m")).otherwise(F.lit(0.0)).alias(f"{n}_offset"))])


def _long(o: DataFrame, names: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_offset").alias("offset_value"), F.col(f"{n}_n").alias("n")) for n in names])).alias("e")
    return o.select("ts", each).select("e.name", "ts", F.round("e.offset_value", 6).alias("offset_value"), "e.n")


@query("SELECT name, ts, round(offset_value, 6) AS offset_value, n FROM off", OBS, IDX, WINDOWS, OFFSETS)
def regional_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.doy_window_baseline(indexed(spark, sf_dir), NAMES, in_baseline())
    return _long(offsets(df, NAMES), NAMES)


@query(f"""
WITH f AS (SELECT o.px, max(-(o.ndvi - off.offset_value - b.med) / greatest(CAST(1.4826 AS DOUBLE) * b.mad, CAST(0.035 AS DOUBLE))) AS top FROM (SELECT * FROM idx WHERE valid AND year = 2001) o JOIN (SELECT * FROM off WHERE name = 'ndvi') off USING (ts) LEFT JOIN b_ndvi b ON b.px = o.px AND b.ts = o.ts GROUP BY o.px HAVING top >= 2.2)
SELECT name, ts, n, round(offset_value, 6) AS offset_value FROM ({offsets_sql('SELECT * FROM idx WHERE valid AND px NOT IN (SELECT px FROM f)')})
""", OBS, IDX, WINDOWS, OFFSETS)
def two_pass_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of every index, locations flagged under them, and offsets again without these locations."""
    df = checkpointed(series.doy_window_baseline(indexed(spark, sf_dir), NAMES, in_baseline()))
    first = offsets(df, ["ndvi"]).select("ts", "ndvi_offset")
    z = series.z_score(F.col("ndvi") - F.col("ndvi_offset"), F.col("ndvi_med"), F.col("ndvi_mad"), -1, 0.035)
    flagged = df.where("year = 2001").join(first, "ts").groupBy("px").agg(F.max(z).alias("top")).where("top >= 2.2").select("px")
    return _long(offsets(df.join(flagged, "px", "left_anti"), NAMES), NAMES)


def _loyo_sql(match: str, targets: str = "valid AND year BETWEEN 1998 AND 2000") -> str:
    return f"""r AS (SELECT px, doy, year, ndvi AS x FROM idx WHERE valid AND year BETWEEN 1998 AND 2000 AND ndvi IS NOT NULL),
t AS (SELECT * FROM idx WHERE {targets}),
p AS (SELECT t.px, t.ts, t.year, t.doy, t.ndvi, r.x, median(r.x) OVER (PARTITION BY t.px, t.ts) AS med, count(r.x) OVER (PARTITION BY t.px, t.ts) AS n
  FROM t LEFT JOIN r ON r.px = t.px AND least(abs(r.doy - t.doy), 365 - abs(r.doy - t.doy)) <= 30 AND {match}),
lo AS (SELECT px, ts, year, doy, any_value(n) AS n, CASE WHEN any_value(n) >= 5 THEN -(any_value(ndvi) - any_value(med)) / greatest(CAST(1.4826 AS DOUBLE) * median(abs(x - med)), CAST(0.035 AS DOUBLE)) END AS z FROM p GROUP BY px, ts, year, doy)"""


_CLEAN_MATCH = "CASE WHEN t.year = 1998 THEN r.year <> 1998 ELSE r.year < t.year END"


@query("""
WITH v AS (SELECT px, year, ts, doy, coalesce(z >= 1.2, false) AS a, row_number() OVER (PARTITION BY px, year ORDER BY ts) AS rn FROM lo WHERE z IS NOT NULL),
g AS (SELECT *, rn - sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY px, year ORDER BY ts) AS island FROM v),
i AS (SELECT px, year, island, count(*) FILTER (a) AS length, max(doy) FILTER (a) - min(doy) FILTER (a) AS span FROM g GROUP BY ALL),
d AS (SELECT px, year, bool_or(length >= 2 AND span >= 7) AS disturbed FROM i GROUP BY px, year)
SELECT px, bool_or(disturbed) AS disturbed, max(CASE WHEN disturbed THEN year END) AS last_year, count(*) AS years FROM d GROUP BY px
""", OBS, IDX, _loyo_sql(_CLEAN_MATCH))
def loyo_cleanliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline years held against the years before them (the first against the others): is a year disturbed?"""
    df = indexed(spark, sf_dir, ["ndvi"]).where(in_baseline())
    df = series.doy_window_baseline(df, ["ndvi"], in_baseline(), admit=lambda ref, own: np.where(own == 1998, ref != 1998, ref < own))
    z = series.z_score(F.col("ndvi"), F.col("ndvi_med"), F.col("ndvi_mad"), -1, 0.035)
    runs = series.persistent_runs(df.withColumn("z", z).where("z is not null"), F.col("z") >= 1.2, ["px", "year"])
    return runs.groupBy("px").agg(F.bool_or("hit").alias("disturbed"), F.max(F.when(F.col("hit"), F.col("year"))).alias("last_year"), F.count(F.lit(1)).alias("years"))


@query("""
SELECT year, month(ts) AS month, round(quantile_cont(z, 0.1), 6) AS p10, round(median(z), 6) AS med, round(quantile_cont(z, 0.9), 6) AS p90, round(avg(CASE WHEN z >= 2.5 THEN 1.0 ELSE 0.0 END), 6) AS share_k, count(*) AS n
FROM lo WHERE z IS NOT NULL GROUP BY year, month(ts) HAVING count(*) >= 50
""", OBS, IDX, _loyo_sql("r.year <> t.year"))
def loyo_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal bias: scores of each baseline year against all others, by month."""
    df = series.doy_window_baseline(indexed(spark, sf_dir, ["ndvi"]).where(in_baseline()), ["ndvi"], in_baseline(), admit=lambda ref, own: ref != own)
    df = df.withColumn("z", series.z_score(F.col("ndvi"), F.col("ndvi_med"), F.col("ndvi_mad"), -1, 0.035)).where("z is not null")
    p = F.percentile("z", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy("year", F.month("ts").cast("long").alias("month")).agg(p.alias("p"), F.avg((F.col("z") >= 2.5).cast("double")).alias("s"), F.count(F.lit(1)).alias("n")).where("n >= 50")
    return out.select("year", "month", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p10", "med", "p90"))], F.round("s", 6).alias("share_k"), "n")


@query("""
SELECT f AS floor, o.year, count(*) AS n, round(avg(CASE WHEN -(o.ndvi - b.med) / greatest(CAST(1.4826 AS DOUBLE) * b.mad, f) >= 2.0 THEN 1.0 ELSE 0.0 END), 6) AS flag_rate
FROM (SELECT * FROM idx WHERE valid) o JOIN b_ndvi b ON b.px = o.px AND b.ts = o.ts, (SELECT unnest([CAST(0.01 AS DOUBLE), CAST(0.02 AS DOUBLE), CAST(0.035 AS DOUBLE), CAST(0.05 AS DOUBLE)]) AS f) WHERE b.med IS NOT NULL AND o.ndvi IS NOT NULL GROUP BY 1, 2
""", OBS, IDX, window_sql("ndvi"))
def mad_floor_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flagged rows by year under each candidate floor; the floors are a column, not a loop."""
    df = series.doy_window_baseline(indexed(spark, sf_dir, ["ndvi"]), ["ndvi"], in_baseline()).where("ndvi_med is not null and ndvi is not null")
    df = df.select("year", "ndvi", "ndvi_med", "ndvi_mad", F.explode(F.array(*[F.lit(f) for f in (0.01, 0.02, 0.035, 0.05)])).alias("floor"))
    z = -(F.col("ndvi") - F.col("ndvi_med")) / F.greatest(F.lit(1.4826) * F.col("ndvi_mad"), F.col("floor"))
    return df.groupBy("floor", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((z >= 2.0).cast("double")), 6).alias("flag_rate"))
