"""Early signals against controls, epochs, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.functions.stats import array_median
from larchspan.plans.kit import UNITS, query
from larchspan.sources import domain

DAY = 86400.0


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, orbit, ts, db."""
    return domain.unit_series(spark, sf_dir).select("uid", "orbit", "ts", (F.lit(10.0) * F.log10("lin")).alias("db"))


SERIES = UNITS + ",\ns AS (SELECT uid, orbit, ts, CAST(10 AS DOUBLE) * log10(lin) AS db FROM units)"


@query("""
SELECT a.uid, a.orbit, a.ts, count(b.db) AS n, round(CASE WHEN count(b.db) >= 2 THEN median(b.db) END, 6) AS trailing FROM s a JOIN s b ON b.uid = a.uid AND b.orbit = a.orbit AND b.ts > a.ts - INTERVAL 3 DAY AND b.ts <= a.ts GROUP BY 1, 2, 3
""", SERIES)
def trailing_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over (t - 3 d, t]: a range frame of values and an array median (ordered frames have no median)."""
    w = W.partitionBy("uid", "orbit").orderBy(F.unix_micros("ts")).rangeBetween(-int(3 * DAY * 1e6) + 1, 0)
    u = _unit(spark, sf_dir).withColumn("v", F.collect_list("db").over(w))
    return u.select("uid", "orbit", "ts", F.size("v").cast("long").alias("n"), F.round(F.when(F.size("v") >= 2, array_median(F.col("v"))), 6).alias("trailing"))


@query("""
SELECT uid, count(db) AS n, round(median(db), 6) AS base FROM s WHERE ts >= CAST(DATE '2024-01-27' - INTERVAL 24 DAY AS TIMESTAMP) AND ts < CAST(DATE '2024-01-27' - INTERVAL 12 DAY AS TIMESTAMP) GROUP BY uid
""", SERIES)
def calendar_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over a half-open calendar window before the anchor."""
    t0 = F.lit("2024-01-27").cast("date")
    u = _unit(spark, sf_dir).where((F.col("ts") >= F.date_sub(t0, 24)) & (F.col("ts") < F.date_sub(t0, 12)))
    return u.groupBy("uid").agg(F.count("db").alias("n"), F.round(F.median("db"), 6).alias("base"))


EARLY = """b AS (SELECT uid, median(db) AS base FROM s WHERE ts < TIMESTAMP '2024-01-10' GROUP BY uid),
f AS (SELECT a.uid, a.orbit, a.ts, base, max(n.db) AS top, count(n.db) AS n, date_diff('microsecond', a.ts, max(n.ts)) / 86400000000.0 AS span
  FROM s a JOIN b USING (uid) JOIN s n ON n.uid = a.uid AND n.orbit = a.orbit AND n.ts BETWEEN a.ts AND a.ts + INTERVAL 6 DAY WHERE a.ts < TIMESTAMP '2024-01-25' GROUP BY a.uid, a.orbit, a.ts, base)"""


@query("""
SELECT uid, orbit, min(ts) FILTER (base - top >= -4) AS signal, round(max(base - top), 6) AS largest, count(*) AS windows FROM f WHERE n >= 3 AND span >= 3 GROUP BY uid, orbit
""", SERIES, EARLY)
def early_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First date whose forward window stays below the baseline by a drop, per unit and orbit; forward range frames."""
    u = _unit(spark, sf_dir)
    base = F.median(F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp"), F.col("db"))).over(W.partitionBy("uid"))
    w = W.partitionBy("uid", "orbit").orderBy(F.unix_micros("ts")).rangeBetween(0, int(6 * DAY * 1e6))
    u = u.withColumn("base", base).withColumns({"top": F.max("db").over(w), "n": F.count("db").over(w), "span": (F.unix_micros(F.max("ts").over(w)) - F.unix_micros("ts")) / (DAY * 1e6)})
    ok = u.where((F.col("ts") < F.lit("2024-01-25").cast("timestamp")) & F.col("base").isNotNull() & (F.col("n") >= 3) & (F.col("span") >= 3))
    drop = F.col("base") - F.col("top")
    return ok.groupBy("uid", "orbit").agg(F.min(F.when(drop >= -4, F.col("ts"))).alias("signal"), F.round(F.max(drop), 6).alias("largest"), F.count(F.lit(1)).alias("windows"))


@query("SELECT uid, count(DISTINCT orbit) FILTER (hit) AS n_orbits, round(date_diff('day', CAST(min(sig) AS DATE), DATE '2024-01-30') / CAST(30.44 AS DOUBLE), 6) AS lead_months FROM (SELECT uid, orbit, min(ts) FILTER (base - top >= -4) AS sig, min(ts) FILTER (base - top >= -4) IS NOT NULL AS hit FROM f WHERE n >= 3 AND span >= 3 GROUP BY uid, orbit) GROUP BY uid", SERIES, EARLY)
def signal_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orbits repeat the signal, and its lead in months."""
    e = early_signal(spark, sf_dir)
    return e.groupBy("uid").agg(F.countDistinct(F.when(F.col("signal").isNotNull(), F.col("orbit"))).alias("n_orbits"), F.round(F.date_diff(F.lit("2024-01-30").cast("date"), F.to_date(F.min("signal"))) / 30.44, 6).alias("lead_months"))


CONTROLS = """t AS (SELECT uid, uid % 10 AS parent, CAST(ts AS DATE) AS d, median(db) AS v FROM s GROUP BY 1, 2, 3),
cd AS (SELECT a.uid, a.d, CASE WHEN count(c.v) >= 3 THEN any_value(a.v) - median(c.v) END AS diff, count(c.v) AS n FROM t a LEFT JOIN t c ON c.parent = a.parent AND c.d = a.d AND c.uid % 20 <> c.parent WHERE a.uid % 20 = a.parent GROUP BY a.uid, a.d)"""


def control_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, d, n, diff: value less the median of its controls on the day; NULL with fewer than 3 controls."""
    t = _unit(spark, sf_dir).groupBy("uid", (F.col("uid") % 10).alias("parent"), F.to_date("ts").alias("d")).agg(F.median("db").alias("v"))
    target = t.where("uid % 20 = parent")
    controls = t.where("uid % 20 <> parent").groupBy("parent", "d").agg(F.median("v").alias("c"), F.count("v").alias("n"))
    return target.join(controls, ["parent", "d"], "left").select("uid", "d", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 3, F.col("v") - F.col("c")).alias("diff"))


@query("SELECT uid, d, n, round(diff, 6) AS diff FROM cd", SERIES, CONTROLS)
def controls_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_differences(spark, sf_dir).withColumn("diff", F.round("diff", 6))


EPOCHS = """anchor AS (SELECT uid, DATE '2024-01-10' + CAST(uid % 10 AS INTEGER) AS a0 FROM t GROUP BY uid),
base AS (SELECT cd.uid, median(diff) AS b FROM cd JOIN anchor USING (uid) WHERE d < a0 - 5 GROUP BY cd.uid),
ep AS (SELECT cd.uid, CAST(floor((date_diff('day', a0, d) + 9) / 3.0) AS BIGINT) AS bin, median(diff - b) AS v FROM cd JOIN anchor USING (uid) JOIN base USING (uid) WHERE diff IS NOT NULL AND date_diff('day', a0, d) >= -9 AND date_diff('day', a0, d) < 9 GROUP BY 1, 2)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, bin, v: median difference from the own baseline in bins relative to each unit's anchor."""
    d = control_differences(spark, sf_dir).withColumn("a0", F.expr("date_add(date'2024-01-10', cast(uid % 10 as int))"))
    d = d.withColumn("b", F.median(F.when(F.col("d") < F.date_sub("a0", 5), F.col("diff"))).over(W.partitionBy("uid")))
    rel = F.date_diff("d", "a0")
    d = d.where(F.col("diff").isNotNull() & F.col("b").isNotNull() & (rel >= -9) & (rel < 9))
    return d.groupBy("uid", F.floor((rel + 9) / 3).alias("bin")).agg(F.median(F.col("diff") - F.col("b")).alias("v"))


@query("SELECT bin, count(*) AS n, round(median(v), 6) AS med FROM ep GROUP BY bin", SERIES, CONTROLS, EPOCHS)
def superposed_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("v"), 6).alias("med"))


@query("""
WITH n AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT uid FROM ep)),
r AS (SELECT b, j, CAST('0x' || substr(md5('boot|' || b || '|' || j), 1, 8) AS BIGINT) % total AS pick FROM range(0, 100) t(b), (SELECT i AS j, total FROM n)),
m AS (SELECT b, bin, median(v) AS med FROM r JOIN n ON n.i = r.pick JOIN ep USING (uid) GROUP BY b, bin)
SELECT bin, round(quantile_cont(med, 0.05), 6) AS low, round(quantile_cont(med, 0.95), 6) AS high, count(*) AS n_boot FROM m GROUP BY bin
""", SERIES, CONTROLS, EPOCHS)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile band of bin medians over resampled units; draws come from a hash, replicates are a column."""
    e = epochs(spark, sf_dir)
    units = e.select("uid").distinct()
    total = units.agg(F.count(F.lit(1)).alias("total"))
    numbered = units.select("uid", (F.row_number().over(W.orderBy("uid")) - 1).alias("i"))  # one row a unit
    draws = numbered.crossJoin(F.broadcast(total)).select(F.col("i").alias("j"), "total", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("boot"), "b", "j")), 1, 8), 16, 10).cast("long") % F.col("total")
    m = draws.select("b", pick.alias("i")).join(numbered, "i").join(e, "uid").groupBy("b", "bin").agg(F.median("v").alias("med"))
    p = F.percentile("med", F.array(F.lit(0.05), F.lit(0.95)))
    return m.groupBy("bin").agg(p.alias("p"), F.count(F.lit(1)).alias("n_boot")).select("bin", F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"), "n_boot")


@query("""
SELECT uid, d, CASE WHEN v IS NULL THEN 'no data' WHEN v < 5 THEN 'frozen' WHEN v > 19 THEN 'snow' ELSE '' END AS reason, coalesce(v >= 5 AND v <= 19, false) AS used FROM t
""", SERIES, CONTROLS)
def frozen_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection reasons, the first match wins."""
    t = _unit(spark, sf_dir).groupBy("uid", F.to_date("ts").alias("d")).agg(F.median("db").alias("v"))
    reason = F.when(F.col("v").isNull(), "no data").when(F.col("v") < 5, "frozen").when(F.col("v") > 19, "snow").otherwise("")
    return t.select("uid", "d", reason.alias("reason"), (reason == "").alias("used"))


@query("SELECT CAST(ts AS DATE) AS d, orbit, round(CAST(10 AS DOUBLE) * log10(median(CASE WHEN uid % 3 <> 0 THEN lin END)), 6) AS stable_db, round(avg(CASE WHEN lin > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_valid FROM units GROUP BY 1, 2", UNITS)
def stable_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = domain.unit_series(spark, sf_dir).groupBy(F.to_date("ts").alias("d"), "orbit").agg(F.median(F.when(F.col("uid") % 3 != 0, F.col("lin"))).alias("m"), F.avg((F.col("lin") > 1).cast("double")).alias("s"))
    return u.select("d", "orbit", F.round(F.lit(10.0) * F.log10("m"), 6).alias("stable_db"), F.round("s", 6).alias("share_valid"))
