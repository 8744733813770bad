"""Climate features: daily aggregation, evapotranspiration, water balance, degree-day phenology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.functions import climate as cl
from larchspan.operators import phenology
from larchspan.plans.kit import WEATHER, query
from larchspan.sources import domain

HOURLY = """h AS (SELECT user_id % 5 AS cell, date_trunc('hour', ts) AS ts, max(value) AS v, max(event_id % 7) AS w FROM events GROUP BY 1, 2),
own AS (SELECT cell, CAST(ts AS DATE) AS d, max(v) AS tmax, min(v) AS tmin, avg(v) AS tmean, avg(w) AS wind, count(*) AS n FROM h GROUP BY 1, 2),
acc AS (SELECT cell, CAST(ts AS DATE) - 1 AS d, v * 1000 AS precip FROM h WHERE hour(ts) = 0)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).alias("cell"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("value").alias("v"), F.max(F.col("event_id") % 7).alias("w"))


@query("""
SELECT coalesce(o.cell, acc.cell) AS cell, coalesce(o.d, acc.d) AS d, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin, round(tmean, 6) AS tmean, round(wind, 6) AS wind, round(precip, 6) AS precip FROM (SELECT * FROM own WHERE n = 24) o FULL JOIN acc ON acc.cell = o.cell AND acc.d = o.d
""", HOURLY)
def hourly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with all 24 hours; an accumulated value at 00 UTC belongs to the day before."""
    h = hourly(spark, sf_dir)
    own = h.groupBy("cell", F.to_date("ts").alias("d")).agg(F.max("v").alias("tmax"), F.min("v").alias("tmin"), F.avg("v").alias("tmean"), F.avg("w").alias("wind"), F.count(F.lit(1)).alias("n")).where("n = 24").drop("n")
    acc = h.where(F.hour("ts") == 0).select("cell", F.date_sub(F.to_date("ts"), 1).alias("d"), (F.col("v") * 1000).alias("precip"))
    return own.join(acc, ["cell", "d"], "full").select("cell", "d", *[F.round(c, 6).alias(c) for c in ("tmax", "tmin", "tmean", "wind", "precip")])


SAT = "CAST(0.6108 AS DOUBLE) * exp(CAST(17.27 AS DOUBLE) * {t} / ({t} + CAST(237.3 AS DOUBLE)))"


@query(f"""
WITH w AS (SELECT *, CAST(dayofyear(date) AS DOUBLE) AS j, radians(CAST(57 AS DOUBLE)) AS phi, (tmax + tmin) / 2 AS mid FROM weather),
a AS (SELECT *, 1 + CAST(0.033 AS DOUBLE) * cos(CAST(2 * 3.141592653589793 / 365 AS DOUBLE) * j) AS dr, CAST(0.409 AS DOUBLE) * sin(CAST(2 * 3.141592653589793 / 365 AS DOUBLE) * j - CAST(1.39 AS DOUBLE)) AS decl FROM w),
b AS (SELECT *, acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), -tan(phi) * tan(decl)))) AS ws FROM a),
c AS (SELECT *, CAST(24 * 60 / 3.141592653589793 * 0.0820 AS DOUBLE) * dr * (ws * sin(phi) * sin(decl) + cos(phi) * cos(decl) * sin(ws)) AS ra, {SAT.format(t='tmin')} AS ea, ({SAT.format(t='tmax')} + {SAT.format(t='tmin')}) / 2 AS es, 4098 * {SAT.format(t='mid')} / ((mid + CAST(237.3 AS DOUBLE)) * (mid + CAST(237.3 AS DOUBLE))) AS s FROM b),
d AS (SELECT *, CAST(0.17 AS DOUBLE) * sqrt(tmax - tmin) * ra AS rs, (CAST(0.75 AS DOUBLE) + CAST(2e-5 AS DOUBLE) * 50) * ra AS rso, CAST(0.000665 AS DOUBLE) * CAST(101.3 AS DOUBLE) * pow((CAST(293 AS DOUBLE) - CAST(0.0065 AS DOUBLE) * 50) / CAST(293 AS DOUBLE), CAST(5.26 AS DOUBLE)) AS gamma FROM c),
e AS (SELECT *, CAST(0.77 AS DOUBLE) * rs - CAST(4.903e-9 AS DOUBLE) * (pow(tmax + CAST(273.16 AS DOUBLE), CAST(4 AS DOUBLE)) + pow(tmin + CAST(273.16 AS DOUBLE), CAST(4 AS DOUBLE))) / 2 * (CAST(0.34 AS DOUBLE) - CAST(0.14 AS DOUBLE) * sqrt(ea)) * (CAST(1.35 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), least(rs / rso, CAST(1 AS DOUBLE))) - CAST(0.35 AS DOUBLE)) AS rn FROM d)
SELECT node, date, round(ra, 6) AS ra, round(CAST(24 / 3.141592653589793 AS DOUBLE) * ws, 6) AS daylight, round((CAST(0.408 AS DOUBLE) * s * rn + gamma * 900 / (mid + 273) * 2 * (es - ea)) / (s + gamma * (1 + CAST(0.34 AS DOUBLE) * 2)), 6) AS et0 FROM e
""", WEATHER)
def et0_fao56(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = domain.daily_weather(spark, sf_dir)
    j, phi = F.dayofyear("date").cast("double"), F.radians(F.lit(57.0))
    ra, ea = cl.extraterrestrial(j, phi), cl.saturation(F.col("tmin"))
    rs, rso = F.lit(0.17) * F.sqrt(F.col("tmax") - F.col("tmin")) * ra, cl.clear_sky(ra, F.lit(50.0))  # radiation from the day's range
    rn = F.lit(1 - cl.ALBEDO) * rs - cl.net_longwave(F.col("tmax"), F.col("tmin"), ea, rs, rso)
    out = cl.et0(F.col("tmax"), F.col("tmin"), (F.col("tmax") + F.col("tmin")) / 2, ea, F.lit(2.0), rn, cl.psychrometric(cl.pressure(F.lit(50.0))))
    return w.select("node", "date", F.round(ra, 6).alias("ra"), F.round(cl.daylight_hours(j, phi), 6).alias("daylight"), F.round(out, 6).alias("et0"))


BALANCE = """bal AS (SELECT node, year, CASE WHEN count(precip) = date_diff('day', make_date(CAST(year AS INTEGER), 4, 1), make_date(CAST(year AS INTEGER), 9, 30)) + 1 THEN sum(precip - et0) END AS balance, count(*) AS days FROM weather WHERE month(date) BETWEEN 4 AND 9 GROUP BY 1, 2)"""


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal precipitation less evapotranspiration; NULL unless every day is there."""
    w = domain.daily_weather(spark, sf_dir).where(F.month("date").between(4, 9))
    need = F.date_diff(F.make_date(F.col("year").cast("int"), F.lit(9), F.lit(30)), F.make_date(F.col("year").cast("int"), F.lit(4), F.lit(1))) + 1
    return w.groupBy("node", "year").agg(F.sum(F.col("precip") - F.col("et0")).alias("s"), F.count("precip").alias("n"), F.count(F.lit(1)).alias("days")).select("node", "year", F.when(F.col("n") == need, F.col("s")).alias("balance"), "days")


@query("SELECT node, year, round(balance, 4) AS balance, days FROM bal", WEATHER, BALANCE)
def seasonal_water_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(spark, sf_dir).withColumn("balance", F.round("balance", 4))


@query("""
SELECT node, year, round(CASE WHEN count(balance) FILTER (year BETWEEN 1996 AND 1999) OVER w = 4 THEN (balance - avg(balance) FILTER (year BETWEEN 1996 AND 1999) OVER w) / stddev_samp(balance) FILTER (year BETWEEN 1996 AND 1999) OVER w END, 5) AS z FROM bal WINDOW w AS (PARTITION BY node)
""", WEATHER, BALANCE)
def water_balance_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised against the reference years; NULL if one is incomplete."""
    w = W.partitionBy("node")
    ref = F.when(F.col("year").between(1996, 1999), F.col("balance"))
    return balance(spark, sf_dir).select("node", "year", F.round(F.when(F.count(ref).over(w) == 4, (F.col("balance") - F.avg(ref).over(w)) / F.stddev_samp(ref).over(w)), 5).alias("z"))


def _since_march(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.daily_weather(spark, sf_dir).where(F.date_format("date", "MM-dd") >= "03-07")


def effective_sql(t: str) -> str:
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    return f"CASE WHEN {t} > {d(cl.LOWER)} AND {t} <= {d(cl.OPTIMUM)} THEN {t} - {d(cl.LOWER)} WHEN {t} > {d(cl.OPTIMUM)} AND {t} < {d(cl.UPPER)} THEN ({d(cl.OPTIMUM)} - {d(cl.LOWER)}) * (exp({d(cl.ALPHA)} * {t}) - exp({d(cl.ALPHA)} * {d(cl.LETHAL)} - ({d(cl.LETHAL)} - {t}) / {d(cl.BETA)}) - {d(cl.GAMMA)}) ELSE 0 END"


def rity_sql(variants: str) -> str:
    """CTE `rity`: the phenology of every (node, year) for the (scenario, corrected) rows in `variants`; broods by joins."""
    line = lambda table, t: "CASE scenario " + " ".join(f"WHEN '{s}' THEN CAST({table[k][0]} AS DOUBLE) + CAST({table[k][1]} AS DOUBLE) * {t.format(k=k)}" for s, k in phenology.SCENARIOS.items()) + " END"
    plain = "CASE scenario " + " ".join(f"WHEN '{s}' THEN t{k}" for s, k in phenology.SCENARIOS.items()) + " END"
    keys = "node, year, scenario, corrected"
    return f"""sc AS (SELECT * FROM (VALUES {variants}) t(scenario, corrected)),
se AS (SELECT *, count(*) OVER y AS days, min(date) OVER y AS a, max(date) OVER y AS b FROM weather WHERE strftime(date, '%m-%d') BETWEEN '03-07' AND '10-31' WINDOW y AS (PARTITION BY node, year)),
sg AS (SELECT *, a = make_date(CAST(year AS INTEGER), 3, 7) AND days = date_diff('day', a, b) + 1 AS gapless, b = make_date(CAST(year AS INTEGER), 10, 31) AS ended FROM se),
sa AS (SELECT *, CASE WHEN corrected THEN {line(cl.FOREST_AIR, 't{k}')} ELSE {plain} END AS air FROM sg CROSS JOIN sc),
sb AS (SELECT *, {line(cl.BARK, 'air')} AS bark FROM sa),
sh AS (SELECT *, {effective_sql('bark')} AS e, sum(greatest(tmax - CAST(8.3 AS DOUBLE), 0)) OVER (PARTITION BY {keys} ORDER BY date) AS heat FROM sb),
si AS (SELECT {keys}, any_value(days) AS days, any_value(gapless) AS gapless, any_value(gapless AND ended) AS complete, min(date) FILTER (heat >= 53 AND tmax > CAST(14.5 AS DOUBLE)) AS swarming, min(date) FILTER (heat >= CAST(155.6 AS DOUBLE) AND tmax > CAST(14.5 AS DOUBLE)) AS infestation FROM sh GROUP BY ALL),
sf AS (SELECT sh.*, sum(sh.e) OVER (PARTITION BY {keys} ORDER BY date) / 557 AS f1, tmax > CAST(14.5 AS DOUBLE) AND daylight_s / 3600 >= CAST(14.5 AS DOUBLE) AS fit FROM sh JOIN si USING ({keys}) WHERE date >= infestation),
lv AS (SELECT 'F2' AS brood, CAST(1 AS DOUBLE) AS level UNION ALL SELECT 'F3', CAST(2 AS DOUBLE) UNION ALL SELECT 'S', j - CAST(0.5 AS DOUBLE) FROM range(1, 12) r(j)),
sl AS (SELECT {keys}, brood, level, min(date) AS start FROM sf JOIN lv ON f1 > level WHERE fit GROUP BY ALL),
sm AS (SELECT {keys}, brood, level, start, sum(e) / 557 AS total FROM sl JOIN sf USING ({keys}) WHERE date >= start GROUP BY ALL),
s1 AS (SELECT {keys}, max(f1) AS sum_f1, min(date) FILTER (f1 >= 1) AS f1_complete FROM sf GROUP BY ALL),
rity AS (SELECT {keys}, days, complete, CASE WHEN gapless THEN swarming END AS swarming, CASE WHEN gapless THEN infestation END AS infestation, CASE WHEN gapless THEN sum_f1 END AS sum_f1, CASE WHEN gapless THEN f1_complete END AS f1_complete,
  CASE WHEN gapless THEN f2.start END AS start_f2, CASE WHEN gapless THEN f2.total END AS sum_f2, CASE WHEN gapless THEN f3.start END AS start_f3, CASE WHEN gapless THEN f3.total END AS sum_f3,
  CASE WHEN gapless THEN (CASE WHEN sum_f1 >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END) + (CASE WHEN f2.total >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END) + (CASE WHEN f3.total >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END) END AS n_filial,
  CASE WHEN gapless THEN coalesce(ns, 0) END AS n_sister
  FROM si LEFT JOIN s1 USING ({keys}) LEFT JOIN (SELECT * FROM sm WHERE brood = 'F2') f2 USING ({keys}) LEFT JOIN (SELECT * FROM sm WHERE brood = 'F3') f3 USING ({keys})
  LEFT JOIN (SELECT {keys}, count(*) AS ns FROM sm WHERE brood = 'S' AND total >= CAST(0.6 AS DOUBLE) GROUP BY ALL) USING ({keys}))"""


@query("""
WITH c AS (SELECT *, sum(greatest(tmean - CAST(5.12 AS DOUBLE), 0)) OVER (PARTITION BY node, year ORDER BY date) AS warm FROM weather WHERE strftime(date, '%m-%d') <= '10-31'),
k AS (SELECT node, year, CASE WHEN strftime(min(date), '%m-%d') = '01-01' THEN min(date) FILTER (warm >= 100 AND tmax >= CAST(16.11 AS DOUBLE)) END AS swarming_check FROM c GROUP BY 1, 2)
SELECT node, year, swarming, infestation, swarming_check FROM rity FULL JOIN k USING (node, year)
""", WEATHER, rity_sql("('AVG', false)"))
def swarming_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First days over the degree-day sums with weather for flight; the check counts from 1 January by another model."""
    w = domain.daily_weather(spark, sf_dir)
    got = phenology.rity(w, ["node"]).select("node", "year", "swarming", "infestation")
    return got.join(phenology.swarming_check(w, ["node"]), ["node", "year"], "full").select("node", "year", "swarming", "infestation", "swarming_check")


@query("""
SELECT node, year, days, complete, infestation, round(sum_f1, 5) AS sum_f1, f1_complete, start_f2, round(sum_f2, 5) AS sum_f2, start_f3, round(sum_f3, 5) AS sum_f3, CAST(n_filial AS BIGINT) AS n_filial, CAST(n_sister AS BIGINT) AS n_sister FROM rity
""", WEATHER, rity_sql("('AVG', false)"))
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filial generations and sister broods of each year, from effective bark temperatures."""
    r = phenology.rity(domain.daily_weather(spark, sf_dir), ["node"])
    return r.select("node", "year", "days", "complete", "infestation", *[F.round(c, 5).alias(c) for c in ("sum_f1", "sum_f2", "sum_f3")], "f1_complete", "start_f2", "start_f3", "n_filial", "n_sister")


@query(f"""
SELECT node, date, round({effective_sql("tmax")}, 6) AS of_air, round({effective_sql("(CAST(0.03 AS DOUBLE) + CAST(0.99 AS DOUBLE) * tmax)")}, 6) AS of_bark, round({effective_sql("(CAST(-0.48 AS DOUBLE) + CAST(1.03 AS DOUBLE) * (CAST(0.5 AS DOUBLE) + CAST(0.81 AS DOUBLE) * tmean))")}, 6) AS of_forest FROM weather
""", WEATHER)
def bark_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective temperatures of the daily maximum, of bark under it, and of bark under forest air of the daily mean."""
    t = F.col("tmax")
    out = {"of_air": t, "of_bark": cl.bark(t, "max"), "of_forest": cl.bark(cl.forest_air(F.col("tmean"), "mean"), "mean")}
    return domain.daily_weather(spark, sf_dir).select("node", "date", *[F.round(cl.effective_bark(c), 6).alias(n) for n, c in out.items()])


@query("""
SELECT node, year, round(max(sum_f1) FILTER (scenario = 'MIN'), 5) AS sum_min, round(max(sum_f1) FILTER (scenario = 'AVG'), 5) AS sum_avg, round(max(sum_f1) FILTER (scenario = 'MAX'), 5) AS sum_max,
  CAST(max(n_filial) FILTER (scenario = 'MIN') AS BIGINT) AS n_min, CAST(max(n_filial) FILTER (scenario = 'AVG') AS BIGINT) AS n_avg, CAST(max(n_filial) FILTER (scenario = 'MAX') AS BIGINT) AS n_max FROM rity GROUP BY 1, 2
""", WEATHER, rity_sql("('MIN', false), ('AVG', false), ('MAX', false)"))
def scenario_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios side by side: one pivot instead of a join per scenario."""
    r = phenology.rity(domain.daily_weather(spark, sf_dir), ["node"], ("MIN", "AVG", "MAX"))
    p = r.groupBy("node", "year").pivot("scenario", ["MIN", "AVG", "MAX"]).agg(F.max("sum_f1").alias("sum"), F.max("n_filial").alias("n"))
    return p.select("node", "year", *[F.round(f"{s}_sum", 5).alias(f"sum_{s.lower()}") for s in ("MIN", "AVG", "MAX")], *[F.col(f"{s}_n").alias(f"n_{s.lower()}") for s in ("MIN", "AVG", "MAX")])


@query("""
SELECT year, round(min(tmean), 6) AS low, round(quantile_cont(tmean, 0.1), 6) AS p10, round(median(tmean), 6) AS med, round(quantile_cont(tmean, 0.9), 6) AS p90, round(max(tmean), 6) AS high, round(avg(CASE WHEN tmax > 20 THEN 1.0 ELSE 0.0 END), 6) AS warm_share FROM weather GROUP BY year
""", WEATHER)
def year_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("tmean", F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.9, 1.0)]))
    g = domain.daily_weather(spark, sf_dir).groupBy("year").agg(q.alias("q"), F.avg((F.col("tmax") > 20).cast("double")).alias("w"))
    return g.select("year", *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("low", "p10", "med", "p90", "high"))], F.round("w", 6).alias("warm_share"))


@query("""
WITH t AS (SELECT quantile_cont(c_acctbal, CAST(1 AS DOUBLE) / 3) AS t1, quantile_cont(c_acctbal, CAST(2 AS DOUBLE) / 3) AS t2 FROM customer)
SELECT round(any_value(s) * 100, 6) AS slope_100, round(any_value(r), 6) AS r, round(avg(c_custkey) FILTER (c_acctbal <= t1), 6) AS low_mean, round(avg(c_custkey) FILTER (c_acctbal > t2), 6) AS high_mean FROM customer, t, (SELECT regr_slope(c_acctbal, c_custkey) AS s, corr(c_acctbal, c_custkey) AS r FROM customer)
""")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope on a projected distance, correlation, and means of the outer terciles."""
    c = domain.table(spark, sf_dir, "customer").select("c_acctbal", F.col("c_custkey").cast("double").alias("k"))
    t = c.agg(F.percentile("c_acctbal", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t"))
    d = c.crossJoin(F.broadcast(t))
    return d.agg(F.round(F.regr_slope("c_acctbal", "k") * 100, 6).alias("slope_100"), F.round(F.corr("c_acctbal", "k"), 6).alias("r"), F.round(F.avg(F.when(F.col("c_acctbal") <= F.col("t")[0], F.col("k"))), 6).alias("low_mean"), F.round(F.avg(F.when(F.col("c_acctbal") > F.col("t")[1], F.col("k"))), 6).alias("high_mean"))


@query("""
SELECT c_custkey AS id, round(round_even(c_acctbal / 1000 / 0.25, 0) * 0.25, 2) AS node_x, arg_min(n_nationkey, abs(n_nationkey * 2 + c_custkey % 7 * CAST(0.3 AS DOUBLE) - c_acctbal / 300) * 1000 + n_nationkey * CAST(0.000001 AS DOUBLE)) AS nearest FROM customer, nation GROUP BY c_custkey, c_acctbal
""")
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid node by half-even rounding, and the nearest of a small fixed set of cells."""
    n = domain.table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("cells"))
    c = domain.table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))
    d = lambda k: F.struct((F.abs(k * 2 + (F.col("c_custkey") % 7) * F.lit(0.3) - F.col("c_acctbal") / 300) * 1000 + k * F.lit(0.000001)).alias("d"), k.alias("k"))
    return c.select(F.col("c_custkey").alias("id"), F.round(F.bround(F.col("c_acctbal") / 1000 / F.lit(0.25), 0) * 0.25, 2).alias("node_x"), F.array_min(F.transform("cells", d))["k"].alias("nearest"))


@query("""
SELECT node, year, count(*) AS n, min(date) = make_date(CAST(year AS INTEGER), 3, 7) AS starts, count(*) = date_diff('day', min(date), max(date)) + 1 AS gapless, min(date) = make_date(CAST(year AS INTEGER), 3, 7) AND max(date) = make_date(CAST(year AS INTEGER), 12, 31) AND count(*) = date_diff('day', min(date), max(date)) + 1 AS complete FROM weather WHERE strftime(date, '%m-%d') >= '03-07' GROUP BY 1, 2
""", WEATHER)
def season_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running year is computed with complete = false."""
    g = _since_march(spark, sf_dir).groupBy("node", "year").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))
    starts = F.col("a") == F.make_date(F.col("year").cast("int"), F.lit(3), F.lit(7))
    gapless = F.col("n") == F.date_diff("b", "a") + 1
    return g.select("node", "year", "n", starts.alias("starts"), gapless.alias("gapless"), (starts & gapless & (F.col("b") == F.make_date(F.col("year").cast("int"), F.lit(12), F.lit(31)))).alias("complete"))


@query("""
SELECT a.node, round(avg(b.tmean - a.tmean), 6) AS bias, round(sqrt(avg((b.tmean - a.tmean) * (b.tmean - a.tmean))), 6) AS rmse, round(corr(a.tmean, b.tmean), 5) AS r, round(max(abs(b.tmean - a.tmean)), 6) AS largest, count(*) AS n FROM weather a JOIN weather b ON b.date = a.date AND b.node = 0 WHERE a.node > 0 GROUP BY a.node
""", WEATHER)
def paired_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources compared on their common days."""
    w = domain.daily_weather(spark, sf_dir).select("node", "date", "tmean")
    d = w.where("node > 0").join(w.where("node = 0").select("date", F.col("tmean").alias("b")), "date").withColumn("e", F.col("b") - F.col("tmean"))
    return d.groupBy("node").agg(F.round(F.avg("e"), 6).alias("bias"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.corr("tmean", "b"), 5).alias("r"), F.round(F.max(F.abs("e")), 6).alias("largest"), F.count(F.lit(1)).alias("n"))
