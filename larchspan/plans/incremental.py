"""Incremental behaviour: quotas, late confirmation, deduplication of arrivals, request planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.plans.kit import query
from larchspan.sources import domain, payload
from larchspan.streaming import late


@query("""
WITH e AS (SELECT event_id, user_id, ts, 1 + event_id % 3 AS w FROM events)
SELECT event_id, CAST(sum(w) OVER m AS BIGINT) AS minute_sum, CAST(sum(w) OVER h AS BIGINT) AS hour_sum, sum(w) OVER m <= 4 AND sum(w) OVER h <= 9 AS allowed FROM e
WINDOW m AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59 SECOND PRECEDING AND CURRENT ROW), h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599 SECOND PRECEDING AND CURRENT ROW)
""")
def rolling_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights spent in the last minute and hour, and whether the spend was allowed."""
    e = domain.table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (1 + F.col("event_id") % 3).alias("w"))
    at = W.partitionBy("user_id").orderBy("t")
    m, h = F.sum("w").over(at.rangeBetween(-59_000_000, 0)), F.sum("w").over(at.rangeBetween(-3_599_000_000, 0))
    return e.select("event_id", m.alias("minute_sum"), h.alias("hour_sum"), ((m <= 4) & (h <= 9)).alias("allowed"))


@query(None)
def late_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open runs kept as state by a stream over the series, batch by batch: confirmed, pending or none at its end."""
    return late.confirm(spark, domain.unit_series(spark, sf_dir))


@query(None)
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals keyed by acquisition: the first of each key stays, across micro-batches."""
    return late.first_arrivals(spark, domain.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("key"), F.col("o_orderkey").alias("id")))


@query("""
WITH m AS (SELECT DISTINCT y, m FROM (SELECT y, m FROM (SELECT unnest(range(1998, 2001)) AS y), (SELECT unnest(range(3, 11)) AS m) UNION ALL SELECT y, m FROM (SELECT unnest(range(1999, 2002)) AS y), (SELECT unnest(range(9, 13)) AS m)))
SELECT CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, 'month' AS kind FROM m UNION ALL
SELECT CAST(y AS BIGINT), CAST(m AS BIGINT), 'acc00' FROM (SELECT CASE WHEN m = 12 THEN y + 1 ELSE y END AS y, CASE WHEN m = 12 THEN 1 ELSE m + 1 END AS m FROM m) n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.y = n.y AND m.m = n.m) AND y * 12 + m <= 2001 * 12 + 12
""")
def month_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of two year-by-month rectangles, plus a first-hour job where the month after is not among them."""
    def rect(a: int, b: int, c: int, d: int) -> DataFrame:
        return spark.range(a, b).select(F.col("id").alias("year"), F.explode(F.sequence(F.lit(c).cast("long"), F.lit(d).cast("long"))).alias("month"))

    months = rect(1998, 2001, 3, 10).union(rect(1999, 2002, 9, 12)).distinct()
    after = months.select(F.when(F.col("month") == 12, F.col("year") + 1).otherwise(F.col("year")).alias("year"), F.when(F.col("month") == 12, 1).otherwise(F.col("month") + 1).cast("long").alias("month"))
    extra = after.join(months, ["year", "month"], "left_anti").where(F.col("year") * 12 + F.col("month") <= 2001 * 12 + 12)
    return months.withColumn("kind", F.lit("month")).unionByName(extra.withColumn("kind", F.lit("acc00")))


@query("""
SELECT CAST(year AS BIGINT) AS year, CAST(CASE WHEN year < 1998 THEN 8 ELSE 214 END AS BIGINT) AS days, round(greatest(1, CASE WHEN year < 1998 THEN 8 ELSE 214 END / 14) * greatest(1, 6 / 10), 6) AS weight FROM (SELECT unnest(range(1995, 2002)) AS year)
""")
def request_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("id") < 1998, F.lit(8)).otherwise(F.lit(214)).cast("long")
    return spark.range(1995, 2002).select(F.col("id").alias("year"), days.alias("days"), F.round(F.greatest(F.lit(1.0), days / 14) * F.greatest(F.lit(1.0), F.lit(0.6)), 6).alias("weight"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, lower(event_type) = event_type AS lower_case FROM events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = domain.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type", (F.lower("event_type") == F.col("event_type")).alias("lower_case"))


@query("""
WITH d AS (SELECT o_custkey % 4 AS node, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1, 2)
SELECT node, date, CASE WHEN CAST(floor(v) AS BIGINT) % 5 <> 0 THEN round(v, 2) END AS tmax FROM d
""")
def daily_weather_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-wise JSON payloads parsed to one row a day: nulls stay NULL, repeated dates keep the first."""
    o = domain.table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1996)
    d = o.groupBy((F.col("o_custkey") % 4).alias("node"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("v"))
    d = d.withColumn("v", F.when(F.col("v").cast("long") % 5 != 0, F.round("v", 2)))
    packed = d.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("date", "v"))).alias("s")).select("node", F.to_json(F.struct(F.struct(F.transform("s", lambda x: x["date"].cast("string")).alias("time"), F.transform("s", lambda x: x["v"]).alias("temperature_2m_max")).alias("daily"), F.struct(F.lit("°C").alias("temperature_2m_max")).alias("daily_units")), {"ignoreNullFields": "false"}).alias("body"))
    return payload.daily_weather(packed, "body", ["node"]).select("node", "date", "tmax")


@query("""
SELECT id, CASE WHEN d1 IS NOT NULL THEN d1 ELSE d2 END AS date, CASE WHEN d1 IS NULL AND d2 IS NULL THEN 'bad date' WHEN verdict NOT IN ('yes', 'no') THEN 'bad verdict' ELSE '' END AS problem FROM (
  SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) END AS d1, CASE o_orderkey % 3 WHEN 1 THEN CAST(o_orderdate AS DATE) END AS d2, CASE WHEN o_orderkey % 4 = 0 THEN 'maybe' ELSE 'yes' END AS verdict FROM orders)
""")
def form_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form rows with ISO or day-first dates and a list of allowed verdicts; every row keeps its problem."""
    o = domain.table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("n/a")
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), raw, F.when(F.col("o_orderkey") % 4 == 0, "maybe").otherwise("yes"))
    return payload.form_rows(o.select(line.alias("line")), "id;date;verdict", {"verdict": ["yes", "no"]}).select(F.col("id").cast("long").alias("id"), "date", "problem")
