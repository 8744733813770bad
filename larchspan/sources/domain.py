"""Domain tables (grid, dated observations, scenes, objects, unit series ...) derived from the star-schema tables.

Missing values are NULL, never NaN.  Each builder reads only the columns it needs, so pruning reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scene classes that make an observation invalid.
INVALID_CLASSES = [0, 1, 3, 8, 9, 10, 11]
BASELINE_YEARS = [1998, 1999, 2000]
MONITOR_YEAR = 2001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(x: float) -> Column:
    return F.lit(float(x))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, row, col, in_aoi, width: one row per location, laid out row by row on a square."""
    s = table(spark, sf_dir, "supplier")
    width = s.agg(F.ceil(F.sqrt((F.max("s_suppkey") + 1).cast("double"))).cast("long").alias("width"))
    return s.crossJoin(F.broadcast(width)).select(  # a one-row side
        F.col("s_suppkey").alias("px"),
        F.floor(F.col("s_suppkey") / F.col("width")).cast("long").alias("row"),
        (F.col("s_suppkey") % F.col("width")).cast("long").alias("col"),
        (F.col("s_nationkey") < 20).alias("in_aoi"),
        F.col("s_nationkey").cast("long").alias("region"),
        F.col("s_acctbal").alias("level"),
        "width",
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, ts, year, doy, bands, scl, valid: one row per location and date; repeats collapse to their largest values."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("px"), F.col("l_shipdate").alias("ts"))
        .agg(
            F.max("l_tax").alias("tax"), F.max("l_discount").alias("disc"), F.min("l_discount").alias("disc0"),
            F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"), F.max("l_linenumber").cast("int").alias("scl"),
            F.max("l_quantity").alias("qty"),
        )
        .select(
            "px", "ts", F.year("ts").cast("long").alias("year"), F.dayofyear("ts").cast("long").alias("doy"),
            (lit(0.02) + F.col("tax")).alias("b02"), (lit(0.03) + F.col("disc")).alias("b04"), (lit(0.08) + F.col("disc0")).alias("b05"),
            (lit(0.1) + F.least("unit", lit(5000.0)) / lit(12503.0)).alias("b08"), (lit(0.11) + F.least("unit", lit(5000.0)) / lit(12503.0)).alias("b8a"),
            (lit(0.1) + F.col("disc") + F.col("qty") / lit(1000.0)).alias("b11"), (lit(0.06) + F.col("tax") + F.col("disc0")).alias("b12"),
            "scl", (~F.col("scl").isin(INVALID_CLASSES)).alias("valid"),
        )
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, x1, y1, area_ha, type, status, confidence, first_detected: one box per part."""
    p = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") % 50) * 100, F.floor(F.col("p_partkey") / 50) * 100
    side = F.col("p_size") * 3
    high = side / (F.col("p_partkey") % 4 + 1)  # squares and ever longer strips
    return p.select(
        F.col("p_partkey").alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + side).cast("double").alias("x1"), (y + high).cast("double").alias("y1"),
        (side * high / lit(10000.0)).alias("area_ha"),
        F.when(F.col("p_size") % 3 == 0, "cut").otherwise("stress").alias("type"),
        F.element_at(F.array(*[F.lit(s) for s in ("new", "persistent", "recovered")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("status"),
        (F.col("p_size").cast("double") / lit(50.0)).alias("confidence"),
        F.date_add(F.lit("2001-05-01").cast("date"), (F.col("p_partkey") * 7 % 140).cast("int")).alias("first_detected"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, x0, y0, x1, y1, cut_date, year, subtype, ha: dated register records with boxes."""
    o = table(spark, sf_dir, "orders")
    x, y = (F.col("o_custkey") % 50) * 100, F.floor(F.col("o_custkey") / 50) * 100
    side = F.col("o_orderkey") % 40 + 5
    return o.select(
        F.col("o_orderkey").alias("rid"), (x + 10).cast("double").alias("x0"), (y + 10).cast("double").alias("y0"), (x + 10 + side).cast("double").alias("x1"), (y + 10 + side).cast("double").alias("y1"),
        F.to_date("o_orderdate").alias("cut_date"), F.year("o_orderdate").cast("long").alias("year"),
        F.when(F.col("o_orderpriority").startswith("1"), 620).when(F.col("o_orderpriority").startswith("2"), 100).otherwise(900).cast("long").alias("subtype"),
        ((side * side).cast("double") / lit(10000.0)).alias("ha"),
    )


def unit_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, orbit, ts, lin: positive linear values per unit and orbit."""
    e = table(spark, sf_dir, "events")
    return e.where(F.col("value") > 0).groupBy(F.col("user_id").alias("uid"), F.col("event_type").alias("orbit"), F.col("ts").cast("timestamp").alias("ts")).agg(F.max("value").alias("lin"))


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, date, year, tmax, tmin, tmean, precip, et0, daylight_s: a seasonal course with the day's order noise.

    Nodes 0 to 2 have every day from the first order's year on; node 3 has the days with orders only, so it has gaps.
    """
    o = table(spark, sf_dir, "orders")
    day = o.groupBy((F.col("o_custkey") % 4).alias("node"), F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    span = o.agg(F.trunc(F.min("o_orderdate"), "year").alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).withColumn("node", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])))
    day = days.join(day, ["node", "date"], "left").where((F.col("node") < 3) | F.col("n").isNotNull())
    season = F.cos((F.dayofyear("date") - 200).cast("double") * lit(0.0172142))
    noise = F.coalesce((F.col("top") % 7).cast("double"), lit(3.0))
    spread = lit(7.0) + F.coalesce((F.col("top") % 5).cast("double"), lit(2.0))
    tmax = lit(14.0) + lit(13.0) * season + noise
    return day.select("node", "date", F.year("date").cast("long").alias("year"), tmax.alias("tmax"), (tmax - spread).alias("tmin"), (tmax - spread / 2).alias("tmean"), (F.coalesce("n", F.lit(0)).cast("double") + F.coalesce(F.col("top") % 3, lit(0.0))).alias("precip"), (lit(1.5) + lit(1.2) * season).alias("et0"), (lit(43200.0) + lit(19000.0) * season).alias("daylight_s"))
