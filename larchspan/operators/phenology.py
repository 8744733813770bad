"""Degree-day phenology of a bark beetle: onsets, filial generations and sister broods from daily temperatures.

Running sums are windows over a location's year (some 240 rows); scenarios and variants are key columns, so all of them
are one plan with one shuffle.  A brood that starts once the first generation's thermal sum is over a level starts on
the first fit day whose sum is over it while the fit day before was not, so no join is needed for any number of broods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.functions import climate as cl

#: Degree days to swarming and infestation, flight temperature, thermal sum of a generation, hours of
#: daylight, least sum that survives the winter, first and last day of the season.
SWARM, INFEST, FLIGHT, WHOLE, DAYLIGHT, WINTER = 53.0, 155.6, 14.5, 557.0, 14.5, 0.6
START, END = "03-07", "10-31"
#: The check by another model: sum, threshold and flight temperature.
CHECK_SUM, CHECK_BASE, CHECK_FLIGHT = 100.0, 5.12, 16.11
SCENARIOS = {"MIN": "min", "AVG": "mean", "MAX": "max"}


def season(daily: DataFrame, keys: list[str]) -> DataFrame:
    """The season's days with `gapless` (no day or value missing since its first) and `complete` (to its last)."""
    d = daily.where(F.date_format("date", "MM-dd").between(START, END))
    w = W.partitionBy(*keys, "year")
    at = lambda day: F.to_date(F.concat_ws("-", F.col("year").cast("string"), F.lit(day)))
    whole = F.count_if(F.col("tmax").isNull() | F.col("tmin").isNull() | F.col("tmean").isNull() | F.col("daylight_s").isNull()).over(w) == 0
    gapless = whole & (F.min("date").over(w) == at(START)) & (F.count(F.lit(1)).over(w) == F.date_diff(F.max("date").over(w), at(START)) + 1)
    return d.withColumn("gapless", gapless).withColumn("complete", gapless & (F.max("date").over(w) == at(END)))


def _first(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("date")))


def rity(daily: DataFrame, keys: list[str], scenarios: tuple[str, ...] = ("AVG",), corrected: tuple[bool, ...] = (False,)) -> DataFrame:
    """keys, year, scenario, corrected, days, complete, swarming, infestation, sum_f1, start_f2, sum_f2, start_f3, sum_f3,
    f1_complete, n_filial, n_sister; `corrected` uses forest air instead of the given air temperature.

    A year with a gap has no results; one that has not ended is computed to its last day with complete = false.
    """
    d = season(daily, keys).withColumns({"scenario": F.explode(F.array(*[F.lit(s) for s in scenarios])), "corrected": F.lit(False)})
    if corrected != (False,):
        d = d.withColumn("corrected", F.explode(F.array(*[F.lit(c) for c in corrected])))
    effective = None
    for name in scenarios:
        kind = SCENARIOS[name]
        air = F.when(F.col("corrected"), cl.forest_air(F.col(f"t{kind}"), kind)).otherwise(F.col(f"t{kind}"))
        one = cl.effective_bark(cl.bark(air, kind))
        effective = F.when(F.col("scenario") == name, one) if effective is None else effective.when(F.col("scenario") == name, one)
    group = [*keys, "year", "scenario", "corrected"]
    w, all_of = W.partitionBy(*group).orderBy("date"), W.partitionBy(*group)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    flight = F.col("tmax") > FLIGHT
    d = d.withColumn("_heat", F.sum(F.greatest(F.col("tmax") - cl.LOWER, F.lit(0.0))).over(so_far))
    d = d.withColumn("_infest", _first(flight & (F.col("_heat") >= INFEST)).over(all_of))
    d = d.withColumn("_be", F.when(F.col("date") >= F.col("_infest"), effective).otherwise(0.0))
    d = d.withColumns({"_sum": F.sum("_be").over(so_far), "_fit": flight & (F.col("daylight_s") / 3600 >= DAYLIGHT)})
    d = d.withColumn("_f1", F.col("_sum") / WHOLE)
    # sum on the fit day before, if any
    d = d.withColumn("_before", F.last(F.when(F.col("_fit"), F.col("_f1")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    d = d.withColumn("_own", (F.sum("_be").over(all_of) - F.col("_sum") + F.col("_be")) / WHOLE)  # of a brood that starts this day
    starts = lambda level: F.col("_fit") & (F.col("_f1") > level) & (F.coalesce("_before", F.lit(-1.0)) <= level)
    low = F.greatest(F.lit(1), F.ceil(F.coalesce("_before", F.lit(0.0)) + 0.5).cast("int"))
    high = F.ceil(F.col("_f1") + 0.5).cast("int") - 1
    sisters = F.when(F.col("_fit") & (F.col("_own") >= WINTER), F.greatest(F.lit(0), high - low + 1)).otherwise(0)
    g = d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("days"), F.bool_and("complete").alias("complete"), F.bool_and("gapless").alias("_ok"), _first(flight & (F.col("_heat") >= SWARM)).alias("swarming"),
        F.min("_infest").alias("infestation"), F.max("_f1").alias("sum_f1"), _first(F.col("_f1") >= 1.0).alias("f1_complete"), F.sum(sisters).alias("n_sister"),
        *[x for i, level in ((2, 1.0), (3, 2.0)) for x in (_first(starts(level)).alias(f"start_f{i}"), F.max(F.when(starts(level), F.col("_own"))).alias(f"sum_f{i}"))],
    )
    lives = lambda c: F.coalesce((F.col(c) >= WINTER).cast("int"), F.lit(0))
    met = F.col("_ok") & F.col("infestation").isNotNull()
    only = lambda c, ok=met: F.when(ok, F.col(c)).alias(c)
    return g.select(
        *group, "days", "complete", only("swarming", F.col("_ok")), only("infestation", F.col("_ok")), *[only(c) for c in ("sum_f1", "start_f2", "sum_f2", "start_f3", "sum_f3", "f1_complete")],
        F.when(F.col("_ok"), F.when(met, lives("sum_f1") + lives("sum_f2") + lives("sum_f3")).otherwise(0)).cast("long").alias("n_filial"),
        F.when(F.col("_ok"), F.when(met, F.col("n_sister")).otherwise(0)).cast("long").alias("n_sister"),
    )


def swarming_check(daily: DataFrame, keys: list[str]) -> DataFrame:
    """keys, year, swarming_check: the other model's first flight day, with sums from 1 January; NULL if that day or any
    value is missing."""
    d = daily.where(F.date_format("date", "MM-dd") <= END)
    so_far = W.partitionBy(*keys, "year").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_warm", F.sum(F.greatest(F.col("tmean") - CHECK_BASE, F.lit(0.0))).over(so_far))
    g = d.groupBy(*keys, "year").agg(F.min("date").alias("a"), F.count_if(F.col("tmean").isNull() | F.col("tmax").isNull()).alias("n"), _first((F.col("_warm") >= CHECK_SUM) & (F.col("tmax") >= CHECK_FLIGHT)).alias("s"))
    return g.select(*keys, "year", F.when((F.dayofyear("a") == 1) & (F.col("n") == 0), F.col("s")).alias("swarming_check"))
