"""Per-location time-series operators: baselines, z-scores, votes, persistent runs, haze."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The factor that makes a median absolute deviation a standard deviation, and the default scale floors.
MAD_SCALE = 1.4826
FLOORS = {"ndvi": 0.035, "ndre": 0.034, "ndmi": 0.047, "crswir": 0.061}


def _middle(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the n smallest values of each row (the others are infinite); NaN where n is 0."""
    x = np.sort(x, axis=1)
    at, k = np.arange(len(x)), np.maximum(n, 1)
    return np.where(n > 0, (x[at, (k - 1) // 2] + x[at, k // 2]) / 2, np.nan)


def doy_window_baseline(obs: DataFrame, names: list[str], reference: Column, reach: int = 30, least: int = 5, key: str = "px", admit: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, cells: int = 1 << 21) -> DataFrame:
    """Every row of `obs` with, per index, `<i>_med`, `<i>_mad` and `<i>_n` of the reference rows within `reach` days
    of its day of the year (around a circle of 365 days); med and mad are NULL below `least` values.

    `admit` further restricts the reference rows by their years, as a condition on (years of reference rows, years of
    rows).  One location's series (some hundred rows whatever the number of locations) is one group of a grouped Arrow
    function: a median is taken once per day of the year, `cells` places of the table of days and rows at a time.
    """

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        doy, year = column("doy").astype(np.int64), column("year").astype(np.int64)
        ref = table.column("_ref").fill_null(False).to_numpy(zero_copy_only=False)
        # rows with the same day (and year, if that matters) have the same reference rows
        _, one, back = np.unique(doy + (year * 1000 if admit else 0), return_index=True, return_inverse=True)
        out = table.drop_columns(["_ref"])
        for name in names:
            x = column(name).astype(np.float64)
            r = np.flatnonzero(ref & ~np.isnan(x))
            n, med, mad = np.zeros(len(one), np.int64), np.full(len(one), np.nan), np.full(len(one), np.nan)
            step = max(1, cells // max(1, len(r)))
            for at in range(0, len(one) if len(r) else 0, step):
                who = one[at : at + step]
                away = np.abs(doy[who][:, None] - doy[r])
                near = np.minimum(away, 365 - away) <= reach
                if admit:
                    near &= admit(year[r], year[who][:, None])
                n[at : at + step] = k = near.sum(1)
                med[at : at + step] = m = _middle(np.where(near, x[r], np.inf), k)
                mad[at : at + step] = _middle(np.where(near, np.abs(x[r] - m[:, None]), np.inf), k)
            few = (n < least)[back]
            for c, v in ((f"{name}_n", pa.array(n[back])), (f"{name}_med", pa.array(med[back], mask=few)), (f"{name}_mad", pa.array(mad[back], mask=few))):
                out = out.append_column(c, v)
        return out

    schema = StructType([StructField(f.name, f.dataType) for f in obs.schema])
    for name in names:
        schema = schema.add(f"{name}_n", "long").add(f"{name}_med", "double").add(f"{name}_mad", "double")
    return obs.withColumn("_ref", reference).groupBy(key).applyInArrow(run, schema)


def z_score(x: Column, med: Column, mad: Column, sign: int, floor: float) -> Column:
    """Signed distance from the baseline in robust standard deviations, with a floor under the scale."""
    return F.lit(float(sign)) * (x - med) / F.greatest(F.lit(MAD_SCALE) * mad, F.lit(float(floor)))


def vote(primary: Column, others: list[Column], k: float, confirming: int) -> tuple[Column, Column, Column]:
    """(valid, n_agree, anomalous) of an observation from its z-scores; a missing score agrees with nothing."""
    agree = sum((F.coalesce(z >= k, F.lit(False)).cast("int") for z in others), F.lit(0))
    return primary.isNotNull(), agree, primary.isNotNull() & F.coalesce(primary >= k, F.lit(False)) & (agree >= confirming)


def islands(df: DataFrame, flag: Column, keys: list[str], order: str = "ts") -> DataFrame:
    """Rows with `_rn` (place in the group), `_last` (places in it) and `_island` (runs of rows whose flag is set)."""
    w = W.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_last", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    # places minus set places so far is constant inside a run
    return df.withColumn("_island", F.col("_rn") - F.sum(F.col("_flag").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def persistent_runs(valid: DataFrame, flag: Column, keys: list[str], n: int = 2, min_days: int = 7, order: str = "ts", day: str = "doy") -> DataFrame:
    """Per group: hit, first, longest, pending over its valid rows (`valid` holds no others).

    A run is a row of consecutive flagged observations; it is a hit once it has n of them and spans min_days.  Without
    a hit, a run that is still open at the end and has n observations is pending.
    """
    runs = (
        islands(valid, flag, keys, order).groupBy(*keys, "_island")
        .agg(F.count_if("_flag").alias("length"), F.min(F.when(F.col("_flag"), F.col(day))).alias("d0"), F.max(F.when(F.col("_flag"), F.col(day))).alias("d1"), F.min(F.when(F.col("_flag"), F.col(order))).alias("t0"), F.max(F.when(F.col("_flag"), F.col("_rn"))).alias("last"), F.max("_last").alias("end"))
    )
    is_hit = (F.col("length") >= n) & (F.col("d1") - F.col("d0") >= min_days)
    is_open = (F.col("last") == F.col("end")) & (F.col("length") >= n)
    got = runs.groupBy(*keys).agg(F.min(F.when(is_hit, F.col("t0"))).alias("_hit"), F.max("length").alias("longest"), F.min(F.when(is_open, F.col("t0"))).alias("_open"))
    return got.select(*keys, F.col("_hit").isNotNull().alias("hit"), F.coalesce("_hit", "_open").alias("first"), F.col("longest"), (F.col("_hit").isNull() & F.col("_open").isNotNull()).alias("pending"))


def with_runs(df: DataFrame, within: Column, flag: Column, keys: list[str], n: int = 2, min_days: int = 7, order: str = "ts", day: str = "doy") -> DataFrame:
    """`df` with hit, first, longest, pending of its group's runs over the rows `within`, as persistent_runs() has them;
    NULL in groups without such rows.  Windows on one partitioning: no second plan of `df` and no join."""
    df = df.withColumn("_in", F.coalesce(within, F.lit(False))).withColumn("_flag", F.col("_in") & F.coalesce(flag, F.lit(False)))
    w, group = W.partitionBy(*keys, "_in").orderBy(order), W.partitionBy(*keys)
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_last", F.count(F.lit(1)).over(W.partitionBy(*keys, "_in")))
    df = df.withColumn("_island", F.col("_rn") - F.sum(F.col("_flag").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*keys, "_in", "_island")
    of = lambda agg, c: agg(F.when(F.col("_flag"), F.col(c))).over(run)
    df = df.withColumns({"_length": F.sum(F.col("_flag").cast("int")).over(run), "_days": of(F.max, day) - of(F.min, day), "_t0": of(F.min, order), "_end": of(F.max, "_rn")})
    long = F.col("_flag") & (F.col("_length") >= n)
    df = df.withColumns({
        "_any": F.max("_in").over(group), "_hit": F.min(F.when(long & (F.col("_days") >= min_days), F.col("_t0"))).over(group),
        "_open": F.min(F.when(long & (F.col("_end") == F.col("_last")), F.col("_t0"))).over(group), "_most": F.max(F.when(F.col("_in"), F.col("_length"))).over(group),
    })
    only = lambda c: F.when(F.col("_any"), c)
    df = df.withColumns({"hit": only(F.col("_hit").isNotNull()), "first": F.coalesce("_hit", "_open"), "longest": F.col("_most"), "pending": only(F.col("_hit").isNull() & F.col("_open").isNotNull())})
    return df.drop("_in", "_flag", "_rn", "_last", "_island", "_length", "_days", "_t0", "_end", "_any", "_hit", "_open", "_most")


def cut_signature(ndvi: Column | None, ndvi_med: Column | None, ndmi: Column | None, ndmi_med: Column | None, low: float = 0.5, fall: float = 0.25, dry: float = 0.15) -> Column:
    """Low and fallen greenness, or fallen moisture; an index that is absent takes no part."""
    parts = []
    if ndvi is not None:
        parts.append(F.coalesce((ndvi <= low) & (ndvi - ndvi_med <= -fall), F.lit(False)))
    if ndmi is not None:
        parts.append(F.coalesce(ndmi - ndmi_med <= -dry, F.lit(False)))
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def transient_haze(obs: DataFrame, reference: Column, threshold: float = 0.02, reach: int = 30, least: int = 3, band: str = "b02") -> DataFrame:
    """`obs` with `hazy` (masked), `unresolved` (a candidate with no later valid row in its year).

    A candidate is a valid row over its reference median by more than the threshold; it is masked if the next valid row
    of the year is none, and kept if that is one too.
    """
    df = doy_window_baseline(obs, [band], reference, reach, least)
    df = df.withColumn("_cand", F.col("valid") & F.coalesce(F.col(band) - F.col(f"{band}_med") > threshold, F.lit(False)))
    w = W.partitionBy("px", "year", "valid").orderBy("ts")
    nxt = F.lead("_cand").over(w)
    return df.withColumn("hazy", F.coalesce(F.col("_cand") & ~nxt, F.lit(False))).withColumn("unresolved", F.col("_cand") & nxt.isNull()).withColumnRenamed("_cand", "candidate").drop(f"{band}_med", f"{band}_mad", f"{band}_n")


def promote_scenes(df: DataFrame, share: float = 0.10) -> DataFrame:
    """`hazy_all`: on dates whose unresolved share of valid rows reaches `share`, unresolved rows are masked too."""
    n, u = F.sum(F.col("valid").cast("int")), F.sum(F.col("unresolved").cast("int"))
    dates = df.groupBy("ts").agg((u / F.greatest(n, F.lit(1))).alias("scene_share"))
    return df.join(dates, "ts").withColumn("hazy_all", F.col("hazy") | (F.col("unresolved") & (F.col("scene_share") >= share)))
