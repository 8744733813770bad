"""Harmonic baseline by iteratively re-weighted least squares, unrolled into window aggregates on one partitioning.

`fit` is for one harmonic, `baseline` for any number of them and of indices, as a grouped Arrow function.  One harmonic
has three coefficients; the normal equations are solved by Cramer's rule in Column expressions, so all
rounds stay inside code generation and share a single shuffle on the location.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

PERIOD = 365.25
HUBER = 1.345
RIDGE = 1e-8


def terms(df: DataFrame, day: str = "doy") -> DataFrame:
    a = F.col(day).cast("double") * F.lit(2 * 3.141592653589793 / PERIOD)
    return df.withColumns({"_c": F.cos(a), "_s": F.sin(a)})


def _solve(m: dict[str, Column]) -> tuple[Column, Column, Column]:
    a, b, c = m["w"] + RIDGE, m["wc"], m["ws"]
    d, e, f = m["wcc"] + RIDGE, m["wcs"], m["wss"] + RIDGE
    x, y, z = m["wx"], m["wxc"], m["wxs"]
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    det = F.when(F.abs(det) > 1e-12, det)
    b0 = (x * (d * f - e * e) - b * (y * f - e * z) + c * (y * e - d * z)) / det
    b1 = (a * (y * f - e * z) - x * (b * f - e * c) + c * (b * z - y * c)) / det
    b2 = (a * (d * z - y * e) - b * (b * z - y * c) + x * (b * e - d * c)) / det
    return b0, b1, b2


def fit(obs: DataFrame, value: str, reference: Column, rounds: int = 5, least: int = 5, key: str = "px") -> DataFrame:
    """`obs` with `expected`, `scale` (1.4826 times the median absolute residual of the reference rows) and `n`.

    `rounds` = 1 is ordinary least squares.  The scale belongs to the last computed coefficients.
    """
    w = W.partitionBy(key)
    df = terms(obs).withColumn("_x", F.when(reference, F.col(value))).withColumn("_w", F.when(F.col("_x").isNotNull(), F.lit(1.0)))
    df = df.withColumn("n", F.count("_x").over(w))
    for r in range(rounds):
        m = {"w": F.col("_w"), "wc": F.col("_w") * F.col("_c"), "ws": F.col("_w") * F.col("_s"), "wcc": F.col("_w") * F.col("_c") * F.col("_c"), "wcs": F.col("_w") * F.col("_c") * F.col("_s"), "wss": F.col("_w") * F.col("_s") * F.col("_s"), "wx": F.col("_w") * F.col("_x"), "wxc": F.col("_w") * F.col("_x") * F.col("_c"), "wxs": F.col("_w") * F.col("_x") * F.col("_s")}
        df = df.withColumns({f"_{k}{r}": F.sum(v).over(w) for k, v in m.items()})
        b0, b1, b2 = _solve({k: F.col(f"_{k}{r}") for k in m})
        df = df.withColumns({f"_b{i}": b for i, b in enumerate((b0, b1, b2))})
        df = df.withColumn("expected", F.col("_b0") + F.col("_b1") * F.col("_c") + F.col("_b2") * F.col("_s")).drop(*[f"_{k}{r}" for k in m])
        df = df.withColumn("_r", F.abs(F.col("_x") - F.col("expected")))
        df = df.withColumn("scale", F.lit(1.4826) * F.median("_r").over(w))
        if r + 1 < rounds:
            u = F.col("_r") / (F.greatest(F.col("scale"), F.lit(1e-6)) * HUBER)
            df = df.withColumn("_w", F.when(F.col("_x").isNotNull(), F.when(u <= 1, F.lit(1.0)).otherwise(1.0 / u)))
    good = (F.col("n") >= least) & (F.col("n") >= 5)
    return df.withColumn("expected", F.when(good, F.col("expected"))).withColumn("scale", F.when(good, F.col("scale"))).drop("_c", "_s", "_x", "_w", "_r", "_b0", "_b1", "_b2")


def solve(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Coefficients and scale of the re-weighted least squares of y on the columns of x."""
    w, beta, scale = np.ones(len(y)), np.zeros(x.shape[1]), np.nan
    for _ in range(max(rounds, 1)):
        beta = np.linalg.solve((x * w[:, None]).T @ x + RIDGE * np.eye(x.shape[1]), (x * w[:, None]).T @ y)
        r = np.abs(y - x @ beta)
        scale = 1.4826 * float(np.median(r))
        u = r / (HUBER * max(scale, 1e-6))
        w = np.where(u <= 1, 1.0, 1.0 / np.maximum(u, 1e-12))
    return beta, scale


def baseline(obs: DataFrame, names: list[str], reference: Column, harmonics: int = 1, rounds: int = 5, key: str = "px") -> DataFrame:
    """`obs` with, per index, `<i>_med` (the expected value), `<i>_mad` (the residual scale over 1.4826) and `<i>_n`, so
    that it stands in for series.doy_window_baseline(); NULL below two more reference values than coefficients."""

    def run(table: pa.Table) -> pa.Table:
        doy = table.column("doy").to_numpy(zero_copy_only=False).astype(np.float64)
        a = 2 * np.pi * doy / PERIOD
        x = np.stack([np.ones_like(a), *(f(k * a) for k in range(1, harmonics + 1) for f in (np.cos, np.sin))], 1)
        ref = table.column("_ref").fill_null(False).to_numpy(zero_copy_only=False)
        out = table.drop_columns(["_ref"])
        for name in names:
            y = table.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
            use = ref & ~np.isnan(y)
            n = int(use.sum())
            good = n >= x.shape[1] + 2
            beta, scale = solve(x[use], y[use], rounds) if good else (np.zeros(x.shape[1]), 0.0)
            none = np.full(len(y), not good)
            for c, v in ((f"{name}_n", pa.array(np.full(len(y), n))), (f"{name}_med", pa.array(x @ beta, mask=none)), (f"{name}_mad", pa.array(np.full(len(y), scale / 1.4826), mask=none))):
                out = out.append_column(c, v)
        return out

    schema = StructType([StructField(f.name, f.dataType) for f in obs.schema])
    for name in names:
        schema = schema.add(f"{name}_n", "long").add(f"{name}_med", "double").add(f"{name}_mad", "double")
    return obs.withColumn("_ref", reference).groupBy(key).applyInArrow(run, schema)
