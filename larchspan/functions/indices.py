"""Spectral indices as Column builders, and the registry that new ones join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Band centres in micrometres.
WAVELENGTH = {"b8a": 0.865, "b11": 1.610, "b12": 2.190}


@dataclass(frozen=True)
class Index:
    name: str
    bands: tuple[str, ...]
    stress_sign: int
    description: str
    build: Callable[[dict[str, Column]], Column]


REGISTRY: dict[str, Index] = {}


def register_index(name: str, bands: tuple[str, ...], stress_sign: int, description: str = ""):  # noqa: ANN201
    """Adds a function of {band: Column} to the registry."""

    def add(f: Callable[[dict[str, Column]], Column]) -> Callable[[dict[str, Column]], Column]:
        REGISTRY[name] = Index(name, bands, stress_sign, description, f)
        return f

    return add


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) where a + b > 0, else NULL."""
    return F.when(a + b > 0, (a - b) / (a + b))


def continuum_ratio(nir: Column, low: Column, high: Column) -> Column:
    """`low` over the straight line from `nir` to `high` at its wavelength, where that line is above 0."""
    line = nir + (high - nir) * F.lit(WAVELENGTH["b11"] - WAVELENGTH["b8a"]) / F.lit(WAVELENGTH["b12"] - WAVELENGTH["b8a"])
    return F.when(line > 0, low / line)


register_index("ndvi", ("b08", "b04"), -1, "greenness")(lambda b: normalised_difference(b["b08"], b["b04"]))
register_index("ndre", ("b8a", "b05"), -1, "red edge")(lambda b: normalised_difference(b["b8a"], b["b05"]))
register_index("ndmi", ("b8a", "b11"), -1, "moisture")(lambda b: normalised_difference(b["b8a"], b["b11"]))
register_index("crswir", ("b8a", "b11", "b12"), 1, "short-wave continuum")(lambda b: continuum_ratio(b["b8a"], b["b11"], b["b12"]))


def sign(name: str) -> int:
    return _get(name).stress_sign


def _get(name: str) -> Index:
    if name not in REGISTRY:
        raise KeyError(f"unknown index {name!r}; available: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def with_indices(df: DataFrame, names: list[str], finite: bool = True) -> DataFrame:
    """`df` with a column per index; values that are not finite become NULL."""
    out = {}
    for name in names:
        i = _get(name)
        c = i.build({b: F.col(b) for b in i.bands})
        out[name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c) if finite else c
    return df.withColumns(out)


def offset_rule(applied: Column, asset_offset: Column, baseline: Column) -> Column:
    """Reflectance offset of a scene: none if applied already, else the asset's own, else -0.1 from baseline 4.0 on."""
    number = F.coalesce(baseline.try_cast("double"), F.lit(0.0))
    return F.when(F.coalesce(applied, F.lit(False)), F.lit(0.0)).when(asset_offset.isNotNull(), asset_offset).when(number >= 4.0, F.lit(-0.1)).otherwise(F.lit(0.0))


def harmonize(dn: Column, scale: Column, offset: Column) -> Column:
    """Digital number to reflectance; 0 is missing."""
    return F.when(dn != 0, dn * scale + offset)


def quantise(x: Column) -> Column:
    """Reflectance as a short in 1e-4 steps (half to even), -32768 where missing."""
    return F.coalesce(F.bround(x * 10000.0, 0).cast("int"), F.lit(-32768)).cast("short")


def dequantise(q: Column) -> Column:
    return F.when(q != -32768, q.cast("double") * F.lit(1e-4))
