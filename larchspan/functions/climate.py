"""Reference evapotranspiration, sun geometry and bark temperature as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Solar constant (MJ m-2 min-1), Stefan-Boltzmann (MJ K-4 m-2 day-1), albedo.
SOLAR, BOLTZMANN, ALBEDO = 0.0820, 4.903e-9, 0.23


def saturation(t: Column) -> Column:
    """Saturation vapour pressure (kPa) at t degrees."""
    return F.lit(0.6108) * F.exp(F.lit(17.27) * t / (t + F.lit(237.3)))


def slope(t: Column) -> Column:
    return F.lit(4098.0) * saturation(t) / ((t + F.lit(237.3)) * (t + F.lit(237.3)))


def pressure(z: Column) -> Column:
    """Air pressure (kPa) at z metres."""
    return F.lit(101.3) * F.pow((F.lit(293.0) - F.lit(0.0065) * z) / F.lit(293.0), F.lit(5.26))


def psychrometric(p: Column) -> Column:
    return F.lit(0.000665) * p


def wind_at_2m(u: Column, z: float = 10.0) -> Column:
    return u * F.lit(4.87 / math.log(67.8 * z - 5.42))


def sun(doy: Column, latitude: Column) -> tuple[Column, Column, Column]:
    """(declination, relative distance, sunset hour angle); latitude in radians."""
    j = F.lit(2 * math.pi / 365) * doy
    dr = F.lit(1.0) + F.lit(0.033) * F.cos(j)
    d = F.lit(0.409) * F.sin(j - F.lit(1.39))
    ws = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(latitude) * F.tan(d))))
    return d, dr, ws


def extraterrestrial(doy: Column, latitude: Column) -> Column:
    """Radiation at the top of the atmosphere (MJ m-2 day-1)."""
    d, dr, ws = sun(doy, latitude)
    return F.lit(24 * 60 / math.pi * SOLAR) * dr * (ws * F.sin(latitude) * F.sin(d) + F.cos(latitude) * F.cos(d) * F.sin(ws))


def clear_sky(ra: Column, z: Column) -> Column:
    """Radiation under a clear sky at z metres."""
    return (F.lit(0.75) + F.lit(2e-5) * z) * ra


def daylight_hours(doy: Column, latitude: Column) -> Column:
    return F.lit(24 / math.pi) * sun(doy, latitude)[2]


def net_longwave(tmax: Column, tmin: Column, ea: Column, rs: Column, rso: Column) -> Column:
    k = (F.pow(tmax + 273.16, F.lit(4.0)) + F.pow(tmin + 273.16, F.lit(4.0))) / 2
    return F.lit(BOLTZMANN) * k * (F.lit(0.34) - F.lit(0.14) * F.sqrt(ea)) * (F.lit(1.35) * F.greatest(F.lit(0.0), F.least(rs / rso, F.lit(1.0))) - F.lit(0.35))


def et0(tmax: Column, tmin: Column, tmean: Column, ea: Column, u2: Column, rn: Column, gamma: Column) -> Column:
    """Reference evapotranspiration (mm day-1) from net radiation (MJ m-2 day-1)."""
    es = (saturation(tmax) + saturation(tmin)) / 2
    s = slope(tmean)
    return (F.lit(0.408) * s * rn + gamma * F.lit(900.0) / (tmean + 273.0) * u2 * (es - ea)) / (s + gamma * (F.lit(1.0) + F.lit(0.34) * u2))


#: Published coefficients (a + b t) of forest air from station temperature and of bark from forest air.
FOREST_AIR = {"min": (1.44, 0.82), "mean": (0.50, 0.81), "max": (1.03, 0.86)}
BARK = {"min": (0.56, 0.99), "mean": (-0.48, 1.03), "max": (0.03, 0.99)}
#: Development thresholds and the coefficients of its decline above the optimum.
LOWER, OPTIMUM, UPPER = 8.3, 30.4, 38.9
ALPHA, BETA, GAMMA, LETHAL = 0.02876507, 3.5922336, 1.24657367, 40.9958913


def forest_air(t: Column, kind: str) -> Column:
    """Forest air temperature from the station's; kind is min, mean or max."""
    return F.lit(FOREST_AIR[kind][0]) + F.lit(FOREST_AIR[kind][1]) * t


def bark(t: Column, kind: str) -> Column:
    """Bark temperature from forest air temperature."""
    return F.lit(BARK[kind][0]) + F.lit(BARK[kind][1]) * t


def effective_bark(t: Column) -> Column:
    """Effective bark temperature: linear up to the optimum, declining up to the upper limit, 0 outside; missing stays missing."""
    fall = F.lit(OPTIMUM - LOWER) * (F.exp(F.lit(ALPHA) * t) - F.exp(F.lit(ALPHA * LETHAL) - (F.lit(LETHAL) - t) / F.lit(BETA)) - F.lit(GAMMA))
    return F.when(t.isNull(), None).when((t > LOWER) & (t <= OPTIMUM), t - F.lit(LOWER)).when((t > OPTIMUM) & (t < UPPER), fall).otherwise(0.0)
