"""Parsers of API payloads and form files into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short names of the daily variables.
DAILY = {"temperature_2m_max": "tmax", "temperature_2m_min": "tmin", "temperature_2m_mean": "tmean", "precipitation_sum": "precip", "et0_fao_evapotranspiration": "et0", "daylight_duration": "daylight_s"}


def daily_weather(df: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """keys, date and the daily variables from column-wise JSON; of repeated dates the first stays."""
    schema = f"daily struct<time: array<string>, {', '.join(f'{k}: array<double>' for k in DAILY)}>"
    parsed = df.select(*keys, F.from_json(body, schema)["daily"].alias("d"))
    rows = parsed.select(*keys, F.posexplode("d.time").alias("i", "time"), "d")
    out = rows.select(*keys, "i", F.to_date("time").alias("date"), *[F.get(F.col(f"d.{k}"), F.col("i")).alias(v) for k, v in DAILY.items()])
    first = out.groupBy(*keys, "date").agg(F.min("i").alias("i"))
    return out.join(first, [*keys, "date", "i"], "left_semi").drop("i")


def scene_items(df: DataFrame, body: str) -> DataFrame:
    """Catalogue items (GeoJSON features) to scenes: tile, platform, cloud cover, band scale and offset."""
    g = lambda path: F.get_json_object(body, path)
    tile = F.coalesce(F.regexp_replace(F.nullif(g("$.properties.grid:code"), F.lit("")), "^MGRS-", ""), F.concat(g("$.properties.mgrs:utm_zone"), g("$.properties.mgrs:latitude_band"), g("$.properties.mgrs:grid_square")))
    return df.select(
        g("$.id").alias("id"), tile.alias("tile"), F.lower(g("$.properties.platform")).alias("platform"), F.coalesce(g("$.properties.datetime"), g("$.properties.start_datetime")).cast("timestamp").alias("ts"),
        g("$.properties.eo:cloud_cover").cast("double").alias("cloud_cover"), g("$.properties.s2:processing_baseline").alias("baseline"),
        g("$.assets.red.raster:bands[0].scale").cast("double").alias("scale"), g("$.assets.red.raster:bands[0].offset").cast("double").alias("offset"),
        F.coalesce(g("$.properties.proj:epsg").cast("int"), F.regexp_extract(F.coalesce(g("$.properties.proj:code"), F.lit("")), r"(\d+)$", 1).try_cast("int")).alias("epsg"),
    )


#: Tag, the value it must have (any if empty) and the kind of line that it tells, first match first.
LINE_TAGS = (("highway", "", "road"), ("waterway", "", "waterway"), ("power", "line", "power_line"))


def line_kinds(df: DataFrame, body: str) -> DataFrame:
    """Ways of a map service to (id, kind, subtype, n): at least two vertices; kind from the first tag that is known."""
    schema = "elements array<struct<id: long, type: string, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>>>"
    e = df.select(F.explode(F.from_json(body, schema)["elements"]).alias("e")).where((F.col("e.type") == "way") & (F.size("e.geometry") >= 2))
    tags, kind = F.col("e.tags"), None
    for tag, value, name in LINE_TAGS:
        has = tags[tag] == value if value else tags[tag].isNotNull()
        kind = F.when(has, name) if kind is None else kind.when(has, name)
    return e.select(F.col("e.id").alias("id"), kind.otherwise("other").alias("kind"), F.coalesce(*[F.nullif(tags[t], F.lit("")) for t, *_ in LINE_TAGS]).alias("subtype"), F.size("e.geometry").alias("n"))


def either_date(text: Column) -> Column:
    """ISO or day-first date; NULL if neither."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd.MM.yyyy"))


def form_rows(lines: DataFrame, header: str, allowed: dict[str, list[str]], date_col: str = "date") -> DataFrame:
    """Rows of a form file (column `line`, without its header) with a `problem` each, empty where there is none.

    The separator is whichever of ; and , the header has more of.
    """
    sep = ";" if header.count(";") >= header.count(",") else ","
    names = header.lstrip("﻿").split(sep)
    parts = F.split("line", sep if sep == "," else ";", -1)
    df = lines.select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])
    problem = F.when(either_date(F.col(date_col)).isNull(), "bad date")
    for name, values in allowed.items():
        problem = problem.when(~F.coalesce(F.col(name).isin(values), F.lit(False)), f"bad {name}")
    return df.withColumn("problem", problem.otherwise("")).withColumn(date_col, either_date(F.col(date_col)))
