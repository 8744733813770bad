"""Connectors, payload parsers and sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from larchspan.sources import connector, payload, sinks


def item(i, cloud, platform="Sentinel-2A", **more):
    return {"id": f"i{i}", "collection": "c", "properties": {"platform": platform, "datetime": f"2001-06-{i:02d}T10:00:00Z", "eo:cloud_cover": cloud, "s2:processing_baseline": "04.00", **more}, "assets": {"red": {"raster:bands": [{"scale": 0.0001, "offset": -0.1}]}}}


def test_scene_source_filters_and_projects(spark, tmp_path):
    items = [item(1, 5.0, **{"grid:code": "MGRS-35VLD"}), item(2, 80.0), item(3, 10.0, **{"mgrs:utm_zone": 35, "mgrs:latitude_band": "V", "mgrs:grid_square": "LC"})]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, items)))
    connector.enable(spark)
    df = spark.read.format("scenes").load(str(tmp_path)).where("cloud_cover <= 60 and ts >= '2001-06-01'")
    got = {r.id: r for r in df.collect()}
    assert set(got) == {"i1", "i3"} and got["i1"].tile == "35VLD" and got["i3"].tile == "35VLC" and got["i1"].platform == "sentinel-2a" and got["i1"].offset == -0.1
    lines = spark.createDataFrame([(json.dumps(x),) for x in items], "body string")
    assert {(r.id, r.tile) for r in payload.scene_items(lines, "body").collect()} == {("i1", "35VLD"), ("i2", None), ("i3", "35VLC")}


def test_unknown_catalogue():
    with pytest.raises(KeyError, match="named"):
        connector.catalogue("nope")


def test_lines_need_two_vertices(spark):
    body = {"elements": [{"id": 1, "type": "way", "tags": {"highway": "track"}, "geometry": [{"lat": 1, "lon": 1}, {"lat": 2, "lon": 2}]}, {"id": 2, "type": "way", "tags": {"power": "line"}, "geometry": [{"lat": 1, "lon": 1}]}, {"id": 3, "type": "node"}]}
    got = payload.line_kinds(spark.createDataFrame([(json.dumps(body),)], "body string"), "body").collect()
    assert [(r.id, r.kind, r.subtype) for r in got] == [(1, "road", "track")]


def test_kinds_of_lines_by_their_tags(spark):
    """First of road, waterway and power line; a power tag of another value tells no kind but stays as subtype."""
    tags = [{"highway": "path", "waterway": "ditch"}, {"power": "line", "waterway": "stream"}, {"power": "line"}, {"power": "minor_line"}, {"railway": "rail"}, {}]
    body = {"elements": [{"id": i, "type": "way", "tags": t, "geometry": [{"lat": 1, "lon": 1}, {"lat": 2, "lon": 2}]} for i, t in enumerate(tags)]}
    got = payload.line_kinds(spark.createDataFrame([(json.dumps(body),)], "body string"), "body").orderBy("id").collect()
    assert [(r.kind, r.subtype) for r in got] == [("road", "path"), ("waterway", "stream"), ("power_line", "line"), ("other", "minor_line"), ("other", None), ("other", None)]


def test_daily_payload_keeps_nulls_and_first_dates(spark):
    body = {"daily": {"time": ["2001-01-01", "2001-01-02", "2001-01-01"], "temperature_2m_max": [1.5, None, 9.0]}}
    got = payload.daily_weather(spark.createDataFrame([(1, json.dumps(body))], "node long, body string"), "body", ["node"]).orderBy("date").collect()
    assert [r.tmax for r in got] == [1.5, None] and got[0].precip is None


def test_form_rows(spark):
    lines = spark.createDataFrame([("1;2001-05-02;yes",), ("2;02.05.2001;maybe",), ("3;x;no",)], "line string")
    got = {r.id: (str(r.date), r.problem) for r in payload.form_rows(lines, "id;date;verdict", {"verdict": ["yes", "no"]}).collect()}
    assert got == {"1": ("2001-05-02", ""), "2": ("2001-05-02", "bad verdict"), "3": ("None", "bad date")}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 2 + 2000).cast("int").alias("year"), F.col("id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("id") + 1.0).alias("x1"), F.lit(1.0).alias("y1"))
    p = str(tmp_path / "y")
    sinks.years(df.where("year = 2000"), p)
    assert sinks.missing_years(spark, p, [2000, 2001]) == [2001]
    sinks.years(df.where("year = 2001"), p)
    assert spark.read.parquet(p).count() == 20 and sinks.missing_years(spark, str(tmp_path / "none"), [1]) == [1]
    sinks.geojson_lines(df, str(tmp_path / "g"), ["id"])
    first = json.loads(spark.read.text(str(tmp_path / "g")).orderBy("value").first()[0])
    assert first["type"] == "Feature" and len(first["geometry"]["coordinates"][0]) == 5
    a, b = sinks.snapshot({"t": df, "u": df}), sinks.snapshot({"t": df.orderBy(F.desc("id")), "v": df})
    assert {(r.name, r.problem) for r in sinks.differences(a, b).collect()} == {("u", "missing"), ("v", "extra")}
    assert [r.problem for r in sinks.differences(a, sinks.snapshot({"t": df.where("id > 0"), "u": df})).collect()] == ["rows differ"]
