"""From flagged cells to objects, targets and missions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.functions.stats import clip
from larchspan.operators import geometry, raster
from larchspan.plans.kit import OBJECTS, query
from larchspan.sources import domain

#: Cells of the larger test grid: one per part, marked by size.
CELLS = """cw AS (SELECT CAST(ceil(sqrt(max(p_partkey) + 1)) AS BIGINT) AS width FROM part),
cells AS (SELECT p_partkey AS px, CAST(floor(p_partkey / width) AS BIGINT) AS row, CAST(p_partkey % width AS BIGINT) AS col, CAST(p_size AS BIGINT) AS size,
  CASE WHEN p_size >= 34 THEN 1 WHEN p_size <= 14 THEN 2 ELSE 0 END AS cls, p_retailprice AS price FROM part, cw)"""
ADJ = "adj AS (SELECT a.px AS a, b.px AS b FROM cells a JOIN cells b ON a.cls = b.cls AND a.cls > 0 AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.row BETWEEN b.row - 1 AND b.row + 1)"
REACH = "reach AS (SELECT px AS a, px AS b FROM cells WHERE cls > 0 UNION SELECT r.a, adj.b FROM reach r JOIN adj ON adj.a = r.b)"
LAB = "lab AS (SELECT c.*, l.label FROM cells c JOIN (SELECT a, min(b) AS label FROM reach GROUP BY a) l ON l.a = c.px)"


def labelled_sql(body: str) -> str:
    return f"WITH RECURSIVE {CELLS},\n{ADJ},\n{REACH},\n{LAB}{body}"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.table(spark, sf_dir, "part")
    width = p.agg(F.ceil(F.sqrt((F.max("p_partkey") + 1).cast("double"))).cast("long").alias("width"))
    cls = F.when(F.col("p_size") >= 34, 1).when(F.col("p_size") <= 14, 2).otherwise(0)
    return p.crossJoin(F.broadcast(width)).select(F.col("p_partkey").alias("px"), F.floor(F.col("p_partkey") / F.col("width")).alias("row"), (F.col("p_partkey") % F.col("width")).alias("col"), F.col("p_size").cast("long").alias("size"), cls.alias("cls"), F.col("p_retailprice").alias("price"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.label8(cells(spark, sf_dir).where("cls > 0"), "cls")


@query(labelled_sql("\nSELECT px, CAST(cls AS INTEGER) AS cls, label FROM lab"))
def components8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("px", "cls", "label")


@query(labelled_sql("\nSELECT px, CAST(cls AS INTEGER) AS cls, label FROM lab QUALIFY count(*) OVER (PARTITION BY label) >= 5"))
def mmu_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.with_minimum(labelled(spark, sf_dir), 5).select("px", "cls", "label")


@query(labelled_sql("\nSELECT c.px, CASE WHEN x.px IS NULL THEN c.size END AS run_len, CASE WHEN x.px IS NULL THEN c.cls END AS flag, c.size AS raw FROM cells c LEFT JOIN (SELECT px FROM lab WHERE cls = 2 QUALIFY count(*) OVER (PARTITION BY label) >= 4) x USING (px)"))
def baseline_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells inside large disturbed components lose their features; the raw value stays."""
    c = cells(spark, sf_dir)
    big = raster.with_minimum(raster.label8(c.where("cls = 2"), "cls"), 4).select("px").withColumn("out", F.lit(True))
    df = c.join(big, "px", "left")
    return df.select("px", F.when(F.col("out").isNull(), F.col("size")).alias("run_len"), F.when(F.col("out").isNull(), F.col("cls").cast("int")).alias("flag"), F.col("size").alias("raw"))


@query(labelled_sql("""
SELECT label, count(*) AS n_cells, round(count(*) * CAST(0.01 AS DOUBLE), 6) AS area_ha, min(size) AS first_min, round(median(size), 6) AS first_median, round(median(price), 6) AS z_median,
  CASE WHEN avg(CASE WHEN cls = 2 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'cut' ELSE 'stress' END AS type, round(avg(CASE WHEN size % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS pending_share
FROM lab GROUP BY label"""))
def object_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.count(F.lit(1)) * F.lit(0.01), 6).alias("area_ha"), F.min("size").alias("first_min"), F.round(F.median("size"), 6).alias("first_median"), F.round(F.median("price"), 6).alias("z_median"), F.when(F.avg((F.col("cls") == 2).cast("double")) >= 0.5, "cut").otherwise("stress").alias("type"), F.round(F.avg((F.col("size") % 5 == 0).cast("double")), 6).alias("pending_share"))


STATUS = """per AS (SELECT o_custkey % 97 AS label, CAST(o_orderdate AS DATE) AS d, o_totalprice / 100000 AS z, o_orderkey % 3 <> 0 AS ok FROM orders),
dates AS (SELECT label, d, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) >= 0.5 AS good, median(CASE WHEN ok THEN z END) AS med FROM per GROUP BY label, d),
det AS (SELECT label, min(d) FILTER (good AND med >= CAST(2.8 AS DOUBLE)) AS first, min(d) FILTER (good) AS first_valid FROM dates GROUP BY label),
st AS (SELECT det.label, any_value(first) AS first, any_value(first_valid) AS first_valid, count(*) FILTER (good AND d > first) AS n_after, median(med) FILTER (good AND d > first) AS med FROM det JOIN dates USING (label) GROUP BY det.label)"""


@query("SELECT label, first AS first_detected, first_valid, n_after, CASE WHEN first IS NULL THEN NULL WHEN n_after < 3 THEN 'new' WHEN med >= 1.25 THEN 'persistent' ELSE 'recovered' END AS status, first <= first_valid AS onset_before FROM st", STATUS)
def object_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date counts if half of the object's cells are valid; the first detection is the first such date over the level,
    and the status comes from the valid dates after it."""
    o = domain.table(spark, sf_dir, "orders")
    per = o.select((F.col("o_custkey") % 97).alias("label"), F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") / 100000).alias("z"), (F.col("o_orderkey") % 3 != 0).alias("ok"))
    dates = per.groupBy("label", "d").agg((F.avg(F.col("ok").cast("double")) >= 0.5).alias("good"), F.median(F.when(F.col("ok"), F.col("z"))).alias("med"))
    first = F.min(F.when(F.col("good") & (F.col("med") >= 2.8), F.col("d"))).over(W.partitionBy("label"))
    dates = dates.withColumn("first", first)
    after = F.col("good") & (F.col("d") > F.col("first"))
    st = dates.groupBy("label").agg(F.min("first").alias("first"), F.min(F.when(F.col("good"), F.col("d"))).alias("first_valid"), F.count_if(after).alias("n_after"), F.median(F.when(after, F.col("med"))).alias("med"))
    status = F.when(F.col("first").isNull(), None).when(F.col("n_after") < 3, "new").when(F.col("med") >= 1.25, "persistent").otherwise("recovered")
    return st.select("label", F.col("first").alias("first_detected"), "first_valid", "n_after", status.alias("status"), (F.col("first") <= F.col("first_valid")).alias("onset_before"))


SCORE = "CAST(0.35 AS DOUBLE) * least(greatest(p_retailprice / 2500, 0), 1) + CAST(0.25 AS DOUBLE) * least(greatest(p_size % 4 / greatest(3, 1), 0), 1) + CAST(0.25 AS DOUBLE) * least(greatest(p_size / CAST(40 AS DOUBLE), 0), 1) + CAST(0.15 AS DOUBLE) * least(greatest(p_partkey % 30 / CAST(15 AS DOUBLE), 0), 1)"


@query(f"SELECT p_partkey AS id, round({SCORE}, 6) AS confidence FROM part")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = domain.table(spark, sf_dir, "part")
    c = F.lit(0.35) * clip(F.col("p_retailprice") / 2500, 0, 1) + F.lit(0.25) * clip((F.col("p_size") % 4) / 3, 0, 1) + F.lit(0.25) * clip(F.col("p_size") / 40.0, 0, 1) + F.lit(0.15) * clip((F.col("p_partkey") % 30) / 15.0, 0, 1)
    return p.select(F.col("p_partkey").alias("id"), F.round(c, 6).alias("confidence"))


@query(f"""
SELECT c.px, round(min(sqrt(CAST((c.row - t.row) * (c.row - t.row) + (c.col - t.col) * (c.col - t.col) AS DOUBLE))), 6) AS distance,
  arg_min(t.px, ((c.row - t.row) * (c.row - t.row) + (c.col - t.col) * (c.col - t.col)) * 1000000 + t.px) AS nearest
FROM cells c LEFT JOIN cells t ON t.size >= 47 GROUP BY c.px
""", CELLS)
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest open cell, and which it is."""
    d = raster.distance_to(cells(spark, sf_dir).select("px", "row", "col", "size"), F.col("size") >= 47)
    return d.select("px", F.round("distance", 6).alias("distance"), "nearest")


EDGE = """ed AS (SELECT c.px, c.label, min(sqrt(CAST((c.row - t.row) * (c.row - t.row) + (c.col - t.col) * (c.col - t.col) AS DOUBLE))) AS dist FROM lab c LEFT JOIN cells t ON t.cls = 2 AND (c.row - t.row) * (c.row - t.row) + (c.col - t.col) * (c.col - t.col) <= 10000 WHERE c.cls = 1 GROUP BY c.px, c.label)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, label, dist: cells of stress objects with the distance to open cells, NULL beyond 100 cells (1 km)."""
    grid = cells(spark, sf_dir)
    own = raster.label8(grid.where("cls = 1"), "cls").select("px", "label")
    d = raster.distance_to(grid.select("px", "row", "col", "cls"), F.col("cls") == 2, 100.0)
    return own.join(d.select("px", F.col("distance").alias("dist")), "px")


@query(labelled_sql(f"\n, {EDGE} SELECT label, round(min(dist), 6) AS edge_distance, round(avg(CASE WHEN dist <= 2 THEN 1.0 ELSE 0.0 END), 6) AS edge_share, count(*) - count(dist) AS n_far FROM ed GROUP BY label"))
def edge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stress object the distance of its cells to open cells, NULL beyond the window."""
    return edges(spark, sf_dir).groupBy("label").agg(F.round(F.min("dist"), 6).alias("edge_distance"), F.round(F.avg(F.coalesce((F.col("dist") <= 2).cast("double"), F.lit(0.0))), 6).alias("edge_share"), (F.count(F.lit(1)) - F.count("dist")).alias("n_far"))


@query("""
SELECT c.px FROM cells c SEMI JOIN cells t ON t.cls = 2 AND (c.row - t.row) * (c.row - t.row) + (c.col - t.col) * (c.col - t.col) <= 4 AND t.row BETWEEN c.row - 2 AND c.row + 2
""", CELLS)
def disc_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return raster.dilate(c.where("cls = 2"), c, raster.disc(2)).select("px")


@query("""
SELECT c.px FROM cells c SEMI JOIN cells t ON t.size >= 48 AND abs(c.row - t.row) + abs(c.col - t.col) <= 3 AND t.row BETWEEN c.row - 3 AND c.row + 3
""", CELLS)
def cross_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return raster.dilate(c.where("size >= 48"), c, raster.cross(3)).select("px")


@query(labelled_sql("""
, e AS (SELECT l.label, count(*) AS n_inner FROM lab l JOIN lab n ON n.label = l.label AND abs(n.row - l.row) + abs(n.col - l.col) = 1 GROUP BY l.label)
SELECT l.label, count(*) AS n_cells, 4 * count(*) - coalesce(any_value(e.n_inner), 0) AS n_edges, round((4 * count(*) - coalesce(any_value(e.n_inner), 0)) / (4 * sqrt(CAST(count(*) AS DOUBLE))), 6) AS shape_index FROM lab l LEFT JOIN e USING (label) GROUP BY l.label"""))
def patch_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline edges and shape index of every component."""
    e = raster.boundary_edges(labelled(spark, sf_dir))
    return e.select("label", "n_cells", "n_edges", F.round(F.col("n_edges") / (4 * F.sqrt(F.col("n_cells").cast("double"))), 6).alias("shape_index"))


TARGETS = """tg AS (SELECT id, type, status, area_ha, confidence, x0, y0, CASE WHEN (x1 - x0) / (y1 - y0) >= 3 AND type = 'stress' THEN 3 WHEN status = 'persistent' THEN 1 WHEN type = 'cut' THEN 4 ELSE 2 END AS priority,
  CASE WHEN type = 'cut' THEN area_ha ELSE 1 + confidence END AS value FROM objects)"""


def box_elongation() -> Column:
    """Longer over shorter side of a box."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return F.greatest(w, h) / F.least(w, h)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.objects(spark, sf_dir)
    priority = F.when((box_elongation() >= 3) & (F.col("type") == "stress"), 3).when(F.col("status") == "persistent", 1).when(F.col("type") == "cut", 4).otherwise(2)
    return o.withColumn("priority", priority).withColumn("value", F.when(F.col("type") == "cut", F.col("area_ha")).otherwise(1 + F.col("confidence")))


@query("SELECT id, priority, round(value, 6) AS value, 'T' || lpad(CAST(row_number() OVER (PARTITION BY id % 8 ORDER BY priority, value DESC, area_ha DESC NULLS LAST, id) AS VARCHAR), 4, '0') AS target_id FROM tg", OBJECTS, TARGETS)
def targets_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered by priority, then value and area, per area of interest."""
    w = W.partitionBy(F.col("id") % 8).orderBy("priority", F.desc("value"), F.desc_nulls_last("area_ha"), "id")
    t = targets(spark, sf_dir).withColumn("n", F.row_number().over(w))
    return t.select("id", "priority", F.round("value", 6).alias("value"), F.concat(F.lit("T"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("target_id"))


@query(None)
def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy missions: sequential inside one area of interest, areas in parallel."""
    t = targets(spark, sf_dir).where("status <> 'recovered'")
    return geometry.missions(t.select(F.floor(F.col("y0") / 500).alias("aoi"), "id", "priority", "value", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")))


@query(None)
def object_elongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = raster.with_minimum(labelled(spark, sf_dir), 3)
    e = geometry.elongations(d)
    return e.select("label", F.round("elongation", 6).alias("elongation"), (F.col("elongation") >= 3).alias("linear"))


@query(None)
def cut_edge_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings around cuts: orientation towards the south-west, freshness and conifer share, as a weighted mean per cut."""
    d = raster.with_minimum(labelled(spark, sf_dir).where("cls = 2"), 3)
    ring = raster.kernel(d.select("label", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("size").alias("_age"), "row", "col"), raster.disc(2))
    grid = cells(spark, sf_dir).where("cls <> 2").select("row", "col", F.col("size").alias("_here"))
    face = F.pmod(F.degrees(F.atan2(F.col("col") - F.col("_c"), F.col("_r") - F.col("row"))) + 360, F.lit(360.0))
    band = ring.join(grid, ["row", "col"]).withColumn("turn", (1 + F.cos(F.radians(face - 225))) / 2)
    out = band.groupBy("label").agg(F.countDistinct("row", "col").alias("ring_cells"), F.avg("turn").alias("turn"), F.avg((F.col("_here") > 25).cast("double")).alias("conifer"), F.avg(1 - F.col("_age") / 14).alias("fresh"), F.avg((F.abs(face - 225) <= 45).cast("double")).alias("south_west"))
    return out.select("label", "ring_cells", F.round(0.5 * F.col("turn") + 0.3 * F.col("conifer") + 0.2 * F.col("fresh"), 6).alias("risk"), F.round("south_west", 6).alias("south_west_share"))


@query("SELECT type, status, count(*) AS n, round(sum(area_ha), 4) AS area_ha FROM objects GROUP BY 1, 2", OBJECTS)
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.objects(spark, sf_dir).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area_ha"), 4).alias("area_ha"))


@query("""
SELECT id, type = 'stress' AND (x1 - x0) / (y1 - y0) >= 3 AS linear, type = 'stress' AND coalesce(d <= 30, false) AS near_road, round(d, 6) AS road_distance
FROM (SELECT o.*, min(greatest(0, greatest(o.x0 - r.x, r.x - o.x1))) AS d FROM objects o, (SELECT CAST(n_nationkey * 200 + 37 AS DOUBLE) AS x FROM nation) r GROUP BY ALL)
""", OBJECTS)
def linear_road_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each box to a small set of straight roads (a constant-size table, sent to all tasks)."""
    roads = domain.table(spark, sf_dir, "nation").agg(F.collect_list((F.col("n_nationkey") * 200 + 37).cast("double")).alias("roads"))
    o = domain.objects(spark, sf_dir).crossJoin(F.broadcast(roads))
    d = F.array_min(F.transform("roads", lambda x: F.greatest(F.lit(0.0), F.col("x0") - x, x - F.col("x1"))))
    o = o.withColumn("d", d)
    stress = F.col("type") == "stress"
    return o.select("id", (stress & (box_elongation() >= 3)).alias("linear"), (stress & F.coalesce(F.col("d") <= 30, F.lit(False))).alias("near_road"), F.round("d", 6).alias("road_distance"))


@query("SELECT o.id, c.px FROM objects o JOIN cells c ON c.col * 100 + 50 BETWEEN o.x0 AND o.x1 AND c.row * 100 + 50 BETWEEN o.y0 AND o.y1", OBJECTS, CELLS)
def rasterize_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose centre lies in an object's box: the box is expanded to the cells it covers, then an equi join."""
    o = domain.objects(spark, sf_dir)
    first = lambda a: F.ceil((F.col(a) - 50) / 100).cast("long")
    last = lambda a: F.floor((F.col(a) - 50) / 100).cast("long")
    cover = o.where((first("x0") <= last("x1")) & (first("y0") <= last("y1"))).select("id", F.explode(F.sequence(first("x0"), last("x1"))).alias("col"), first("y0").alias("a"), last("y1").alias("b"))
    cover = cover.select("id", "col", F.explode(F.sequence("a", "b")).alias("row"))
    return cover.join(cells(spark, sf_dir).select("px", "row", "col"), ["row", "col"]).select("id", "px")


@query("""
SELECT px, size >= 25 AND s16 = 16 AS control_site FROM (SELECT c.px, c.size, (SELECT count(*) FROM cells n WHERE n.size >= 5 AND n.row BETWEEN c.row - 2 AND c.row + 1 AND n.col BETWEEN c.col - 2 AND c.col + 1) AS s16 FROM cells c)
""", CELLS)
def block_all_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose 4 x 4 window is fully valid, as sites for controls."""
    c = raster.all_true(cells(spark, sf_dir), F.col("size") >= 5, 4)
    return c.select("px", ((F.col("size") >= 25) & F.col("block")).alias("control_site"))
