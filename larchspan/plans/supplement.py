"""Composite and diagnostic queries that reuse the operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.functions import indices as ix
from larchspan.operators import phenology, raster, sampling, spatial
from larchspan.plans.climate import rity_sql
from larchspan.plans.kit import GRID, IDX, OBJECTS, OBS, REFS, UNITS, WEATHER, query
from larchspan.plans.masks import FOREST, forest_table
from larchspan.plans.objects import CELLS, EDGE, cells, edges, labelled_sql
from larchspan.plans.statistics import average_rank
from larchspan.sources import domain


@query("""
SELECT c_custkey AS key, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'S' || c_custkey END, concat_ws('-', CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 17 AS VARCHAR), CAST(c_custkey % 9 AS VARCHAR), CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 4 AS VARCHAR) END)) AS stand_id FROM customer
""")
def stand_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier of its own, else its parts joined; a last part of 0 is left out and whole floats print as integers."""
    c = domain.table(spark, sf_dir, "customer")
    whole = lambda x: x.cast("double").cast("long").cast("string")
    k = F.col("c_custkey")
    parts = F.concat_ws("-", F.col("c_nationkey").cast("string"), whole(k % 17), whole(k % 9), F.when(k % 4 > 0, whole(k % 4)))
    return c.select(k.alias("key"), F.coalesce(F.when(k % 5 == 0, F.concat(F.lit("S"), k.cast("string"))), parts).alias("stand_id"))


@query("""
WITH d AS (SELECT px % 60 AS obj, median(ndvi) FILTER (year = 2000) AS a, median(ndvi) FILTER (year = 2001) AS b, median(ndmi) FILTER (year = 2000) AS c, median(ndmi) FILTER (year = 2001) AS e, count(ndvi) FILTER (year = 2001) AS n_post FROM idx WHERE valid GROUP BY 1),
q AS (SELECT quantile_cont(b - a, 0.1) AS lo, quantile_cont(b - a, 0.9) AS hi, quantile_cont(e - c, 0.1) AS lo2, quantile_cont(e - c, 0.9) AS hi2 FROM d)
SELECT obj, round(b - a, 6) AS d_ndvi, round(e - c, 6) AS d_ndmi, CASE WHEN n_post = 0 OR b IS NULL OR a IS NULL THEN 'no data' WHEN NOT coalesce(b - a BETWEEN lo AND hi, false) OR NOT coalesce(e - c BETWEEN lo2 AND hi2, false) THEN 'real change' ELSE 'no change' END AS class FROM d, q
""", OBS, IDX)
def change_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each object before and after, outside the outer quantiles of any index or not."""
    o = ix.with_indices(domain.obs(spark, sf_dir).where("valid and year in (2000, 2001)"), ["ndvi", "ndmi"])
    med = lambda i, y: F.median(F.when(F.col("year") == y, F.col(i)))
    d = o.groupBy((F.col("px") % 60).alias("obj")).agg((med("ndvi", 2001) - med("ndvi", 2000)).alias("u"), (med("ndmi", 2001) - med("ndmi", 2000)).alias("v"))
    p = F.array(F.lit(0.1), F.lit(0.9))
    q = d.agg(F.percentile("u", p).alias("qu"), F.percentile("v", p).alias("qv"))
    inside = lambda c, q: F.coalesce(F.col(c).between(F.col(q)[0], F.col(q)[1]), F.lit(False))
    return d.crossJoin(F.broadcast(q)).select("obj", F.round("u", 6).alias("d_ndvi"), F.round("v", 6).alias("d_ndmi"), F.when(F.col("u").isNull(), "no data").when(~inside("u", "qu") | ~inside("v", "qv"), "real change").otherwise("no change").alias("class"))


@query("""
WITH s AS (SELECT px % 60 AS obj, CAST(ts AS DATE) AS d, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) >= 0.5 AS clear FROM obs GROUP BY 1, 2), f AS (SELECT id % 60 AS obj, min(first_detected) AS first FROM objects GROUP BY 1)
SELECT f.obj, f.first, max(s.d) AS previous_clear, max(s.d) - 30 AS pre_from, f.first + 30 AS post_to FROM f LEFT JOIN s ON s.obj = f.obj AND s.clear AND s.d < f.first GROUP BY 1, 2
""", OBS, OBJECTS)
def asof_previous_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest clear date before the first detection, and the windows around it."""
    s = domain.obs(spark, sf_dir).groupBy((F.col("px") % 60).alias("obj"), F.to_date("ts").alias("d")).agg((F.avg(F.col("valid").cast("double")) >= 0.5).alias("clear"))
    f = domain.objects(spark, sf_dir).groupBy((F.col("id") % 60).alias("obj")).agg(F.min("first_detected").alias("first"))
    j = f.join(s.where("clear").select("obj", "d"), "obj", "left").groupBy("obj", "first").agg(F.max(F.when(F.col("d") < F.col("first"), F.col("d"))).alias("previous_clear"))
    return j.select("obj", "first", "previous_clear", F.date_sub("previous_clear", 30).alias("pre_from"), F.date_add("first", 30).alias("post_to"))


@query("""
SELECT split_part(u, '#', 1) AS run, CAST(split_part(u, '#', 2) AS BIGINT) AS id, o.type FROM (SELECT (1996 + p_partkey % 5) || '#' || p_partkey AS u FROM part) JOIN objects o ON o.id = CAST(split_part(u, '#', 2) AS BIGINT)
""", OBJECTS)
def uid_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.objects(spark, sf_dir)
    u = o.select(F.concat_ws("#", (1996 + F.col("id") % 5).cast("string"), F.col("id").cast("string")).alias("u")).select(F.split("u", "#").alias("p"))
    return u.select(F.element_at("p", 1).alias("run"), F.element_at("p", 2).cast("long").alias("id")).join(o.select("id", "type"), "id")


@query("""
SELECT a.px AS a, b.px AS b FROM cells a JOIN cells b ON b.row = a.row + CAST(round(4.0 + 0.2) AS BIGINT) AND b.col = a.col + CAST(round(6.0 - 0.2) AS BIGINT)
""", CELLS)
def grid_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grids with a whole offset after rounding: an equi join on shifted keys."""
    c = cells(spark, sf_dir)
    a = c.select(F.col("px").alias("a"), (F.col("row") + round(4.2)).alias("row"), (F.col("col") + round(5.8)).alias("col"))
    return a.join(c.select(F.col("px").alias("b"), "row", "col"), ["row", "col"]).select("a", "b")


@query("""
SELECT l_suppkey AS px, CAST(l_shipdate AS DATE) AS d, arg_min(l_quantity, CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey) FILTER (l_linenumber % 4 <> 0) AS fused, count(*) FILTER (l_linenumber % 4 <> 0) AS n FROM lineitem GROUP BY 1, 2
""")
def scene_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles: the first one with data wins."""
    t = domain.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("px"), F.to_date("l_shipdate").alias("d"))
    ok = F.col("l_linenumber") % 4 != 0
    return t.agg(F.min(F.when(ok, F.struct("l_linenumber", "l_orderkey", "l_quantity"))).alias("m"), F.count_if(ok).alias("n")).select("px", "d", F.col("m.l_quantity").alias("fused"), "n")


@query("""
SELECT uid % 40 AS obj, string_agg(DISTINCT orbit, ',' ORDER BY orbit) AS orbits, count(DISTINCT orbit) AS n_orbits, CASE WHEN count(*) FILTER (uid % 3 = 0) > count(*) FILTER (uid % 3 = 1) THEN 'broadleaf' ELSE 'conifer' END AS leaf, round(count(*) FILTER (uid % 3 = 1) / count(*), 6) AS conifer_share FROM units WHERE lin > 5 GROUP BY 1
""", UNITS)
def object_orbit_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits of each object as a list, dominant leaf type with ties to conifer."""
    u = domain.unit_series(spark, sf_dir).where("lin > 5").groupBy((F.col("uid") % 40).alias("obj"))
    b, c = F.count_if(F.col("uid") % 3 == 0), F.count_if(F.col("uid") % 3 == 1)
    return u.agg(F.array_join(F.array_sort(F.collect_set("orbit")), ",").alias("orbits"), F.countDistinct("orbit").alias("n_orbits"), F.when(b > c, "broadleaf").otherwise("conifer").alias("leaf"), F.round(c / F.count(F.lit(1)), 6).alias("conifer_share"))


@query("""
WITH r AS (SELECT rid, rid % 100 + 1 AS px, cut_date FROM refs)
SELECT rid, o.ts, CASE WHEN CAST(o.ts AS DATE) < cut_date THEN 'pre' ELSE 'post' END AS phase, date_diff('day', CAST(o.ts AS DATE), cut_date) AS days_to_cut, round(median(o.ndvi), 6) AS ndvi FROM r JOIN idx o ON o.px = r.px WHERE o.valid AND abs(date_diff('day', CAST(o.ts AS DATE), cut_date)) <= 45 GROUP BY ALL
""", REFS, OBS, IDX)
def reference_series(spark: SparkSession, sf_dir: str, days: int = 45) -> DataFrame:
    """Series of each reference around its date, with the phase and the days to the date.

    Dates meet in buckets as long as the window, so a long series does not meet every reference of its cell."""
    r = domain.references(spark, sf_dir).select("rid", (F.col("rid") % 100 + 1).alias("px"), "cut_date")
    day = lambda c: F.unix_date(F.to_date(c))
    near = r.withColumn("b", F.explode(F.sequence(F.floor((day("cut_date") - days) / days), F.floor((day("cut_date") + days) / days))))
    o = ix.with_indices(domain.obs(spark, sf_dir).where("valid"), ["ndvi"]).select("px", "ts", "ndvi", F.floor(day("ts") / days).alias("b"))
    d = F.date_diff("cut_date", F.to_date("ts"))
    o = o.join(near, ["px", "b"]).where(F.abs(d) <= days)
    return o.groupBy("rid", "ts", F.when(F.to_date("ts") < F.col("cut_date"), "pre").otherwise("post").alias("phase"), d.cast("long").alias("days_to_cut")).agg(F.round(F.median("ndvi"), 6).alias("ndvi"))


@query(labelled_sql(f"""
, {EDGE}, x AS (SELECT CASE WHEN count(*) >= 5 THEN 'large' ELSE 'small' END AS grp, min(dist) AS dist FROM ed GROUP BY label)
SELECT grp, count(*) AS n, round(median(dist), 6) AS med, round(avg(CASE WHEN dist <= 2 THEN 1.0 ELSE 0.0 END), 6) AS near_share, count(*) - count(dist) AS n_far FROM x GROUP BY grp UNION ALL
SELECT 'all', count(*), round(median(dist), 6), round(avg(CASE WHEN dist <= 2 THEN 1.0 ELSE 0.0 END), 6), count(*) - count(dist) FROM x
"""))
def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge distances of stress objects, per size group and over all, by a rollup."""
    x = edges(spark, sf_dir).groupBy("label").agg(F.when(F.count(F.lit(1)) >= 5, "large").otherwise("small").alias("g"), F.min("dist").alias("dist"))
    g = x.rollup("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("dist"), 6).alias("med"), F.round(F.avg(F.coalesce((F.col("dist") <= 2).cast("double"), F.lit(0.0))), 6).alias("near_share"), (F.count(F.lit(1)) - F.count("dist")).alias("n_far"))
    return g.select(F.coalesce("g", F.lit("all")).alias("grp"), "n", "med", "near_share", "n_far")


@query("""
WITH c AS (SELECT CAST(floor(row / 5) AS BIGINT) AS r, CAST(floor(col / 5) AS BIGINT) AS c, count(*) FILTER (cls = 1) AS hits, count(*) FILTER (cls <> 2) AS forest FROM cells GROUP BY 1, 2), v AS (SELECT r, c, CASE WHEN forest >= 12 THEN hits * 1000 / CAST(forest AS DOUBLE) / 7 END AS rate FROM c), q AS (SELECT quantile_cont(rate, 0.98) AS cap FROM v)
SELECT r, c, round(CASE WHEN rate IS NOT NULL THEN least(rate, cap) END, 6) AS rate, round(cap, 6) AS cap FROM v, q
""", CELLS)
def cell_rate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly rate per thousand forest cells, missing where there is little forest, with a cap for display."""
    c = cells(spark, sf_dir).groupBy(F.floor(F.col("row") / 5).alias("r"), F.floor(F.col("col") / 5).alias("c")).agg(F.count_if(F.col("cls") == 1).alias("h"), F.count_if(F.col("cls") != 2).alias("f"))
    v = c.select("r", "c", F.when(F.col("f") >= 12, F.col("h") * 1000 / F.col("f") / 7).alias("rate"))
    q = v.agg(F.percentile("rate", F.lit(0.98)).alias("cap"))
    return v.crossJoin(F.broadcast(q)).select("r", "c", F.round(F.when(F.col("rate").isNotNull(), F.least("rate", "cap")), 6).alias("rate"), F.round("cap", 6).alias("cap"))


@query("""
WITH t AS (SELECT unnest([CAST(10 AS DOUBLE), CAST(20 AS DOUBLE), CAST(30 AS DOUBLE)]) AS thr), g AS (SELECT thr, px % 7 AS grp, count(*) FILTER (size >= thr) AS n, sum(price) AS official FROM cells, t GROUP BY 1, 2),
r AS (SELECT thr, rank() OVER (PARTITION BY thr ORDER BY n) + (count(*) OVER (PARTITION BY thr, n) - 1) / 2.0 AS a, rank() OVER (PARTITION BY thr ORDER BY official) AS b FROM g)
SELECT thr, count(*) AS n, round(corr(a, b), 6) AS spearman FROM r GROUP BY thr
""", CELLS)
def threshold_rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts above thresholds against an official figure, by rank; thresholds are a column."""
    c = cells(spark, sf_dir).withColumn("thr", F.explode(F.array(*[F.lit(x) for x in (10.0, 20.0, 30.0)])))
    g = c.groupBy("thr", (F.col("px") % 7).alias("grp")).agg(F.count_if(F.col("size") >= F.col("thr")).alias("n"), F.sum("price").alias("official"))
    r = g.withColumns({"a": average_rank("n", "thr"), "b": average_rank("official", "thr")})
    return r.groupBy("thr").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("a", "b"), 6).alias("spearman"))


@query("""
SELECT count(*) AS n, round(avg(CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END), 6) AS cover_share, round(avg(CASE WHEN cls <> 2 THEN 1.0 ELSE 0.0 END) FILTER (row > 2), 6) AS forest_inside, round(avg(price) FILTER (row BETWEEN 3 AND 9 AND col BETWEEN 3 AND 9), 6) AS window_mean, avg(CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END) >= 0.99 AS ok FROM cells
""", CELLS)
def extent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg((F.col("size") > 0).cast("double"))
    return cells(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("cover_share"), F.round(F.avg(F.when(F.col("row") > 2, (F.col("cls") != 2).cast("double"))), 6).alias("forest_inside"), F.round(F.avg(F.when(F.col("row").between(3, 9) & F.col("col").between(3, 9), F.col("price"))), 6).alias("window_mean"), (share >= 0.99).alias("ok"))


@query("""
SELECT g.region AS grp, f.code, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY g.region), 6) AS share, coalesce(sum(count(*)) FILTER (f.code = 1) OVER (PARTITION BY g.region), 0) / sum(count(*)) OVER (PARTITION BY g.region) >= 0.5 AS analysed FROM (SELECT px, CAST(code AS INTEGER) AS code FROM forest) f JOIN grid g USING (px) GROUP BY 1, 2
""", GRID, OBS, IDX, FOREST)
def mask_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by group with their share of the group's total."""
    n = forest_table(spark, sf_dir).groupBy(F.col("region").alias("grp"), "code").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("grp")
    total, one = F.sum("n").over(w), F.sum(F.when(F.col("code") == 1, F.col("n")).otherwise(0)).over(w)
    return n.select("grp", "code", "n", F.round(F.col("n") / total, 6).alias("share"), (one / total >= 0.5).alias("analysed"))


@query("""
SELECT obj, index, round(median(v) FILTER (w = 'pre'), 6) AS pre, round(median(v) FILTER (w = 'post'), 6) AS post, round(median(v) FILTER (w = 'post') - median(v) FILTER (w = 'pre'), 6) AS d_poly, count(v) FILTER (w = 'pre') AS n_pre, count(v) FILTER (w = 'post') AS n_post FROM (
  SELECT px % 50 AS obj, CASE WHEN year = 2000 THEN 'pre' ELSE 'post' END AS w, unnest(['ndvi','ndmi']) AS index, unnest([ndvi, ndmi]) AS v FROM idx WHERE valid AND year IN (2000, 2001) AND doy BETWEEN 150 AND 250) GROUP BY 1, 2
""", OBS, IDX)
def index_check_pre_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where("valid and year in (2000, 2001) and doy between 150 and 250"), ["ndvi", "ndmi"])
    long = o.select((F.col("px") % 50).alias("obj"), F.when(F.col("year") == 2000, "pre").otherwise("post").alias("w"), "ndvi", "ndmi").unpivot(["obj", "w"], ["ndvi", "ndmi"], "index", "v")
    m = lambda w: F.median(F.when(F.col("w") == w, F.col("v")))
    n = lambda w: F.count(F.when(F.col("w") == w, F.col("v")))
    return long.groupBy("obj", "index").agg(F.round(m("pre"), 6).alias("pre"), F.round(m("post"), 6).alias("post"), F.round(m("post") - m("pre"), 6).alias("d_poly"), n("pre").alias("n_pre"), n("post").alias("n_post"))


@query("""
WITH d AS (SELECT c.px, any_value(cls) AS cls, min(abs(col * 100 + 50 - (n_nationkey * 200 + 37))) AS d FROM cells c, nation GROUP BY c.px)
SELECT CASE WHEN d < 50 THEN '0-50' WHEN d < 100 THEN '50-100' ELSE '100+' END AS band, count(*) AS n, round(count(*) FILTER (cls = 1) / nullif(count(*) FILTER (cls <> 2), 0), 6) AS class_share, round(count(*) / sum(count(*)) OVER (), 6) AS area_share FROM d GROUP BY 1
""", CELLS)
def road_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class share by the cells' distance to the nearest road (a constant-size table, sent to all tasks)."""
    roads = domain.table(spark, sf_dir, "nation").agg(F.collect_list(F.col("n_nationkey") * 200 + 37).alias("roads"))
    d = F.array_min(F.transform("roads", lambda x: F.abs(F.col("col") * 100 + 50 - x)))
    c = cells(spark, sf_dir).crossJoin(F.broadcast(roads)).withColumn("d", d)
    g = c.groupBy(F.when(F.col("d") < 50, "0-50").when(F.col("d") < 100, "50-100").otherwise("100+").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cls") == 1).alias("h"), F.count_if(F.col("cls") != 2).alias("f"))
    total = g.agg(F.sum("n").alias("t"))
    return g.crossJoin(F.broadcast(total)).select("band", "n", F.round(F.try_divide("h", "f"), 6).alias("class_share"), F.round(F.col("n") / F.col("t"), 6).alias("area_share"))


@query("""
SELECT CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, arg_min(CAST(ts AS DATE), -share * 1000000 + dayofyear(ts)) AS best, round(max(share), 6) AS share FROM (SELECT ts, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM obs GROUP BY ts) WHERE n >= 5 GROUP BY 1, 2
""", OBS)
def clearest_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best date of each month, the earliest on ties."""
    s = domain.obs(spark, sf_dir).groupBy("ts").agg(F.avg(F.col("valid").cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    g = s.groupBy(F.year("ts").cast("long").alias("year"), F.month("ts").cast("long").alias("month")).agg(F.min(F.struct(-F.col("share"), F.col("ts").alias("ts"))).alias("m"), F.max("share").alias("share"))
    return g.select("year", "month", F.to_date("m.ts").alias("best"), F.round("share", 6).alias("share"))


@query("""
SELECT id, row_number() OVER (PARTITION BY id % 16 ORDER BY CASE status WHEN 'persistent' THEN 0 WHEN 'new' THEN 1 ELSE 2 END, confidence DESC, id) AS place FROM objects
""", OBJECTS)
def status_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom order of statuses, then confidence."""
    rank = F.when(F.col("status") == "persistent", 0).when(F.col("status") == "new", 1).otherwise(2)
    return domain.objects(spark, sf_dir).select("id", F.row_number().over(W.partitionBy(F.col("id") % 16).orderBy(rank, F.desc("confidence"), "id")).alias("place"))


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT px FROM cells WHERE size > 20 INTERSECT SELECT px FROM cells WHERE cls = 1) UNION ALL SELECT 'only_first', count(*) FROM (SELECT px FROM cells WHERE size > 20 EXCEPT SELECT px FROM cells WHERE cls = 1) UNION ALL SELECT 'union', count(*) FROM (SELECT px FROM cells WHERE size > 20 UNION SELECT px FROM cells WHERE cls = 1) UNION ALL SELECT 'bag', count(*) FROM (SELECT px FROM cells WHERE size > 20 UNION ALL SELECT px FROM cells WHERE cls = 1)
""", CELLS)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    a, b = c.where("size > 20").select("px"), c.where("cls = 1").select("px")
    n = lambda d, name: d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(a.intersect(b), "both").union(n(a.subtract(b), "only_first")).union(n(a.union(b).distinct(), "union")).union(n(a.union(b), "bag"))


@query("""
WITH m AS (SELECT size AS label, avg(col * 10 + 5) AS cx, avg(row * 10 + 5) AS cy, count(*) AS n FROM cells GROUP BY size)
SELECT m.label, round(cx, 6) AS cx, round(cy, 6) AS cy, arg_min(c.px, pow(c.col * 10 + 5 - cx, 2) + pow(c.row * 10 + 5 - cy, 2) + c.px * CAST(1e-7 AS DOUBLE)) AS own_px FROM m JOIN cells c ON c.size = m.label GROUP BY m.label, cx, cy
""", CELLS)
def representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of each object's cells and its own cell nearest to that."""
    c = cells(spark, sf_dir).select(F.col("size").alias("label"), "px", (F.col("col") * 10 + 5).alias("x"), (F.col("row") * 10 + 5).alias("y"))
    w = W.partitionBy("label")
    c = c.withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w)})
    d = F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)) + F.col("px") * F.lit(1e-7)
    return c.groupBy("label", "cx", "cy").agg(F.min_by("px", d).alias("own_px")).select("label", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "own_px")


@query("""
WITH c AS (SELECT count(*) AS total FROM cells), t AS (SELECT rid, try AS k, CAST('0x' || substr(md5('move|' || rid || '|' || try), 1, 8) AS BIGINT) % total AS px FROM refs, range(0, 200) r(try), c),
f AS (SELECT rid, arg_min(t.px, k) AS px, min(k) AS tries FROM t JOIN cells c USING (px) WHERE c.cls <> 2 GROUP BY rid)
SELECT refs.rid, coalesce(f.px, l.px) AS px, coalesce(f.tries, 199) AS tries FROM refs LEFT JOIN f USING (rid) LEFT JOIN (SELECT rid, px FROM t WHERE k = 199) l USING (rid)
""", REFS, CELLS)
def random_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-drawn places for each record: the first of 200 that is forest, else the last."""
    c = cells(spark, sf_dir).select("px", (F.col("cls") != 2).alias("forest"))
    r = domain.references(spark, sf_dir).select("rid")
    got = sampling.relocated(r, "rid", c, "move", 200)
    return got.select("rid", "px", "tries")


@query(None)
def disc_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping pure discs per class."""
    return sampling.discs(cells(spark, sf_dir).withColumn("cls", F.when(F.col("size") > 3, 1).otherwise(0)).where("cls = 1"), 1, 25, 7)


@query(None)
def chip_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-pixel shift between two layers of small chips over the whole grid (here a layer and itself moved by a cell)."""
    c = cells(spark, sf_dir)
    across = c.agg((F.floor(F.max("col") / 16) + 1).alias("across"))
    c = c.crossJoin(F.broadcast(across)).withColumn("chip", F.floor(F.col("row") / 16) * F.col("across") + F.floor(F.col("col") / 16))  # a one-row side
    w = W.partitionBy("chip", "row").orderBy("col")
    return sampling.shifts(c.select("chip", "row", "col", F.col("price").alias("a"), F.coalesce(F.lag("price").over(w), F.lit(0.0)).alias("b")))


@query("""
WITH n AS (SELECT DISTINCT CAST(floor(x0 / 250) AS BIGINT) + dx AS i, CAST(floor(y0 / 250) AS BIGINT) + dy AS j, dx = 0 AND dy = 0 AS core FROM objects, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE status = 'new')
SELECT i, j, bool_or(core) AS core FROM n GROUP BY i, j
""", OBJECTS)
def node_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose cells meet the area, with one ring around them; `core` marks the former."""
    o = domain.objects(spark, sf_dir).where("status = 'new'").select(F.floor(F.col("x0") / 250).alias("row"), F.floor(F.col("y0") / 250).alias("col")).distinct().withColumns({"r0": F.col("row"), "c0": F.col("col")})
    k = raster.kernel(o, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return k.groupBy(F.col("row").alias("i"), F.col("col").alias("j")).agg(F.bool_or((F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))).alias("core"))


@query("""
WITH u AS (SELECT uid, CAST(ts AS DATE) AS d, avg(CASE WHEN lin > 3 THEN 1.0 ELSE 0.0 END) AS share, median(lin) FILTER (lin > 3) AS vv, median(lin * 1.5) FILTER (lin > 3) AS both, median(10 * log10(lin * 0.5) - 10 * log10(lin)) FILTER (lin > 3) AS diff FROM units GROUP BY 1, 2)
SELECT uid, d, round(CASE WHEN share >= 0.5 THEN 10 * log10(vv) END, 6) AS vv, round(CASE WHEN share >= 0.5 THEN 10 * log10("both") END, 6) AS k0, round(CASE WHEN share >= 0.5 THEN diff END, 6) AS vh_minus_vv FROM u
""", UNITS)
def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit values: medians in linear scale as decibels, and the median of decibel differences."""
    ok = F.col("lin") > 3
    db = lambda x: F.lit(10.0) * F.log10(x)
    u = domain.unit_series(spark, sf_dir).groupBy("uid", F.to_date("ts").alias("d")).agg(F.avg(ok.cast("double")).alias("share"), F.median(F.when(ok, F.col("lin"))).alias("vv"), F.median(F.when(ok, F.col("lin") * 1.5)).alias("k0"), F.median(F.when(ok, db(F.col("lin") * 0.5) - db(F.col("lin")))).alias("diff"))
    keep = lambda x: F.round(F.when(F.col("share") >= 0.5, x), 6)
    return u.select("uid", "d", keep(db(F.col("vv"))).alias("vv"), keep(db(F.col("k0"))).alias("k0"), keep(F.col("diff")).alias("vh_minus_vv"))


@query("""
SELECT c.px, cls <> 2 AND NOT EXISTS (SELECT 1 FROM cells r WHERE r.size >= 49 AND (r.row - c.row) * (r.row - c.row) + (r.col - c.col) * (r.col - c.col) <= 2) AS analysis, cls <> 2 AND NOT EXISTS (SELECT 1 FROM cells r WHERE r.size >= 49 AND (r.row - c.row) * (r.row - c.row) + (r.col - c.col) * (r.col - c.col) <= 2) AND NOT EXISTS (SELECT 1 FROM cells r WHERE r.size IN (40, 41) AND (r.row - c.row) * (r.row - c.row) + (r.col - c.col) * (r.col - c.col) <= 4) AS stable FROM cells c
""", CELLS)
def mask_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest less buffered roads is analysed; less buffered suspects it is stable."""
    c = cells(spark, sf_dir)
    touched = lambda cond, r, name: raster.kernel(c.where(cond).select("row", "col"), raster.disc(r)).distinct().withColumn(name, F.lit(True))
    d = c.join(touched("size >= 49", 2**0.5, "road"), ["row", "col"], "left").join(touched("size in (40, 41)", 2, "suspect"), ["row", "col"], "left")
    analysis = (F.col("cls") != 2) & F.col("road").isNull()
    return d.select("px", analysis.alias("analysis"), (analysis & F.col("suspect").isNull()).alias("stable"))


@query("""
SELECT id, CASE WHEN area_ha < 0.3 THEN 'small' WHEN month(first_detected) NOT BETWEEN 5 AND 8 THEN 'month' WHEN id % 13 = 0 THEN 'winter' ELSE '' END AS reason FROM objects WHERE type = 'cut'
""", OBJECTS)
def proxy_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and excluded cuts, each with the first reason that applies."""
    reason = F.when(F.col("area_ha") < 0.3, "small").when(~F.month("first_detected").between(5, 8), "month").when(F.col("id") % 13 == 0, "winter").otherwise("")
    return domain.objects(spark, sf_dir).where("type = 'cut'").select("id", reason.alias("reason"))


@query("""
SELECT node, year, scenario, corrected, infestation, round(sum_f1, 5) AS sum_f1, CAST(n_filial AS BIGINT) AS n_filial, CAST(n_sister AS BIGINT) AS n_sister FROM rity
""", WEATHER, rity_sql("('MIN', false), ('AVG', false), ('MAX', false), ('MIN', true), ('AVG', true), ('MAX', true)"))
def phenology_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature scenarios, with and without the forest-air correction, as rows of one plan."""
    r = phenology.rity(domain.daily_weather(spark, sf_dir), ["node"], ("MIN", "AVG", "MAX"), (False, True))
    return r.select("node", "year", "scenario", "corrected", "infestation", F.round("sum_f1", 5).alias("sum_f1"), "n_filial", "n_sister")


@query("""
WITH r AS (SELECT c_custkey AS id, round(c_custkey % 12 * 0.25, 2) AS lon, round(c_custkey % 9 * 0.5, 2) AS lat, c_acctbal AS v FROM customer)
SELECT CAST(round(lat / 0.5) AS BIGINT) AS i, CAST(round(lon / 0.25) AS BIGINT) AS j, count(*) AS n, round(max(v), 2) AS top, (SELECT count(*) FROM r WHERE lon > 2.75 OR lat > 4.0) AS off_grid FROM r GROUP BY 1, 2
""")
def table_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded keys to grid indices, with the number of rows off the grid as a check."""
    r = domain.table(spark, sf_dir, "customer").select(((F.col("c_custkey") % 12) * 0.25).alias("lon"), ((F.col("c_custkey") % 9) * 0.5).alias("lat"), F.col("c_acctbal").alias("v"))
    off = r.agg(F.count_if((F.col("lon") > 2.75) | (F.col("lat") > 4.0)).alias("off_grid"))
    return r.groupBy(F.round(F.col("lat") / 0.5).cast("long").alias("i"), F.round(F.col("lon") / 0.25).cast("long").alias("j")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 2).alias("top")).crossJoin(F.broadcast(off))


@query("""
WITH x AS (SELECT year, ndvi FROM idx WHERE valid AND ndvi IS NOT NULL), m AS (SELECT year, median(ndvi) AS med FROM x GROUP BY year), s AS (SELECT x.year, any_value(med) AS med, median(abs(ndvi - med)) AS mad, quantile_cont(ndvi, 0.95) AS p95, quantile_cont(ndvi, 0.99) AS p99 FROM x JOIN m USING (year) GROUP BY x.year)
SELECT s.year, round(med + 3 * CAST(1.4826 AS DOUBLE) * mad, 6) AS limit_value, round(p95, 6) AS p95, round(p99, 6) AS p99, thr, round(avg(CASE WHEN ndvi >= thr THEN 1.0 ELSE 0.0 END), 6) AS share FROM s JOIN x USING (year), (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE)]) AS thr) GROUP BY ALL
""", OBS, IDX)
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of a year with its robust limit, and shares over candidate thresholds."""
    x = ix.with_indices(domain.obs(spark, sf_dir).where("valid"), ["ndvi"]).where("ndvi is not null").select("year", "ndvi")
    x = x.withColumn("med", F.median("ndvi").over(W.partitionBy("year")))
    q = F.percentile("ndvi", F.array(F.lit(0.95), F.lit(0.99)))
    s = x.groupBy("year", "med").agg(F.median(F.abs(F.col("ndvi") - F.col("med"))).alias("mad"), q.alias("q"), *[F.avg((F.col("ndvi") >= t).cast("double")).alias(f"s{i}") for i, t in enumerate((0.5, 0.7))])
    s = s.withColumn("t", F.explode(F.array(*[F.struct(F.lit(t).alias("thr"), F.col(f"s{i}").alias("share")) for i, t in enumerate((0.5, 0.7))])))
    return s.select("year", F.round(F.col("med") + 3 * F.lit(1.4826) * F.col("mad"), 6).alias("limit_value"), F.round(F.col("q")[0], 6).alias("p95"), F.round(F.col("q")[1], 6).alias("p99"), "t.thr", F.round("t.share", 6).alias("share"))


@query("""
WITH h AS (SELECT user_id % 5 AS cell, date_trunc('hour', ts) AS ts, max(value) AS v FROM events GROUP BY 1, 2), s AS (SELECT cell, CAST(ts - INTERVAL 1 HOUR AS DATE) AS d, v FROM h), d AS (SELECT cell, d, CASE WHEN count(*) = 24 THEN sum(v) END AS total, count(*) AS n FROM s GROUP BY 1, 2)
SELECT cell, d, n, round(total, 4) AS total, round(total * 1.1 - total, 7) AS effect_a, round((total * 1.1 * 0.9 - total * 1.1 + (total * 0.9 - total)) / 2, 7) AS effect_b FROM d
""")
def et0_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly values cover the hour before, so days are cut one hour back; each input swapped in both directions."""
    e = domain.table(spark, sf_dir, "events")
    h = e.groupBy((F.col("user_id") % 5).alias("cell"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("value").alias("v"))
    d = h.groupBy("cell", F.to_date(F.col("ts") - F.expr("interval 1 hour")).alias("d")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("total", F.when(F.col("n") == 24, F.col("s")))
    t = F.col("total")
    return d.select("cell", "d", "n", F.round(t, 4).alias("total"), F.round(t * 1.1 - t, 7).alias("effect_a"), F.round((t * 1.1 * 0.9 - t * 1.1 + (t * 0.9 - t)) / 2, 7).alias("effect_b"))


@query("""
SELECT o.year, date_add(max(CAST(ts AS DATE)), INTERVAL 1 DAY)::DATE AS after_season, count(DISTINCT ts) AS scenes FROM obs o WHERE valid AND doy BETWEEN 121 AND 273 GROUP BY o.year
""", OBS)
def winter_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower bound of winter dates: the day after the last accepted scene of the season."""
    o = domain.obs(spark, sf_dir).where("valid and doy between 121 and 273")
    return o.groupBy("year").agg(F.date_add(F.max(F.to_date("ts")), 1).alias("after_season"), F.countDistinct("ts").alias("scenes"))


@query("""
SELECT 'status' AS name, CAST(o_orderstatus AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', CAST(o_orderpriority AS VARCHAR), count(*) FROM orders GROUP BY 2
""")
def layer_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts of the columns with few distinct values; both in one pass."""
    o = domain.table(spark, sf_dir, "orders").select(F.explode(F.array(F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value")))).alias("s"))
    return o.groupBy("s.name", "s.value").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH v AS (SELECT uid % 3 AS grp, uid, orbit AS variable, avg(10 * log10(lin)) AS v FROM units GROUP BY 1, 2, 3), q AS (SELECT variable, quantile_cont(v, 0.95) AS p95 FROM v WHERE grp = 2 GROUP BY variable)
SELECT variable, grp, count(*) AS n, round(avg(CASE WHEN v > 15 THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) FILTER (v > p95) AS above_placebo FROM v JOIN q USING (variable) GROUP BY 1, 2
""", UNITS)
def signal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by variable and group, and how many lie above the placebo group's 95th percentile."""
    v = domain.unit_series(spark, sf_dir).groupBy((F.col("uid") % 3).alias("grp"), "uid", F.col("orbit").alias("variable")).agg(F.avg(F.lit(10.0) * F.log10("lin")).alias("v"))
    q = v.where("grp = 2").groupBy("variable").agg(F.percentile("v", F.lit(0.95)).alias("p95"))
    return v.join(F.broadcast(q), "variable").groupBy("variable", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("v") > 15).cast("double")), 6).alias("share"), F.count_if(F.col("v") > F.col("p95")).alias("above_placebo"))


@query("""
SELECT CAST(year AS BIGINT) AS year, px % 3 AS platform, round(median(ndvi), 6) AS ndvi, count(ndvi) AS n, count(ndvi) / count(*) >= 0.3 AS enough FROM idx WHERE month(ts) BETWEEN 6 AND 8 GROUP BY 1, 2
""", OBS, IDX)
def platform_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ix.with_indices(domain.obs(spark, sf_dir).where(F.month("ts").between(6, 8)), ["ndvi"])
    return o.groupBy("year", (F.col("px") % 3).alias("platform")).agg(F.round(F.median("ndvi"), 6).alias("ndvi"), F.count("ndvi").alias("n"), (F.count("ndvi") / F.count(F.lit(1)) >= 0.3).alias("enough"))


@query("""
SELECT o_orderkey % 3 AS owner, CAST(year(o_orderdate) AS BIGINT) AS year, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 8) AS final, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 8) AS open FROM orders GROUP BY 1, 2
""")
def official_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by owner and year, indicators as columns."""
    p = domain.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 3).alias("owner"), F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice"))
    return p.select("owner", "year", F.round("F", 8).alias("final"), F.round("O", 8).alias("open"))


@query("""
SELECT r.rid, count(o.id) > 0 AS in_runs, string_agg((1996 + o.id % 5) || '#' || o.id, ';' ORDER BY o.id) AS matches FROM refs r LEFT JOIN objects o ON r.x0 - o.x1 <= 20 AND o.x0 - r.x1 <= 20 AND r.y0 - o.y1 <= 20 AND o.y0 - r.y1 <= 20 AND sqrt(pow(greatest(0, r.x0 - o.x1, o.x0 - r.x1), 2) + pow(greatest(0, r.y0 - o.y1, o.y0 - r.y1), 2)) <= 20 GROUP BY r.rid
""", OBJECTS, REFS)
def register_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register records against runs with the matches as one string."""
    r = domain.references(spark, sf_dir).select("rid", "x0", "y0", "x1", "y1")
    pairs = spatial.near_pairs(r, domain.objects(spark, sf_dir).select("id", "x0", "y0", "x1", "y1"), 20.0, 100.0)
    m = pairs.groupBy(F.col("a.rid").alias("rid")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b.id")), lambda i: F.concat((1996 + i % 5).cast("string"), F.lit("#"), i.cast("string"))), ";").alias("matches"))
    return r.select("rid").join(m, "rid", "left").select("rid", F.col("matches").isNotNull().alias("in_runs"), "matches")


@query("""
SELECT id, CAST(floor(id / 50) AS BIGINT) AS row, id % 50 AS col, round((x0 + x1) / 2, 6) AS cx, round(sqrt(area_ha * 10000 / CAST(3.141592653589793 AS DOUBLE)), 6) AS radius FROM objects
""", OBJECTS)
def cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier to row and column, centre and equal-area radius."""
    return domain.objects(spark, sf_dir).select("id", F.floor(F.col("id") / 50).alias("row"), (F.col("id") % 50).alias("col"), F.round((F.col("x0") + F.col("x1")) / 2, 6).alias("cx"), F.round(F.sqrt(F.col("area_ha") * 10000 / math.pi), 6).alias("radius"))
