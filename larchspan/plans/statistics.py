"""Label statistics, official tables, cross-checks and tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.functions import stats
from larchspan.operators import raster
from larchspan.plans.kit import OBJECTS, REFS, query
from larchspan.plans.objects import labelled, labelled_sql
from larchspan.sources import domain

LABELS = """lbl AS (SELECT l_partkey AS px, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(max(l_linenumber) % 4 AS BIGINT) AS agent FROM lineitem GROUP BY 1, 2)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, year, agent: annual label per cell."""
    return domain.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("px"), F.year("l_shipdate").cast("long").alias("year")).agg((F.max("l_linenumber") % 4).cast("long").alias("agent"))


@query("""
SELECT r.region, y.year, a.agent, count(l.px) AS n FROM (SELECT unnest(range(0, 5)) AS region) r, (SELECT unnest(range(1995, 2002)) AS year) y, (SELECT unnest([1, 2, 3]) AS agent) a LEFT JOIN lbl l ON l.px % 5 = r.region AND l.year = y.year AND l.agent = a.agent GROUP BY 1, 2, 3
""", LABELS)
def annual_counts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by region, year and agent with the zero rows."""
    scaffold = spark.range(5).select(F.col("id").alias("region"), F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))).alias("year")).withColumn("agent", F.explode(F.array(*[F.lit(a) for a in (1, 2, 3)])))
    n = labels(spark, sf_dir).groupBy((F.col("px") % 5).alias("region"), "year", "agent").agg(F.count(F.lit(1)).alias("n"))
    return scaffold.join(n, ["region", "year", "agent"], "left").select("region", "year", "agent", F.coalesce("n", F.lit(0)).alias("n"))


VERSIONS = """va AS (SELECT px, year FROM lbl WHERE agent = 1), vb AS (SELECT px, year FROM lbl WHERE agent IN (1, 2) AND px % 3 > 0)"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = labels(spark, sf_dir)
    return d.where("agent = 1").select("px", "year"), d.where("agent in (1, 2) and px % 3 > 0").select("px", "year")


@query("""
SELECT year, count(*) FILTER (a AND b) AS both_n, count(*) FILTER (a OR b) AS either_n, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard, count(*) FILTER (a AND near) AS matched_pm1 FROM (
  SELECT coalesce(va.px, vb.px) AS px, coalesce(va.year, vb.year) AS year, va.px IS NOT NULL AS a, vb.px IS NOT NULL AS b, EXISTS (SELECT 1 FROM vb n WHERE n.px = va.px AND n.year BETWEEN va.year - 1 AND va.year + 1) AS near FROM va FULL JOIN vb ON vb.px = va.px AND vb.year = va.year) GROUP BY year
""", LABELS, VERSIONS)
def crosscheck_pm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions: same-year Jaccard, and matches within a year by lag and lead instead of an interval join."""
    a, b = _versions(spark, sf_dir)
    d = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["px", "year"], "full")
    w = W.partitionBy("px").orderBy("year").rangeBetween(-1, 1)
    d = d.withColumns({"a": F.coalesce("a", F.lit(False)), "b": F.coalesce("b", F.lit(False))})
    d = d.withColumn("near", F.max("b").over(w))
    return d.groupBy("year").agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), F.count(F.lit(1)).alias("either_n"), F.round(F.count_if(F.col("a") & F.col("b")) / F.count(F.lit(1)), 6).alias("jaccard"), F.count_if(F.col("a") & F.col("near")).alias("matched_pm1"))


@query("""
SELECT year, count(*) AS n, round(avg(CASE WHEN EXISTS (SELECT 1 FROM vb WHERE vb.px = va.px AND vb.year = va.year) THEN 1.0 ELSE 0.0 END), 6) AS same_year, round(avg(CASE WHEN EXISTS (SELECT 1 FROM vb WHERE vb.px = va.px AND vb.year BETWEEN va.year - 1 AND va.year + 1) THEN 1.0 ELSE 0.0 END), 6) AS within_one, year < 2001 AS next_year_available FROM va GROUP BY year
""", LABELS, VERSIONS)
def followup_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _versions(spark, sf_dir)
    near = b.select("px", F.col("year").alias("y"), F.explode(F.sequence(F.col("year") - 1, F.col("year") + 1)).alias("year")).groupBy("px", "year").agg(F.bool_or(F.col("y") == F.col("year")).alias("same"))
    d = a.join(near, ["px", "year"], "left")
    return d.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(F.col("same").cast("double"), F.lit(0.0))), 6).alias("same_year"), F.round(F.avg(F.col("same").isNotNull().cast("double")), 6).alias("within_one")).withColumn("next_year_available", F.col("year") < 2001)


@query("""
SELECT CAST(floor(y0 / 500) * 10 + floor(x0 / 500) AS BIGINT) AS cell, count(*) AS n, round(sum(area_ha), 4) AS ha, round(count(*) FILTER (type = 'cut') / nullif(count(*) FILTER (status <> 'new'), 0), 6) AS conifer_share FROM objects GROUP BY 1
""", OBJECTS)
def grid_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = (F.floor(F.col("y0") / 500) * 10 + F.floor(F.col("x0") / 500)).cast("long")
    return domain.objects(spark, sf_dir).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), stats.round_scaled(stats.sum_in_order(F.col("area_ha"), F.col("id")), 4).alias("ha"), stats.round_scaled(F.try_divide(F.count_if(F.col("type") == "cut"), F.count_if(F.col("status") != "new")), 6).alias("conifer_share"))


@query(labelled_sql("""
, e AS (SELECT l.label, count(*) AS n_inner FROM lab l JOIN lab n ON n.label = l.label AND abs(n.row - l.row) + abs(n.col - l.col) = 1 GROUP BY l.label),
q AS (SELECT l.label, any_value(cls) AS cls, count(*) AS n, count(*) * CAST(0.37 AS DOUBLE) AS ha, (4 * count(*) - coalesce(any_value(e.n_inner), 0)) / (4 * sqrt(CAST(count(*) AS DOUBLE))) AS si FROM lab l LEFT JOIN e USING (label) GROUP BY l.label)
SELECT CAST(cls AS INTEGER) AS cls, count(*) AS n, round(sum(ha), 4) AS ha, round(median(ha), 6) AS med, round(quantile_cont(ha, 0.9), 6) AS p90, round(max(ha), 6) AS top, round(avg(CASE WHEN ha >= 1 THEN 1.0 ELSE 0.0 END), 6) AS share_1ha, round(median(si), 6) AS si_median, round(sum(si * ha) / sum(ha), 6) AS si_weighted FROM q GROUP BY cls"""))
def patch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of components: sizes, shares, shape index as median and weighted by area."""
    d = labelled(spark, sf_dir)
    e = raster.boundary_edges(d).join(d.groupBy("label").agg(F.first("cls").alias("cls")), "label")
    q = e.select("cls", (F.col("n_cells") * F.lit(0.37)).alias("ha"), (F.col("n_edges") / (4 * F.sqrt(F.col("n_cells").cast("double")))).alias("si"))
    return q.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ha"), 4).alias("ha_sum"), F.round(F.median("ha"), 6).alias("med"), F.round(F.percentile("ha", F.lit(0.9)), 6).alias("p90"), F.round(F.max("ha"), 6).alias("top"), F.round(F.avg((F.col("ha") >= 1).cast("double")), 6).alias("share_1ha"), F.round(F.median("si"), 6).alias("si_median"), F.round(F.sum(F.col("si") * F.col("ha")) / F.sum("ha"), 6).alias("si_weighted")).withColumnRenamed("ha_sum", "ha")


WIDE = """wide AS (SELECT n_nationkey AS owner, CASE WHEN n_nationkey % 2 = 0 THEN 'final' ELSE 'thin' END AS type, CAST(n_nationkey * 3 AS VARCHAR) || ',5' AS "area 2013", CASE WHEN n_nationkey % 7 = 0 THEN '..' ELSE CAST(n_nationkey * 4 AS VARCHAR) || ',25' END AS "area 2014" FROM nation)"""


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, type, indicator, year, value from a wide table with decimal commas; what is no number becomes NULL."""
    n = domain.table(spark, sf_dir, "nation")
    wide = n.select(F.col("n_nationkey").alias("owner"), F.when(F.col("n_nationkey") % 2 == 0, "final").otherwise("thin").alias("type"), F.concat((F.col("n_nationkey") * 3).cast("string"), F.lit(",5")).alias("area 2013"), F.when(F.col("n_nationkey") % 7 == 0, "..").otherwise(F.concat((F.col("n_nationkey") * 4).cast("string"), F.lit(",25"))).alias("area 2014"))
    long = wide.unpivot(["owner", "type"], ["area 2013", "area 2014"], "name", "raw")
    return long.select("owner", "type", F.regexp_extract("name", r"^(.*) (\d{4})$", 1).alias("indicator"), F.regexp_extract("name", r"(\d{4})$", 1).cast("int").alias("year"), F.regexp_replace("raw", ",", ".").try_cast("double").alias("value"))


@query("""
SELECT owner, type, 'area' AS indicator, CAST(y AS INTEGER) AS year, TRY_CAST(replace(raw, ',', '.') AS DOUBLE) AS value FROM (SELECT owner, type, 2013 AS y, "area 2013" AS raw FROM wide UNION ALL SELECT owner, type, 2014, "area 2014" FROM wide)
""", WIDE)
def unpivot_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official(spark, sf_dir)


@query("""
SELECT y AS year, round(sum(v) FILTER (type = 'final'), 4) AS final, round(sum(v) FILTER (type = 'thin'), 4) AS thin, round(coalesce(sum(v) FILTER (type = 'final'), 0) + coalesce(sum(v) FILTER (type = 'thin'), 0), 4) AS total
FROM (SELECT type, 2013 AS y, TRY_CAST(replace("area 2013", ',', '.') AS DOUBLE) AS v FROM wide UNION ALL SELECT type, 2014, TRY_CAST(replace("area 2014", ',', '.') AS DOUBLE) FROM wide) GROUP BY y
""", WIDE)
def pivot_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = official(spark, sf_dir).groupBy("year").pivot("type", ["final", "thin"]).agg(F.sum("value"))
    return p.select("year", F.round("final", 4).alias("final"), F.round("thin", 4).alias("thin"), F.round(F.coalesce("final", F.lit(0.0)) + F.coalesce("thin", F.lit(0.0)), 4).alias("total"))


@query("""
SELECT subtype, count(ha) AS n, round(sum(ha), 4) AS ha, round(quantile_cont(ha, 0.1), 6) AS p10, round(quantile_cont(ha, 0.25), 6) AS p25, round(median(ha), 6) AS p50, round(quantile_cont(ha, 0.75), 6) AS p75, round(quantile_cont(ha, 0.9), 6) AS p90, round(avg(CASE WHEN ha >= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS large_share FROM refs GROUP BY subtype
""", REFS)
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("ha", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    g = domain.references(spark, sf_dir).groupBy("subtype").agg(F.count("ha").alias("n"), F.sum("ha").alias("s"), q.alias("q"), F.avg((F.col("ha") >= 0.1).cast("double")).alias("l"))
    return g.select("subtype", "n", F.round("s", 4).alias("ha"), *[F.round(F.col("q")[i], 6).alias(c) for i, c in enumerate(("p10", "p25", "p50", "p75", "p90"))], F.round("l", 6).alias("large_share"))


@query("""
SELECT coalesce(type, 'total') AS type, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'persistent') AS persistent, count(*) FILTER (status = 'recovered') AS recovered, count(*) FILTER (status = 'lost') AS lost, count(*) AS total FROM objects GROUP BY ROLLUP (type)
""", OBJECTS)
def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by verdict with margins, by a rollup; verdicts that do not occur are 0."""
    o = domain.objects(spark, sf_dir)
    return o.rollup("type").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "persistent", "recovered", "lost")], F.count(F.lit(1)).alias("total")).withColumn("type", F.coalesce("type", F.lit("total")))


@query("""
WITH c AS (SELECT px % 100 AS poly, px, max(CASE WHEN agent = 1 THEN year END) AS latest, bool_or(agent = 1) AS ever1, bool_or(agent = 3) AS ever3 FROM lbl GROUP BY px),
m AS (SELECT poly, latest, count(*) AS n FROM c WHERE latest IS NOT NULL GROUP BY 1, 2)
SELECT c.poly, round(avg(CASE WHEN ever1 THEN 1.0 ELSE 0.0 END), 6) AS share1, round(avg(CASE WHEN ever3 THEN 1.0 ELSE 0.0 END), 6) AS share3, round(avg(CASE WHEN ever1 OR ever3 THEN 1.0 ELSE 0.0 END), 6) AS share_any, (SELECT arg_min(latest, -n * 10000 + latest) FROM m WHERE m.poly = c.poly) AS mode_year FROM c GROUP BY c.poly
""", LABELS)
def mode_latest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History per polygon: ever-shares and the mode of the latest year, the smallest on ties."""
    c = labels(spark, sf_dir).groupBy((F.col("px") % 100).alias("poly"), "px").agg(F.max(F.when(F.col("agent") == 1, F.col("year"))).alias("latest"), F.bool_or(F.col("agent") == 1).alias("e1"), F.bool_or(F.col("agent") == 3).alias("e3"))
    mode = c.where("latest is not null").groupBy("poly", "latest").count().groupBy("poly").agg(F.min(F.struct(-F.col("count"), F.col("latest"))).alias("m"))
    g = c.groupBy("poly").agg(*[F.round(F.avg(x.cast("double")), 6).alias(n) for n, x in (("share1", F.col("e1")), ("share3", F.col("e3")), ("share_any", F.col("e1") | F.col("e3")))])
    return g.join(mode, "poly", "left").select("poly", "share1", "share3", "share_any", F.col("m.latest").alias("mode_year"))


@query("""
WITH s AS (SELECT c_custkey AS id, [c_custkey % 5, c_nationkey % 4, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 3 END] AS g, [c_nationkey % 6, c_custkey % 7, 2] AS n FROM customer),
w AS (SELECT id, CASE WHEN list_sum(g) > 0 THEN g ELSE n END AS w FROM s)
SELECT id, round(w[1] / nullif(list_sum(w), 0), 6) AS spruce_share, ['spruce','pine','birch'][list_position(w, list_max(w))] AS dominant FROM w
""")
def stand_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are basal areas, or tree counts where these sum to 0; dominant is the first largest."""
    c = domain.table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    g = F.array(k % 5, n % 4, F.when(k % 9 == 0, F.lit(0).cast("long")).otherwise(k % 3))
    t = F.array(n % 6, k % 7, F.lit(2).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    s = c.select(k.alias("id"), F.when(total(g) > 0, g).otherwise(t).alias("w"))
    names = F.array(F.lit("spruce"), F.lit("pine"), F.lit("birch"))
    return s.select("id", F.round(F.try_divide(F.col("w")[0], total(F.col("w"))), 6).alias("spruce_share"), F.element_at(names, F.array_position("w", F.array_max("w")).cast("int")).alias("dominant"))


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties at their mean."""
    w = W.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2.0


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal, by the rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


@query("""
WITH r AS (SELECT c_mktsegment AS seg, c_nationkey < 12 AS low, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 50) + (count(*) OVER (PARTITION BY c_mktsegment, c_custkey % 50) - 1) / 2.0 AS rb FROM customer),
u AS (SELECT seg, count(*) AS n, count(*) FILTER (low) AS n1, count(*) FILTER (NOT low) AS n2, sum(ra) FILTER (low) AS s1, corr(ra, rb) AS rho FROM r GROUP BY seg),
z AS (SELECT *, s1 - n1 * (n1 + 1) / 2.0 AS uu FROM u),
y AS (SELECT *, (uu - n1 * n2 / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS zz FROM z),
x AS (SELECT *, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(zz) / sqrt(2)) AS t FROM y)
SELECT seg, n, round(rho, 6) AS spearman, round(uu, 4) AS u, round(t * (CAST(0.254829592 AS DOUBLE) + t * (CAST(-0.284496736 AS DOUBLE) + t * (CAST(1.421413741 AS DOUBLE) + t * (CAST(-1.453152027 AS DOUBLE) + t * CAST(1.061405429 AS DOUBLE))))) * exp(-zz * zz / 2), 6) AS p FROM x
""")
def spearman_mannwhitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation and the two-sided rank-sum test per segment."""
    c = domain.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), (F.col("c_nationkey") < 12).alias("low"), "c_acctbal", (F.col("c_custkey") % 50).alias("k"))
    r = c.withColumns({"ra": average_rank("c_acctbal", "seg"), "rb": average_rank("k", "seg")})
    u = r.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.count_if("low").cast("double").alias("n1"), F.count_if(~F.col("low")).cast("double").alias("n2"), F.sum(F.when(F.col("low"), F.col("ra"))).alias("s1"), F.corr("ra", "rb").alias("rho"))
    u = u.withColumn("u", F.col("s1") - F.col("n1") * (F.col("n1") + 1) / 2)
    z = (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return u.select("seg", "n", F.round("rho", 6).alias("spearman"), F.round("u", 4).alias("u"), F.round(normal_tail(z), 6).alias("p"))


@query("""
WITH s AS (SELECT o_orderkey AS id, o_orderstatus AS source, o_custkey % 40 AS tile, CAST(o_orderdate AS DATE) AS d, o_custkey % 6 AS baseline, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank FROM orders),
f AS (SELECT d, tile % 8 AS acq, min(rank) AS rank FROM s GROUP BY 1, 2)
SELECT s.d, s.tile % 8 AS acq, s.tile, s.id, s.source FROM s JOIN f ON f.d = s.d AND f.acq = s.tile % 8 AND f.rank = s.rank QUALIFY row_number() OVER (PARTITION BY s.d, s.tile ORDER BY s.baseline DESC, s.id) = 1
""")
def source_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per overpass the first source that has it; in it, per tile the highest baseline, the first on ties."""
    o = domain.table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 40).alias("tile"), F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 6).alias("baseline"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("rank")).withColumn("acq", F.col("tile") % 8)
    s = s.withColumn("first", F.min("rank").over(W.partitionBy("d", "acq"))).where(F.col("rank") == F.col("first"))
    best = s.groupBy("d", "acq", "tile").agg(F.min(F.struct(-F.col("baseline"), F.col("id"), F.col("source"))).alias("m"))
    return best.select("d", "acq", "tile", "m.id", "m.source")


@query("""
WITH s AS (SELECT o_orderkey % 3 AS platform, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month, o_orderstatus AS source, o_totalprice < 200000 AS accepted, o_totalprice FROM orders)
SELECT year, month, count(*) AS total, count(*) FILTER (accepted) AS accepted, string_agg(DISTINCT source, '+' ORDER BY source) AS sources, round(median(o_totalprice), 4) AS med FROM s GROUP BY 1, 2
""")
def monthly_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_totalprice") < 200000).alias("accepted"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "+").alias("sources"), F.round(F.median("o_totalprice"), 4).alias("med"))


@query("""
WITH d AS (SELECT (n_nationkey * 37) % 50 AS cell, n_regionkey AS region FROM nation), c AS (SELECT CAST(floor(y0 / 500) AS BIGINT) AS row, CAST(floor(x0 / 500) AS BIGINT) AS col, count(*) AS n, sum(area_ha) AS ha FROM objects GROUP BY 1, 2)
SELECT row, col, n, round(ha, 4) AS ha, row_number() OVER (ORDER BY n DESC, ha DESC, row, col) AS rank, n >= 30 AS many, ha >= 2.5 AS large, n >= 30 AND ha >= 2.5 AS all_ok FROM c ORDER BY n DESC, ha DESC, row, col LIMIT 10
""", OBJECTS)
def densest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten densest cells (a top-k report) with criteria flags."""
    c = domain.objects(spark, sf_dir).groupBy(F.floor(F.col("y0") / 500).alias("row"), F.floor(F.col("x0") / 500).alias("col")).agg(F.count(F.lit(1)).alias("n"), stats.sum_in_order(F.col("area_ha"), F.col("id")).alias("ha"))
    top = c.orderBy(F.desc("n"), F.desc("ha"), "row", "col").limit(10)
    w = W.orderBy(F.desc("n"), F.desc("ha"), "row", "col")  # ten rows
    many, large = F.col("n") >= 30, F.col("ha") >= 2.5
    return top.select("row", "col", "n", stats.round_scaled(F.col("ha"), 4).alias("ha"), F.row_number().over(w).cast("long").alias("rank"), many.alias("many"), large.alias("large"), (many & large).alias("all_ok"))


@query("""
WITH t AS (SELECT r.rid, r.subtype, r.year, off, bool_or(l.agent = 1) AS c1, bool_or(l.agent = 3) AS c3 FROM refs r, (SELECT unnest([-1, 0, 1]) AS off) o LEFT JOIN lbl l ON l.px = r.rid % 1500 AND l.year = r.year + off GROUP BY ALL),
b AS (SELECT avg(CASE WHEN agent = 1 THEN 1.0 ELSE 0.0 END) AS base FROM lbl)
SELECT subtype, off, count(*) AS n, round(avg(CASE WHEN c1 THEN 1.0 ELSE 0.0 END), 6) AS share1, round(avg(CASE WHEN c3 THEN 1.0 ELSE 0.0 END), 6) AS share3, round(avg(CASE WHEN c1 OR c3 THEN 1.0 ELSE 0.0 END), 6) AS share_any, round(avg(CASE WHEN c1 THEN 1.0 ELSE 0.0 END) / any_value(base), 6) AS lift FROM t, b GROUP BY 1, 2
""", REFS, LABELS)
def timing_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels around the registration year, against the base rate."""
    d = labels(spark, sf_dir)
    r = domain.references(spark, sf_dir).select("rid", "subtype", (F.col("rid") % 1500).alias("px"), "year", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("off"))
    j = r.join(d.select("px", F.col("year").alias("y"), "agent"), (r["px"] == d["px"]) & (F.col("y") == F.col("year") + F.col("off")), "left")
    base = d.agg(F.avg((F.col("agent") == 1).cast("double")).alias("base"))
    c1, c3 = F.coalesce((F.col("agent") == 1).cast("double"), F.lit(0.0)), F.coalesce((F.col("agent") == 3).cast("double"), F.lit(0.0))
    g = j.groupBy("subtype", "off").agg(F.count(F.lit(1)).alias("n"), F.avg(c1).alias("s1"), F.avg(c3).alias("s3")).crossJoin(F.broadcast(base))
    return g.select("subtype", "off", "n", F.round("s1", 6).alias("share1"), F.round("s3", 6).alias("share3"), F.round(F.col("s1") + F.col("s3"), 6).alias("share_any"), F.round(F.col("s1") / F.col("base"), 6).alias("lift"))


@query("""
SELECT r_name AS region, round(coalesce(sum(c_acctbal) FILTER (c_custkey % 3 = 0), 0), 3) AS y0, round(coalesce(sum(c_acctbal) FILTER (c_custkey % 3 = 1), 0), 3) AS y1, round(coalesce(sum(c_acctbal) FILTER (c_custkey % 3 = 2), 0), 3) AS y2 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name
""")
def region_year_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (domain.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 3).cast("string").alias("y")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    p = j.groupBy(F.col("r_name").alias("region")).pivot("y", ["0", "1", "2"]).agg(F.sum("c_acctbal"))
    return p.select("region", *[F.round(F.coalesce(F.col(k), F.lit(0.0)), 3).alias(f"y{k}") for k in ("0", "1", "2")])


@query("""
SELECT method, lim, criterion, k, round(v, 6) AS value FROM (SELECT p_partkey % 3 AS method, CAST(p_size % 5 AS BIGINT) AS k, unnest(['rate', 'cover']) AS criterion, unnest([avg(p_retailprice) / 1000, avg(p_size) / 40]) AS v, avg(CASE WHEN p_size > 40 THEN 1.0 ELSE 0.0 END) AS fa FROM part GROUP BY 1, 2), (SELECT unnest([CAST(0.2 AS DOUBLE), CAST(0.4 AS DOUBLE)]) AS lim) WHERE fa <= lim QUALIFY row_number() OVER (PARTITION BY method, lim, criterion ORDER BY v DESC, k) = 1
""")
def criterion_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria in long form, the best setting per criterion, limit and method."""
    g = domain.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 3).alias("method"), (F.col("p_size") % 5).cast("long").alias("k")).agg((F.avg("p_retailprice") / 1000).alias("rate"), (F.avg("p_size") / 40).alias("cover"), F.avg((F.col("p_size") > 40).cast("double")).alias("fa"))
    m = g.unpivot(["method", "k", "fa"], ["rate", "cover"], "criterion", "v").withColumn("lim", F.explode(F.array(F.lit(0.2), F.lit(0.4)))).where("fa <= lim")
    best = m.groupBy("method", "lim", "criterion").agg(F.min(F.struct(-F.col("v"), F.col("k"), F.col("v").alias("w"))).alias("m"))
    return best.select("method", "lim", "criterion", "m.k", F.round("m.w", 6).alias("value"))


@query("""
SELECT 'objects' AS layer, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(id || '|' || type || '|' || status), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM objects UNION ALL
SELECT 'refs', count(*), CAST(sum(CAST('0x' || substr(md5(rid || '|' || subtype), 1, 8) AS BIGINT)) AS BIGINT) FROM refs
""", OBJECTS, REFS)
def golden_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive digests of result tables."""
    h = lambda *c: F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *c)), 1, 8), 16, 10).cast("long"))
    o = domain.objects(spark, sf_dir).agg(F.lit("objects").alias("layer"), F.count(F.lit(1)).alias("n_rows"), h("id", "type", "status").alias("checksum"))
    r = domain.references(spark, sf_dir).agg(F.lit("refs").alias("layer"), F.count(F.lit(1)).alias("n_rows"), h("rid", "subtype").alias("checksum"))
    return o.unionByName(r)
