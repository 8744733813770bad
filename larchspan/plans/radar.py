"""Before/after change on composites per orbit: normalisation, class-wise robust z, windows, sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.operators import injection, raster
from larchspan.plans.kit import UNITS, query
from larchspan.plans.objects import CELLS, cells
from larchspan.sources import domain

DB = "CAST(10 AS DOUBLE) * log10(%s)"


def db(x):  # noqa: ANN001, ANN201
    """Decibels of a positive linear value."""
    return F.lit(10.0) * F.log10(x)


@query(f"SELECT uid, orbit, count(*) AS n, round(avg(lin), 6) AS linear, round({DB % 'avg(lin)'}, 6) AS db FROM units GROUP BY 1, 2", UNITS)
def linear_composite_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = domain.unit_series(spark, sf_dir).groupBy("uid", "orbit").agg(F.count(F.lit(1)).alias("n"), F.avg("lin").alias("m"))
    return u.select("uid", "orbit", "n", F.round("m", 6).alias("linear"), F.round(db(F.col("m")), 6).alias("db"))


@query("SELECT uid, orbit, ts, round(lin / median(CASE WHEN uid % 3 = 0 THEN lin END) OVER (PARTITION BY orbit, CAST(ts AS DATE)), 6) AS normalised FROM units", UNITS)
def scene_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scene (orbit and day) divided by the median of its stable units."""
    u = domain.unit_series(spark, sf_dir).withColumn("day", F.to_date("ts"))
    scenes = u.where("uid % 3 = 0").groupBy("orbit", "day").agg(F.median("lin").alias("med"))
    return u.join(scenes, ["orbit", "day"], "left").select("uid", "orbit", "ts", F.round(F.col("lin") / F.col("med"), 6).alias("normalised"))


COMPOSITES = """comp AS (SELECT uid, orbit, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'pre' ELSE 'post' END AS win, avg(lin) AS m, avg(lin * 0.5 + 1) AS m2, count(*) AS n FROM units GROUP BY 1, 2, 3),
piv AS (SELECT uid, orbit, max(m) FILTER (win = 'pre') AS pre, max(m) FILTER (win = 'post') AS post, max(m2) FILTER (win = 'pre') AS pre2, max(m2) FILTER (win = 'post') AS post2, min(n) AS n, count(*) AS k FROM comp GROUP BY 1, 2),
delta AS (SELECT uid, orbit, n, 10 * log10(post) - 10 * log10(pre) AS d_vv, 10 * log10(post2) - 10 * log10(pre2) AS d_vh FROM piv WHERE k = 2),
comb AS (SELECT uid, avg(d_vv) AS d_vv, avg(d_vh) AS d_vh, avg(d_vv) + avg(d_vh) AS idx, count(*) AS n_orbits FROM delta WHERE d_vv IS NOT NULL AND d_vh IS NOT NULL GROUP BY uid)"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, orbit, n, d_vv, d_vh: orbits with both windows."""
    u = domain.unit_series(spark, sf_dir).withColumn("win", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "pre").otherwise("post"))
    c = u.groupBy("uid", "orbit").pivot("win", ["pre", "post"]).agg(F.avg("lin").alias("m"), F.avg(F.col("lin") * 0.5 + 1).alias("m2"), F.count("lin").alias("n"))
    c = c.where("pre_m is not null and post_m is not null")
    return c.select("uid", "orbit", F.least("pre_n", "post_n").alias("n"), (db(F.col("post_m")) - db(F.col("pre_m"))).alias("d_vv"), (db(F.col("post_m2")) - db(F.col("pre_m2"))).alias("d_vh"))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(spark, sf_dir).where("d_vv is not null and d_vh is not null").groupBy("uid").agg(F.avg("d_vv").alias("d_vv"), F.avg("d_vh").alias("d_vh"), (F.avg("d_vv") + F.avg("d_vh")).alias("idx"), F.count(F.lit(1)).alias("n_orbits"))


@query("SELECT uid, orbit, n, round(d_vv, 6) AS d_vv, round(d_vh, 6) AS d_vh FROM delta", UNITS, COMPOSITES)
def orbit_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(spark, sf_dir).select("uid", "orbit", "n", F.round("d_vv", 6).alias("d_vv"), F.round("d_vh", 6).alias("d_vh"))


@query("SELECT uid, round(d_vv, 6) AS d_vv, round(d_vh, 6) AS d_vh, round(idx, 6) AS idx, n_orbits FROM comb", UNITS, COMPOSITES)
def orbit_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined(spark, sf_dir).select("uid", *[F.round(c, 6).alias(c) for c in ("d_vv", "d_vh", "idx")], "n_orbits")


CLASS_Z = """cz AS (SELECT uid, uid % 4 AS cls, idx FROM comb),
cm AS (SELECT cls, median(idx) AS med FROM cz WHERE uid % 3 <> 0 GROUP BY cls),
cs AS (SELECT cls, any_value(med) AS med, median(abs(idx - med)) AS mad FROM cz JOIN cm USING (cls) WHERE uid % 3 <> 0 GROUP BY cls),
zz AS (SELECT uid, cz.cls, CASE WHEN mad > 0 THEN (idx - med) / (CAST(1.4826 AS DOUBLE) * mad) END AS z FROM cz LEFT JOIN cs USING (cls))"""


def class_scores(df: DataFrame, value: str = "idx", by: str = "cls", stable: str = "uid % 3 <> 0") -> DataFrame:
    """`df` with `z`: robust z with the statistics of the class's stable members; NULL without any or without spread."""
    members = df.where(stable).select(by, F.col(value).alias("_v"))
    center = members.groupBy(by).agg(F.median("_v").alias("_med"))
    spread = members.join(center, by).groupBy(by, "_med").agg(F.median(F.abs(F.col("_v") - F.col("_med"))).alias("_mad"))
    df = df.join(spread, by, "left")  # a row a class, small enough for Spark to broadcast
    return df.withColumn("z", F.when(F.col("_mad") > 0, (F.col(value) - F.col("_med")) / (F.lit(1.4826) * F.col("_mad")))).drop("_med", "_mad")


@query("SELECT uid, cls, round(z, 6) AS z FROM zz", UNITS, COMPOSITES, CLASS_Z)
def class_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(combined(spark, sf_dir).withColumn("cls", F.col("uid") % 4)).select("uid", "cls", F.round("z", 6).alias("z"))


@query("SELECT k, CASE WHEN z >= k THEN 1 WHEN z <= -k THEN 2 ELSE 0 END AS change, count(*) AS n, round(count(*) * CAST(0.01 AS DOUBLE), 6) AS area_ha FROM zz, (SELECT unnest([CAST(1 AS DOUBLE), CAST(1.5 AS DOUBLE), CAST(2 AS DOUBLE), CAST(3 AS DOUBLE)]) AS k) GROUP BY 1, 2", UNITS, COMPOSITES, CLASS_Z)
def classify_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitivity: thresholds are a column, so all are one plan."""
    z = class_scores(combined(spark, sf_dir).withColumn("cls", F.col("uid") % 4)).withColumn("k", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0, 3.0)])))
    change = F.when(F.col("z") >= F.col("k"), 1).when(F.col("z") <= -F.col("k"), 2).otherwise(0)
    return z.groupBy("k", change.alias("change")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * F.lit(0.01), 6).alias("area_ha"))


@query("""
SELECT c.px, round(avg(n.price), 6) AS box FROM cells c JOIN cells n ON n.row BETWEEN c.row - 1 AND c.row + 1 AND n.col BETWEEN c.col - 1 AND c.col + 1 AND n.cls <> 2 WHERE c.cls <> 2 GROUP BY c.px
""", CELLS)
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked 3 x 3 mean by two range windows."""
    c = cells(spark, sf_dir).withColumn("price", F.when(F.col("cls") != 2, F.col("price")))
    return raster.box_mean(c, "price", 1).where("price_box is not null").select("px", F.round("price_box", 6).alias("box"))


_OFFSETS = ", ".join(f"({i}, {j})" for i, j in raster.disc_offsets(13))


@query(f"""
WITH ker(dr, dc) AS (VALUES {_OFFSETS}),
m AS (SELECT c.px, CASE WHEN count(CASE WHEN n.cls <> 2 THEN n.price END) >= 0.7 * 13 THEN avg(CASE WHEN n.cls <> 2 THEN n.price END) END AS v, count(CASE WHEN n.cls <> 2 THEN 1 END) AS n_valid FROM cells c JOIN ker ON true JOIN cells n ON n.row = c.row + dr AND n.col = c.col + dc GROUP BY c.px),
s AS (SELECT median(v) AS med FROM m), d AS (SELECT any_value(med) AS med, median(abs(v - med)) AS mad FROM m, s)
SELECT px, n_valid, round(v, 6) AS mean_value, round((v - med) / (CAST(1.4826 AS DOUBLE) * mad), 6) AS z FROM m, d
""", CELLS)
def disc_window_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over 13-cell discs, and their robust z against all of them."""
    c = cells(spark, sf_dir).withColumn("price", F.when(F.col("cls") != 2, F.col("price")))
    m = raster.disc_mean(c, "price", 13)
    med = m.agg(F.median("price_disc").alias("med"))
    both = m.crossJoin(F.broadcast(med))
    mad = both.agg(F.median(F.abs(F.col("price_disc") - F.col("med"))).alias("mad"))
    return both.crossJoin(F.broadcast(mad)).select("px", "n_valid", F.round("price_disc", 6).alias("mean_value"), F.round((F.col("price_disc") - F.col("med")) / (F.lit(1.4826) * F.col("mad")), 6).alias("z"))


@query(f"""
WITH ker(dr, dc) AS (VALUES {_OFFSETS})
SELECT c.px, CAST(min(CASE WHEN t.size >= 46 THEN 1 ELSE 2 END) AS INTEGER) AS cls FROM cells c JOIN ker ON true JOIN cells t ON t.row = c.row - dr AND t.col = c.col - dc WHERE t.size >= 46 OR t.size <= 4 GROUP BY c.px
""", CELLS)
def footprint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of disc footprints around strong centres; the first class wins where they overlap."""
    t = cells(spark, sf_dir).where("size >= 46 or size <= 4").select("row", "col", F.when(F.col("size") >= 46, 1).otherwise(2).alias("cls"))
    touched = raster.kernel(t, raster.disc_offsets(13)).groupBy("row", "col").agg(F.min("cls").alias("cls"))
    return cells(spark, sf_dir).select("px", "row", "col").join(touched, ["row", "col"]).select("px", "cls")


ACQ = """acq AS (SELECT o_orderkey AS id, o_custkey % 5 AS orbit, o_orderdate AS ts, CASE WHEN o_orderdate < TIMESTAMP '1996-06-15' THEN 'pre' ELSE 'post' END AS win, abs(date_diff('day', DATE '1996-06-15', CAST(o_orderdate AS DATE))) AS days, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-05-15' AND TIMESTAMP '1996-07-15')"""


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = domain.table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(F.lit("1996-05-15").cast("timestamp"), F.lit("1996-07-15").cast("timestamp")))
    event = F.lit("1996-06-15").cast("date")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("orbit"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderdate") < F.lit("1996-06-15").cast("timestamp"), "pre").otherwise("post").alias("win"), F.abs(F.date_diff(F.to_date("o_orderdate"), event)).cast("long").alias("days"), "o_totalprice")


@query("SELECT id, orbit, win, days, r <= 3 AS used, CASE WHEN r <= 3 THEN '' ELSE 'too far from the event' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY orbit, win ORDER BY days, ts, id) AS r FROM acq)", ACQ)
def window_select_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n acquisitions closest to the event in each window, the others with a reason."""
    r = F.row_number().over(W.partitionBy("orbit", "win").orderBy("days", "ts", "id"))
    a = acquisitions(spark, sf_dir).withColumn("r", r)
    return a.select("id", "orbit", "win", "days", (F.col("r") <= 3).alias("used"), F.when(F.col("r") <= 3, "").otherwise("too far from the event").alias("reason"))


@query("""
SELECT id, wet, CASE WHEN wet AND dry >= 4 THEN 'wet' ELSE '' END AS reason, NOT (wet AND dry >= 4) AS kept FROM (SELECT id, o_totalprice > 150000 AS wet, count(*) FILTER (o_totalprice <= 150000) OVER (PARTITION BY orbit, win) AS dry FROM acq)
""", ACQ)
def wet_scene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wet scenes are dropped only where enough dry ones remain."""
    a = acquisitions(spark, sf_dir).withColumn("wet", F.col("o_totalprice") > 150000)
    dry = F.count_if(~F.col("wet")).over(W.partitionBy("orbit", "win"))
    drop = F.col("wet") & (dry >= 4)
    return a.withColumn("drop", drop).select("id", "wet", F.when(F.col("drop"), "wet").otherwise("").alias("reason"), (~F.col("drop")).alias("kept"))


@query("""
SELECT event_id, round(sum(v), 6) AS precip FROM (SELECT e.event_id, p.value AS v FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts BETWEEN e.ts - INTERVAL 24 HOUR AND e.ts) GROUP BY event_id
""")
def precip_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over the 24 hours up to each row, closed at both ends, as a range window: no self join."""
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    e = domain.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(F.sum("value").over(w), 6).alias("precip"))


@query("""
WITH a AS (SELECT px, cls FROM cells WHERE cls > 0), b AS (SELECT px, CASE WHEN size >= 30 THEN 1 WHEN size <= 12 THEN 2 END AS cls FROM cells WHERE size >= 30 OR size <= 12)
SELECT k AS cls, count(*) FILTER (a.cls = k AND b.cls = k) AS inter, count(*) FILTER (a.cls = k OR b.cls = k) AS uni, round(count(*) FILTER (a.cls = k AND b.cls = k) / nullif(count(*) FILTER (a.cls = k OR b.cls = k), 0), 6) AS iou
FROM a FULL JOIN b USING (px), (SELECT unnest([1, 2]) AS k) GROUP BY k
""", CELLS)
def variant_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    a = c.where("cls > 0").select("px", F.col("cls").alias("a"))
    b = c.where("size >= 30 or size <= 12").select("px", F.when(F.col("size") >= 30, 1).otherwise(2).alias("b"))
    d = a.join(b, "px", "full").withColumn("cls", F.explode(F.array(F.lit(1), F.lit(2))))
    is_a, is_b = F.coalesce(F.col("a") == F.col("cls"), F.lit(False)), F.coalesce(F.col("b") == F.col("cls"), F.lit(False))
    d = d.groupBy("cls").agg(F.count_if(is_a & is_b).alias("inter"), F.count_if(is_a | is_b).alias("uni"))
    return d.withColumn("iou", F.round(F.try_divide("inter", "uni"), 6))


#: The experiment on the test grid: blocks of 8 x 8 cells alternate between two classes.
SETUP = injection.Setup(sizes=(4, 9), strengths=(0.5, 1.0), windows=(1, 3), ks=(1.5, 2.0, 2.5), wanted=6, purity=0.75, gap=1, batch_share=0.05, min_cells=2)


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the injection experiment: analysis and stable cells, linear layers before and after."""
    c = cells(spark, sf_dir).withColumn("price", F.col("price").cast("double"))
    cls = 1 + (F.floor(F.col("row") / 8) + F.floor(F.col("col") / 8)) % 2
    layers = {"pre_vv": F.col("price"), "post_vv": F.col("price") * (1 + (F.col("size") - 25) / F.lit(400.0)), "pre_vh": F.col("price") / 4, "post_vh": F.col("price") / 4 * (1 + (F.col("size") * 7 % 50 - 25) / F.lit(400.0))}
    return c.select("px", "row", "col", cls.alias("cls"), (F.col("size") > 2).alias("analysis"), (F.col("size") > 6).alias("stable"), *[v.alias(k) for k, v in layers.items()])


def _experiment_sql(body: str, found: bool = True) -> str:
    """The experiment's steps as SQL, in front of `body`: candidates by join, sites where no better one is in reach,
    layers per run, means over offsets, medians, and components by recursion."""
    values = lambda rows: ", ".join(str(r) for r in rows)
    disc = values((n, i, *o) for i, n in enumerate(SETUP.sizes) for o in raster.disc_offsets(n))
    square = values((w, i, j) for w in SETUP.windows for i in range(-(w // 2), w // 2 + 1) for j in range(-(w // 2), w // 2 + 1))
    cross = values((w, *o) for w in SETUP.windows for o in raster.cross(w // 2))
    far = values((n, injection.reach(n, SETUP.gap)) for n in SETUP.sizes)
    n_st, wanted, d = len(SETUP.strengths), SETUP.wanted, "CAST(%s AS DOUBLE)"
    head = f"""WITH RECURSIVE {CELLS},
land AS (SELECT px, row, col, 1 + (row // 8 + col // 8) % 2 AS cls, size > 2 AS analysis, size > 6 AS stable, CAST(price AS DOUBLE) AS pre_vv, CAST(price AS DOUBLE) * (1 + (size - 25) / {d % 400}) AS post_vv,
  CAST(price AS DOUBLE) / 4 AS pre_vh, CAST(price AS DOUBLE) / 4 * (1 + (size * 7 % 50 - 25) / {d % 400}) AS post_vh FROM cells),
disc(size, i, dr, dc) AS (VALUES {disc}), square(win, dr, dc) AS (VALUES {square}), spill(win, dr, dc) AS (VALUES {cross}), far(size, reach) AS (VALUES {far}),
ks AS (SELECT unnest([{", ".join(d % k for k in SETUP.ks)}]) AS k), st AS (SELECT unnest({list(range(n_st))}) AS j, unnest([{", ".join(d % x for x in SETUP.strengths)}]) AS strength),
cand AS (SELECT o.size, o.i, c.px, c.row, c.col, c.cls, CAST('0x' || substr(md5('inject|' || o.size || '|' || c.px), 1, 8) AS BIGINT) % 2147483648 AS draw FROM land c JOIN disc o ON true JOIN land t ON t.row = c.row + o.dr AND t.col = c.col + o.dc
  WHERE c.stable AND t.stable GROUP BY 1, 2, 3, 4, 5, 6 HAVING count(*) = o.size AND count(*) FILTER (t.cls = c.cls) >= {d % SETUP.purity} * count(*)),
best AS (SELECT a.* FROM cand a JOIN far f USING (size) WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.size = a.size AND abs(b.row - a.row) <= f.reach AND abs(b.col - a.col) <= f.reach AND (b.draw < a.draw OR (b.draw = a.draw AND b.px < a.px)))),
site AS (SELECT *, row_number() OVER (PARTITION BY size, cls ORDER BY draw, px) AS site FROM best QUALIFY row_number() OVER (PARTITION BY size, cls ORDER BY draw, px) <= {wanted}),
room AS (SELECT cls, count(*) AS n FROM land WHERE stable GROUP BY cls),
inj AS (SELECT 1 + (s.i * {n_st} + j) * {wanted} + (s.site - 1) // greatest(1, CAST(ceil({d % SETUP.batch_share} * n / s.size) AS BIGINT) - 1) AS run, CAST(s.size AS BIGINT) AS size, strength, (s.site - 1) // greatest(1, CAST(ceil({d % SETUP.batch_share} * n / s.size) AS BIGINT) - 1) AS batch, s.cls, s.site,
  o.dr = 0 AND o.dc = 0 AS center, s.row + o.dr AS row, s.col + o.dc AS col FROM site s JOIN room USING (cls) JOIN disc o USING (size) CROSS JOIN st)"""
    if found:
        factor = lambda p: f"post_{p} * pow({d % 10}, coalesce(strength, 0) * {d % SETUP.base_db[p]} / 10) AS post_{p}"
        head += f""",
runs AS (SELECT 0 AS run UNION SELECT DISTINCT run FROM inj),
layers AS (SELECT r.run, l.px, l.row, l.col, l.cls, l.stable, pre_vv, pre_vh, {factor("vv")}, {factor("vh")}, i.run IS NOT NULL AS inside FROM runs r CROSS JOIN land l LEFT JOIN inj i ON i.run = r.run AND i.row = l.row AND i.col = l.col WHERE l.analysis),
means AS (SELECT *, d_vv + d_vh AS idx FROM (SELECT a.run, o.win, a.px, a.row, a.col, a.cls, a.stable, a.inside, 10 * log10(avg(b.post_vv)) - 10 * log10(avg(b.pre_vv)) AS d_vv, 10 * log10(avg(b.post_vh)) - 10 * log10(avg(b.pre_vh)) AS d_vh
  FROM layers a JOIN square o ON true JOIN layers b ON b.run = a.run AND b.row = a.row + o.dr AND b.col = a.col + o.dc GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)),
spilt AS (SELECT DISTINCT run, win, row + dr AS row, col + dc AS col FROM inj CROSS JOIN spill),
counted AS (SELECT m.run, m.win, m.cls, idx FROM means m LEFT JOIN spilt s ON s.run = m.run AND s.win = m.win AND s.row = m.row AND s.col = m.col WHERE m.stable AND s.run IS NULL),
med AS (SELECT run, win, cls, median(idx) AS med FROM counted GROUP BY ALL), mad AS (SELECT run, win, cls, med, median(abs(idx - med)) AS mad FROM counted JOIN med USING (run, win, cls) GROUP BY ALL),
score AS (SELECT m.run, m.win, px, row, col, inside, idx, d_vv, d_vh, (idx - med) / ({d % 1.4826} * mad) AS z FROM means m JOIN mad USING (run, win, cls) WHERE mad > 0),
high AS (SELECT run, win, k, px, row, col, inside FROM score, ks WHERE z >= k),
touch AS (SELECT a.run, a.win, a.k, a.px AS a, b.px AS b FROM high a JOIN high b ON a.run = b.run AND a.win = b.win AND a.k = b.k AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
walk AS (SELECT run, win, k, px AS a, px AS b FROM high UNION SELECT w.run, w.win, w.k, w.a, t.b FROM walk w JOIN touch t ON t.run = w.run AND t.win = w.win AND t.k = w.k AND t.a = w.b),
lab AS (SELECT h.*, l.label FROM high h JOIN (SELECT run, win, k, a, min(b) AS label FROM walk GROUP BY ALL) l ON l.run = h.run AND l.win = h.win AND l.k = h.k AND l.a = h.px QUALIFY count(*) OVER (PARTITION BY h.run, h.win, h.k, l.label) >= {SETUP.min_cells}),
det AS (SELECT i.run, i.size, i.strength, i.batch, w.win, ks.k, i.cls, i.site, avg(CAST(l.px IS NOT NULL AS INTEGER)) AS share, bool_or(i.center AND l.px IS NOT NULL) AS center_in FROM inj i CROSS JOIN (SELECT DISTINCT win FROM square) w CROSS JOIN ks
  LEFT JOIN lab l ON l.run = i.run AND l.win = w.win AND l.k = ks.k AND l.row = i.row AND l.col = i.col GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
rate AS (SELECT win, k, size, strength, count(*) AS n, count(*) FILTER (share >= {d % SETUP.hit_share} OR center_in) AS n_hit FROM det GROUP BY 1, 2, 3, 4),
wrong AS (SELECT run, win, k, count(*) AS n_false FROM (SELECT run, win, k, label FROM lab GROUP BY ALL HAVING NOT bool_or(inside)) GROUP BY 1, 2, 3),
alarm AS (SELECT a.run, a.win, ks.k, coalesce(n_false, 0) AS n_false, area_ha, coalesce(n_false, 0) * {d % 1000} / nullif(area_ha, 0) AS fa FROM (SELECT run, win, count(*) FILTER (NOT inside) * {d % SETUP.cell_ha} AS area_ha FROM score GROUP BY 1, 2) a CROSS JOIN ks LEFT JOIN wrong w ON w.run = a.run AND w.win = a.win AND w.k = ks.k),
tab AS (SELECT r.win, r.k, n, n_hit / n AS rate, b.fa AS base_fa, c.fa AS injected_fa FROM rate r JOIN alarm b ON b.run = 0 AND b.win = r.win AND b.k = r.k JOIN (SELECT win, k, avg(fa) AS fa FROM alarm WHERE run > 0 GROUP BY 1, 2) c ON c.win = r.win AND c.k = r.k WHERE r.size = 9 AND r.strength = 1)"""
    return head + "\n" + body.strip()


@query(_experiment_sql("""
SELECT i.run, i.size, strength, batch, i.cls, site, center, px, round(post_vv * pow(CAST(10 AS DOUBLE), strength * CAST(0.45 AS DOUBLE) / 10), 6) AS injected_vv, round(post_vh * pow(CAST(10 AS DOUBLE), strength * CAST(0.68 AS DOUBLE) / 10), 6) AS injected_vh
FROM inj i JOIN land l ON l.row = i.row AND l.col = i.col
""", found=False))
def synthetic_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the drawn sites, run by run, with both layers changed by the strength in decibels."""
    grid = land(spark, sf_dir)
    i = injection.footprints(grid, SETUP).join(grid.select("row", "col", "px", "post_vv", "post_vh"), ["row", "col"])
    changed = [F.round(F.col(f"post_{p}") * F.pow(F.lit(10.0), F.col("strength") * db / 10), 6).alias(f"injected_{p}") for p, db in SETUP.base_db.items()]
    return i.select("run", "size", "strength", "batch", "cls", "site", "center", "px", *changed)


@query(_experiment_sql("SELECT win, k, size, strength, n, n_hit, round(n_hit / n, 6) AS rate FROM rate"))
def injection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the injected sites that is found, per window, threshold, size and strength."""
    return injection.rates(injection.experiment(land(spark, sf_dir), SETUP), "win", "k", "size", "strength").withColumn("rate", F.round("rate", 6))


@query(_experiment_sql("""
SELECT run, win, k, n_false, round(area_ha, 6) AS area_ha, round(fa, 6) AS per_1000ha, fa <= 500 AND NOT coalesce(bool_or(fa <= 500) OVER (PARTITION BY run, win ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chosen FROM alarm
"""))
def false_alarm_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms per run, window and threshold; `chosen` is the smallest threshold within the limit."""
    a = injection.experiment(land(spark, sf_dir), SETUP).alarms
    least = F.min(F.when(F.col("per_1000ha") <= 500, F.col("k"))).over(W.partitionBy("run", "win"))
    return a.select("run", "win", "k", "n_false", F.round("area_ha", 6).alias("area_ha"), F.round("per_1000ha", 6).alias("per_1000ha"), F.coalesce(F.col("k") == least, F.lit(False)).alias("chosen"))


@query(_experiment_sql("SELECT win, k, n, round(rate, 6) AS rate, round(base_fa, 6) AS base_fa, round(injected_fa, 6) AS injected_fa FROM tab"))
def rate_alarm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of one size and strength with the false alarms of the data as they are and of the injected runs."""
    t = injection.merged(injection.experiment(land(spark, sf_dir), SETUP), 9, 1.0)
    return t.select("win", "k", "n", *[F.round(c, 6).alias(c) for c in ("rate", "base_fa", "injected_fa")])


@query(_experiment_sql("""
SELECT lim, win, k, round(rate, 6) AS rate, round(base_fa, 6) AS base_fa FROM tab, (SELECT unnest([CAST(100 AS DOUBLE), CAST(500 AS DOUBLE), CAST(20000 AS DOUBLE)]) AS lim) WHERE base_fa <= lim QUALIFY row_number() OVER (PARTITION BY lim ORDER BY rate DESC, base_fa, k, win) = 1
"""))
def injection_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The setting that finds most under each false-alarm limit."""
    t = injection.recommended(injection.merged(injection.experiment(land(spark, sf_dir), SETUP), 9, 1.0), (100.0, 500.0, 20000.0))
    return t.select("lim", "win", "k", F.round("rate", 6).alias("rate"), F.round("base_fa", 6).alias("base_fa"))


@query(_experiment_sql("""
SELECT label, count(*) AS n_cells, round(count(*) * CAST(0.01 AS DOUBLE), 6) AS area_ha, round(avg(z), 6) AS z, round(avg(idx), 6) AS idx, round(avg(d_vv), 6) AS d_vv, round(avg(d_vh), 6) AS d_vh
FROM lab JOIN score USING (run, win, px) WHERE run = 0 AND win = 3 AND k = 1.5 GROUP BY label
"""))
def candidate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of the data as they are at one window and threshold, with the means of their layers."""
    c = injection.candidates(land(spark, sf_dir), SETUP, 3, 1.5)
    return c.select("label", "n_cells", *[F.round(x, 6).alias(x) for x in ("area_ha", "z", "idx", "d_vv", "d_vh")])


@query("""
SELECT cls, px, CAST(floor((row_number() OVER (PARTITION BY cls ORDER BY px) - 1) / greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY cls)) - 1)) AS BIGINT) AS batch FROM cells
""", CELLS)
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites dealt into batches of at most a share of each class."""
    w = W.partitionBy("cls")
    c = cells(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("px")))
    return c.select("cls", "px", F.floor((F.col("r") - 1) / F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1) - 1)).alias("batch"))


@query("""
WITH m AS (SELECT avg(price) AS mu FROM cells), z AS (SELECT c.*, price - mu AS v FROM cells c, m), lags AS (SELECT a AS dr, b AS dc FROM range(0, 4) t(a), range(-3, 4) u(b) WHERE a > 0 OR b >= 0),
p AS (SELECT CAST(round(sqrt(CAST(dr * dr + dc * dc AS DOUBLE))) AS BIGINT) AS lag, x.v * y.v AS prod FROM z x JOIN lags ON true JOIN z y ON y.row = x.row + dr AND y.col = x.col + dc), q AS (SELECT lag, avg(prod) AS c, count(*) AS n FROM p WHERE lag <= 3 GROUP BY lag)
SELECT lag, n, round(c / (SELECT c FROM q WHERE lag = 0), 6) AS correlation FROM q
""", CELLS)
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotropic autocorrelation by rounded lag, as an offset join up to the largest lag."""
    c = cells(spark, sf_dir).select("row", "col", "price")
    z = c.crossJoin(F.broadcast(c.agg(F.avg("price").alias("mu")))).select("row", "col", (F.col("price") - F.col("mu")).alias("v"))
    lags = [(i, j) for i in range(4) for j in range(-3, 4) if i > 0 or j >= 0]
    moved = raster.kernel(z.select(F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("v").alias("v0"), "row", "col"), lags)
    lag = F.round(F.sqrt(((F.col("row") - F.col("r0")) * (F.col("row") - F.col("r0")) + (F.col("col") - F.col("c0")) * (F.col("col") - F.col("c0"))).cast("double"))).cast("long")
    q = moved.join(z, ["row", "col"]).groupBy(lag.alias("lag")).agg(F.avg(F.col("v") * F.col("v0")).alias("c"), F.count(F.lit(1)).alias("n")).where("lag <= 3")
    zero = q.where("lag = 0").select(F.col("c").alias("c0"))
    return q.crossJoin(F.broadcast(zero)).select("lag", "n", F.round(F.col("c") / F.col("c0"), 6).alias("correlation"))
