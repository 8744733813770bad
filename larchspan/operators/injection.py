"""Injection experiment: known changes put into real before/after layers, and what the detection makes of them.

Sites are discs that lie in stable cells, mostly of one class, and keep apart.  A site is drawn where its hash is the
least among all possible centres in reach, so all are drawn at once and no centre waits for another.  Sizes, strengths,
batches, windows and thresholds are key columns: the whole experiment is one plan, whose rows are those of the grid
times the parameters.  Run 0 has no sites and gives the false alarms of the data as they are.

A grid has px, row, col, cls, analysis and stable (booleans), and `pre_<layer>`, `post_<layer>`, positive linear values.
Defined cases: a class without room for a site has none; a class whose stable cells have no spread has no z, hence no
detections and no area; an empty grid gives no rows.
"""

from __future__ import annotations

import dataclasses
import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larchspan.operators import raster, sampling
from larchspan.session import checkpointed


@dataclass(frozen=True)
class Setup:
    """Sizes in cells, strengths as multiples of `base_db`, smoothing windows (odd), thresholds, and bounds."""

    sizes: tuple[int, ...]
    strengths: tuple[float, ...] = (0.5, 1.0, 2.0)
    windows: tuple[int, ...] = (1, 3, 5, 7)
    ks: tuple[float, ...] = (2.5, 3.0, 3.5, 4.0)
    base_db: dict[str, float] = field(default_factory=lambda: {"vv": 0.45, "vh": 0.68})
    wanted: int = 30
    purity: float = 0.9
    gap: int = 5
    batch_share: float = 0.02
    min_cells: int = 1
    cell_ha: float = 0.01
    hit_share: float = 0.5
    seed: str = "inject"


@dataclass(frozen=True)
class Outcome:
    """`sites`: one row per footprint cell and run; `detections`: per site, window and k; `alarms`: per run, window and k."""

    sites: DataFrame
    detections: DataFrame
    alarms: DataFrame


def reach(size: int, gap: int) -> int:
    """Rows or columns between centres below which the discs would come closer than `gap`."""
    return 2 * max(max(abs(i), abs(j)) for i, j in raster.disc_offsets(size)) + gap


def sites(grid: DataFrame, size: int, setup: Setup) -> DataFrame:
    """size, cls, site (1 to `wanted` of its class), row, col of the centres."""
    stable = grid.where("stable")
    moved = raster.kernel(stable.select("px", "cls", F.col("row").alias("r0"), F.col("col").alias("c0"), "row", "col"), raster.disc_offsets(size))
    met = moved.join(stable.select("row", "col", F.col("cls").alias("there")), ["row", "col"]).groupBy("px", "cls", F.col("r0").alias("row"), F.col("c0").alias("col"))
    whole = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there") == F.col("cls")).alias("same")).where((F.col("n") == size) & (F.col("same") >= F.lit(setup.purity) * F.col("n")))
    rank = F.struct(sampling.draw(1 << 31, setup.seed, F.lit(size), F.col("px")).alias("draw"), "px")
    whole = checkpointed(whole.select("px", "cls", "row", "col", rank.alias("rank")))
    far = reach(size, setup.gap)
    square = [(i, j) for i in range(-far, far + 1) for j in range(-far, far + 1)]
    first = raster.kernel(whole.select("rank", "row", "col"), square).groupBy("row", "col").agg(F.min("rank").alias("first"))
    apart = whole.join(first, ["row", "col"]).where(F.col("first") == F.col("rank"))
    place = F.row_number().over(W.partitionBy("cls").orderBy("rank"))
    return apart.withColumn("site", place).where(F.col("site") <= setup.wanted).select(F.lit(size).cast("long").alias("size"), "cls", F.col("site").cast("long").alias("site"), "row", "col")


def footprints(grid: DataFrame, setup: Setup) -> DataFrame:
    """run, size, strength, batch, cls, site, center, row, col: the cells of every site in every run that has it.

    A batch holds less than `batch_share` of a class's stable cells (one site at least); its number is bounded by
    `wanted`, so runs number at most sizes x strengths x `wanted`.
    """
    stable = grid.where("stable").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for i, size in enumerate(setup.sizes):
        room = F.greatest(F.lit(1), F.ceil(F.lit(setup.batch_share) * F.col("n") / size) - 1)
        s = sites(grid, size, setup).join(stable, "cls").withColumn("batch", F.floor((F.col("site") - 1) / room)).drop("n")
        cells = raster.kernel(s.withColumns({"r0": F.col("row"), "c0": F.col("col")}), raster.disc_offsets(size))
        cells = cells.withColumn("center", (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))).drop("r0", "c0")
        strengths = F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.lit(float(x)).alias("strength")) for j, x in enumerate(setup.strengths)])
        cells = cells.withColumn("s", F.explode(strengths))
        run = 1 + (i * len(setup.strengths) + F.col("s.j")) * setup.wanted + F.col("batch")
        cells = cells.select(run.alias("run"), "size", "s.strength", "batch", "cls", "site", "center", "row", "col")
        out = cells if out is None else out.unionByName(cells)
    return checkpointed(out)


def _db(x: Column) -> Column:
    return F.lit(10.0) * F.log10(x)


def scores(grid: DataFrame, placed: DataFrame, setup: Setup) -> DataFrame:
    """run, win, px, row, col, site (whether injected), idx, d_<layer>, z of the analysed cells: class-wise robust z, whose statistics
    leave out injected cells and those that smoothing carries them to."""
    layers, marked = list(setup.base_db), placed.select("run", "row", "col", "strength")
    # the runs are bounded by the parameters, whatever the grid
    runs = [0, *sorted(r["run"] for r in placed.select("run").distinct().collect())]
    masked = grid.select("px", "row", "col", "cls", "analysis", "stable", *[F.when(F.col("analysis"), F.col(f"{when}_{p}")).alias(f"{when}_{p}") for p in layers for when in ("pre", "post")])
    every = masked.withColumn("run", F.explode(F.array(*[F.lit(r).cast("long") for r in runs]))).join(marked, ["run", "row", "col"], "left")
    every = every.withColumns({f"post_{p}": F.col(f"post_{p}") * F.pow(F.lit(10.0), F.coalesce("strength", F.lit(0.0)) * db / 10) for p, db in setup.base_db.items()})
    out = None
    for win in setup.windows:
        radius = (win - 1) // 2
        spill = raster.kernel(marked.select("run", "row", "col"), raster.cross(radius)).distinct().withColumn("spilt", F.lit(True))
        df = raster.box_means(every.join(spill, ["run", "row", "col"], "left"), [f"{when}_{p}" for p in layers for when in ("pre", "post")], radius, ("run",))
        change = {f"d_{p}": _db(F.col(f"post_{p}_box")) - _db(F.col(f"pre_{p}_box")) for p in layers}
        df = df.where("analysis").select("run", F.lit(win).cast("long").alias("win"), "px", "row", "col", "cls", F.col("strength").isNotNull().alias("site"), (F.col("stable") & F.col("spilt").isNull()).alias("counts"), *[v.alias(c) for c, v in change.items()])
        df = df.withColumn("idx", functools.reduce(operator.add, [F.col(c) for c in change]))
        out = df if out is None else out.unionByName(df)
    df = checkpointed(out.where("idx is not null"))
    keys = ["run", "win", "cls"]
    center = df.where("counts").groupBy(*keys).agg(F.median("idx").alias("med"))
    spread = df.where("counts").join(center, keys).groupBy(*keys, "med").agg(F.median(F.abs(F.col("idx") - F.col("med"))).alias("mad"))
    z = (F.col("idx") - F.col("med")) / (F.lit(1.4826) * F.col("mad"))
    return df.join(spread.where("mad > 0"), keys).select("run", "win", "px", "row", "col", "site", "idx", *[f"d_{p}" for p in layers], z.alias("z"))


def experiment(grid: DataFrame, setup: Setup) -> Outcome:
    placed = footprints(grid, setup)
    z = checkpointed(scores(grid, placed, setup))
    ks = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(float(k)).alias("k")) for i, k in enumerate(setup.ks)]))
    top = (grid.agg(F.max("px")).first()[0] or 0) + 1
    high = z.withColumn("s", ks).where(F.col("z") >= F.col("s.k"))
    field_no = (F.col("run") * (max(setup.windows) + 1) + F.col("win")) * len(setup.ks) + F.col("s.i")
    high = high.select("run", "win", "s.k", "row", "col", "site", field_no.alias("field"), (field_no * top + F.col("px")).alias("px"))
    found = checkpointed(raster.with_minimum(raster.label8(high, "field"), setup.min_cells))

    each = placed.withColumn("win", F.explode(F.array(*[F.lit(w).cast("long") for w in setup.windows]))).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in setup.ks])))
    each = each.join(found.select("run", "win", "k", "row", "col", F.lit(True).alias("in")), ["run", "win", "k", "row", "col"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    det = each.groupBy("run", "size", "strength", "batch", "win", "k", "cls", "site").agg(F.avg(F.col("in").cast("double")).alias("detected_share"), F.bool_or(F.col("in") & F.col("center")).alias("center_in"))
    det = det.withColumn("hit", (F.col("detected_share") >= setup.hit_share) | F.col("center_in"))

    wrong = found.groupBy("run", "win", "k", "label").agg(F.bool_or("site").alias("hit")).where("not hit").groupBy("run", "win", "k").agg(F.count(F.lit(1)).alias("n_false"))
    area = z.groupBy("run", "win").agg((F.count_if(~F.col("site")) * setup.cell_ha).alias("area_ha")).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in setup.ks])))
    alarms = area.join(wrong, ["run", "win", "k"], "left").withColumn("n_false", F.coalesce("n_false", F.lit(0).cast("long")))
    return Outcome(placed, det, alarms.withColumn("per_1000ha", F.try_divide(F.col("n_false") * 1000.0, F.col("area_ha"))))


def candidates(grid: DataFrame, setup: Setup, win: int, k: float) -> DataFrame:
    """label, n_cells, area_ha, and the means of z, idx and d_<layer>: the objects of the data as they are at one window
    and threshold, without those under `min_cells`."""
    none = grid.sparkSession.createDataFrame([], "run long, row long, col long, strength double")
    high = scores(grid, none, dataclasses.replace(setup, windows=(win,))).where(F.col("z") >= k)
    found = raster.with_minimum(raster.label8(checkpointed(high)), setup.min_cells)
    means = [F.avg(c).alias(c) for c in ("z", "idx", *(f"d_{p}" for p in setup.base_db))]
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"), *means).withColumn("area_ha", F.col("n_cells") * setup.cell_ha)


def rates(o: Outcome, *by: str) -> DataFrame:
    """n, n_hit and rate of the sites by `by`."""
    return o.detections.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit")).withColumn("rate", F.col("n_hit") / F.col("n"))


def merged(o: Outcome, size: int, strength: float) -> DataFrame:
    """win, k, n, rate of one size and strength, with the false alarms of run 0 and the mean of those of the other runs."""
    r = rates(o, "win", "k", "size", "strength").where((F.col("size") == size) & (F.col("strength") == strength)).select("win", "k", "n", "rate")
    base = o.alarms.where("run = 0").select("win", "k", F.col("per_1000ha").alias("base_fa"))
    runs = o.alarms.where("run > 0").groupBy("win", "k").agg(F.avg("per_1000ha").alias("injected_fa"))
    return r.join(base, ["win", "k"]).join(runs, ["win", "k"])


def recommended(table: DataFrame, limits: tuple[float, ...]) -> DataFrame:
    """lim, win, k, rate, base_fa: of the settings within each limit that with the highest rate, then fewest alarms,
    then the smallest k and window; no row where none is within it."""
    t = table.withColumn("lim", F.explode(F.array(*[F.lit(float(x)) for x in limits]))).where("base_fa <= lim")
    return t.groupBy("lim").agg(F.min(F.struct((-F.col("rate")).alias("r"), "base_fa", "k", "win", "rate")).alias("m")).select("lim", "m.win", "m.k", "m.rate", "m.base_fa")
