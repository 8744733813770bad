"""Raster-graph operators over tables of cells (px, row, col): kernels as equi joins, components as joins to a fixpoint."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from larchspan.operators.graph import components


def kernel(df: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ()) -> DataFrame:
    """Each row once per offset, moved by it: (keys, row, col) of the touched cell and the row's other columns.

    The offsets are a constant of the kernel's size, so this is a narrow explode and what follows is an equi join.
    """
    table = F.array(*[F.struct(F.lit(dr).cast("long").alias("dr"), F.lit(dc).cast("long").alias("dc")) for dr, dc in offsets])
    return df.withColumn("_o", F.explode(table)).withColumns({"row": F.col("row") + F.col("_o.dr"), "col": F.col("col") + F.col("_o.dc")}).drop("_o")


def disc(radius: float) -> list[tuple[int, int]]:
    """Offsets within a Euclidean radius."""
    r = int(math.floor(radius))
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if i * i + j * j <= radius * radius]


def cross(n: int) -> list[tuple[int, int]]:
    """Offsets within n steps of the 4-neighbourhood: n rounds of cross dilation at once."""
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if abs(i) + abs(j) <= n]


def disc_offsets(n: int) -> list[tuple[int, int]]:
    """The n cells closest to the centre; ties by row, then column, at 1e-6 steps."""
    r = int(math.ceil(math.sqrt(n / math.pi))) + 1
    cells = [(i * i + j * j + 1e-6 * (i * (2 * r + 1) + j), i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    return [(i, j) for _, i, j in sorted(cells)[:n]]


def dilate(marked: DataFrame, grid: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Cells of `grid` that a marked cell's kernel touches (outside the grid nothing is marked)."""
    touched = kernel(marked.select("row", "col"), offsets).distinct()
    return grid.join(touched, ["row", "col"], "left_semi")


def label8(cells: DataFrame, group: str | None = None) -> DataFrame:
    """`cells` (px, row, col) with `label`: the smallest px of its 8-connected component (within equal `group`)."""
    keys = ["row", "col"] + ([group] if group else [])
    base = cells.select("px", *keys)
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]
    moved = kernel(base.withColumnRenamed("px", "a"), half)
    edges = moved.join(base.withColumnRenamed("px", "b"), keys).select("a", "b")
    roots = components(edges)
    return cells.join(roots, cells["px"] == roots["node"], "left").withColumn("label", F.coalesce("root", "px")).drop("node", "root")


def with_minimum(labelled: DataFrame, least: int, *by: str) -> DataFrame:
    """Drops components with fewer than `least` cells."""
    w = W.partitionBy(*by, "label")
    return labelled.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_n")


def distance_to(grid: DataFrame, target: Column, most: float | None = None) -> DataFrame:
    """`grid` (px, row, col) with `distance` in cells to the nearest cell where `target` holds, and `nearest`, the
    smallest px among the closest; NULL beyond `most`, and everywhere if there is no target.

    Exact, in two passes of grouped Arrow functions: along each row, the nearest target of its row for every column of
    the grid (cells that a ragged grid lacks stand in for this pass); then down each column the best of the cells' own,
    those one row away, two rows away ... until that many rows are further than any cell's best.
    """
    columns = grid.columns
    bounds = grid.agg(F.min("col").alias("_c0"), F.max("col").alias("_c1"))  # one row

    def along(table: pa.Table) -> pa.Table:
        col, hit = table.column("col").to_numpy().astype(np.int64), table.column("_hit").to_numpy(zero_copy_only=False)
        c0, c1 = table.column("_c0")[0].as_py(), table.column("_c1")[0].as_py()
        out = table.select(columns)
        if not hit.any():
            return out.append_column("_d", pa.nulls(len(col), pa.int64())).append_column("_px", pa.nulls(len(col), pa.int64())).append_column("_real", pa.array(np.ones(len(col), bool)))
        lacking = np.setdiff1d(np.arange(c0, c1 + 1), col)
        if len(lacking):
            fill = {c: pa.nulls(len(lacking), out.schema.field(c).type) for c in columns}
            fill |= {"row": pa.array(np.full(len(lacking), table.column("row")[0].as_py()), out.schema.field("row").type), "col": pa.array(lacking, out.schema.field("col").type)}
            out = pa.concat_tables([out, pa.table(fill, out.schema)])
        every = np.concatenate([col, lacking])
        order = np.lexsort((table.column("px").to_numpy()[hit], col[hit]))
        tc, tp = col[hit][order], table.column("px").to_numpy()[hit][order]
        right = np.minimum(np.searchsorted(tc, every), len(tc) - 1)
        left = np.maximum(np.searchsorted(tc, every, "right") - 1, 0)
        d_left, d_right = np.abs(every - tc[left]), np.abs(every - tc[right])
        use = (d_left < d_right) | ((d_left == d_right) & (tp[left] < tp[right]))
        out = out.append_column("_d", pa.array(np.where(use, d_left, d_right))).append_column("_px", pa.array(np.where(use, tp[left], tp[right]).astype(np.int64)))
        return out.append_column("_real", pa.array(np.arange(len(every)) < len(col)))

    def down(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        row = table.column("row").to_numpy().astype(np.int64)
        h = int(row[-1] - row[0]) + 1
        at, none = row - row[0], np.iinfo(np.int64).max
        d2, px = np.full(h, none), np.full(h, none)  # of the row pass, by row; a row without a cell holds nothing
        d = table.column("_d").fill_null(-1).to_numpy().astype(np.int64)
        has = d >= 0
        d2[at[has]], px[at[has]] = d[has] ** 2, table.column("_px").fill_null(-1).to_numpy()[has]
        best, who = d2.copy(), px.copy()
        for k in range(1, h):
            if k * k > best[at].max():
                break
            for to, of in ((slice(k, None), slice(None, -k)), (slice(None, -k), slice(k, None))):
                new = np.where(d2[of] < none, d2[of] + k * k, none)
                better = (new < best[to]) | ((new == best[to]) & (px[of] < who[to]))
                best[to][better], who[to][better] = new[better], px[of][better]
        gone = best[at] == none if most is None else best[at] > most * most
        out = table.select(columns).append_column("distance", pa.array(np.sqrt(best[at].astype(np.float64)), mask=gone))
        return out.append_column("nearest", pa.array(who[at], mask=gone)).filter(table.column("_real"))

    schema = StructType([StructField(f.name, f.dataType) for f in grid.schema]).add("distance", "double").add("nearest", "long")
    marked = grid.withColumn("_hit", F.coalesce(target, F.lit(False))).crossJoin(F.broadcast(bounds))
    passed = StructType([StructField(f.name, f.dataType) for f in grid.schema]).add("_d", "long").add("_px", "long").add("_real", "boolean")
    return marked.groupBy("row").applyInArrow(along, passed).groupBy("col").applyInArrow(down, schema)


def box_means(df: DataFrame, values: list[str], radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `<value>_box` for each value: mean over the (2r+1) square of cells with a value, by two passes of range
    windows for all values at once.

    The second pass goes down a column, so a place that the grid lacks, next to cells of its row, has to carry their
    sums: such places (at the ends of rows and in gaps) are added before the first pass and removed after the second.
    """
    if not radius:
        return df.withColumns({f"{v}_box": F.col(v) for v in values})
    order, col = W.partitionBy(*keys, "row").orderBy("col"), F.col("col")
    df = df.withColumns({"_before": F.lag("col").over(order), "_after": F.lead("col").over(order)})
    last = F.least(col + radius, F.coalesce(F.col("_after") - 1, col + radius))
    first = F.greatest(col - radius, F.coalesce(F.col("_before") + radius + 1, col - radius))
    places = F.array(F.array(col), F.when(last > col, F.sequence(col + 1, last)), F.when(first < col, F.sequence(first, col - 1)))
    df = df.withColumn("_at", F.explode(F.flatten(F.array_compact(places)))).withColumn("_own", F.col("_at") == col)
    df = df.withColumns({"col": F.col("_at"), **{f"_v_{v}": F.when(F.col("_own"), F.col(v)) for v in values}})
    along, across = order.rangeBetween(-radius, radius), W.partitionBy(*keys, "col").orderBy("row").rangeBetween(-radius, radius)
    df = df.withColumns({k: x for v in values for k, x in ((f"_s_{v}", F.sum(f"_v_{v}").over(along)), (f"_n_{v}", F.count(f"_v_{v}").over(along)))})
    df = df.withColumns({k: x for v in values for k, x in ((f"_ss_{v}", F.sum(f"_s_{v}").over(across)), (f"_nn_{v}", F.sum(f"_n_{v}").over(across)))}).where("_own")
    df = df.withColumns({f"{v}_box": F.when(F.col(v).isNotNull() & (F.col(f"_nn_{v}") > 0), F.col(f"_ss_{v}") / F.col(f"_nn_{v}")) for v in values})
    return df.drop("_before", "_after", "_at", "_own", *[f"_{x}_{v}" for v in values for x in ("v", "s", "n", "ss", "nn")])


def box_mean(df: DataFrame, value: str, radius: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """`df` with `<value>_box`: see `box_means`."""
    return box_means(df, [value], radius, keys)


def disc_mean(df: DataFrame, value: str, n: int, least_share: float = 0.7) -> DataFrame:
    """px, `<value>_disc`, `n_valid`: mean over the n-cell disc around every cell; NULL if too few cells have a value."""
    spread = kernel(df.select("row", "col", value), [(-i, -j) for i, j in disc_offsets(n)])
    got = spread.groupBy("row", "col").agg(F.avg(value).alias("_m"), F.count(value).alias("n_valid"))
    return df.join(got, ["row", "col"]).select("px", "row", "col", F.when(F.col("n_valid") >= least_share * n, F.col("_m")).alias(f"{value}_disc"), "n_valid")


def all_true(df: DataFrame, flag: Column, size: int = 4) -> DataFrame:
    """`df` with `block`: the size x size window around the cell (even sizes reach one further up and left) is all set."""
    low, high = -(size // 2), size - size // 2 - 1
    along = W.partitionBy("row").orderBy("col").rangeBetween(low, high)
    across = W.partitionBy("col").orderBy("row").rangeBetween(low, high)
    df = df.withColumn("_f", flag.cast("int")).withColumn("_a", F.sum("_f").over(along))
    return df.withColumn("block", F.sum("_a").over(across) == size * size).drop("_f", "_a")


def boundary_edges(labelled: DataFrame) -> DataFrame:
    """label, n_cells, n_edges: cell edges without a 4-neighbour of the same label, for outlines and shape indices."""
    moved = kernel(labelled.select("row", "col", "label"), [(0, 1), (1, 0), (0, -1), (-1, 0)])
    shared = moved.join(labelled.select("row", "col", "label"), ["row", "col", "label"]).groupBy("label").agg(F.count(F.lit(1)).alias("inner"))
    n = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"))
    return n.join(shared, "label", "left").select("label", "n_cells", (4 * F.col("n_cells") - F.coalesce("inner", F.lit(0))).alias("n_edges"))
