"""Cases of the second round's findings."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchspan import plans
from larchspan.functions import stats
from larchspan.operators import geometry
from tests.comparing import duck, same


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cell_sums_are_rounded_as_in_sql(spark, sf):
    """Sums that end in a 5 behind the last digit kept; at sf0.1 some differ by the order of addition."""
    sf_dir = f"/root/testdata/{sf}"
    same(plans.QUERIES["grid_cell_counts"](spark, sf_dir), duck(sf_dir), plans.ORACLE["grid_cell_counts"])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_densest_cells_are_rounded_as_in_sql(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    same(plans.QUERIES["densest_cells"](spark, sf_dir), duck(sf_dir), plans.ORACLE["densest_cells"])


def test_sums_in_order_leave_nulls_out(spark):
    d = spark.createDataFrame([(1, 3, 1e16), (1, 1, 1.0), (1, 2, -1e16), (1, None, None), (2, 1, None)], "g int, o int, v double").repartition(4)
    got = {r.g: r.s for r in d.groupBy("g").agg(stats.sum_in_order(F.col("v"), F.col("o")).alias("s")).collect()}
    assert got == {1: ((0.0 + 1.0) - 1e16) + 1e16, 2: None}


def by_definition(xy, priority, ids, most, gap):
    left, out = list(range(len(xy))), []
    while left:
        chosen = [left.pop(0)]
        while True:
            ring = geometry.hull(xy[chosen])
            ways = [((priority[i], d, ids[i]), i) for i in left if (d := geometry._distance(xy[i], ring)) <= gap and geometry.area(geometry.hull(xy[[*chosen, i]])) <= most]
            if not ways:
                break
            chosen.append(min(ways)[1])
            left.remove(chosen[-1])
        out.append(chosen)
    return out


@pytest.mark.parametrize("step", [0.001, 50.0])
def test_missions_as_defined(step):
    """Points at random and on a grid of 50 m, where points repeat, lie in line and hulls have just the largest area."""
    r = np.random.default_rng(3)
    for n, most, gap in ((1, 10.0, 10.0), (40, 30e4, 500.0), (60, 5e4, 200.0), (60, 2500.0, 120.0)):
        xy = np.round(r.uniform(0, 1, (n, 2)) * (2000, 500) / step) * step
        priority, ids = r.integers(1, 5, n), r.permutation(n)
        assert geometry.grouped(xy, priority, ids, most, gap) == by_definition(xy, priority, ids, most, gap)


def test_missions_of_many_targets(spark):
    """Time grows with a target's neighbours, not with all triples of an area's targets."""
    n = 4000
    d = spark.range(n).selectExpr("id % 4 aoi", "id", "cast(id % 3 as int) priority", "cast(id % 7 as double) value", "cast(id * 7919 % 5000 as double) x", "cast(id * 104729 % 500 as double) y")
    began = time.monotonic()
    got = geometry.missions(d).collect()
    assert len({r.id for r in got}) == len(got) == n and time.monotonic() - began < 40
