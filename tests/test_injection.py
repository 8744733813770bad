"""Box means on grids with holes, and the injection experiment against numpy on a small grid."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchspan.operators import injection, raster

GRID = "px long, row long, col long, cls long, analysis boolean, stable boolean, pre_vv double, post_vv double, pre_vh double, post_vh double"


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_box_mean_with_holes(spark, radius):
    r = np.random.default_rng(radius)
    cells = [(int(i * 12 + j), int(i), int(j), float(r.integers(1, 99)) if r.random() < 0.9 else None) for i in range(9) for j in range(12) if r.random() < 0.6]
    df = spark.createDataFrame(cells, "px long, row long, col long, v double")
    got = {x.px: x.v_box for x in raster.box_mean(df, "v", radius).collect()}
    assert set(got) == {c[0] for c in cells}
    for px, i, j, v in cells:
        near = [w for _, a, b, w in cells if abs(a - i) <= radius and abs(b - j) <= radius and w is not None]
        assert got[px] is None if v is None else got[px] == pytest.approx(np.mean(near))


def landscape(spark, n=24, alternating=True):
    r = np.random.default_rng(5)
    rows = [(i * n + j, i, j, 1 + (j >= n // 2), True, True, 100.0, 100.0 * float(r.uniform(0.98, 1.02)) if alternating else 100.0, 50.0, 50.0 * float(r.uniform(0.98, 1.02)) if alternating else 50.0) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, GRID), rows


SETUP = injection.Setup(sizes=(5,), strengths=(1.0,), windows=(1, 3), ks=(3.0,), wanted=3, purity=0.9, gap=2, batch_share=0.05, min_cells=2)


def test_sites_are_pure_apart_and_within_batches(spark):
    grid, _ = landscape(spark)
    sites = injection.sites(grid, 5, SETUP).collect()
    assert 0 < len(sites) and all(s.site <= 3 for s in sites)
    far = injection.reach(5, 2)
    for a in sites:
        for i, j in raster.disc_offsets(5):
            assert 0 <= a.row + i < 24 and 0 <= a.col + j < 24 and 1 + (a.col + j >= 12) == a.cls
        assert all(a is b or abs(a.row - b.row) > far or abs(a.col - b.col) > far for b in sites)
    placed = injection.footprints(grid, SETUP)
    assert placed.count() == 5 * len(sites) and placed.where("center").count() == len(sites)
    assert all(r["count"] < max(0.05 * 288, 6) for r in placed.groupBy("run", "cls").count().collect())


def test_scores_equal_numpy(spark):
    grid, rows = landscape(spark)
    placed = injection.footprints(grid, SETUP)
    marks = {(r.run, r.row, r.col) for r in placed.collect()}
    got = {(r.run, r.win, r.px): r.z for r in injection.scores(grid, placed, SETUP).collect()}
    runs = {0} | {m[0] for m in marks}
    assert len(got) == len(runs) * 2 * len(rows)
    for run in runs:
        for win in (1, 3):
            layer = {}
            for k, at in (("pre_vv", 6), ("post_vv", 7), ("pre_vh", 8), ("post_vh", 9)):
                gain = 10 ** ({"post_vv": 0.45, "post_vh": 0.68}.get(k, 0) / 10)
                layer[k] = {(r[1], r[2]): r[at] * (gain if (run, r[1], r[2]) in marks else 1) for r in rows}
            h = win // 2
            mean = lambda k, i, j: np.mean([layer[k][a, b] for a in range(i - h, i + h + 1) for b in range(j - h, j + h + 1) if (a, b) in layer[k]])  # noqa: B023, E731
            idx = {(r[1], r[2]): sum(10 * np.log10(mean(f"post_{p}", r[1], r[2]) / mean(f"pre_{p}", r[1], r[2])) for p in ("vv", "vh")) for r in rows}
            for cls in (1, 2):
                own = [r for r in rows if r[3] == cls]
                base = [idx[r[1], r[2]] for r in own if not any((run, r[1] + a, r[2] + b) in marks for a, b in raster.cross(h))]
                med = np.median(base)
                mad = np.median(np.abs(np.array(base) - med))
                for r in own:
                    assert got[run, win, r[0]] == pytest.approx((idx[r[1], r[2]] - med) / (1.4826 * mad), abs=1e-9)


def test_strong_changes_are_found_and_nothing_else(spark):
    grid, rows = landscape(spark)
    o = injection.experiment(grid, injection.Setup(sizes=(5,), strengths=(0.0, 3.0), windows=(1,), ks=(8.0,), wanted=3, gap=2, batch_share=0.05, min_cells=3))
    got = {r.strength: (r.n, r.n_hit) for r in injection.rates(o, "strength").collect()}
    assert got[0.0][1] == 0 and got[3.0][0] == got[3.0][1] > 0
    assert o.alarms.agg(F.sum("n_false")).first()[0] == 0
    areas = {r.run: r.area_ha for r in o.alarms.collect()}
    assert areas[0] == pytest.approx(0.01 * len(rows)) and all(a < areas[0] for k, a in areas.items() if k)


def test_no_spread_and_no_cells(spark):
    flat, _ = landscape(spark, 12, alternating=False)
    o = injection.experiment(flat, SETUP)
    assert not o.detections.where("hit").count() and not o.alarms.count()
    o = injection.experiment(flat.where("px < 0"), SETUP)
    assert [x.count() for x in (o.sites, o.detections, o.alarms)] == [0, 0, 0]
