"""Planted events, invariants and reference values of the series operators."""

from __future__ import annotations

import datetime
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larchspan.functions import climate as cl
from larchspan.functions import indices as ix
from larchspan.operators import geometry, harmonic, phenology, raster, series, spatial


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def runs_by_hand(flags, days, n, min_days):
    first = longest = 0
    hit, start, length = None, None, 0
    for i, f in enumerate(flags):
        if f:
            start = i if length == 0 else start
            length += 1
            longest = max(longest, length)
            if hit is None and length >= n and days[i] - days[start] >= min_days:
                hit = start
        else:
            length = 0
    pending = hit is None and length >= n
    return hit is not None, hit if hit is not None else (start if pending else None), longest, pending


def test_persistent_runs_equal_a_scan(spark):
    r = random.Random(3)
    rows, want = [], {}
    for px in range(300):
        days = sorted(r.sample(range(1, 360), r.randint(1, 14)))
        flags = [r.random() < 0.5 for _ in days]
        want[px] = runs_by_hand(flags, days, 2, 20)
        rows += [(px, dt.datetime(2001, 1, 1) + dt.timedelta(days=d - 1), d, f) for d, f in zip(days, flags)]
    df = frame(spark, rows, "px long, ts timestamp, doy long, a boolean")
    got = {x.px: x for x in series.persistent_runs(df, F.col("a"), ["px"], 2, 20).collect()}
    for px, (hit, first, longest, pending) in want.items():
        days = sorted(x[2] for x in rows if x[0] == px)
        assert (got[px].hit, got[px].longest, got[px].pending) == (hit, longest, pending)
        assert got[px].first == (None if first is None else dt.datetime(2001, 1, 1) + dt.timedelta(days=days[first] - 1))


def cube(spark, event):
    """A healthy series every 8 days over four seasons with an event in the last."""
    r = np.random.default_rng(1)
    rows = []
    for year in (1998, 1999, 2000, 2001):
        for k in range(18):
            ts = dt.datetime(year, 5, 5) + dt.timedelta(days=8 * k)
            v = {"ndvi": 0.85, "ndre": 0.45, "ndmi": 0.35, "crswir": 0.55}
            v = {n: x + r.normal(0, 0.01) for n, x in v.items()}
            if year == 2001:
                v = event(k, v)
            rows.append((1, ts, year, ts.timetuple().tm_yday, *[float(v[n]) for n in ("ndvi", "ndre", "ndmi", "crswir")]))
    return frame(spark, rows, "px long, ts timestamp, year long, doy long, ndvi double, ndre double, ndmi double, crswir double")


def detect(df):
    names = ["ndvi", "ndre", "ndmi", "crswir"]
    d = series.doy_window_baseline(df, names, F.col("year") < 2001)
    d = d.withColumns({f"z_{n}": series.z_score(F.col(n), F.col(f"{n}_med"), F.col(f"{n}_mad"), ix.sign(n), 0.02) for n in names})
    ok, agree, odd = series.vote(F.col("z_crswir"), [F.col("z_ndvi"), F.col("z_ndre"), F.col("z_ndmi")], 2.5, 1)
    return series.persistent_runs(d.withColumn("odd", odd).where(ok & (F.col("year") == 2001)), F.col("odd"), ["px"]).first()


def stressed(v):
    return v | {"crswir": v["crswir"] + 0.2, "ndmi": v["ndmi"] - 0.2}


def test_planted_stress_is_found_and_noise_is_not(spark):
    assert detect(cube(spark, lambda k, v: v)).hit is False
    hit = detect(cube(spark, lambda k, v: stressed(v) if k >= 9 else v))
    assert hit.hit and hit.first == dt.datetime(2001, 5, 5) + dt.timedelta(days=72)
    assert detect(cube(spark, lambda k, v: stressed(v) if k == 9 else v)).hit is False  # a single outlier
    late = detect(cube(spark, lambda k, v: stressed(v) if k == 17 or k == 16 else v))
    assert late.hit and not late.pending


def test_vote_needs_a_confirming_index(spark):
    only = detect(cube(spark, lambda k, v: v | {"crswir": v["crswir"] + 0.2} if k >= 9 else v))
    assert only.hit is False


def test_transient_haze(spark):
    rows = []
    for px in range(3):
        for year in (1998, 1999, 2000, 2001):
            for k in range(12):
                ts = dt.datetime(year, 5, 5) + dt.timedelta(days=10 * k)
                b = 0.02 + 0.0001 * k + (0.05 if px == 1 and year == 2001 and k == 7 else 0) + (0.04 if px == 2 and year == 2001 and k >= 5 else 0)
                rows.append((px, ts, year, ts.timetuple().tm_yday, b, True))
    df = frame(spark, rows, "px long, ts timestamp, year long, doy long, b02 double, valid boolean")
    got = series.transient_haze(df, F.col("year") < 2001).where("hazy").select("px", "ts").collect()
    assert [(x.px, x.ts) for x in got] == [(1, dt.datetime(2001, 5, 5) + dt.timedelta(days=70))]


def test_harmonic_equals_numpy(spark):
    r = np.random.default_rng(5)
    doy = np.sort(r.integers(1, 366, 80))
    x = 0.5 + 0.2 * np.cos(2 * np.pi * doy / 365.25) - 0.1 * np.sin(2 * np.pi * doy / 365.25) + r.normal(0, 0.02, 80)
    df = frame(spark, [(1, int(d), float(v)) for d, v in zip(doy, x)], "px long, doy long, v double")
    got = [row.expected for row in harmonic.fit(df, "v", F.lit(True), 1).orderBy("doy", "v").collect()]
    a = np.stack([np.ones(80), np.cos(2 * np.pi * doy / 365.25), np.sin(2 * np.pi * doy / 365.25)], 1)
    beta = np.linalg.lstsq(a, x, rcond=None)[0]
    order = np.lexsort((x, doy))
    assert np.allclose(got, (a @ beta)[order], atol=1e-6)


def test_harmonic_resists_outliers(spark):
    doy = list(range(1, 360, 6))
    rows = [(1, d, 0.5 + (1.0 if d % 7 == 0 else 0.0)) for d in doy]
    got = harmonic.fit(frame(spark, rows, "px long, doy long, v double"), "v", F.lit(True), 5).agg(F.median("expected")).first()[0]
    assert abs(got - 0.5) < 0.05


def test_unknown_index_lists_the_known(spark):
    with pytest.raises(KeyError, match="ndvi"):
        ix.with_indices(spark.range(1), ["nope"])


def test_fao_examples(spark):
    one = spark.range(1)
    v = one.select(cl.extraterrestrial(F.lit(246.0), F.radians(F.lit(-20.0))).alias("ra"), cl.daylight_hours(F.lit(246.0), F.radians(F.lit(-20.0))).alias("n"), cl.saturation(F.lit(24.5)).alias("es"), cl.slope(F.lit(24.5)).alias("s"), cl.pressure(F.lit(1800.0)).alias("p"), cl.wind_at_2m(F.lit(3.2)).alias("u")).first()
    assert abs(v.ra - 32.2) < 0.1 and abs(v.n - 11.7) < 0.05 and abs(v.es - 3.075) < 0.01 and abs(v.s - 0.1838) < 0.001 and abs(v.p - 81.8) < 0.1 and abs(v.u - 2.4) < 0.05


def test_effective_bark_temperature(spark):
    """Edges of the branches, and values inside the decline worked out by hand."""
    want = {8.0: 0, 8.3: 0, 20.0: 11.7, 30.4: 22.1, 30.4 + 1e-9: 21.68, 33.0: 21.77, 35.0: 19.42, 37.0: 12.88, 38.9 - 1e-6: 0.014, 38.9: 0, 45.0: 0, -5.0: 0}
    t = frame(spark, [(float(k),) for k in want] + [(None,)], "t double")
    got = [x[0] for x in t.select(cl.effective_bark(F.col("t"))).collect()]
    assert got[-1] is None and all(abs(g - w) < 0.06 for g, w in zip(got, want.values(), strict=False))
    v = spark.range(1).select(cl.bark(F.lit(20.0), "mean"), cl.forest_air(F.lit(20.0), "max")).first()
    assert abs(v[0] - (-0.48 + 1.03 * 20)) < 1e-9 and abs(v[1] - (1.03 + 0.86 * 20)) < 1e-9


def weather_year(spark, tmax, tmin, tmean, hours=15.0, first="2023-01-01", last="2023-10-31", without=()):
    days = [datetime.date.fromisoformat(first) + datetime.timedelta(k) for k in range((datetime.date.fromisoformat(last) - datetime.date.fromisoformat(first)).days + 1)]
    at = lambda v, d: float(v(d)) if callable(v) else float(v)
    return frame(spark, [(1, d, d.year, at(tmax, d), at(tmin, d), at(tmean, d), at(hours, d) * 3600) for d in days if d.isoformat() not in without], "node long, date date, year long, tmax double, tmin double, tmean double, daylight_s double")


def test_onsets_by_hand(spark):
    """18.3 degrees give 10 degree days a day: 53 on the sixth, 155.6 on the sixteenth; no flight up to 14.5 degrees."""
    r = phenology.rity(weather_year(spark, 18.3, 8.0, 13.0), ["node"]).first()
    assert r.complete and r.days == 239 and (str(r.swarming), str(r.infestation)) == ("2023-03-12", "2023-03-22")
    r = phenology.rity(weather_year(spark, lambda d: 14.0 if d.month < 5 else 20.0, 8.0, 12.0), ["node"]).first()
    assert str(r.swarming) == str(r.infestation) == "2023-05-01"
    tmax = lambda d: 15.0 if d.month < 4 else 17.0
    assert str(phenology.swarming_check(weather_year(spark, tmax, 5.0, 10.0), ["node"]).first().swarming_check) == "2023-04-01"
    assert phenology.swarming_check(weather_year(spark, tmax, 5.0, 10.0, first="2023-01-02"), ["node"]).first().swarming_check is None


def test_gaps_and_running_years(spark):
    r = phenology.rity(weather_year(spark, 18.3, 8.0, 13.0, without=("2023-06-01",)), ["node"]).first()
    assert not r.complete and r.swarming is None and r.n_filial is None
    r = phenology.rity(weather_year(spark, 18.3, 8.0, 13.0, last="2023-10-23"), ["node"]).first()
    assert not r.complete and str(r.swarming) == "2023-03-12"
    r = phenology.rity(weather_year(spark, 5.0, 0.0, 2.0), ["node"]).first()
    assert r.complete and r.infestation is None and (r.n_filial, r.n_sister) == (0, 0)


@pytest.mark.parametrize(("mean", "short_from"), [(20.0, None), (20.0, "2023-08-01"), (14.0, None), (26.0, "2023-07-01")])
def test_broods_by_hand(spark, mean, short_from):
    """Generations and sister broods by a loop over the days."""
    light = lambda d: 10.0 if short_from and d.isoformat() >= short_from else 15.0
    r = phenology.rity(weather_year(spark, 25.0, 15.0, mean, light), ["node"]).first()
    be = -0.48 + 1.03 * mean - 8.3
    days = [datetime.date(2023, 3, 7) + datetime.timedelta(k) for k in range(239)]
    heat = np.cumsum(np.full(239, 25.0 - 8.3))
    i0 = int(np.flatnonzero(heat >= 155.6)[0])
    e = np.where(np.arange(239) >= i0, be, 0.0)
    f1, fit = np.cumsum(e) / 557, np.array([light(d) >= 14.5 for d in days])

    def brood(level):
        at = np.flatnonzero((f1 > level) & fit)
        return (days[at[0]], e[at[0] :].sum() / 557) if len(at) else (None, None)

    sums, j = [], 1
    while brood(j - 0.5)[0]:
        sums.append(brood(j - 0.5)[1])
        j += 1
    two, three = brood(1.0), brood(2.0)
    assert abs(r.sum_f1 - f1[-1]) < 1e-9 and r.infestation == days[i0]
    assert (r.start_f2, r.start_f3) == (two[0], three[0])
    assert r.n_sister == sum(x >= 0.6 for x in sums)
    assert r.n_filial == sum(x is not None and x >= 0.6 for x in (f1[-1], two[1], three[1]))
    cool = phenology.rity(weather_year(spark, 25.0, 15.0, mean, light), ["node"], corrected=(True,)).first()
    assert cool.sum_f1 < r.sum_f1 and cool.swarming == r.swarming


def test_red_edge_index_uses_the_narrow_band(spark):
    got = ix.with_indices(frame(spark, [(0.9, 0.4, 0.1)], "b08 double, b8a double, b05 double"), ["ndre"]).first()
    assert abs(got.ndre - (0.4 - 0.1) / (0.4 + 0.1)) < 1e-12


@pytest.mark.parametrize("n", [0, 1, 7, 60])
def test_distances_by_brute_force(spark, n):
    """Every cell of a grid against every target, ties to the smallest px; exact however far the targets are."""
    r = np.random.default_rng(n)
    h, w = 23, 31
    px = r.permutation(h * w)
    chosen = set(r.choice(h * w, n, replace=False).tolist())
    rows = [(int(px[k]), k // w, k % w, k in chosen) for k in range(h * w) if n < 60 or k % 7]  # the last grid is ragged
    got = {x.px: (x.distance, x.nearest) for x in raster.distance_to(frame(spark, rows, "px long, row long, col long, open boolean"), F.col("open")).collect()}
    for p, a, b, _ in rows:
        best = min((((a - c) ** 2 + (b - d) ** 2, q) for q, c, d, o in rows if o), default=None)
        assert got[p] == ((None, None) if best is None else (best[0] ** 0.5, best[1]))


def test_components_join_diagonals(spark):
    cells = frame(spark, [(1, 0, 0), (2, 1, 1), (3, 5, 5), (4, 5, 6), (9, 9, 9)], "px long, row long, col long")
    got = {x.px: x.label for x in raster.label8(cells).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}


def test_components_of_nothing(spark):
    assert raster.label8(frame(spark, [], "px long, row long, col long")).count() == 0


def test_box_mean_equals_numpy(spark):
    r = np.random.default_rng(2)
    v = r.random((9, 9))
    mask = r.random((9, 9)) < 0.8
    rows = [(i * 9 + j, i, j, float(v[i, j]) if mask[i, j] else None) for i in range(9) for j in range(9)]
    got = {x.px: x.v_box for x in raster.box_mean(frame(spark, rows, "px long, row long, col long, v double"), "v", 1).collect()}
    for i in range(9):
        for j in range(9):
            m = mask[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
            w = v[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
            assert (got[i * 9 + j] is None) == (not mask[i, j])
            if mask[i, j]:
                assert abs(got[i * 9 + j] - w[m].mean()) < 1e-12


def test_near_pairs_equal_all_pairs(spark):
    r = random.Random(4)
    box = lambda i: (i, *(lambda x, y, s: (x, y, x + s, y + s))(r.uniform(0, 500), r.uniform(0, 500), r.uniform(1, 60)))
    a, b = [box(i) for i in range(80)], [box(i) for i in range(80)]
    s = "id long, x0 double, y0 double, x1 double, y1 double"
    got = sorted((x.a.id, x.b.id) for x in spatial.near_pairs(frame(spark, a, s), frame(spark, b, s), 15.0, 50.0).collect())
    gap = lambda p, q: (max(0, p[1] - q[3], q[1] - p[3]) ** 2 + max(0, p[2] - q[4], q[2] - p[4]) ** 2) ** 0.5
    assert got == sorted((p[0], q[0]) for p in a for q in b if gap(p, q) <= 15)


def test_hull_and_elongation():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)
    assert len(geometry.hull(square)) == 4 and geometry.area(geometry.hull(square)) == 4
    assert abs(geometry.elongation(np.array([[0, 0], [6, 0], [6, 2], [0, 2]], float)) - 3) < 1e-9
    assert geometry.elongation(np.array([[0, 0], [1, 0]], float)) == float("inf")


@pytest.mark.parametrize("harmonics", [1, 2, 3])
def test_harmonics_recover_their_signal(spark, harmonics):
    """A planted cycle with outliers is found; below p + 2 values there is nothing."""
    r = np.random.default_rng(harmonics)
    coef, rows = r.normal(size=1 + 2 * harmonics), []
    signal = lambda d: coef[0] + sum(coef[2 * k - 1] * np.cos(k * 2 * np.pi * d / 365.25) + coef[2 * k] * np.sin(k * 2 * np.pi * d / 365.25) for k in range(1, harmonics + 1))
    for d in range(1, 366, 6):
        rows.append((1, d, 1999, float(signal(d) + r.normal() * 0.01 + (3.0 if d % 60 == 1 else 0.0))))
    rows += [(2, d, 1999, 1.0) for d in range(1, 2 * harmonics + 3)]
    got = harmonic.baseline(frame(spark, rows, "px long, doy long, year long, x double"), ["x"], F.col("year") == 1999, harmonics).collect()
    assert all(abs(g.x_med - signal(g.doy)) < 0.05 and g.x_n == 61 for g in got if g.px == 1)
    assert all(g.x_med is None and g.x_mad is None and g.x_n == 2 * harmonics + 2 for g in got if g.px == 2)
