"""Queries without SQL cover their whole table."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import pandas as pd
import pyarrow.parquet as pq

from larchspan import plans
from larchspan.operators import geometry, sampling

SF = "/root/testdata/sf0.01"


def test_chip_shift_covers_the_grid(spark):
    part = pq.read_table(f"{SF}/part.parquet", columns=["p_partkey", "p_retailprice"]).to_pydict()
    width = math.ceil(math.sqrt(max(part["p_partkey"]) + 1))
    price = {(k // width, k % width): p for k, p in zip(part["p_partkey"], part["p_retailprice"], strict=True)}
    across, want = (width - 1) // 16 + 1, {}
    for i, j in {(r // 16, c // 16) for r, c in price}:
        own = {k for k in price if (k[0] // 16, k[1] // 16) == (i, j)}
        d = pd.DataFrame([(r, c, price[r, c], price[r, c - 1] if (r, c - 1) in own else 0.0) for r, c in sorted(own)], columns=["row", "col", "a", "b"])
        # as the query lays a chip out: where frequencies vanish, the peak hangs on the order of the sums
        a, b = (d.pivot_table(index="row", columns="col", values=v, fill_value=0.0).to_numpy() for v in "ab")
        want[i * across + j] = sampling.phase_shift(a - a.mean(), b - b.mean())
    got = {r.chip: (r.d_row, r.d_col) for r in plans.QUERIES["chip_shift"](spark, SF).collect()}
    assert len(want) > 4 and set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def grid():
    """{(row, col): (px, size)} of the cells, as the table has them."""
    part = pq.read_table(f"{SMALL}/part.parquet", columns=["p_partkey", "p_size"]).to_pydict()
    width = math.ceil(math.sqrt(max(part["p_partkey"]) + 1))
    return {(k // width, k % width): (k, s) for k, s in zip(part["p_partkey"], part["p_size"], strict=True)}


def objects(grid, wanted):
    """label -> cells of the 8-connected components of the wanted cells, by flood fill."""
    left, out = {at for at, (_, s) in grid.items() if wanted(s)}, {}
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            seen.add((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out[min(grid[at][0] for at in seen)] = seen
    return out


def test_elongations_by_turning(spark, grid):
    """The smallest of all rectangles around an object's cells, over fine steps of the angle."""
    got = {r.label: r.elongation for r in plans.QUERIES["object_elongation"](spark, SMALL).collect()}
    want = {k: v for wanted in (lambda s: s >= 34, lambda s: s <= 14) for k, v in objects(grid, wanted).items() if len(v) >= 3}
    assert set(got) == set(want) and want
    for label, seen in want.items():
        p = np.array([(c + i, r + j) for r, c in seen for i in (0, 1) for j in (0, 1)], float)
        a = np.linspace(0, np.pi / 2, 20_001)
        w, h = np.ptp(np.outer(p[:, 0], np.cos(a)) + np.outer(p[:, 1], np.sin(a)), axis=0), np.ptp(np.outer(p[:, 1], np.cos(a)) - np.outer(p[:, 0], np.sin(a)), axis=0)
        near = (w * h) <= (w * h).min() * 1.001
        assert np.abs(np.maximum(w, h)[near] / np.minimum(w, h)[near] - got[label]).min() < 0.02


def test_cut_edge_risk_by_hand(spark, grid):
    got = {r.label: r for r in plans.QUERIES["cut_edge_risk"](spark, SMALL).collect()}
    cuts = {k: v for k, v in objects(grid, lambda s: s <= 14).items() if len(v) >= 3}
    disc = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    want = {}
    for label, seen in cuts.items():
        rows = []
        for r, c in seen:
            for i, j in disc:
                at = (r + i, c + j)
                if at in grid and not grid[at][1] <= 14:
                    face = (math.degrees(math.atan2(j, -i)) + 360) % 360
                    rows.append((at, (1 + math.cos(math.radians(face - 225))) / 2, grid[at][1] > 25, 1 - grid[r, c][1] / 14, abs(face - 225) <= 45))
        if rows:
            m = [np.mean([x[k] for x in rows]) for k in range(1, 5)]
            want[label] = (len({x[0] for x in rows}), 0.5 * m[0] + 0.3 * m[1] + 0.2 * m[2], m[3])
    assert set(got) == set(want) and want
    assert all(got[k].ring_cells == n and abs(got[k].risk - risk) < 2e-6 and abs(got[k].south_west_share - sw) < 2e-6 for k, (n, risk, sw) in want.items())


def test_first_arrivals_by_hand(spark):
    o = pq.read_table(f"{SMALL}/orders.parquet", columns=["o_custkey", "o_orderkey"]).to_pydict()
    keys = defaultdict(list)
    for c, k in zip(o["o_custkey"], o["o_orderkey"], strict=True):
        keys[c % 500].append(k)
    got = {r.key: (r.id, r.n) for r in plans.QUERIES["stream_dedupe"](spark, SMALL).collect()}
    assert got == {k: (min(v), len(v)) for k, v in keys.items()}


def test_late_confirmation_by_hand(spark):
    """Runs over 15 dB, two values over a day at least, from the whole series at once."""
    e = pq.read_table(f"{SMALL}/events.parquet").to_pandas()
    e = e[e["value"] > 0].groupby(["user_id", "ts"])["value"].max().reset_index()
    want = {}
    for uid, g in e.groupby("user_id"):
        best = start = last = None
        n = 0
        for t, v in zip(g["ts"], g["value"], strict=True):
            if v >= 10**1.5:
                start, last, n = (t if n == 0 else start), t, n + 1
                if best is None and n >= 2 and last - start >= pd.Timedelta(days=1):
                    best = start
            else:
                start, last, n = None, None, 0
        want[uid] = ("confirmed", best) if best is not None else ("pending", start) if n >= 2 else ("none", None)
    got = {r.uid: (r.status, r.first) for r in plans.QUERIES["late_confirmation"](spark, SMALL).collect()}
    assert set(got) == set(want)
    assert all(got[k][0] == s and (t is None) == (got[k][1] is None) and (t is None or pd.Timestamp(got[k][1]) == t) for k, (s, t) in want.items())


def test_discs_lie_inside_and_apart(spark, grid):
    got = [(r.row, r.col) for r in plans.QUERIES["disc_sampling"](spark, SMALL).collect()]
    inside = {at for at, (_, s) in grid.items() if s > 3}
    cross = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    fit = {(r, c) for r, c in inside if all((r + i, c + j) in inside for i, j in cross)}
    assert got and set(got) <= fit and max(Counter(got).values()) == 1
    assert all((a - c) ** 2 + (b - d) ** 2 > 9 for k, (a, b) in enumerate(got) for c, d in got[:k])
    assert len(got) == 25 or all(any((a - c) ** 2 + (b - d) ** 2 <= 9 for c, d in got) for a, b in fit)  # else as many as fit


def test_missions_keep_their_bounds(spark):
    """Every target in one mission; its hull stays within the area and every joint within the gap."""
    t = {r.id: (math.floor(r.y0 / 500), (r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2) for r in plans.objects.targets(spark, SMALL).where("status <> 'recovered'").collect()}
    got = plans.QUERIES["missions"](spark, SMALL).collect()
    assert sorted(r.id for r in got) == sorted(t) and all(r.aoi == t[r.id][0] for r in got)
    groups = defaultdict(list)
    for r in got:
        groups[r.aoi, r.mission].append((r.rank, t[r.id][1:]))
    for some in groups.values():
        ranks, points = zip(*sorted(some), strict=True)
        assert ranks == tuple(range(1, len(some) + 1))
        assert geometry.area(geometry.hull(np.array(points))) <= 30e4 + 1e-6
        assert all(geometry._distance(np.array(points[k]), geometry.hull(np.array(points[:k]))) <= 500 for k in range(1, len(points)))
