"""Sequential geometry on small groups, as grouped Arrow/pandas functions: hulls, elongation, greedy missions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull (counter-clockwise) of points by the monotone chain."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(q: list) -> list:
        out: list = []
        for x in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(x)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def elongation(points: np.ndarray) -> float:
    """Longer over shorter side of the smallest rotated rectangle around the points; infinite without area."""
    h = hull(points)
    if len(h) < 3:
        return float("inf")
    best = (np.inf, np.inf)
    for a, b in zip(h, np.roll(h, -1, axis=0), strict=True):
        u = (b - a) / np.hypot(*(b - a))
        s, t = h @ u, h @ np.array([-u[1], u[0]])
        w, d = np.ptp(s), np.ptp(t)
        best = min(best, (w * d, max(w, d) / max(min(w, d), 1e-12)))
    return float(best[1])


def elongations(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """label, elongation of each label's cell corners; a label's cells are one object, bounded by its own extent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["col", "row"]].to_numpy(float)
        corners = np.concatenate([xy + d for d in ((0, 0), (1, 0), (0, 1), (1, 1))]) * size
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "elongation": [elongation(corners)]})

    return cells.select("label", "row", "col").groupBy("label").applyInPandas(run, "label long, elongation double")


def missions(targets: DataFrame, most_ha: float = 30.0, gap: float = 500.0) -> DataFrame:
    """aoi, id, mission, rank: greedy groups of targets (aoi, id, priority, value, x, y) within one area of interest.

    The best unassigned target seeds a mission; further ones join in order of (priority, distance to its hull) while the
    hull stays within `most_ha` and the gap within `gap`.  The choice is sequential inside an area, areas are parallel:
    they are dealt to a fixed number of tasks, as their work is large where their rows are few.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "value", "id"], ascending=[True, False, True]).reset_index(drop=True)
        groups = grouped(pdf[["x", "y"]].to_numpy(float), pdf["priority"].to_numpy(), pdf["id"].to_numpy(), most_ha * 1e4, gap)
        order = np.concatenate(groups)
        number, rank = (np.concatenate([f(k, len(g)) for k, g in enumerate(groups)]) + 1 for f in (lambda k, n: np.full(n, k), lambda k, n: np.arange(n)))
        return pd.DataFrame({"aoi": pdf["aoi"].iloc[0], "id": pdf["id"].to_numpy()[order], "mission": number, "rank": rank})

    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return targets.select("aoi", "id", "priority", "value", "x", "y").repartition(tasks, "aoi").groupBy("aoi").applyInPandas(run, "aoi long, id long, mission int, rank int")


def grouped(xy: np.ndarray, priority: np.ndarray, ids: np.ndarray, most: float, gap: float) -> list[list[int]]:
    """Greedy groups of points in their order; each is the seed, then further points as they join."""
    left, out = np.ones(len(xy), bool), []
    for seed in range(len(xy)):
        if not left[seed]:
            continue
        left[seed] = False
        chosen, ring = [seed], xy[[seed]]
        others = np.flatnonzero(left)
        while len(others):
            far, size = _reaches(xy[others], ring)
            fits = size <= most
            for k in np.flatnonzero(np.abs(size - most) <= 1e-9 * most):  # on the limit: as the hull itself measures
                fits[k] = area(hull(np.concatenate([ring, xy[others[[k]]]]))) <= most
            others, far = others[fits], far[fits]  # hulls only grow, so what does not fit now never will
            near = np.flatnonzero(far <= gap)
            if not len(near):
                break
            for key in (priority[others], far, ids[others]):
                near = near[key[near] == key[near].min()]
            best = int(near[0])
            chosen.append(int(others[best]))
            if len(ring) < 3 or far[best] > 0:
                ring = hull(np.concatenate([ring, xy[others[[best]]]]))
            others = np.delete(others, best)
        left[chosen] = False
        out.append(chosen)
    return out


def _reaches(p: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point its distance from a convex ring, 0 inside, and the area of the ring's hull with it: a point sees the
    edges that it lies outside of, and the hull grows by its triangles with them."""
    if len(ring) == 1:
        return np.hypot(*(p - ring[0]).T), np.zeros(len(p))
    (ax, ay), (bx, by), (px, py) = ring.T, np.roll(ring, -1, axis=0).T, p.T[:, :, None]
    dx, dy, qx, qy = bx - ax, by - ay, px - ax, py - ay
    side = dx * qy - dy * qx
    t = np.clip((qx * dx + qy * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
    far = np.hypot(ax + t * dx - px, ay + t * dy - py).min(1)
    if len(ring) > 2:
        far[(side >= 0).all(1)] = 0.0
    return far, area(ring) + np.maximum(-side, 0).sum(1) / 2


def _distance(p: np.ndarray, ring: np.ndarray) -> float:
    """Distance of a point from a convex ring, 0 inside."""
    if len(ring) == 1:
        return float(np.hypot(*(p - ring[0])))
    a, b = ring, np.roll(ring, -1, axis=0)
    if len(ring) > 2:
        side = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
        if (side >= 0).all():
            return 0.0
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-12), 0, 1)
    return float(np.hypot(*(a + t[:, None] * d - p).T).min())
