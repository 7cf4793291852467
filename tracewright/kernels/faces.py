"""Closed faces of line work: lines are cut where they meet, ends that lead nowhere are dropped, and the faces are walked.

Points are snapped to a grid of the tolerance, so lines that meet within it do meet. Quadratic in the segments of a page, in numpy.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from .. import config

Segment = tuple[float, float, float, float]


def noded(segments: list[Segment], tolerance: float = config.TOPOLOGY) -> tuple[np.ndarray, list[tuple[int, int]], list[set[int]]]:
    """Points, edges (pairs of points, the smaller first) and for each edge the segments that it lies on."""
    if not segments:
        return np.zeros((0, 2)), [], []
    s = np.asarray(segments, float)
    p, d = s[:, :2], s[:, 2:] - s[:, :2]
    length = np.hypot(d[:, 0], d[:, 1])
    places: dict[tuple[int, int], int] = {}
    points: list[tuple[float, float]] = []

    def at(x: float, y: float) -> int:
        key = (int(np.rint(x / tolerance)), int(np.rint(y / tolerance)))
        if key not in places:
            places[key] = len(points)
            points.append((x, y))
        return places[key]

    owners: dict[tuple[int, int], set[int]] = defaultdict(set)
    low, high = np.minimum(s[:, :2], s[:, 2:]) - tolerance, np.maximum(s[:, :2], s[:, 2:]) + tolerance
    ends = np.concatenate([s[:, :2], s[:, 2:]])
    for i in range(len(s)):
        if length[i] <= tolerance:
            continue
        near = np.flatnonzero((low[:, 0] <= high[i, 0]) & (high[:, 0] >= low[i, 0]) & (low[:, 1] <= high[i, 1]) & (high[:, 1] >= low[i, 1]))
        near = near[near != i]
        cross = d[i, 0] * d[near, 1] - d[i, 1] * d[near, 0]
        off = p[near] - p[i]
        bent = np.abs(cross) > 1e-12 * length[i] * np.maximum(length[near], 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (off[:, 0] * d[near, 1] - off[:, 1] * d[near, 0]) / cross
            u = (off[:, 0] * d[i, 1] - off[:, 1] * d[i, 0]) / cross
        slack, their = tolerance / length[i], tolerance / np.maximum(length[near], 1e-12)
        hit = bent & (t >= -slack) & (t <= 1 + slack) & (u >= -their) & (u <= 1 + their)
        found = [(float(x), *(p[i] + x * d[i])) for x in t[hit]]
        own = ends[np.concatenate([near, near + len(s)])]
        along = ((own - p[i]) @ d[i]) / length[i] ** 2
        foot = p[i] + along[:, None] * d[i]
        on = (np.hypot(*(own - foot).T) <= tolerance) & (along >= -slack) & (along <= 1 + slack)
        found += [(float(a), *xy) for a, xy in zip(along[on], own[on], strict=True)]
        found += [(0.0, *p[i]), (1.0, *s[i, 2:])]
        chain = [at(x, y) for _, x, y in sorted(found)]
        for a, b in zip(chain, chain[1:], strict=False):
            if a != b:
                owners[min(a, b), max(a, b)].add(i)
    edges = sorted(owners)
    return np.array(points).reshape(-1, 2), edges, [owners[e] for e in edges]


def _rings(points: np.ndarray, edges: list[tuple[int, int]]) -> tuple[list[list[int]], dict[tuple[int, int], int]]:
    """Rings of directed edges, each always taking the next edge clockwise, and the ring of each directed edge."""
    around: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
    turn = {}
    for a, others in around.items():
        d = points[others] - points[a]
        order = [others[k] for k in np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]
        for k, b in enumerate(order):
            turn[a, b] = order[k - 1]
    rings, ring_of = [], {}
    for start in [x for e in edges for x in (e, e[::-1])]:
        if start in ring_of:
            continue
        ring, (a, b) = [], start
        while (a, b) not in ring_of:
            ring_of[a, b] = len(rings)
            ring.append(a)
            a, b = b, turn[b, a]
        rings.append(ring)
    return rings, ring_of


def faces(segments: list[Segment], least_area: float = 0.0, tolerance: float = config.TOPOLOGY) -> list[tuple[list[tuple[float, float]], set[int]]]:
    """(ring, segments on it) of each closed face with that area at least, by y, x, then the largest first."""
    points, edges, owners = noded(segments, tolerance)
    own = dict(zip(edges, owners, strict=True))
    while True:
        degree: dict[int, int] = defaultdict(int)
        for a, b in edges:
            degree[a] += 1
            degree[b] += 1
        kept = [e for e in edges if degree[e[0]] > 1 and degree[e[1]] > 1]
        if len(kept) == len(edges):
            rings, ring_of = _rings(points, edges)
            kept = [(a, b) for a, b in edges if ring_of[a, b] != ring_of[b, a]]  # a line with one face on both sides bounds none
            if len(kept) == len(edges):
                break
        edges = kept
    out = []
    for ring in rings:
        xy = points[ring]
        area = 0.5 * float(np.sum(xy[:, 0] * np.roll(xy[:, 1], -1) - np.roll(xy[:, 0], -1) * xy[:, 1]))
        if area > 0 and area >= least_area:
            on = set().union(*(own[min(a, b), max(a, b)] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)))
            out.append((area, [tuple(q) for q in xy.tolist()], on))
    out.sort(key=lambda f: (min(y for _, y in f[1]), min(x for x, _ in f[1]), -f[0]))
    return [(ring, on) for _, ring, on in out]


def clipped(segment: Segment, box: tuple[float, float, float, float]) -> Segment | None:
    """The part of a segment inside a box, null if there is none."""
    x0, y0, x1, y1 = segment
    dx, dy, low, high = x1 - x0, y1 - y0, 0.0, 1.0
    for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            low = max(low, q / p)
        else:
            high = min(high, q / p)
    return (x0 + low * dx, y0 + low * dy, x0 + high * dx, y0 + high * dy) if low <= high else None


def inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    """Whether a ring holds a point, its boundary included."""
    x, y, odd = *point, False
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if min(ax, bx) - 1e-9 <= x <= max(ax, bx) + 1e-9 and min(ay, by) - 1e-9 <= y <= max(ay, by) + 1e-9 and abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= 1e-9 * max(1.0, abs(bx - ax) + abs(by - ay)):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def point_to_segment(x: float, y: float, s: Segment) -> float:
    dx, dy = s[2] - s[0], s[3] - s[1]
    whole = dx * dx + dy * dy
    t = 0.0 if whole == 0 else max(0.0, min(1.0, ((x - s[0]) * dx + (y - s[1]) * dy) / whole))
    return float(np.hypot(x - s[0] - t * dx, y - s[1] - t * dy))
