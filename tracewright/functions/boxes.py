"""Axis-parallel boxes as four columns, and points with straight lines and curves as arrays of struct(x, y)."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

CORNERS = ("x0", "y0", "x1", "y1")


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def named(prefix: str = "") -> Box:
        return Box(*[F.col(f"{prefix}{c}") for c in CORNERS])

    @staticmethod
    def of(value: Column) -> Box:
        """From a struct with the fields x0, y0, x1, y1."""
        return Box(*[value[c] for c in CORNERS])

    def struct(self) -> Column:
        return F.struct(*[v.cast("double").alias(c) for v, c in zip(self, CORNERS, strict=True)])

    def columns(self) -> list[Column]:
        return [v.alias(c) for v, c in zip(self, CORNERS, strict=True)]


class Side:
    """The box of one side of a join, named when it is used."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getattr__(self, name: str) -> Column:
        if name not in CORNERS:
            raise AttributeError(name)
        return F.col(f"{self.prefix}{name}")

    def __iter__(self):
        return iter(Box.named(self.prefix))


def _at_least_0(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def width(a: Box) -> Column:
    return _at_least_0(a.x1 - a.x0)


def height(a: Box) -> Column:
    return _at_least_0(a.y1 - a.y0)


def area(a: Box) -> Column:
    return width(a) * height(a)


def gap(a: Box, b: Box) -> Column:
    """Distance between two boxes, 0 where they touch."""
    dx, dy = F.greatest(a.x0 - b.x1, b.x0 - a.x1, F.lit(0.0)), F.greatest(a.y0 - b.y1, b.y0 - a.y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def edge_distance(a: Box, b: Box, diagonal_factor: float = config.DIAGONAL_FACTOR) -> Column:
    """Distance of the nearest parallel edges where the boxes' projections meet, else their gap times a factor."""
    apart = lambda low, high: F.least(*[F.abs(getattr(a, i) - getattr(b, j)) for i in (low, high) for j in (low, high)])
    meet = lambda low, high: F.least(getattr(a, high), getattr(b, high)) >= F.greatest(getattr(a, low), getattr(b, low))
    x, y = F.when(meet("y0", "y1"), apart("x0", "x1")), F.when(meet("x0", "x1"), apart("y0", "y1"))
    return F.coalesce(F.least(x, y), gap(a, b) * diagonal_factor)


def centre(a: Box) -> tuple[Column, Column]:
    return (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2


def centre_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    return _at_least_0(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * _at_least_0(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    return _share(both, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - both)


def coverage(container: Box, target: Box) -> Column:
    """Share of the target's area inside the container."""
    return _share(overlap(container, target), area(target))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return _share(overlap(a, b), F.least(area(a), area(b)))


def covered_share(child: Box, parent: Box) -> Column:
    """Share of the child inside the parent: of its area, of its length if it has none, or whether it is covered if it is a point."""
    length = _at_least_0(F.least(child.x1, parent.x1) - F.greatest(child.x0, parent.x0)) + _at_least_0(F.least(child.y1, parent.y1) - F.greatest(child.y0, parent.y0))
    whole = width(child) + height(child)
    line = F.when(intersects(child, parent), length / whole).otherwise(0.0)
    return F.when(area(child) > 0, overlap(child, parent) / area(child)).when(whole > 0, line).otherwise(contains(parent, child).cast("double"))


def intersects(a: Box, b: Box, slack: float = 0.0) -> Column:
    """Whether they meet, edges included."""
    return (F.least(a.x1, b.x1) >= F.greatest(a.x0, b.x0) - slack) & (F.least(a.y1, b.y1) >= F.greatest(a.y0, b.y0) - slack)


def contains(outer: Box, inner: Box, slack: float = 0.0) -> Column:
    return (inner.x0 >= outer.x0 - slack) & (inner.y0 >= outer.y0 - slack) & (inner.x1 <= outer.x1 + slack) & (inner.y1 <= outer.y1 + slack)


def strictly_contains(outer: Box, inner: Box, tolerance: float = config.GRID_COORDINATE) -> Column:
    """Contains, and some edge is farther out than the tolerance."""
    apart = [F.abs(a - b) > tolerance for a, b in zip(outer, inner, strict=True)]
    return contains(outer, inner) & (apart[0] | apart[1] | apart[2] | apart[3])


def holds_centre(outer: Box, inner: Box) -> Column:
    x, y = centre(inner)
    return x.between(outer.x0, outer.x1) & y.between(outer.y0, outer.y1)


def near_region(region: Box, item: Box, threshold: float) -> Column:
    """The item's centre is outside of the region and no farther from it than the threshold."""
    x, y = centre(item)
    dx, dy = F.greatest(region.x0 - x, x - region.x1, F.lit(0.0)), F.greatest(region.y0 - y, y - region.y1, F.lit(0.0))
    away = dx * dx + dy * dy
    return (away > 0) & (away <= threshold * threshold)


def expand(a: Box, slack: float) -> Box:
    """Grown about its centre: a slack of 0.1 adds a tenth to width and height."""
    x, y = centre(a)
    w, h = (a.x1 - a.x0) * (1 + slack) / 2, (a.y1 - a.y0) * (1 + slack) / 2
    return Box(x - w, y - h, x + w, y + h)


def flipped(a: Box, page_height: Column) -> Box:
    """Between coordinates that count up from the bottom of the page and those that count down from its top; its own inverse."""
    return Box(a.x0, page_height - a.y1, a.x1, page_height - a.y0)


def ordered(a: Box) -> Box:
    return Box(F.least(a.x0, a.x1), F.least(a.y0, a.y1), F.greatest(a.x0, a.x1), F.greatest(a.y0, a.y1))


def query_box(a: Box, slack: float, page_height: Column | None = None) -> Box:
    """A query's box in page coordinates (flipped if a page height is given), with ordered corners, expanded."""
    return expand(ordered(a if page_height is None else flipped(a, page_height)), slack)


def relative(inner: Box, outer: Box) -> Box:
    """inner in units of outer; an outer box without width or height is an error."""
    w, h = outer.x1 - outer.x0, outer.y1 - outer.y0
    flat = (F.abs(w) < 1e-12) | (F.abs(h) < 1e-12)
    of = lambda value: F.when(flat, F.raise_error(F.lit("outer box must have non-zero width and height")).cast("double")).otherwise(value)
    return Box(of((inner.x0 - outer.x0) / w), of((inner.y0 - outer.y0) / h), of((inner.x1 - outer.x0) / w), of((inner.y1 - outer.y0) / h))


def snapped(value: Column, step: float) -> Column:
    """value in steps, halves to the even one."""
    return F.rint(value / step).cast("long")


def is_tiny(a: Box, vectors: Column, texts: Column, most: int = 20, size: float = 20.0) -> Column:
    """Few vectors, no text and a small box: not worth a costly stage."""
    return (vectors <= most) & (texts == 0) & (a.x1 - a.x0 <= size) & (a.y1 - a.y0 <= size)


def is_frame_line(vector: Box, frame: Box, inside: Column | None = None) -> Column:
    """A long thin line on an edge of the frame, or one on an edge with little of its length (the share inside) within the frame."""
    t = config.FRAME_EDGE
    w, h = vector.x1 - vector.x0, vector.y1 - vector.y0
    near = lambda ends, edges: F.least(*[F.abs(a - b) for a in ends for b in edges]) <= t
    on_rows, on_columns = near((vector.y0, vector.y1), (frame.y0, frame.y1)), near((vector.x0, vector.x1), (frame.x0, frame.x1))
    wide, tall = (w >= (frame.x1 - frame.x0) * config.FRAME_SPAN) & (h <= t), (h >= (frame.y1 - frame.y0) * config.FRAME_SPAN) & (w <= t)
    out = (wide & on_rows) | (tall & on_columns)
    return out if inside is None else out | ((on_rows | on_columns) & (inside <= config.FRAME_INSIDE))


def fallback_content(page: Box) -> Box:
    """The page without a margin of a hundredth, or a point at least."""
    inset = F.greatest(F.least(page.x1 - page.x0, page.y1 - page.y0) * config.CONTENT_INSET_SHARE, F.lit(config.CONTENT_INSET))
    return Box(page.x0 + inset, page.y0 + inset, page.x1 - inset, page.y1 - inset)


# Points.


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def box_of_points(points: Column) -> Box:
    of = lambda which, axis: which(F.transform(points, lambda p: p[axis]))
    return Box(of(F.array_min, "x"), of(F.array_min, "y"), of(F.array_max, "x"), of(F.array_max, "y"))


def _cubic(p: list[Column], t: Column) -> Column:
    u = 1 - t
    return u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3]


def cubic_box(points: Column) -> Box:
    """Exact box of a cubic curve of four points: its ends and where its slope is level, at t within (0, 1)."""

    def reach(axis: str) -> Column:
        p = [F.get(points, i)[axis] for i in range(4)]
        slope = F.struct((-p[0] + 3 * p[1] - 3 * p[2] + p[3]).alias("a"), (2 * (p[0] - 2 * p[1] + p[2])).alias("b"), (p[1] - p[0]).alias("c"))

        def level(k: Column) -> Column:
            a, b, c = k["a"], k["b"], k["c"]
            straight = F.abs(a) < 1e-12
            root = F.when(~straight & (b * b - 4 * a * c >= 0), F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0))))
            over = F.nullif(2 * a, F.lit(0.0))
            return F.array(F.when(straight & (F.abs(b) >= 1e-12), -c / F.nullif(b, F.lit(0.0))), (-b + root) / over, (-b - root) / over)

        inner = F.transform(F.filter(let(slope, level), lambda t: (t > 0) & (t < 1)), lambda t: _cubic(p, t))
        return F.concat(F.array(p[0], p[3]), inner)

    x, y = reach("x"), reach("y")
    return Box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def shape_box(kind: Column, points: Column) -> Box:
    curved, plain = cubic_box(points), box_of_points(points)
    is_curve = (kind == "curve") & (F.size(points) == 4)
    return Box(*[F.when(is_curve, c).otherwise(p) for c, p in zip(curved, plain, strict=True)])


def sampled(points: Column, segments: int = config.CURVE_SEGMENTS) -> Column:
    """Points along a cubic curve, both ends included."""
    at = lambda axis, t: _cubic([F.get(points, i)[axis] for i in range(4)], t)
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: point(at("x", i / segments), at("y", i / segments)))


def polyline(kind: Column, points: Column) -> Column:
    """The line that a path of that kind draws: curves sampled, rectangles and quads closed."""
    closed = F.concat(points, F.slice(points, 1, 1))
    return F.when((kind == "curve") & (F.size(points) == 4), sampled(points)).when(kind.isin("rect", "quad"), closed).otherwise(points)


def transformed(points: Column, *, degrees: Column, scale: Column, dx: Column, dy: Column, mirrored: Column) -> Column:
    """Mirrored in x, scaled, turned, then moved."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    sign = F.when(mirrored, -1.0).otherwise(1.0)

    def of(p: Column) -> Column:
        x, y = p["x"] * scale * sign, p["y"] * scale
        return point(cos * x - sin * y + dx, sin * x + cos * y + dy)

    return F.transform(points, of)


def corners(a: Box) -> Column:
    return F.array(point(a.x0, a.y0), point(a.x1, a.y0), point(a.x1, a.y1), point(a.x0, a.y1))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def diameter(points: Column) -> Column:
    return F.array_max(F.flatten(F.transform(points, lambda p: F.transform(points, lambda q: distance(p, q)))))


def scale_estimate(source: Column, target: Column) -> Column:
    """Ratio of diameters; 1 for a source without one."""
    d = diameter(source)
    return F.when(d < 1e-12, 1.0).otherwise(diameter(target) / d)


def _mean(points: Column, axis: str) -> Column:
    return _total(F.transform(points, lambda p: p[axis])) / F.size(points)


def _means(source: Column, target: Column) -> Column:
    return F.struct(_mean(source, "x").alias("sx"), _mean(source, "y").alias("sy"), _mean(target, "x").alias("tx"), _mean(target, "y").alias("ty"))


def _farthest(source: Column, target: Column, dx: Column, dy: Column) -> Column:
    return F.array_max(F.zip_with(source, target, lambda s, t: distance(point(s["x"] + dx, s["y"] + dy), t)))


def fixed_fit(source: Column, target: Column, *, degrees: Column, scale: Column, mirrored: Column) -> Column:
    """struct(dx, dy, error): the mean shift onto target after that turn and scale, and the farthest point left."""

    def fitted(turned: Column) -> Column:
        shift = F.struct((_mean(target, "x") - _mean(turned, "x")).alias("dx"), (_mean(target, "y") - _mean(turned, "y")).alias("dy"))
        return let(shift, lambda d: F.struct(d["dx"].alias("dx"), d["dy"].alias("dy"), _farthest(turned, target, d["dx"], d["dy"]).alias("error")))

    turned = transformed(source, degrees=degrees, scale=scale, dx=F.lit(0.0), dy=F.lit(0.0), mirrored=mirrored)
    return F.when(F.size(source) == F.size(target), let(turned, fitted))


def rigid_fit(source: Column, target: Column) -> Column:
    """struct(angle, dx, dy, error): the turn and shift with the least squares, and the farthest point left."""

    def fitted(m: Column) -> Column:
        dot = _total(F.zip_with(source, target, lambda s, t: (s["x"] - m["sx"]) * (t["x"] - m["tx"]) + (s["y"] - m["sy"]) * (t["y"] - m["ty"])))
        cross = _total(F.zip_with(source, target, lambda s, t: (s["x"] - m["sx"]) * (t["y"] - m["ty"]) - (s["y"] - m["sy"]) * (t["x"] - m["tx"])))

        def placed(angle: Column) -> Column:
            dx, dy = m["tx"] - (F.cos(angle) * m["sx"] - F.sin(angle) * m["sy"]), m["ty"] - (F.sin(angle) * m["sx"] + F.cos(angle) * m["sy"])
            moved = transformed(source, degrees=F.degrees(angle), scale=F.lit(1.0), dx=dx, dy=dy, mirrored=F.lit(False))
            return F.struct(angle.alias("angle"), dx.alias("dx"), dy.alias("dy"), F.array_max(F.zip_with(moved, target, distance)).alias("error"))

        return let(F.atan2(cross, dot), placed)

    return F.when(F.size(source) == F.size(target), let(_means(source, target), fitted))


def extended(points: Column, by: float = config.FRAME_EXTENSION) -> Column:
    """The free ends moved outwards along their last step; closed lines as they are."""

    def out(origin: Column, tip: Column) -> Column:
        length = distance(origin, tip)
        return F.when(length > 0, point(tip["x"] + (tip["x"] - origin["x"]) * by / F.nullif(length, F.lit(0.0)), tip["y"] + (tip["y"] - origin["y"]) * by / F.nullif(length, F.lit(0.0)))).otherwise(tip)

    n = F.size(points)
    first, last = out(F.get(points, 1), F.get(points, 0)), out(F.get(points, n - 2), F.get(points, n - 1))
    closed = distance(F.get(points, 0), F.get(points, n - 1)) <= 1e-9
    middle = F.slice(points, F.lit(2), F.greatest(n - 2, F.lit(0)))
    return F.when((n < 2) | closed, points).otherwise(F.concat(F.array(first), middle, F.array(last)))


def line_angle(p: Column, q: Column) -> Column:
    """Degrees in [0, 180) of a line without direction."""
    return F.pmod(F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"])), F.lit(180.0))


def is_axis_angle(angle: Column, tolerance: float = config.MARK_AXIS_DEGREES) -> Column:
    return F.least(F.abs(angle), F.abs(angle - 90), F.abs(angle - 180)) <= tolerance


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    norm = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    return F.when(norm > 0, (ax * bx + ay * by) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


def side_of(p: Column, kind: Column, start: Column, end: Column) -> Column:
    """On which side of a vertical, horizontal or slanted boundary a point is: the sign counts."""
    slanted = (end["x"] - start["x"]) * (p["y"] - start["y"]) - (end["y"] - start["y"]) * (p["x"] - start["x"])
    return F.when(kind == "vertical", p["x"] - (start["x"] + end["x"]) / 2).when(kind == "horizontal", p["y"] - (start["y"] + end["y"]) / 2).otherwise(slanted)


def _steps(ring: Column) -> Column:
    """struct(p, q) of each edge of a closed ring given without its last point."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, F.pmod(i + 1, n)).alias("q")))


def ring_area(ring: Column) -> Column:
    return F.abs(_total(F.transform(_steps(ring), lambda e: e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))) / 2


def ring_length(ring: Column) -> Column:
    return _total(F.transform(_steps(ring), lambda e: distance(e["p"], e["q"])))


def without_repeats(points: Column, tolerance: float = config.CLOSED_EDGE) -> Column:
    """Points closer than the tolerance to the one kept before left out, and the last if it is that close to the first."""
    kept = F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), lambda acc, p: F.when((F.size(acc) > 0) & (distance(F.coalesce(F.try_element_at(acc, F.lit(-1)), p), p) <= tolerance), acc).otherwise(F.array_append(acc, point(p["x"], p["y"]))))
    last = lambda k: F.get(k, F.size(k) - 1)
    return let(kept, lambda k: F.when((F.size(k) > 1) & (distance(F.get(k, 0), last(k)) <= tolerance), F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0)))).otherwise(k))


def _measures(ring: Column) -> Column:
    b = box_of_points(ring)
    return F.struct(ring_area(ring).alias("area"), ring_length(ring).alias("length"), (b.x1 - b.x0).alias("w"), (b.y1 - b.y0).alias("h"))


def looks_like_circle(ring: Column) -> Column:
    """Round enough for its outline, and about as wide as high."""

    def judged(m: Column) -> Column:
        even = F.abs(m["w"] - m["h"]) / F.nullif(F.greatest(m["w"], m["h"]), F.lit(0.0)) <= config.CIRCLE_ASPECT
        return (m["area"] >= config.REGION_AREA) & (m["w"] > 0) & (m["h"] > 0) & even & (4 * math.pi * m["area"] / F.nullif(m["length"] * m["length"], F.lit(0.0)) >= config.CIRCULARITY)

    return F.coalesce(let(_measures(ring), judged), F.lit(False))


def looks_like_box(ring: Column, axis: float = config.CLOSED_EDGE) -> Column:
    """An axis-parallel rectangle, or a ring that nearly fills its box with long axis-parallel edges."""
    across = lambda e: (F.abs(e["p"]["x"] - e["q"]["x"]), F.abs(e["p"]["y"] - e["q"]["y"]))
    square = let(without_repeats(ring), lambda few: (F.size(few) == 4) & F.forall(_steps(few), lambda e: (across(e)[0] <= axis) | (across(e)[1] <= axis)))
    rows = _total(F.transform(_steps(ring), lambda e: F.when(across(e)[1] <= axis, across(e)[0]).otherwise(0.0)))
    columns = _total(F.transform(_steps(ring), lambda e: F.when(across(e)[0] <= axis, across(e)[1]).otherwise(0.0)))

    def judged(m: Column) -> Column:
        whole = m["w"] * m["h"]
        rectangle = square & (whole > 0) & (F.abs(m["area"] - whole) <= F.greatest(whole * 0.01, F.lit(config.REGION_AREA)))
        filled = (whole > 0) & (m["area"] / F.nullif(whole, F.lit(0.0)) >= config.BOX_FILL) & (rows >= m["w"] * config.BOX_SPANS) & (columns >= m["h"] * config.BOX_SPANS)
        return rectangle | filled

    return F.coalesce(let(_measures(ring), judged), F.lit(False))


def arrow_direction(ring: Column) -> Column:
    """Where a filled triangle points: left, right, up or down; null for what is no slim or flat isosceles triangle along an axis."""

    def apex(c: Column, i: int) -> Column:
        p, q, r = F.get(c, i), F.get(c, 0 if i else 1), F.get(c, 1 if i == 2 else 2)
        left, right = distance(p, q), distance(p, r)
        dx, dy = p["x"] - (q["x"] + r["x"]) / 2, p["y"] - (q["y"] + r["y"]) / 2
        return F.struct((2 * F.abs(left - right) / F.nullif(left + right, F.lit(0.0))).alias("error"), F.lit(i).alias("i"), ((left + right) / 2).alias("leg"), distance(q, r).alias("base"), dx.alias("dx"), dy.alias("dy"))

    def pointing(best: Column) -> Column:
        far, near = F.greatest(F.abs(best["dx"]), F.abs(best["dy"])), F.least(F.abs(best["dx"]), F.abs(best["dy"]))
        uneven = F.abs(best["leg"] - best["base"]) / F.greatest(best["leg"], best["base"], F.lit(1e-9)) > config.EQUILATERAL
        ok = (best["error"] <= config.ISOSCELES) & uneven & (far > 1e-9) & (near / F.nullif(far, F.lit(0.0)) <= config.DIRECTION_AXIS)
        across = F.when(best["dx"] > 0, "right").otherwise("left")
        return F.when(ok, F.when(F.abs(best["dx"]) > F.abs(best["dy"]), across).otherwise(F.when(best["dy"] > 0, "down").otherwise("up")))

    def judged(c: Column) -> Column:
        fits = let(_measures(c), lambda m: (m["area"] >= config.ARROW_AREA) & (F.least(m["w"], m["h"]) >= config.PIN_SIZE) & (F.greatest(m["w"], m["h"]) <= config.ARROW_SIZE))
        best = F.array_min(F.filter(F.array(apex(c, 0), apex(c, 1), apex(c, 2)), lambda s: s["error"].isNotNull()))
        return F.when((F.size(c) == 3) & fits, let(best, pointing))

    return let(without_repeats(ring, config.PIN_POINT), judged)
