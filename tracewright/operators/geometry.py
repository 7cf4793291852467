"""Faces, entities, wires, pins and frames of pages' vectors. A page is worked on in one task; rows between tasks are ids, boxes and rings.

vectors: keys, id, type, points (array of struct(x, y)), x0, y0, x1, y1, dashes, path_index.

Defined cases: a vector without points has no lines; ids are unique within the keys; a page without lines gives no rows; columns besides those named are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import boxes as B
from ..functions import text as X
from ..kernels import faces as K
from ..kernels.sets import Sets
from ..plans.runtime import cut, per_group
from . import intervals, spatial

KEYS = ("page",)
POINTS = "array<struct<x: double, y: double>>"


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(rest).fields])


def _table(table: pa.Table, keys: Sequence[str], names: Sequence[str], rows: list[tuple], types: Sequence[pa.DataType]) -> pa.Table:
    heads = [pa.array([table[k][0].as_py()] * len(rows) if len(rows) else [], table.schema.field(k).type) for k in keys]
    return pa.table([*heads, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=[*keys, *names])


def _per_page(df: DataFrame, keys: Sequence[str], ddl: str, run: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    schema = _schema(df, keys, ddl)
    names = [f.name for f in schema.fields[len(keys) :]]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields[len(keys) :]]
    return per_group(df, keys, lambda t: _table(t, keys, names, run(t), types), schema)


def lines(vectors: DataFrame, keys: Sequence[str] = KEYS, which: Column | None = None) -> DataFrame:
    """(keys, id, type, dashes, path_index, line): the points of each vector's line, curves sampled, rectangles closed."""
    rows = vectors if which is None else vectors.where(which)
    return rows.select(*keys, *[c for c in ("id", "type", "dashes", "path_index") if c not in keys], B.polyline(F.col("type"), F.col("points")).alias("line")).where(F.size("line") >= 2)


def _segments(table: pa.Table) -> tuple[list[K.Segment], list[int]]:
    """Segments of a page's lines, and the row of each."""
    out, row = [], []
    for i, line in enumerate(table["line"].to_pylist()):
        for p, q in zip(line, line[1:], strict=False):
            out.append((p["x"], p["y"], q["x"], q["y"]))
            row.append(i)
    return out, row


def _ring(ring: list[tuple[float, float]]) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ring]


def _bounds(ring: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    return min(xs), min(ys), max(xs), max(ys)


FACE = f"nth int, ring {POINTS}, x0 double, y0 double, x1 double, y1 double, vectors array<long>"


def cells(vectors: DataFrame, keys: Sequence[str] = KEYS, least_area: float = config.REGION_AREA, which: Column | None = None) -> DataFrame:
    """(keys, FACE): every closed face of all lines, by y, x, then largest first, with the vectors near its boundary."""

    def run(table: pa.Table) -> list[tuple]:
        segments, row = _segments(table)
        ids = table["id"].to_pylist()
        found = K.faces(segments, least_area)
        return [(n, _ring(ring), *_bounds(ring), sorted({ids[row[s]] for s in on})) for n, (ring, on) in enumerate(found)]

    return _per_page(lines(vectors, keys, which), keys, FACE, run)


def _straight() -> Column:
    """Axis-parallel solid lines, rectangles and quads."""
    ring = F.when(F.col("type").isin("rect", "quad"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    steps = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.least(F.abs(p["x"] - q["x"]), F.abs(p["y"] - q["y"])) <= config.CLOSED_EDGE)
    return F.col("type").isin("line", "rect", "quad") & F.forall(steps, lambda ok: ok)


def vector_classes(vectors: DataFrame) -> DataFrame:
    """vectors with dash_type and booleans: dashed, axis_linear (solid axis-parallel lines), dashed_linear, boundary (of boxes: those and solid cubic curves)."""
    dashed, linear = X.is_dashed(F.col("dashes")), F.col("type").isin("line", "rect", "quad")
    curve = (F.col("type") == "curve") & (F.size("points") == 4)
    return vectors.withColumns({"dash_type": X.dash_type(F.col("dashes")), "dashed": dashed, "axis_linear": ~dashed & _straight(), "dashed_linear": dashed & linear, "boundary": ~dashed & (_straight() | curve)})


def circle_groups(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, path_index, ids): solid curves of one path, two or more."""
    solid = vectors.where((F.col("type") == "curve") & ~X.is_dashed(F.col("dashes")))
    return solid.groupBy(*keys, "path_index").agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") >= 2)


def boxes(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Faces of solid axis-parallel lines and curves at corners that look like boxes."""
    dashed = X.is_dashed(F.col("dashes"))
    curve = (F.col("type") == "curve") & (F.size("points") == 4)
    return cells(vectors, keys, which=~dashed & (_straight() | curve)).where(B.looks_like_box(F.col("ring")))


def circles(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Faces of the curves of one path that look like circles."""
    groups = circle_groups(vectors, keys).select(*keys, "path_index")
    own = vectors.where((F.col("type") == "curve") & ~X.is_dashed(F.col("dashes"))).join(groups, [*keys, "path_index"], "left_semi")
    return cells(own, [*keys, "path_index"], 0.0).where(B.looks_like_circle(F.col("ring")))


def dashed_faces(vectors: DataFrame, kind: str = "dashed", keys: Sequence[str] = KEYS) -> DataFrame:
    """Faces of straight dashed or dash_dotted lines; the latter frame groups."""
    return cells(vectors, keys, which=(X.dash_type(F.col("dashes")) == kind) & F.col("type").isin("line", "rect", "quad"))


def entities(vectors: DataFrame, keys: Sequence[str] = KEYS, *, contained: bool = False, gap: float | None = None) -> DataFrame:
    """(keys, entity, ids, x0, y0, x1, y1): vectors whose lines meet, in chains, numbered by their first vector.

    With contained, an entity within or touching a closed face (of ENTITY_FACE_AREA) of a larger one, within ENTITY_CONTAINMENT, joins it,
    until nothing changes; with gap, so do entities with vectors that close to each other.
    """

    def run(table: pa.Table) -> list[tuple]:
        segments, row = _segments(table)
        ids, n = table["id"].to_pylist(), table.num_rows
        sets = Sets(n)
        _, edges, owners = K.noded(segments)
        first: dict[int, int] = {}
        for (a, b), on in zip(edges, owners, strict=True):
            own = [row[s] for s in on]
            for r in own:
                sets.join(own[0], r)
            for p in (a, b):
                sets.join(first.setdefault(p, own[0]), own[0])
        boxes_ = np.full((n, 4), np.nan)
        for s, r in zip(segments, row, strict=True):
            low, high = (min(s[0], s[2]), min(s[1], s[3])), (max(s[0], s[2]), max(s[1], s[3]))
            boxes_[r] = [np.fmin(boxes_[r, 0], low[0]), np.fmin(boxes_[r, 1], low[1]), np.fmax(boxes_[r, 2], high[0]), np.fmax(boxes_[r, 3], high[1])]
        if contained:
            _absorb(sets, segments, row, boxes_)
        if gap is not None:
            for i in range(n):
                apart = np.hypot(np.maximum(np.maximum(boxes_[:, 0] - boxes_[i, 2], boxes_[i, 0] - boxes_[:, 2]), 0), np.maximum(np.maximum(boxes_[:, 1] - boxes_[i, 3], boxes_[i, 1] - boxes_[:, 3]), 0))
                for j in np.flatnonzero(apart <= gap).tolist():
                    sets.join(i, j)
        groups = sorted(sets.groups(), key=lambda g: min(ids[i] for i in g))
        return [(k, sorted(ids[i] for i in g), float(boxes_[g, 0].min()), float(boxes_[g, 1].min()), float(boxes_[g, 2].max()), float(boxes_[g, 3].max())) for k, g in enumerate(groups)]

    return _per_page(lines(vectors, keys), keys, "entity int, ids array<long>, x0 double, y0 double, x1 double, y1 double", run)


def _absorb(sets: Sets, segments: list[K.Segment], row: list[int], boxes_: np.ndarray) -> None:
    """Joins entities with those that their closed faces hold or touch, the largest first, until nothing changes."""
    changed = True
    while changed:
        changed = False
        members: dict[int, list[int]] = defaultdict(list)
        for s, r in enumerate(row):
            members[sets.find(r)].append(s)
        area = {g: (boxes_[sorted({row[s] for s in own}), 2].max() - boxes_[sorted({row[s] for s in own}), 0].min()) * (boxes_[sorted({row[s] for s in own}), 3].max() - boxes_[sorted({row[s] for s in own}), 1].min()) for g, own in members.items()}
        for g in sorted(members, key=lambda g: (-area[g], g)):
            for ring, _ in K.faces([segments[s] for s in members[g]], config.ENTITY_FACE_AREA):
                x0, y0, x1, y1 = _bounds(ring)
                t = config.ENTITY_CONTAINMENT
                edges = [(*p, *q) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
                for other, own in members.items():
                    if sets.find(other) == sets.find(g):
                        continue
                    b = boxes_[sorted({row[s] for s in own})]
                    if b[:, 0].min() > x1 + t or b[:, 2].max() < x0 - t or b[:, 1].min() > y1 + t or b[:, 3].max() < y0 - t:
                        continue
                    ends = [(segments[s][k], segments[s][k + 1]) for s in own for k in (0, 2)]
                    if any(K.inside(p, ring) or min(K.point_to_segment(*p, e) for e in edges) <= t for p in ends):
                        changed |= sets.join(g, other)


WIRE = "wire int, ids array<long>, free array<struct<x: double, y: double>>"


def wires(vectors: DataFrame, keys: Sequence[str] = KEYS, *, seed: float = config.WIRE_SEED_LENGTH, diagonal: float = config.TERMINAL_DIAGONAL_LENGTH) -> DataFrame:
    """(keys, WIRE): vectors that share ends, in chains, of groups with a long axis-parallel line; a short diagonal does not chain groups but
    goes to the first of those that it meets; what ends on another wire's line joins it. free are the ends that one line only has, by (y, x)."""
    grid = config.TOPOLOGY

    def run(table: pa.Table) -> list[tuple]:
        ids, kinds = table["id"].to_pylist(), table["type"].to_pylist()
        paths = [[(p["x"], p["y"]) for p in line] for line in table["line"].to_pylist()]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ends = {i: (paths[i][0], paths[i][-1]) for i in order}
        across = {i: (abs(paths[i][-1][0] - paths[i][0][0]), abs(paths[i][-1][1] - paths[i][0][1])) for i in order}
        straight = {i for i in order if kinds[i] == "line" and len(paths[i]) == 2}
        long = {i for i in straight if min(across[i]) <= grid and max(across[i]) >= seed}
        slant = {i for i in straight if min(across[i]) > grid and float(np.hypot(*across[i])) <= diagonal}
        key = lambda p: (round(p[0] / grid), round(p[1] / grid))
        at: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in order:
            for p in ends[i]:
                at[key(p)].append(i)
        sets = Sets(len(ids))
        for own in at.values():
            chained = [i for i in own if i not in slant]
            for i in chained[1:]:
                sets.join(chained[0], i)
        seeds = {sets.find(i) for i in long}
        # Ends on another line of a seeded group or a line's end on them.
        pieces = {i: [(*p, *q) for p, q in zip(paths[i], paths[i][1:], strict=False)] for i in order}
        for i in order:
            for j in order:
                if i != j and i not in slant and j not in slant and (sets.find(i) in seeds or sets.find(j) in seeds) and any(K.point_to_segment(*p, s) <= grid for p in ends[i] for s in pieces[j]):
                    sets.join(i, j)
                    seeds = {sets.find(s) for s in seeds}
        group = {i: sets.find(i) for i in order if i not in slant and sets.find(i) in seeds}
        number = {g: n for n, g in enumerate(sorted(set(group.values()), key=lambda g: min(ids[i] for i in group if group[i] == g)))}
        for i in slant:
            met = [number[group[j]] for p in ends[i] for j in at[key(p)] if j in group]
            if met:
                group[i] = next(g for g, n in number.items() if n == min(met))
        out = []
        for g, n in number.items():
            own = sorted((i for i in group if group[i] == g), key=ids.__getitem__)
            _, edges, _ = K.noded([s for i in own for s in pieces[i]])
            points, _, _ = K.noded([s for i in own for s in pieces[i]])
            degree = Counter(p for e in edges for p in e)
            free = sorted(((float(points[p][1]), float(points[p][0])) for p, d in degree.items() if d == 1))
            out.append((n, sorted(ids[i] for i in own), [{"x": x, "y": y} for y, x in free]))
        return out

    return _per_page(lines(vectors, keys), keys, WIRE, run)


def endpoints(wire_points: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = config.TOPOLOGY) -> DataFrame:
    """(keys, id, x, y, wires): wires' free ends (keys, wire, x, y), those within the tolerance of an earlier one as one, numbered by (y, x)."""

    def run(table: pa.Table) -> list[tuple]:
        rows = sorted(zip(table["wire"].to_pylist(), table["y"].to_pylist(), table["x"].to_pylist(), strict=True))
        kept: list[list] = []
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for wire, y, x in rows:
            cx, cy = int(np.floor(x / tolerance)), int(np.floor(y / tolerance))
            close = sorted(k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in near[cx + i, cy + j] if np.hypot(kept[k][0] - x, kept[k][1] - y) <= tolerance)
            if close:
                kept[close[0]][2].add(wire)
            else:
                near[cx, cy].append(len(kept))
                kept.append([x, y, {wire}])
        kept.sort(key=lambda e: (e[1], e[0]))
        return [(n, x, y, sorted(own)) for n, (x, y, own) in enumerate(kept)]

    return _per_page(wire_points, keys, "id long, x double, y double, wires array<long>", run)


def graphical_endpoints(points: DataFrame, circles_: DataFrame, keys: Sequence[str] = KEYS, reach: float = config.ENDPOINT_COMPONENT) -> DataFrame:
    """(keys, id, circle): for each endpoint (id, x, y, wires), in order, the nearest endpoint circle (id, box) within reach, then the smallest, that has none of its wires yet."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        taken: dict[int, set] = defaultdict(set)
        around = sorted(zip(*(right[c].to_pylist() for c in ("id", *B.CORNERS)), strict=True))
        rows = []
        for i, x, y, own in sorted(zip(*(left[c].to_pylist() for c in ("id", "x", "y", "wires")), strict=True)):
            ranked = []
            for c, x0, y0, x1, y1 in around:
                d = float(np.hypot(max(x0 - x, x - x1, 0), max(y0 - y, y - y1, 0)))
                if d <= reach and not taken[c] & set(own):
                    ranked.append((d, (x1 - x0) * (y1 - y0), c))
            if ranked:
                taken[min(ranked)[2]] |= set(own)
                rows.append((i, min(ranked)[2]))
        return _table(left, keys, ("id", "circle"), rows, (pa.int64(), pa.int64())) if left.num_rows else pa.table({k: [] for k in (*keys, "id", "circle")})

    schema = _schema(points, keys, "id long, circle long")
    return points.groupBy(*keys).cogroup(circles_.groupBy(*keys)).applyInArrow(run, schema)


def frame(vectors: DataFrame, pages: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, x0, y0, x1, y1, info_y0): each page's content: the largest face of its largest entity, lines extended a little; else the page without a margin.

    pages: keys and the page's box. info_y0 is where what lies below begins, null if nothing does.
    """

    def run(table: pa.Table) -> list[tuple]:
        segments, row = _segments(table)
        sets = Sets(table.num_rows)
        first: dict[int, int] = {}
        _, edges, owners = K.noded(segments)
        for (a, b), on in zip(edges, owners, strict=True):
            own = [row[s] for s in on]
            for r in own:
                sets.join(own[0], r)
            for p in (a, b):
                sets.join(first.setdefault(p, own[0]), own[0])
        paths = [[(p["x"], p["y"]) for p in line] for line in table["line"].to_pylist()]
        size = lambda g: (lambda b: (b[2] - b[0]) * (b[3] - b[1]))(_bounds([p for i in g for p in paths[i]]))
        ids = table["id"].to_pylist()
        outer = max(sets.groups(), key=lambda g: (size(g), -min(ids[i] for i in g)), default=[])
        grown = [s for i in outer for s in _extended(paths[i])]
        found = K.faces(grown)
        if not found:
            return []
        best = max((ring for ring, _ in found), key=lambda ring: abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True))))
        return [_bounds(best)]

    content = _per_page(lines(vectors, keys), keys, "c0 double, d0 double, c1 double, d1 double", run)
    joined = pages.select(*keys, *B.CORNERS).join(content, list(keys), "left")
    spare = B.fallback_content(B.Box.named())
    box = [F.coalesce(F.col(c), s).alias(n) for c, s, n in zip(("c0", "d0", "c1", "d1"), spare, B.CORNERS, strict=True)]
    below = F.greatest(F.coalesce(F.col("d1"), spare.y1), F.col("y0"))
    return joined.select(*keys, *box, F.when(below < F.col("y1"), below).alias("info_y0"))


def _extended(path: list[tuple[float, float]], by: float = config.FRAME_EXTENSION) -> list[K.Segment]:
    if len(path) > 1 and np.hypot(path[0][0] - path[-1][0], path[0][1] - path[-1][1]) > 1e-9:

        def out(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
            n = float(np.hypot(b[0] - a[0], b[1] - a[1]))
            return (b[0] + (b[0] - a[0]) * by / n, b[1] + (b[1] - a[1]) * by / n) if n else b

        path = [out(path[1], path[0]), *path[1:-1], out(path[-2], path[-1])]
    return [(*p, *q) for p, q in zip(path, path[1:], strict=False)]


def content_vectors(vectors: DataFrame, regions: DataFrame, keys: Sequence[str] = KEYS, clip: bool = False) -> DataFrame:
    """vectors whose line meets their page's region (keys, box): without those of its frame, or, with clip, cut to it as lines (a row for each part)."""
    frame_ = regions.select(*keys, *[F.col(c).alias(f"r_{c}") for c in B.CORNERS])
    out = T.StructType([*vectors.schema.fields])
    source = vectors.join(frame_, list(keys))

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = []
            for r in rows:
                box = tuple(r.pop(f"r_{c}") for c in B.CORNERS)
                path = [(p["x"], p["y"]) for p in r["points"] or ()]
                if r["type"] in ("rect", "quad") and path:
                    path.append(path[0])
                parts = [(s, K.clipped(s, box)) for s in ((*p, *q) for p, q in zip(path, path[1:], strict=False))]
                inside = [c for _, c in parts if c]
                if not inside:
                    continue
                total = sum(float(np.hypot(s[2] - s[0], s[3] - s[1])) for s, _ in parts)
                within = sum(float(np.hypot(c[2] - c[0], c[3] - c[1])) for c in inside)
                if not clip:
                    if not _of_frame(r, box, within / total if total else 1.0):
                        made.append(r)
                elif all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in path):
                    made.append(r)
                else:
                    chains: list[list[tuple[float, float]]] = []
                    for c in inside:
                        if (c[0], c[1]) == (c[2], c[3]):
                            continue
                        if chains and chains[-1][-1] == (c[0], c[1]):
                            chains[-1].append((c[2], c[3]))
                        else:
                            chains.append([(c[0], c[1]), (c[2], c[3])])
                    for chain in chains:
                        x0, y0, x1, y1 = _bounds(chain)
                        made.append({**r, "type": "line", "points": _ring(chain), "x0": x0, "y0": y0, "x1": x1, "y1": y1})
            from pyspark.sql.pandas.types import to_arrow_schema

            yield pa.RecordBatch.from_pylist(made, schema=to_arrow_schema(out))

    return source.mapInArrow(run, out)


def _of_frame(v: dict, box: tuple[float, float, float, float], share: float) -> bool:
    t = config.FRAME_EDGE
    w, h = v["x1"] - v["x0"], v["y1"] - v["y0"]
    rows = min(abs(a - b) for a in (v["y0"], v["y1"]) for b in (box[1], box[3])) <= t
    columns = min(abs(a - b) for a in (v["x0"], v["x1"]) for b in (box[0], box[2])) <= t
    if w >= (box[2] - box[0]) * config.FRAME_SPAN and h <= t and rows or h >= (box[3] - box[1]) * config.FRAME_SPAN and w <= t and columns:
        return True
    return (rows or columns) and share <= config.FRAME_INSIDE


def circle_pins(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Small circles of the size that most of a page have, one for each rounded box."""
    found = circles(vectors, keys).where((F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= config.PIN_SIZE) & (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= config.CIRCLE_DIAMETER))
    sized = found.withColumn("size", (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) / 2).withColumn("id", F.element_at("vectors", 1))
    return spatial.distinct_regions(intervals.size_vote(cut(sized), keys, "size"), keys=keys, category=None, step=config.PIN_POINT)


def arrow_pins(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Faces of one path's lines that are arrows, with direction, one for each rounded box."""
    own = cells(vectors.where(F.col("type").isin("line", "quad", "rect")), [*keys, "path_index"], config.ARROW_AREA)
    found = own.withColumn("direction", B.arrow_direction(F.col("ring"))).where("direction is not null").withColumn("id", F.element_at("vectors", 1))
    return spatial.distinct_regions(found, keys=keys, category=None, step=config.PIN_POINT)


def wire_marks(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, id, box, angle, length, wire_vector): short slanted lines with free ends whose middle lies on a longer axis-parallel line, of the model that most have; wire_vector is the first such line."""
    from .relations import near_segments

    ends = vectors.where((F.col("type") == "line") & (F.size("points") == 2)).select(*keys, "id", F.get("points", 0).alias("p"), F.get("points", 1).alias("q"))
    ends = ends.withColumns({"length": B.distance(F.col("p"), F.col("q")), "angle": B.line_angle(F.col("p"), F.col("q"))})
    drawn = lambda df: df.select(*keys, "id", "length", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))
    short = cut(ends.where((F.col("length") > 0) & (F.col("length") <= config.MARK_LENGTH) & ~B.is_axis_angle(F.col("angle"))))
    centre = short.select(*keys, "id", "length", *[((F.col(f"p.{a}") + F.col(f"q.{a}")) / 2).alias(f"{a}{i}") for i in (0, 1) for a in "xy"])
    across = near_segments(centre, drawn(ends.where(B.is_axis_angle(F.col("angle")))), config.MARK_CENTRE, keys).where("b_length > a_length and a_id != b_id")
    on = across.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min("b_id").alias("wire_vector"))
    tips = short.select(*keys, "id", F.explode(F.array("p", "q")).alias("t")).select(*keys, "id", *[F.col(f"t.{a}").alias(f"{a}{i}") for i in (0, 1) for a in "xy"])
    touched = near_segments(tips, drawn(ends), config.MARK_END, keys).where("a_id != b_id").select(*keys, F.col("a_id").alias("id")).distinct()
    found = short.join(on, [*keys, "id"]).join(touched, [*keys, "id"], "left_anti")
    box = [F.least("p.x", "q.x").alias("x0"), F.least("p.y", "q.y").alias("y0"), F.greatest("p.x", "q.x").alias("x1"), F.greatest("p.y", "q.y").alias("y1")]
    return intervals.mark_vote(cut(found.select(*keys, "id", *box, "angle", "length", "wire_vector")), keys)


def without(vectors: DataFrame, used: DataFrame, keys: Sequence[str] = KEYS, column: str = "id") -> DataFrame:
    """vectors that are not in used (keys, column)."""
    return vectors.join(used.select(*keys, column).distinct(), [*keys, column], "left_anti")


def without_arrow_lines(vectors: DataFrame, arrows: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = config.RELATION_POINT) -> DataFrame:
    """vectors but for those that lie on the boundary of an arrow (ring), and the arrows' own."""
    own = arrows.select(*keys, F.explode("vectors").alias("id"))
    sides = arrows.select(*keys, F.monotonically_increasing_id().alias("arrow"), F.explode(F.zip_with("ring", F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e"))
    sides = sides.select(*keys, "arrow", F.monotonically_increasing_id().alias("id"), F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))
    from .relations import near_segments

    points = vectors.select(*keys, "id", F.size("points").alias("n"), F.posexplode("points").alias("nth", "t")).select(*keys, F.struct("id", "nth").alias("id"), "n", *[F.col(f"t.{a}").alias(f"{a}{i}") for i in (0, 1) for a in "xy"])
    met = near_segments(points, sides, tolerance, keys).select(*keys, F.col("a_id.id").alias("id"), F.col("a_id.nth").alias("nth"), "a_n", "b_arrow").distinct()
    lying = met.groupBy(*keys, "id", "b_arrow", "a_n").agg(F.count("*").alias("m")).where("m = a_n").select(*keys, "id").distinct()
    return without(without(vectors, own, keys), lying, keys)


def table_vectors(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """vectors that bound tables: no quads or curves, nothing of a path with curves, no slanted lines, no line that is an edge of a quad."""
    edge = lambda p, q: F.array_sort(F.array(p, q))
    quads = vectors.where("type = 'quad' and size(points) >= 4").select(*keys, F.explode(F.array(*[edge(F.get("points", i), F.get("points", (i + 1) % 4)) for i in range(4)])).alias("__edge")).distinct()
    curved = vectors.where("type = 'curve' and path_index is not null").select(*keys, "path_index").distinct()
    kept = vectors.where("type not in ('quad', 'curve')").join(curved, [*keys, "path_index"], "left_anti")
    line = (F.col("type") == "line") & (F.size("points") >= 2)
    p, q = F.get("points", 0), F.get("points", 1)
    straight = kept.where(~line | (p["x"] == q["x"]) | (p["y"] == q["y"])).withColumn("__edge", F.when(line, edge(p, q)))
    return straight.join(quads, [*keys, "__edge"], "left_anti").select(*vectors.columns)


def release_containers(elements: DataFrame, texts: DataFrame, areas: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, id) of dashed elements that frame others: a fifth of the content area (keys, box) or more, with ten device tags and three labelled elements inside."""
    own = elements.where("type = 'dashed'").join(areas.select(*keys, B.area(B.Box.named()).alias("whole")), list(keys)).where(B.area(B.Box.named()) >= config.CONTAINER_AREA_SHARE * F.col("whole"))
    tags = texts.where(X.is_device_tag(F.col("text")))
    held = lambda rows, name: spatial.meet(rows.select(*keys, "id", *B.CORNERS), own.select(*keys, "id", *B.CORNERS), keys=keys).where(B.holds_centre(spatial.Z, spatial.A) & (F.col("a_id") != F.col("b_id") if name == "labelled" else F.lit(True))).groupBy(*keys, F.col("b_id").alias("id")).agg(F.count_distinct("a_id").alias(name))
    labelled = elements.where(F.size("title") > 0)
    both = held(tags, "tags").join(held(labelled, "labelled"), [*keys, "id"])
    return both.where((F.col("tags") >= config.CONTAINER_TAGS) & (F.col("labelled") >= config.CONTAINER_LABELLED)).select(*keys, "id")
