"""Joins of axis-parallel boxes (keys, id, x0, y0, x1, y1) through a grid, and greedy choices among the boxes of a page.

Boxes meet within one value of the keys, such as document and page. The grid has three levels: a box lives at the finest
whose cells it crosses few of, and a pair meets at the coarser of its two levels, in one cell. The levels of both are part
of the key, so small boxes are held against the whole page only where a large one lies on it, and neither a large box nor
a crowd of small ones makes more rows than a few for each box. The join is never broadcast: rows multiply after the size
that Spark knows.

Defined cases: a box with a null or endless coordinate, and a row with a null key, meets nothing; rows that repeat meet
each by itself; an empty table gives an empty result; other columns pass through with their side's prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import boxes as B
from ..plans.runtime import cut, per_group

#: Side of the cells of the two finer levels; the coarsest has one cell for each value of the keys.
CELLS = (64.0, 1024.0)
#: Cells that a box may cross in a direction at its own level.
CROSSED = 4
#: Boxes on a page from which a search without a bound begins at less than its usual distance.
CROWD = 1000
KEYS = ("page",)
A, Z = B.Side("a_"), B.Side("b_")


def _sided(boxes: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    return boxes.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`").alias(f"{side}_{c}") for c in boxes.columns if c not in keys])


def _known(box: B.Box) -> Column:
    known = F.lit(True)
    for v in box:
        known &= v.between(-1e12, 1e12)
    return known


def _levelled(boxes: DataFrame, side: str, keys: Sequence[str], reach: float) -> DataFrame:
    """A row for each level of a partner (the other side's column) and each cell there."""
    box = B.Box.named(f"{side}_")
    known = _known(box)
    for k in keys:
        known &= F.col(f"`{k}`").isNotNull()
    size = F.greatest(box.x1 - box.x0, box.y1 - box.y0) + 2 * reach
    level = F.when(size <= CELLS[0] * CROSSED, 0).when(size <= CELLS[1] * CROSSED, 1).otherwise(2)
    own, other = f"__{side}", "__b" if side == "a" else "__a"
    rows = _sided(boxes, side, keys).where(known).withColumn(own, level).withColumn(other, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    at = F.greatest(own, other)
    cell = F.when(at == 0, CELLS[0]).otherwise(CELLS[1])
    span = lambda low, high: F.when(at == 2, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor((low - reach) / cell), F.floor((high + reach) / cell)))
    return rows.withColumn("__x", F.explode(span(box.x0, box.x1))).withColumn("__y", F.explode(span(box.y0, box.y1)))


def meet(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = KEYS, within: float = 0.0) -> DataFrame:
    """Pairs at most within apart: keys, a_* and b_*. The cell of the pair's lower common corner reports it."""
    left, right = _levelled(a, "a", keys, within), _levelled(b, "b", keys, 0.0)
    joined = left.join(right.hint("merge"), [*keys, "__a", "__b", "__x", "__y"])
    at = F.greatest("__a", "__b")
    cell = F.when(at == 0, CELLS[0]).otherwise(CELLS[1])
    corner = lambda p, q: F.when(at == 2, 0).otherwise(F.floor(F.greatest(p - within, q) / cell))
    once = joined.where((F.col("__x") == corner(A.x0, Z.x0)) & (F.col("__y") == corner(A.y0, Z.y0)))
    return once.drop("__x", "__y", "__a", "__b").where(B.gap(A, Z) <= within)


def _spacing(boxes: DataFrame, keys: Sequence[str], k: int, most: float) -> float:
    """About half the side of a square that holds k boxes on the most crowded page, at most that distance; that distance if no page is crowded."""
    per = boxes.where(_known(B.Box.named())).groupBy(*keys).agg(F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h"))
    side = F.sqrt(F.greatest("w", F.lit(1.0)) * F.greatest("h", F.lit(1.0)) * k / F.col("n"))
    least = per.where(F.col("n") > CROWD).agg(F.min(side)).first()[0]
    return most if least is None else min(most, max(least / 2, most / 256))


def iou_join(a: DataFrame, b: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs that overlap, with overlap (area), iou and coverage (share of b's area inside a)."""
    both = meet(a, b, keys=keys).withColumn("overlap", B.overlap(A, Z)).where("overlap > 0")
    return both.withColumn("iou", B.iou(A, Z)).withColumn("coverage", B.coverage(A, Z))


def smallest_cover(children: DataFrame, parents: DataFrame, share: float = config.CONTAINMENT_SHARE, *, keys: Sequence[str] = KEYS, larger: bool = True) -> DataFrame:
    """(keys, id, parent): the smallest box with at least that share of the child's area (length for lines, cover for points), ties by id.

    With larger, parents are other boxes of strictly more area; without, any box (groups around components).
    """
    good = meet(children, parents, keys=keys).where(B.covered_share(A, Z) >= share)
    if larger:
        good = good.where((F.col("a_id") != F.col("b_id")) & (B.area(Z) > B.area(A)))
    best = good.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min(F.struct(B.area(Z).alias("area"), F.col("b_id").alias("b"))).alias("x"))
    return best.select(*keys, "id", F.col("x.b").alias("parent"))


def smallest_container(items: DataFrame, containers: DataFrame, *, keys: Sequence[str] = KEYS, slack: float = 0.0, by_centre: bool = False, ties_by_centre: bool = True) -> DataFrame:
    """(keys, id, container): the smallest box that covers the item, within slack, or only its centre; ties by centre distance if asked, then id."""
    inside = B.holds_centre(Z, A) if by_centre else B.contains(Z, A, slack)
    good = meet(items, containers, keys=keys, within=slack).where(inside)
    order = F.struct(B.area(Z).alias("area"), *([B.centre_distance(A, Z).alias("d")] if ties_by_centre else []), F.col("b_id").alias("b"))
    return good.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min(order).alias("x")).select(*keys, "id", F.col("x.b").alias("container"))


def adjacent(boxes: DataFrame, margin: float = config.BOX_ADJACENCY, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs (a_id < b_id) at most margin apart of which neither covers the other."""
    return meet(boxes, boxes, keys=keys, within=margin).where((F.col("a_id") < F.col("b_id")) & ~B.contains(A, Z) & ~B.contains(Z, A))


def nearest(a: DataFrame, b: DataFrame, *, k: int = config.NEAREST_COUNT, keys: Sequence[str] = KEYS, reach: float | None = None, order: Sequence[Column] = (), start: float = 64.0, distance: Column | None = None) -> DataFrame:
    """keys, a_*, b_*, distance, rank: the k nearest boxes of each box, ties by order, then b_id. Ids are unique within the keys.

    With reach, none farther. Without it the search widens fourfold for those that have not k yet, until they have, or all of their page;
    it begins at start, or at less where a page is crowded.
    """
    apart = B.gap(A, Z) if distance is None else distance
    mine = Window.partitionBy(*keys, "a_id")
    rank = F.row_number().over(mine.orderBy("distance", *order, "b_id"))

    def within(rows: DataFrame, d: float) -> DataFrame:
        return meet(rows, b, keys=keys, within=d).withColumn("distance", apart).withColumn("rank", rank).where(F.col("rank") <= k)

    if reach is not None:
        return within(a, reach).where(F.col("distance") <= reach)
    whole = b.groupBy(*keys).agg(F.least(F.count("*"), F.lit(k)).alias("__n"))
    open_, out, d = cut(a.join(whole, list(keys))), None, _spacing(b, keys, 2 * k, start)
    while True:
        found = within(open_, d).withColumn("__m", F.count("*").over(mine))
        done = cut(found.where(F.col("__m") >= F.col("a___n")).drop("__m", "a___n"))
        out = done if out is None else out.unionByName(done)
        open_ = cut(open_.join(done.where("rank = 1").select(*keys, F.col("a_id").alias("id")).hint("merge"), [*keys, "id"], "left_anti"))
        if open_.isEmpty() or d > 1e12:
            return out
        d *= 4


def nearest_band(a: DataFrame, b: DataFrame, *, k: int = config.NEAREST_COUNT, ratio: float = config.NEAREST_RATIO, within: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, a_id, b_id, distance, rank): of the k nearest boxes those no farther than ratio times the nearest."""
    ranked = nearest(a, b, k=k, keys=keys, reach=within)
    least = F.min("distance").over(Window.partitionBy(*keys, "a_id"))
    return ranked.withColumn("least", least).where(F.col("distance") <= F.col("least") * ratio + config.NEAREST_SLACK).select(*keys, "a_id", "b_id", "distance", "rank")


def assign_by_proximity(items: DataFrame, targets: DataFrame, threshold: float = config.TEXT_NEAR, *, keys: Sequence[str] = KEYS, margin: float = config.AMBIGUITY, factor: float = config.DIAGONAL_FACTOR) -> DataFrame:
    """(keys, id, target, distance): the nearest target by edge distance, ties by area, then id; none beyond the threshold or with a runner-up within it less than margin behind."""
    apart = B.edge_distance(A, Z, factor)
    order = Window.partitionBy(*keys, "a_id").orderBy("distance", B.area(Z), "b_id")

    def first(rows: DataFrame, reach: float) -> DataFrame:
        # An edge distance may be less than the reach only if the gap is: each is an edge's, or the gap times a factor of at least 1.
        ranked = meet(rows, targets, keys=keys, within=reach).withColumn("distance", apart).where(F.col("distance") <= reach)
        ranked = ranked.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("distance").over(order))
        return ranked.where("rank = 1").select(*keys, F.col("a_id").alias("id"), F.col("b_id").alias("target"), "distance", "next")

    # On crowded pages a nearer search settles those whose runner-up lies within it, or beyond the margin.
    out, open_, reach = None, items, _spacing(targets, keys, 1, threshold) + 2 * margin
    while reach < threshold:
        done = cut(first(open_, reach).where(F.col("distance") + 2 * margin <= reach))
        out = done if out is None else out.unionByName(done)
        open_ = cut(open_.join(done.select(*keys, "id").hint("merge"), [*keys, "id"], "left_anti"))
        reach *= 4
    rest = first(open_, threshold)
    sure = F.col("next").isNull() | (F.col("next") - F.col("distance") >= margin)
    return (rest if out is None else out.unionByName(rest)).where(sure).select(*keys, "id", "target", "distance")


def distinct_regions(regions: DataFrame, *, keys: Sequence[str] = KEYS, category: str | None = "category", step: float = config.CLOSED_EDGE) -> DataFrame:
    """One region of each category and rounded box (halves to even): the first by category, y0, x0, y1, x1, then id."""
    cells = [B.snapped(F.col(c), step) for c in B.CORNERS]
    order = [F.col(c) for c in ("y0", "x0", "y1", "x1", "id")]
    by = [*keys, *([category] if category else []), *cells]
    return regions.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")


def _sorted(table: pa.Table, order: Sequence[tuple[str, str]]) -> pa.Table:
    return table.sort_by(list(order))


def suppress(boxes: DataFrame, *, keys: Sequence[str] = KEYS, weight: str = "weight", most: float = config.SYMBOL_OVERLAP) -> DataFrame:
    """Boxes that stay when, from the heaviest on (ties by id), one goes that overlaps one kept by more than most of the smaller area."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table, [(weight, "descending"), ("id", "ascending")])
        x0, y0, x1, y1 = (np.nan_to_num(table[c].to_numpy().astype(float)) for c in B.CORNERS)
        size = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
        kept: list[int] = []
        for i in range(table.num_rows):
            k = np.array(kept, np.int64)
            shared = np.maximum(np.minimum(x1[k], x1[i]) - np.maximum(x0[k], x0[i]), 0) * np.maximum(np.minimum(y1[k], y1[i]) - np.maximum(y0[k], y0[i]), 0)
            if not (shared > most * np.minimum(size[k], size[i])).any():
                kept.append(i)
        return table.take(pa.array(kept, pa.int64()))

    return per_group(boxes, keys, run)


def pack_sets(candidates: DataFrame, *, keys: Sequence[str] = KEYS, order: Sequence[tuple[str, str]] = (("weight", "descending"), ("symbol", "ascending"), ("y0", "ascending"), ("x0", "ascending")), members: str = "members") -> DataFrame:
    """Candidates that stay when, in that order, one goes that shares a member with one kept."""

    def run(table: pa.Table) -> pa.Table:
        table, taken, kept = _sorted(table, order), set(), []
        for i, own in enumerate(table[members].to_pylist()):
            own = set(own or ())
            if not own & taken:
                kept.append(i)
                taken |= own
        return table.take(pa.array(kept, pa.int64()))

    return per_group(candidates, keys, run)


def anchors(shapes: DataFrame, *, keys: Sequence[str] = KEYS, gap: float = config.ANCHOR_GAP, most: int = 3) -> DataFrame:
    """Up to most well-spread boxes of a group, with their place in the choice (anchor): the farthest pair that does not touch, then always the farthest from those chosen. All of a small group."""
    from pyspark.sql import types as T

    out = T.StructType([*shapes.schema.fields, T.StructField("anchor", T.IntegerType())])

    def run(table: pa.Table) -> pa.Table:
        table = _sorted(table, [("id", "ascending")])
        n = table.num_rows
        x0, y0, x1, y1 = (table[c].to_numpy().astype(float) for c in B.CORNERS)
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        chosen = list(range(n)) if n <= most else []
        if n > most:
            far = np.hypot(cx[:, None] - cx, cy[:, None] - cy)
            apart = np.hypot(np.maximum(np.maximum(x0[:, None] - x1, x0 - x1[:, None]), 0), np.maximum(np.maximum(y0[:, None] - y1, y0 - y1[:, None]), 0)) > gap
            upper = np.triu(np.ones((n, n), bool), 1)
            pool = upper & apart if (upper & apart).any() else upper
            chosen = list(divmod(int(np.argmax(np.where(pool, far, -1.0))), n))[: max(1, most)]
            while len(chosen) < most:
                free = np.ones(n, bool)
                free[chosen] = False
                clear = free & apart[chosen].all(0)
                chosen.append(int(np.argmax(np.where(clear if clear.any() else free, far[chosen].min(0), -1.0))))
        picked = table.take(pa.array(chosen, pa.int64()))
        return picked.append_column("anchor", pa.array(range(len(chosen)), pa.int32()))

    return per_group(shapes, keys, run, out)


def united(boxes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, x0, y0, x1, y1): the box around all boxes of a group."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def largest(boxes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The box with most area of each group, ties by id."""
    rest = [c for c in boxes.columns if c not in (*keys, "id")]
    best = boxes.groupBy(*keys).agg(F.min(F.struct((-B.area(B.Box.named())).alias("__a"), "id", *rest)).alias("x"))
    return best.select(*keys, "x.*").select(*boxes.columns)


def selected(items: DataFrame, area: B.Box, *, keys: Sequence[str] = KEYS, slack: float = 0.25) -> DataFrame:
    """Items inside an area of their page; where there is none, those that meet it."""
    marked = items.where(B.intersects(area, B.Box.named())).withColumn("__in", B.contains(area, B.Box.named(), slack))
    some = F.max("__in").over(Window.partitionBy(*keys))
    return marked.withColumn("__some", some).where("__in or not __some").drop("__in", "__some")


#: What lies under a point in this order of kinds, and the least size that each kind has there.
HIT_ORDER, HIT_SIZE = {"link": 4, "text": 3, "image": 2, "vector": 1}, {"link": 8.0, "text": 4.0, "image": 4.0, "vector": 6.0}


def hits(items: DataFrame, points: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, point, id, kind, rank): items (id, kind, box) under each point (id, x, y): links first, then texts, images, vectors; then the smallest, then by id."""
    size = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in HIT_SIZE.items()], F.lit(0.0))
    grow = lambda low, high: F.greatest((size - (F.col(high) - F.col(low))) / 2, F.lit(0.0))
    dx, dy = grow("x0", "x1"), grow("y0", "y1")
    shown = items.select(*keys, "id", "kind", (F.col("x0") - dx).alias("x0"), (F.col("y0") - dy).alias("y0"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"))
    at = points.select(*keys, "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    place = F.coalesce(*[F.when(F.col("b_kind") == k, v) for k, v in HIT_ORDER.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*keys, "a_id").orderBy(F.desc(place), B.area(Z), "b_id"))
    return meet(at, shown, keys=keys).select(*keys, F.col("a_id").alias("point"), F.col("b_id").alias("id"), F.col("b_kind").alias("kind"), rank.alias("rank"))
