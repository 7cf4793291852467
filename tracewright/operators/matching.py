"""Finding shapes and symbols among pages' vectors, turned, mirrored and scaled.

shapes: symbol, id, type, dashed, points; vectors: keys, id, type, dashed, points. Shapes meet vectors by what no transform changes: type, style and number of
points. A symbol is found from two far shapes whose transforms agree, in bins of them; then all its shapes are looked for where that transform puts them.

Defined cases: shapes of one point match no scale but 1; symbols without shapes match nothing; an empty catalog or page gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import boxes as B
from ..plans.runtime import cut, small
from . import spatial

KEYS = ("page",)
#: Scales and shifts of two anchors that agree.
SCALE_STEP, SHIFT_LEAST = 0.002, 1.0
CLASS = ["type", "dashed", "n"]


def _orders(points: Column, kind: Column) -> Column:
    """Point lists that draw the same: forwards, backwards and, for closed shapes, from each point."""
    n = F.size(points)
    starts = F.when(kind.isin("rect", "quad"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    turned = F.transform(starts, lambda k: F.concat(F.slice(points, k + 1, n), F.slice(points, F.lit(1), k)))
    return F.concat(turned, F.transform(turned, F.reverse))


def shape_matches(shapes: DataFrame, vectors: DataFrame, *, keys: Sequence[str] = KEYS, tolerance: float = config.SHAPE, scales: tuple[float, float] = (0.5, 2.0), rotations: Collection[float] = config.ROTATIONS, mirror: bool = True) -> DataFrame:
    """(keys, symbol, shape, id, degrees, mirrored, scale, dx, dy, error): vectors that a shape becomes within the tolerance, by all its best transforms."""
    own = shapes.select("symbol", F.col("id").alias("shape"), "type", "dashed", F.size("points").alias("n"), F.col("points").alias("source"))
    rows = vectors.select(*keys, "id", "type", "dashed", F.size("points").alias("n"), "points").join(small(own), CLASS)
    rows = rows.withColumn("scale", B.scale_estimate(F.col("source"), F.col("points"))).where(F.col("scale").between(*scales))
    ways = F.array(*[F.struct(F.lit(float(r)).alias("degrees"), F.lit(m).alias("mirrored")) for r in rotations for m in ((False, True) if mirror else (False,))])
    rows = rows.withColumn("way", F.explode(ways)).withColumn("target", F.explode(_orders(F.col("points"), F.col("type"))))
    fit = B.fixed_fit(F.col("source"), F.col("target"), degrees=F.col("way.degrees"), scale=F.col("scale"), mirrored=F.col("way.mirrored"))
    good = rows.withColumn("fit", fit).where(F.col("fit.error") <= tolerance).select(*keys, "symbol", "shape", "id", "way.degrees", "way.mirrored", "scale", "fit.dx", "fit.dy", "fit.error")
    best = F.min("error").over(Window.partitionBy(*keys, "symbol", "shape", "id"))
    return good.withColumn("__best", best).where(F.col("error") <= F.col("__best") + 1e-9).drop("__best").distinct()


def allowed_missing(n: Column, share: float = config.MISSING_VECTORS) -> Column:
    return F.floor(n * share + 1e-12)


def _anchors(shapes: DataFrame) -> DataFrame:
    boxed = shapes.select("symbol", "id", *B.shape_box(F.col("type"), F.col("points")).columns())
    return spatial.anchors(boxed, keys=("symbol",), most=2).select("symbol", F.col("id").alias("shape"), "anchor")


def transform_bins(scale: Column, dx: Column, dy: Column, shift: float) -> list[Column]:
    return [F.floor(scale / SCALE_STEP).alias("s"), F.floor(dx / shift).alias("x"), F.floor(dy / shift).alias("y")]


def agreeing(a: DataFrame, b: DataFrame, by: Sequence[str], shift: float) -> DataFrame:
    """Pairs of rows (degrees, mirrored, scale, dx, dy and by) whose transforms agree within the steps: a's columns and b_<column>, by bins and their neighbours."""
    left = a.select("*", *transform_bins(F.col("scale"), F.col("dx"), F.col("dy"), shift))
    for c in "sxy":
        left = left.withColumn(f"__{c}", F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    equal = [*by, "degrees", "mirrored"]
    right = b.select(*equal, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in equal], *[v.alias(f"__{c}") for v, c in zip(transform_bins(F.col("scale"), F.col("dx"), F.col("dy"), shift), "sxy", strict=True)])
    joined = left.join(right, [*equal, "__s", "__x", "__y"]).drop("__s", "__x", "__y", "s", "x", "y")
    return joined.where((F.abs(F.col("scale") - F.col("b_scale")) <= SCALE_STEP) & (F.abs(F.col("dx") - F.col("b_dx")) <= shift) & (F.abs(F.col("dy") - F.col("b_dy")) <= shift))


def symbol_matches(shapes: DataFrame, vectors: DataFrame, *, keys: Sequence[str] = KEYS, tolerance: float = config.SHAPE, scales: tuple[float, float] = (0.5, 2.5), rotations: Collection[float] = config.ROTATIONS, mirror: bool = True, missing: float = config.MISSING_VECTORS) -> DataFrame:
    """(keys, symbol, degrees, mirrored, scale, dx, dy, weight, members, x0, y0, x1, y1): where symbols are, with the vectors that they have there.

    weight is the symbol's number of shapes, of which a share may be missing (not the two anchors); places that have the same vectors are one.
    """
    shift = max(tolerance, SHIFT_LEAST)
    first = shape_matches(shapes.join(_anchors(shapes).select("symbol", F.col("shape").alias("id")), ["symbol", "id"], "left_semi"), vectors, keys=keys, tolerance=tolerance, scales=scales, rotations=rotations, mirror=mirror)
    found = cut(first.join(F.broadcast(_anchors(shapes)), ["symbol", "shape"]))
    sizes = shapes.groupBy("symbol").agg(F.count("*").alias("weight"))
    alone = found.join(F.broadcast(sizes.where("weight = 1")), "symbol", "left_semi").select(*keys, "symbol", "degrees", "mirrored", "scale", "dx", "dy")
    pairs = agreeing(found.where("anchor = 0"), found.where("anchor = 1"), [*keys, "symbol"], shift).where("id != b_id")
    mean = lambda c: ((F.col(c) + F.col(f"b_{c}")) / 2).alias(c)
    places = pairs.select(*keys, "symbol", "degrees", "mirrored", mean("scale"), mean("dx"), mean("dy")).unionByName(alone).distinct()
    places = cut(places.withColumn("place", F.monotonically_increasing_id()))
    moved = places.join(small(shapes.select("symbol", F.col("id").alias("shape"), "type", "dashed", "points")), "symbol")
    moved = moved.withColumn("points", B.transformed(F.col("points"), degrees=F.col("degrees"), scale=F.col("scale"), dx=F.col("dx"), dy=F.col("dy"), mirrored=F.col("mirrored")))
    asked = moved.select(*keys, F.struct("place", "shape").alias("id"), "type", "dashed", "points", *B.shape_box(F.col("type"), F.col("points")).columns())
    there = vectors.select(*keys, "id", "type", "dashed", "points", *B.shape_box(F.col("type"), F.col("points")).columns())
    met = spatial.meet(asked, there, keys=keys, within=2 * shift).where((F.col("a_type") == F.col("b_type")) & (F.col("a_dashed") == F.col("b_dashed")) & (F.size("a_points") == F.size("b_points")))
    error = F.array_min(F.transform(_orders(F.col("b_points"), F.col("b_type")), lambda p: F.array_max(F.zip_with(F.col("a_points"), p, B.distance))))
    close = met.withColumn("error", error).where(F.col("error") <= tolerance)
    # Each shape takes its closest vector, each vector its closest shape.
    by_shape = F.row_number().over(Window.partitionBy(*keys, "a_id").orderBy("error", "b_id"))
    by_vector = F.row_number().over(Window.partitionBy(*keys, "a_id.place", "b_id").orderBy("error", "a_id.shape"))
    taken = close.withColumn("__s", by_shape).where("__s = 1").withColumn("__v", by_vector).where("__v = 1")
    had = taken.groupBy(*keys, F.col("a_id.place").alias("place")).agg(F.array_sort(F.collect_list("b_id")).alias("members"), F.min("b_x0").alias("x0"), F.min("b_y0").alias("y0"), F.max("b_x1").alias("x1"), F.max("b_y1").alias("y1"), F.sum("error").alias("error"))
    whole = places.join(had, [*keys, "place"]).join(F.broadcast(sizes), "symbol").where(F.size("members") >= F.col("weight") - allowed_missing(F.col("weight"), missing))
    order = Window.partitionBy(*keys, "symbol", "members").orderBy(F.round("error", 6), "degrees", "mirrored", "scale", "dx", "dy")
    columns = [*keys, "symbol", "degrees", "mirrored", "scale", "dx", "dy", "weight", "members", *B.CORNERS]
    return whole.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(columns)


def found_symbols(shapes: DataFrame, vectors: DataFrame, *, keys: Sequence[str] = KEYS, **options) -> DataFrame:
    """symbol_matches that share no vector: those of the most shapes first, then by symbol, y, x."""
    return spatial.pack_sets(cut(symbol_matches(shapes, vectors, keys=keys, **options)), keys=keys)


def same_symbols(shapes: DataFrame, tolerance: float = config.SHAPE) -> DataFrame:
    """(symbol, kept): for each symbol of a catalog the first one (by id) with as many shapes of each class that it matches as a whole, unturned at scale 1; itself if there is none."""
    placed = shapes.withColumn("__o", F.struct(*B.box_of_points(F.flatten(F.collect_list("points").over(Window.partitionBy("symbol"))))[:2]))
    local = placed.withColumn("points", F.transform("points", lambda p: B.point(p["x"] - F.col("__o.col1"), p["y"] - F.col("__o.col2")))).drop("__o")
    local = cut(local)
    classed = local.withColumn("n", F.size("points"))
    signature = classed.groupBy("symbol", *CLASS).agg(F.count("*").alias("m")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*CLASS, "m"))).alias("signature"), F.sum("m").alias("size"))
    a = classed.join(signature, "symbol").select("signature", "size", F.col("symbol").alias("a"), F.col("id").alias("a_id"), *CLASS, F.col("points").alias("p"))
    b = classed.join(signature, "symbol").select("signature", F.col("symbol").alias("b"), F.col("id").alias("b_id"), *CLASS, F.col("points").alias("q"))
    error = F.array_min(F.transform(_orders(F.col("q"), F.col("type")), lambda o: F.array_max(F.zip_with(F.col("p"), o, B.distance))))
    close = a.join(b, ["signature", *CLASS]).where("b < a").withColumn("error", error).where(F.col("error") <= tolerance)
    one = close.groupBy("a", "b", "size", "a_id").agg(F.min(F.struct("error", "b_id")).alias("x")).groupBy("a", "b", "size").agg(F.count_distinct("x.b_id").alias("m")).where("m = size")
    kept = one.groupBy(F.col("a").alias("symbol")).agg(F.min("b").alias("kept"))
    return signature.select("symbol").join(kept, "symbol", "left").select("symbol", F.coalesce("kept", "symbol").alias("kept"))


def paired_lines(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = config.SHAPE) -> DataFrame:
    """(keys, a, b): lines (id, points) paired one to one, from the first id of left on with the first free one of right whose points are all within the tolerance, in either direction."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*(left.schema[k] for k in keys), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        path = lambda t: sorted((i, [(p["x"], p["y"]) for p in line]) for i, line in zip(t["id"].to_pylist(), t["points"].to_pylist(), strict=True))
        free, rows = path(two), []
        for i, p in path(one):
            for k, (j, q) in enumerate(free):
                if len(p) == len(q) and min(max(math.dist(s, t) for s, t in zip(p, o, strict=True)) for o in (q, q[::-1])) <= tolerance:
                    rows.append((i, j))
                    del free[k]
                    break
        heads = [pa.array([k.as_py()] * len(rows), one.schema.field(n).type if one.num_rows else two.schema.field(n).type) for k, n in zip(key, keys, strict=True)]
        return pa.table([*heads, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=[f.name for f in schema.fields])

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
