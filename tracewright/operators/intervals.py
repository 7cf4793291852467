"""One-dimensional intervals, running-mean clusters and the grids that they make.

Folds run within one group, such as a page. Defined cases: null values are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..plans.runtime import per_group


def union_length(df: DataFrame, keys: str | Sequence[str], start: str, stop: str, *, join: float = 0.0, low: str | None = None, high: str | None = None) -> DataFrame:
    """(keys, pieces, covered): the union of a key's intervals, those at most join apart as one, clipped to low and high if those columns are given."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if low:
        df = df.where((F.col(start) < F.col(high)) & (F.col(stop) > F.col(low))).withColumn(start, F.greatest(start, low)).withColumn(stop, F.least(stop, high))
    df = df.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    order = Window.partitionBy(*keys).orderBy(start, stop)
    before = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("new", F.when(before.isNull() | (F.col(start) > before + join), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*keys, "island").agg(F.min(start).alias("a"), F.max(stop).alias("b"))
    return runs.groupBy(*keys).agg(F.count("*").alias("pieces"), F.sum(F.col("b") - F.col("a")).alias("covered"))


def _running_means(values: np.ndarray, reach: float) -> list[int]:
    """Where each cluster starts: a sorted value joins the last one if it is at most reach from its mean so far."""
    starts: list[int] = []
    total = count = 0.0
    for i, v in enumerate(values.tolist()):
        if count and abs(v - total / count) <= reach:
            total, count = total + v, count + 1
        else:
            starts.append(i)
            total, count = v, 1.0
    return starts


def running_mean_clusters(df: DataFrame, key: str, value: str, reach: float = config.GRID_COORDINATE) -> DataFrame:
    """(key, cluster, members, mean): sorted values join the last cluster if they are at most reach from its running mean."""
    out = T.StructType([df.schema[key], T.StructField("cluster", T.LongType()), T.StructField("members", T.LongType()), T.StructField("mean", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        v = np.sort(table[value].to_numpy().astype(float))
        starts = _running_means(v, reach)
        ends = [*starts[1:], len(v)]
        return pa.table([pa.array([table[key][0].as_py()] * len(starts), table.schema.field(key).type), pa.array(range(len(starts)), pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array([float(sum(v[a:b].tolist()) / (b - a)) for a, b in zip(starts, ends, strict=True)])], names=[key, "cluster", "members", "mean"])

    return per_group(df.where(F.col(value).isNotNull()).select(key, value), [key], run, out)


def size_vote(df: DataFrame, keys: Sequence[str], size: str, *, absolute: float = config.CIRCLE_SIZE_ABSOLUTE, relative: float = config.CIRCLE_SIZE_RELATIVE) -> DataFrame:
    """The rows of the largest cluster of sizes; then the tightest, then that of the least mean. Sizes in order join the nearest cluster whose mean is within tolerance."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(size, "ascending")])
        clusters: list[list[int]] = []
        v = table[size].to_pylist()
        for i, s in enumerate(v):
            means = [sum(v[k] for k in c) / len(c) for c in clusters]
            near = [(abs(s - m), n) for n, m in enumerate(means) if abs(s - m) <= max(absolute, m * relative)]
            if near:
                clusters[min(near)[1]].append(i)
            else:
                clusters.append([i])
        rank = lambda c: (len(c), -(max(v[k] for k in c) - min(v[k] for k in c)), -sum(v[k] for k in c) / len(c))
        return table.take(pa.array(max(clusters, key=rank), pa.int64()))

    return per_group(df.where(F.col(size).isNotNull()), keys, run)


def mark_vote(df: DataFrame, keys: Sequence[str], angle: str = "angle", length: str = "length", *, degrees: float = config.MARK_ANGLE_DEGREES, relative: float = config.MARK_LENGTH_RELATIVE, absolute: float = config.PIN_POINT) -> DataFrame:
    """The rows of the largest cluster of (angle, length), then of the one whose lengths differ least, then the first.

    In order of both, a row joins the cluster whose means are nearest, in units of the tolerances, of those within both.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(angle, "ascending"), (length, "ascending")])
        a, n, clusters = table[angle].to_pylist(), table[length].to_pylist(), []
        for i in range(len(a)):
            near = []
            for k, c in enumerate(clusters):
                mean = sum(n[j] for j in c) / len(c)
                reach, turn = max(absolute, mean * relative), abs(a[i] - sum(a[j] for j in c) / len(c))
                if abs(n[i] - mean) <= reach and turn <= degrees:
                    near.append((abs(n[i] - mean) / reach + turn / degrees, k))
            if near:
                clusters[min(near)[1]].append(i)
            else:
                clusters.append([i])
        best = max(clusters, key=lambda c: (len(c), min(n[j] for j in c) - max(n[j] for j in c)))
        return table.take(pa.array(best, pa.int64()))

    return per_group(df, keys, run)


def edges_of(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """(keys, index, start, end): the intervals between the distinct edges of boxes along an axis, in order."""
    edges = df.select(*keys, F.explode(F.array(low, high)).alias("start")).where("start is not null").distinct()
    order = Window.partitionBy(*keys).orderBy("start")
    return edges.withColumn("index", F.row_number().over(order) - 1).withColumn("end", F.lead("start").over(order)).where("end is not null").select(*keys, "index", "start", "end")


def grid(faces: DataFrame, tables: DataFrame, *, keys: Sequence[str] = ("page",), reach: float = config.GRID_COORDINATE, share: float = config.GRID_COVERAGE) -> DataFrame:
    """(keys, row, col, x0, y0, x1, y1): the cells of each table between the boundaries that its faces' edges cover for the most part, and its own.

    faces and tables: keys, x0, y0, x1, y1; a table for each value of the keys.
    """

    def axis(i: int) -> DataFrame:
        low, high, across_low, across_high = (("x0", "x1", "y0", "y1"), ("y0", "y1", "x0", "x1"))[i]
        ends = faces.select(*keys, F.explode(F.array(low, high)).alias("v"))
        key = F.struct(*keys)
        centres = running_mean_clusters(ends.select(key.alias("k"), "v"), "k", "v", reach).select("k.*", F.col("mean").alias("c"))
        outer = tables.select(*keys, F.col(low).alias("t0"), F.col(high).alias("t1"), F.col(across_low).alias("lo"), F.col(across_high).alias("hi"))
        at = centres.join(faces, list(keys)).where((F.abs(F.col(low) - F.col("c")) <= reach) | (F.abs(F.col(high) - F.col("c")) <= reach))
        spans = at.select(*keys, "c", F.col(across_low).alias("a"), F.col(across_high).alias("b")).join(outer.select(*keys, "lo", "hi"), list(keys))
        covered = union_length(spans, [*keys, "c"], "a", "b", join=reach, low="lo", high="hi").join(outer, list(keys)).where(F.col("covered") >= F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0)) * share)
        chosen = covered.select(*keys, F.col("c").alias("v")).unionByName(outer.select(*keys, F.explode(F.array("t0", "t1")).alias("v")))
        means = running_mean_clusters(chosen.select(key.alias("k"), "v"), "k", "v", reach).select("k.*", F.col("cluster").alias("n"), F.col("mean").alias("start"))
        order = Window.partitionBy(*keys).orderBy("n")
        return means.withColumn("end", F.lead("start").over(order)).where("end is not null").select(*keys, F.col("n").alias(("col", "row")[i]), F.col("start").alias(f"{'xy'[i]}0"), F.col("end").alias(f"{'xy'[i]}1"))

    return axis(0).join(axis(1), list(keys)).select(*keys, "row", "col", "x0", "y0", "x1", "y1")
