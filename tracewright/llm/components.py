"""Connected components of a graph of long ids, by alternating large and small stars. Each round is a written table,
deleted when the next one is there.

The least neighbours are a table of their own, broadcast behind a count. Beyond it the join reads that table and the edges as
they are written, without a sum between the shuffle and the join, so a hub's edges can be split over tasks as the plan runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize, small


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """v, root: for each id in edges (columns u, v) other than its component's smallest, that smallest."""
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    before = _mark(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = materialize(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m")), tag)
        large = both.join(small(near), F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, tag)
        forget(edges, near)
        least = materialize(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), tag)
        tight = large.join(small(least), F.col("u") == F.col("c")).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        edges = materialize(tight.where("u != v").distinct(), tag)
        forget(large, least)
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
