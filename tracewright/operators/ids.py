"""Numbers, ranks and lists of rows within groups.

Defined cases: null keys are a group; nulls in the order come first; values that repeat count once where a list is of unique values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "id") -> DataFrame:
    """rows with dense numbers from 0 within each group, in that order."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def listed(rows: DataFrame, column: str, place: str = "place") -> DataFrame:
    """A row for each item of a list, with its place as its id."""
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(column).alias(place, "item"))


def runner_up(rows: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """The row of the least value of each group, ties by another column, and margin: how far the second one is, null without one."""
    order = Window.partitionBy(*keys).orderBy(value, tie)
    return rows.withColumn("__n", F.row_number().over(order)).withColumn("margin", F.lead(value).over(order) - F.col(value)).where("__n = 1").drop("__n")


def unique_in_order(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, values): each value of a group once, by where it is first."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("__first"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__first", value))).alias("x")).select(*keys, F.transform("x", lambda s: s[value]).alias("values"))


def ranked(rows: DataFrame, column: str = "id", tasks: int = 200) -> DataFrame:
    """rows with rank from 1 on, in the order of ids over the whole table: sorted by range, then numbered by task, so no task sees all rows."""
    from ..plans.runtime import cut, small

    ordered = rows.withColumn("__o", T.id_order(F.col(column)))
    keys = [F.col(f"__o.{c}") for c in ("page", "kind", "number", "local")]
    ranged = cut(ordered.repartitionByRange(tasks, *keys).withColumn("__task", F.spark_partition_id()))
    counts = ranged.groupBy("__task").agg(F.count("*").alias("n"))
    shifts = counts.select("__task", (F.sum("n").over(Window.orderBy("__task")) - F.col("n")).alias("__shift"))  # a row for each task
    nth = F.row_number().over(Window.partitionBy("__task").orderBy(*keys))
    return ranged.withColumn("__nth", nth).join(small(shifts), "__task").withColumn("rank", F.col("__nth") + F.col("__shift")).drop("__o", "__task", "__nth", "__shift")
