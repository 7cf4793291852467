"""Cutting lineage: tables written to the folder that the session names in spark.checkpoint.dir, and joins that broadcast behind a count."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
#: Rows of a side that is broadcast; with more, it is shuffled.
BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a plain local master without that setting gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _LOCAL[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: survives lost executors, and later plans know its size."""
    path = f"{shared_folder(df.sparkSession)}/tracewright/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it has at most that many rows (BROADCAST_ROWS if not given)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def per_group(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table], pa.Table], schema: T.StructType | str | None = None) -> DataFrame:
    """run on the rows of each group, as Arrow tables; a group is a page or smaller, so it fits a task."""
    return df.groupBy(*keys).applyInArrow(run, schema if schema is not None else df.schema)
