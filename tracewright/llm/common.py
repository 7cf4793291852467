"""What the training-data operators share: the shared folder, row keys and joins that keep repeated rows apart."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a plain local master without that setting gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _LOCAL[app]


#: Rows in an Arrow batch at most, so that batches of long texts stay small in the JVM and in Python.
BATCH_ROWS = 2000


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder. Arrow batches of the session are limited to BATCH_ROWS rows, as the operators hold whole batches of texts."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))
    return f"{shared_root(spark)}/tracewright/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*written: DataFrame) -> None:
    """Deletes what materialize wrote, when nothing reads it any more."""
    for df in written:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished plans now, and not when the driver happens to collect its garbage."""
    for _ in range(2):  # a second time, for what the first one lets go
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)


def as_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def row_key(name: str = "text") -> Column:
    """Tells rows that share a doc_id apart by their text."""
    return F.xxhash64(F.col(name))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Rows of a few longs that a join broadcasts; with more, it shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it has at most that many rows (BROADCAST_ROWS if not given)."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, prefix: str = "__column") -> tuple[DataFrame, list[Column]]:
    """df with its columns renamed by place, so that none clashes with a name of ours, and the columns that name them back."""
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))]), [F.col(f"{prefix}{i}").alias(c) for i, c in enumerate(df.columns)]


def place_of(df: DataFrame, name: str, prefix: str = "__column") -> Column:
    """The column called name, in numbered(df)."""
    return F.col(f"{prefix}{[c.lower() for c in df.columns].index(name)}")


def apply_copies(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs with each row repeated as often as decided says, whatever its columns are called.

    decided holds doc_id, row_key and copies, a row for each row of docs, 0 for those that go. Rows of docs equal in doc_id and text
    take the copies of their rows of decided in falling order. Null ids match null ids. Of such rows only the numbers of copies are
    gathered, with how many rows have each, so rows that repeat without end are never in one list.
    """
    plain, back = numbered(docs)
    keys = decided.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), F.col("copies").cast("int").alias("__c")).groupBy("__d", "__k", "__c").agg(F.count("*").alias("__m"))
    listed = keys.groupBy("__d", "__k").agg(F.sort_array(F.collect_list(F.struct("__c", "__m")), asc=False).alias("__cs"), F.max("__c").alias("__n"))
    listed = materialize(listed, "copies")
    keyed = plain.select("*", place_of(docs, "doc_id").alias("__doc"), F.xxhash64(place_of(docs, "text")).alias("__key"))
    same = lambda left, right: left["__doc"].eqNullSafe(right["__d"]) & (left["__key"] == right["__k"])
    # Nearly all rows are taken once; the others are told, whatever is left stays.
    alone = small(listed.where("size(__cs) > 1 or __n != 1").select("__d", "__k", F.when(F.size("__cs") == 1, F.col("__n")).otherwise(0).alias("__n")))
    single = keyed.join(alone, same(keyed, alone), "left").withColumn("__n", F.coalesce("__n", F.lit(1))).where("__n > 0")
    single = single.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__n")))).select(*back)
    odd = listed.where("size(__cs) > 1").select("__d", "__k", "__cs")
    if odd.isEmpty():
        return single
    odd = small(odd)
    # A row's rank among its equals: its place within a task's own ones, after those of the tasks before.
    several = materialize(keyed.join(odd, same(keyed, odd)).withColumn("__task", F.spark_partition_id()), "several")
    counts = several.groupBy("__d", "__key", "__task").agg(F.count("*").alias("__in"))
    before = F.coalesce(F.sum("__in").over(Window.partitionBy("__d", "__key").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = small(materialize(counts.select(F.col("__d").alias("__sd"), F.col("__key").alias("__sk"), F.col("__task").alias("__st"), before.alias("__shift")), "shifts"))
    ranked = several.withColumn("__rn", F.row_number().over(Window.partitionBy("__d", "__key", "__task").orderBy("__key")))
    ranked = ranked.join(shifts, F.col("__d").eqNullSafe(F.col("__sd")) & (F.col("__key") == F.col("__sk")) & (F.col("__task") == F.col("__st"))).withColumn("__rank", F.col("__rn") + F.col("__shift"))
    # The first run of equal copies whose rows, with those of the runs before, reach the rank.
    run = F.aggregate("__cs", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("n"), F.lit(False).alias("done")), lambda a, x: F.when(a["done"], a).otherwise(F.struct((a["upto"] + x["__m"]).alias("upto"), x["__c"].alias("n"), (a["upto"] + x["__m"] >= F.col("__rank")).alias("done"))))
    return single.unionByName(ranked.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), run["n"]))).select(*back))


class Memo(dict):
    """What a Python worker remembers of words, at most room of them. The first ones, often the frequent ones, stay longest."""

    room = 250_000

    def put(self, key, value):
        if len(self) >= self.room:
            for old in list(islice(self, self.room // 2, None)):
                del self[old]
        self[key] = value
        return value


_KEPT: list = [None, None]


def kept(name: object, make: Callable[[], Memo]) -> Memo:
    """The worker's memo of that name, made anew if it last served another one; it outlives the task."""
    if _KEPT[0] != name:
        _KEPT[:] = [name, make()]
    return _KEPT[1]


def give_back() -> None:
    """Returns a Python worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, whose worker gives free memory back at the end of a task; idle workers outlive their stage."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


#: Keys of a filter for each of its words of 64 bits, and words that one group of keys fills.
KEYS_A_WORD, SEGMENT = 5, 1 << 11


def _marks(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key in a filter, and the four bits that it sets there."""
    one = np.uint64(1)
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    at = ((x >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64)
    bits = np.zeros(len(x), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= one << (x >> np.uint64(shift) & np.uint64(63))
    return at, bits


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """A filter of the n longs in the only column of keys, of 13 bits each: held() is true of them all, and of one in a hundred others."""
    words = max(1, -(-n // KEYS_A_WORD))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_marks(batch.column(0).to_numpy(), words)[0] // SEGMENT), batch.column(0)], names=["segment", "key"])

    def fill(table: pa.Table) -> pa.Table:
        first = table["segment"][0].as_py() * SEGMENT
        at, bits = _marks(table["key"].to_numpy(), words)
        out = np.zeros(min(SEGMENT, words - first), np.uint64)
        np.bitwise_or.at(out, at - first, bits)
        return pa.table([pa.array([first // SEGMENT]), pa.array([out.tobytes()], pa.binary())], names=["segment", "bits"])

    parts = keys.mapInArrow(lean(deal), "segment long, key long").groupBy("segment").applyInArrow(fill, "segment long, bits binary").toArrow()
    out = np.zeros(words, np.uint64)
    for segment, bits in zip(parts["segment"].to_pylist(), parts["bits"], strict=True):
        own = np.frombuffer(bits.as_buffer(), np.uint64)
        out[segment * SEGMENT : segment * SEGMENT + len(own)] = own
    return out


def held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (longs) a filter may hold."""
    at, bits = _marks(keys, len(table))
    return table[at] & bits == bits
