"""Exact duplicates by content-defined chunk recipes.

Each text without its white space is cut where a rolling hash of the last 32 bytes says so, so equal texts have equal
cuts. A chunk's identifier is its SHA-256, verified: the bytes behind each identifier are compared, for all documents
whose lists of identifiers look alike, and chunks of one digest but different bytes get different variants. Documents
with equal ordered lists of verified identifiers are copies. Long texts move at most once, chunk by chunk and only if a
twin is likely; the lists and keys do the rest.

Defined cases: a null text is empty, and all texts without a character other than white space are copies of each other;
a null doc_id comes after all others; of rows equal in everything, one stays; an empty table gives an empty result;
a very long text is a long list of chunks; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apply_copies, as_bytes, batch_of, lean, materialize, row_key

SPACE = b" \t\n\x0b\x0c\r"
#: Mean chunk of 2 to the BITS bytes; bounds of a chunk in bytes.
BITS, LEAST, MOST = 11, 256, 65_536
#: Candidate keys (8 bytes each) that are broadcast; with more, the chunks are filtered by a join.
BROADCAST_KEYS = 4_000_000
#: Bytes of recipes, about, whose table of groups is broadcast.
BROADCAST_BYTES = 64 << 20
_GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data, by its content alone."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    out, at = [], 0
    for end in (np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1).tolist():
        if end - at < LEAST:
            continue
        while end - at > MOST:
            at += MOST
            out.append(at)
        if end > at:
            out.append(end)
            at = end
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _key(recipe: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(recipe), digest_size=8).digest(), "little", signed=True)


def recipes(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """doc_id, row_key, row (a number of the row), n_chars, text_sha256, recipe, recipe_key."""
    schema = pa.schema([("row", pa.int64()), ("text_sha256", pa.string()), ("recipe", pa.list_(pa.binary())), ("recipe_key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            rows, shas, lists, keys = [], [], [], []
            for data in batch.column(3):
                data = data.as_py().translate(None, SPACE)
                recipe = [digest(c) for c in _chunks(data)]
                rows.append(row)
                shas.append(hashlib.sha256(data).hexdigest())
                lists.append(recipe)
                keys.append(_key(recipe))
                row += 1
            new = batch_of(schema, [rows, shas, lists, keys])
            yield pa.record_batch([*batch.columns[:3], *new.columns], names=["doc_id", "row_key", "n_chars", *schema.names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), as_bytes().alias("data"))
    return source.mapInArrow(lean(run), "doc_id long, row_key long, n_chars long, row long, text_sha256 string, recipe array<binary>, recipe_key long")


def _candidate_chunks(docs: DataFrame, keys: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, row_key, recipe_key, place, chunk_id, chunk of the rows whose recipe_key is in keys."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    known = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(keys.toArrow().column(0).to_numpy(), np.int64))) if few else None
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("recipe_key", pa.int64()), ("place", pa.int64()), ("chunk_id", pa.binary()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value if known is not None else None
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            held = 0
            for doc_id, key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                chunks = _chunks(data.as_py().translate(None, SPACE))
                recipe = [digest(c) for c in chunks]
                k = _key(recipe)
                if table is not None and (len(table) == 0 or table[min(np.searchsorted(table, k), len(table) - 1)] != k):
                    continue
                for place, (i, c) in enumerate(zip(recipe, chunks, strict=True)):
                    for column, value in zip(out, (doc_id, key, k, place, i, c), strict=True):
                        column.append(value)
                    held += len(c)
                if held > 16_000_000:
                    yield batch_of(schema, out)
                    out, held = [[] for _ in schema], 0
            yield batch_of(schema, out)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), as_bytes().alias("data"))
    made = source.mapInArrow(lean(run), "doc_id long, row_key long, recipe_key long, place long, chunk_id binary, chunk binary")
    return made if few else made.join(keys, "recipe_key", "left_semi")


def exact_groups(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row_key: a row for each row of docs."""
    listed = materialize(recipes(docs, digest), "recipes")
    keys = materialize(listed.groupBy("recipe_key").count().where("count > 1").select("recipe_key"), "recipe-keys")
    chunks = _candidate_chunks(docs, keys, digest)
    # The distinct bytes behind each identifier; almost never more than one.
    clashes = materialize(chunks.select("chunk_id", "chunk").distinct().groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"), "chunk-clashes")
    listed = listed.withColumn("variants", F.array().cast("array<int>"))
    if not clashes.isEmpty():
        odd = chunks.join(clashes, "chunk_id")
        variants = odd.select("chunk_id", "chunk").distinct().withColumn("variant", F.row_number().over(Window.partitionBy("chunk_id").orderBy("chunk")))
        told = odd.join(variants, ["chunk_id", "chunk"]).groupBy("doc_id", "row_key").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "variant"))), lambda x: x["variant"]).alias("__v"))
        told = told.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__k"), "__v")
        listed = listed.join(told, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("row_key") == F.col("__k")), "left").withColumn("variants", F.coalesce("__v", "variants")).drop("__d", "__k", "__v")
    # Of equal texts the longest original stays, then the smallest id (null after all others), then the first row.
    none = F.lit(2**63 - 1)
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.coalesce("doc_id", none).alias("d"), F.col("row").alias("r")))
    groups = listed.groupBy("recipe", "variants").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1").select(F.col("recipe").alias("__recipe"), F.col("variants").alias("__variants"), "n", "best")
    # Broadcast behind a sum of its bytes; beyond it the written tables are joined, so a hot recipe's rows can be split over tasks.
    groups = materialize(groups, "copies-groups")
    held = groups.agg(F.coalesce(F.sum(60 + 40 * F.size("__recipe")), F.lit(0))).first()[0]
    groups = F.broadcast(groups) if held <= BROADCAST_BYTES else groups
    out = listed.join(groups, (F.col("recipe") == F.col("__recipe")) & (F.col("variants") == F.col("__variants")), "left")
    alone = F.col("n").isNull()
    first = F.when(F.col("best.d") == none, F.lit(None)).otherwise(F.col("best.d"))
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(first).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.r") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row_key",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    return apply_copies(docs, exact_groups(docs).select("doc_id", "row_key", F.col("kept").cast("int").alias("copies")))


