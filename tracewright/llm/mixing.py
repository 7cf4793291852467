"""Mixing sources to target weights by pivotal dependent rounding.

A source's rows share one copy probability, target / source size, whose whole part is a number of certain copies. The
fractions are rounded in pairs: words of probability mass move from one row to the other, at random and without bias,
until one of the two is a whole copy or none. So the sum of words stays the target's, but for the last row of all.
Rows are dealt into small groups by a hash; each group leaves at most one fractional row, and those meet again in groups
64 times wider, as a reduction tree, up to one for each source.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, last in order; rows that
repeat count each by itself; an empty table gives an empty result; a very long text is one row of a large size; columns besides doc_id, text and source are not read, whatever their names, and pass through mixed_documents().
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, apply_copies, lean, materialize, row_key

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
#: Rows that one task rounds in one go, and the width of the reduction tree.
GROUP_ROWS, FAN_BITS = 256, 6
#: Sources whose table is broadcast and whose targets are set on the driver; with more, Spark does both, with the same result.
BROADCAST_SOURCES = 10_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], cap: float = MAX_COPIES) -> list[float]:
    """Targets in proportion to weights with the sum of sizes, none above cap times its size; the excess goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        share = sum(weights[i] for i in free)
        level = left / share if share else 0.0
        full = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        gone = set(full)
        free = [i for i in free if i not in gone]
    return out


def pivot(sizes: Sequence[float], parts: Sequence[float], rng: random.Random, last: bool) -> list[float]:
    """Rounds parts (0..1) so that the sum of sizes times parts stays; at most one part is left between, none if last."""
    f, held = list(parts), -1
    for j in range(len(f)):
        if not 0.0 < f[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        to_i = min(sizes[i] * (1 - f[i]), sizes[j] * f[j])
        to_j = min(sizes[i] * f[i], sizes[j] * (1 - f[j]))
        if rng.random() * (to_i + to_j) < to_j:
            first = sizes[i] * (1 - f[i]) <= sizes[j] * f[j]
            f[i], f[j] = (1.0, max(0.0, f[j] - to_i / sizes[j])) if first else (min(1.0, f[i] + to_i / sizes[i]), 0.0)
        else:
            first = sizes[i] * f[i] <= sizes[j] * (1 - f[j])
            f[i], f[j] = (0.0, min(1.0, f[j] + to_j / sizes[j])) if first else (max(0.0, f[i] - to_j / sizes[i]), 1.0)
        for k in (i, j):
            f[k] = 0.0 if f[k] < 1e-12 else 1.0 if f[k] > 1 - 1e-12 else f[k]
        held = i if 0 < f[i] < 1 else j if 0 < f[j] < 1 else -1
    if last and held >= 0:
        f[held] = float(rng.random() < f[held])
    return f


def _targets_here(sources: DataFrame, weight_of: Callable[[int, str | None], float], cap: int) -> DataFrame:
    """source_no, source, n, source_size, target of a table of sources that the driver can hold."""
    found = sorted(sources.collect(), key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    targets = water_fill([r.size for r in found], [weight_of(i, r.source) for i, r in enumerate(found)], cap)
    rows = [(i, r.source, r.n, r.size, t) for i, (r, t) in enumerate(zip(found, targets, strict=True))]
    return sources.sparkSession.createDataFrame(rows, "source_no long, source string, n long, source_size long, target double")


def _targets_there(sources: DataFrame, weight_of: Callable[[int, str | None], float], cap: int) -> DataFrame:
    """The same by Spark: places by a range sort, and the level of the shares by one sum for each round of resharing."""
    out = T.StructType([*sources.schema.fields, T.StructField("none", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType())])
    dealt = sources.withColumn("none", F.col("source").isNull())
    ranged = dealt.repartitionByRange("none", "source").sortWithinPartitions("none", "source").withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(range(at, at + batch.num_rows), pa.int64())], names=[f.name for f in out.fields])
            at += batch.num_rows

    placed = materialize(ranged.mapInArrow(lean(number), out), "mix-places")
    parts = placed.groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect()  # a row for each task
    shifts, at = {}, 0
    for r in parts:
        shifts[r["part"]] = at
        at += r["rows"]
    shift = F.element_at(F.create_map(*[F.lit(x) for pair in shifts.items() for x in pair]), F.col("part"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [float(weight_of(i, name)) for i, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(weights, pa.float64())], names=["source_no", "source", "n", "source_size", "weight"])

    numbered_ = placed.select((shift + F.col("nth")).cast("long").alias("source_no"), "source", "n", F.col("size").alias("source_size"))
    weighed = materialize(numbered_.mapInArrow(lean(weigh), "source_no long, source string, n long, source_size long, weight double"), "mix-weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    full, left = F.lit(False), float(total)
    level = 0.0
    while True:
        share = weighed.where(~full).agg(F.sum("weight")).first()[0]
        if not share:
            break
        level = left / share
        now = full | (F.lit(level) * F.col("weight") > cap * F.col("source_size"))
        found = weighed.where(now & ~full).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
        if not found[0]:
            break
        # Levels only rise, so what was full stays so: the last level tells all of them.
        full, left = F.lit(level) * F.col("weight") > cap * F.col("source_size"), left - float(cap * found[1])
    target = F.when(full, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select("source_no", "source", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, *, weight_of: Callable[[int, str | None], float] | None = None, max_copies: int = MAX_COPIES, seed: int = 17) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, copies, taken: a row for each row of docs.

    weight_of gets a source's place in code point order (null last) and its name; WEIGHTS repeats if it is not given.
    """
    weight_of = weight_of or (lambda i, _: WEIGHTS[i % len(WEIGHTS)])
    sizes = materialize(docs.select("doc_id", row_key().alias("row_key"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    sources = materialize(sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mix-sources")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = (_targets_here if few else _targets_there)(sources, weight_of, max_copies)
    p = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.least(F.floor("p"), F.lit(max_copies)).cast("int")
    plan = plan.withColumn("p", p).withColumn("whole", whole).withColumn("part", F.when(F.col("whole") < max_copies, F.col("p") - F.col("whole")).otherwise(0.0))
    plan = plan.withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_ROWS)).cast("long")).drop("p", "n")
    widest = plan.agg(F.coalesce(F.max("groups"), F.lit(1))).first()[0]
    plan = F.broadcast(plan) if few else materialize(plan, "mix-plan")
    rows_of = sizes.withColumnRenamed("source", "__source").join(plan, F.col("__source").eqNullSafe(F.col("source"))).drop("__source")
    even = (F.col("size") == 0) | (F.col("part") <= 0)
    done = rows_of.where(even).withColumn("copies", F.col("whole"))
    open_ = rows_of.where(~even).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key", F.lit(seed)), F.col("groups")))
    levels = 0
    while (widest - 1) >> (FAN_BITS * levels):
        levels += 1
    out = T.StructType([f for f in open_.schema.fields])

    def rounding(level: int):
        def apply(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            # Largest first, so the row left between is a small one.
            rows = rows.sort_by([("size", "descending"), *((c, "ascending") for c in ("doc_id", "row_key", "part"))])
            rng = random.Random(f"{seed}/{level}/{key[0].as_py()}/{key[1].as_py()}")
            parts = pivot(rows["size"].to_pylist(), rows["part"].to_pylist(), rng, level == levels)
            return rows.set_column(rows.schema.get_field_index("part"), "part", pa.array(parts, pa.float64()))

        return apply

    for level in range(levels + 1):
        rounded = materialize(open_.groupBy("source_no", F.shiftright("bucket", FAN_BITS * level).alias("group")).applyInArrow(rounding(level), out), f"mix-{level}")
        whole = F.col("part").isin(0.0, 1.0)
        done = done.unionByName(rounded.where(whole).withColumn("copies", (F.col("whole") + F.col("part")).cast("int")).drop("bucket"))
        open_ = rounded.where(~whole)
    return done.select("doc_id", "row_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: rows not taken go, others repeat."""
    return apply_copies(docs, mix(docs, **options))
