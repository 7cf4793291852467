"""Graph stores, caches and checkpoints as tables that are only added to; what is live is found when they are read.

A save adds a batch. Readers take the rows of the latest batch of each key, so a save that dies half-way, or an executor that is lost, changes nothing
that is read: the list of batches is written last. compact() writes the live rows to a new place.

Defined cases: a null document id replaces nothing; ids that two files share are told by clashes(); an empty save adds an empty batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Store, valid_edges


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return None  # nothing saved yet


def save_graph(store: Store, path: str) -> dict[str, int]:
    """Adds documents with their nodes and valid edges to the store at path, in place of those with the same filename or document id; the counts saved."""
    spark = store.nodes.sparkSession
    log = _read(spark, f"{path}/documents")
    batch = 1 + ((log.agg(F.max("batch")).first()[0] or 0) if log is not None else 0)
    edges = valid_edges(store.edges, store.nodes)
    for name, rows in (("nodes", store.nodes), ("edges", edges), ("documents", store.documents)):
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/{name}")
    saved = lambda name: spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}").where(F.col("batch") == batch).count()
    return {"nodes": saved("nodes"), "edges": saved("edges")}


def live_documents(log: DataFrame) -> DataFrame:
    """Rows of a documents log that no later batch replaces by filename or document id."""
    later = log.select(F.col("filename").alias("__f"), F.col("document_id").alias("__d"), F.col("batch").alias("__b"))
    newest = lambda c: later.where(F.col(c).isNotNull()).groupBy(c).agg(F.max("__b").alias(f"__last{c}"))
    joined = log.join(newest("__f"), F.col("filename") == F.col("__f"), "left").join(newest("__d"), F.col("document_id") == F.col("__d"), "left")
    return joined.where((F.col("batch") == F.col("__last__f")) & (F.col("__last__d").isNull() | (F.col("batch") == F.col("__last__d")))).select(*log.columns)


def read_graph(spark: SparkSession, path: str) -> Store:
    """The live store at path."""
    log = _read(spark, f"{path}/documents")
    if log is None:
        raise FileNotFoundError(path)
    documents = live_documents(log)
    alive = F.broadcast(documents.select("filename", "batch")) if documents.limit(200_001).count() <= 200_000 else documents.select("filename", "batch")
    rows = lambda name: spark.read.option("mergeSchema", "true").parquet(f"{path}/{name}").join(alive, ["filename", "batch"], "left_semi").drop("batch")
    return Store(documents.drop("batch"), rows("nodes"), rows("edges"))


def compact(spark: SparkSession, path: str, target: str) -> Store:
    """The live store at path written to target, as its first batch, and read from there."""
    save_graph(read_graph(spark, path), target)
    return read_graph(spark, target)


def clashes(store: Store) -> DataFrame:
    """(id, files): node ids that more than one file has, as files of one stem do."""
    return store.nodes.groupBy("id").agg(F.array_sort(F.collect_set("filename")).alias("files")).where(F.size("files") > 1)


#: Columns of a cache of classifications; updated_at is a time, the numbers are int, the rest are strings.
CACHE = ("document", "page_number", "entity_index", "fingerprint", "classification", "source", "model", "updated_at")


def cache_put(entries: DataFrame, path: str) -> None:
    """Adds classifications (columns of CACHE) to the cache at path."""
    entries.select(*CACHE).write.mode("append").parquet(path)


def cache_latest(entries: DataFrame) -> DataFrame:
    """The latest entry of each document, page and entity."""
    order = Window.partitionBy("document", "page_number", "entity_index").orderBy(F.col("updated_at").desc_nulls_last(), "fingerprint", "classification")
    return entries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def cache_with_seed(cache: DataFrame, seed: DataFrame) -> DataFrame:
    """The cache, and of documents that it has nothing of the seed."""
    return cache.unionByName(seed.join(cache.select("document").distinct(), "document", "left_anti"))


def cache_get(entities: DataFrame, cache: DataFrame) -> DataFrame:
    """entities (document, page_number, entity_index, fingerprint, ...) with classification, null where the cache has none for that fingerprint."""
    hits = cache_latest(cache).select("document", "page_number", "entity_index", "fingerprint", "classification")
    return entities.join(hits, ["document", "page_number", "entity_index", "fingerprint"], "left").select(*entities.columns, "classification")


def classify_or_cache(entities: DataFrame, cache: DataFrame, classify, path: str | None = None, *, model: str | None = None) -> DataFrame:
    """entities with classification and cache_hit: what the cache has, and classify(misses) (the same rows with classification) for the rest, which is kept at path."""
    from ..plans.runtime import cut

    looked = cut(cache_get(entities, cache))
    hits = looked.where("classification is not null").withColumn("cache_hit", F.lit(True))
    made = cut(classify(looked.where("classification is null").drop("classification")).withColumn("cache_hit", F.lit(False)))
    if path:
        cache_put(made.select("document", "page_number", "entity_index", "fingerprint", "classification", F.lit("llm").alias("source"), F.lit(model).cast("string").alias("model"), F.current_timestamp().alias("updated_at")), path)
    return hits.unionByName(made.select(*hits.columns))


CHECKPOINT_VERSION = 15


def checkpoint_pages(pages: DataFrame, path: str, document: str, page_count: int) -> None:
    """Adds finished pages (page, result) of a document to the checkpoint at path."""
    pages.withColumn("version", F.lit(CHECKPOINT_VERSION)).withColumn("document", F.lit(document)).withColumn("page_count", F.lit(page_count)).write.mode("append").parquet(path)


def resume(spark: SparkSession, path: str, document: str, page_count: int, wanted: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(finished pages, the pages of wanted (page) still to do); ValueError if the checkpoint is of another document, page count or version."""
    done = _read(spark, path)
    if done is None:
        return None, wanted
    other = done.where((F.col("version") != CHECKPOINT_VERSION) | (F.col("document") != document) | (F.col("page_count") != page_count))
    if not other.isEmpty():
        raise ValueError("the checkpoint does not belong to this document")
    return done, wanted.join(done.select("page").distinct(), "page", "left_anti")


def insert_jobs(jobs: DataFrame, requests: DataFrame, now) -> DataFrame:
    """jobs and the requests whose idempotency_key is new, as queued rows with the columns of jobs."""
    from ..operators.jobs import submitted

    fresh = submitted(jobs, requests).where("id = job_id").drop("job_id")
    rows = fresh.withColumns({"status": F.lit("queued"), "progress": F.lit(0), "stage": F.lit("queued"), "message": F.lit("Waiting for a worker"), "created_at": now, "updated_at": now})
    return jobs.unionByName(rows, allowMissingColumns=True)


def reader_bundle(items: DataFrame, path: str) -> None:
    """Pages of documents as JSON, a folder for each document and page; replaces what is there of these documents only."""
    nested = items.groupBy("doc", "page").agg(F.collect_list(F.struct(*[c for c in items.columns if c not in ("doc", "page")])).alias("items"))
    nested.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc", "page").json(path)
