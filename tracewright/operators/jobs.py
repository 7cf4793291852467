"""Job tables: listings, rollups of batches and documents, publishing, deletion and files.

jobs: id, batch_id, document_id, status, reader_status, created_at, finished_at, ... Equal times go by id, later ids first where the newest counts.
Defined cases: null times come last in newest-first order; a job without a batch or document is in none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T

ENDED = ("succeeded", "failed", "cancelled")
ACTIVE = ("running", "pause_requested", "cancel_requested", "delete_requested")


def _newest(jobs: DataFrame, time: str, limit: int) -> DataFrame:
    return jobs.orderBy(F.col(time).desc_nulls_last(), F.desc("id")).limit(max(1, min(int(limit), config.LIST_LIMIT)))


def recent(jobs: DataFrame, limit: int = 100, batch_id: str | None = None) -> DataFrame:
    """The newest jobs, of a batch if one is named; 1 to 500 of them."""
    return _newest(jobs.where(F.col("batch_id") == batch_id) if batch_id else jobs, "created_at", limit)


def completed(jobs: DataFrame, limit: int = 200) -> DataFrame:
    return _newest(jobs.where("status = 'succeeded'"), "finished_at", limit)


def ready(jobs: DataFrame, limit: int = 200) -> DataFrame:
    return _newest(jobs.where("status = 'succeeded' and reader_status = 'ready'"), "finished_at", limit)


def queue_head(jobs: DataFrame) -> DataFrame:
    """The queued job that waits longest."""
    return jobs.where("status = 'queued'").orderBy(F.col("created_at").asc_nulls_last(), "id").limit(1)


def latest(jobs: DataFrame, by: str = "document_id", time: str = "finished_at") -> DataFrame:
    """The newest row of each value of by."""
    rest = [c for c in jobs.columns if c not in (by, time, "id")]
    return jobs.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(F.struct(time, "id", *rest)).alias("x")).select(by, "x.*").select(*jobs.columns)


def latest_completed(jobs: DataFrame, ready_only: bool = False) -> DataFrame:
    done = jobs.where("status = 'succeeded'")
    return latest(done.where("reader_status = 'ready'") if ready_only else done)


def batch_status(jobs: DataFrame, by: str = "batch_id") -> DataFrame:
    """(batch, status): completed if all jobs ended, running if any runs or waits to be cancelled, else queued."""
    s = F.col("status")
    flags = jobs.where(F.col(by).isNotNull()).groupBy(by).agg(F.bool_and(s.isin(list(ENDED))).alias("over"), F.bool_or(s.isin("running", "cancel_requested")).alias("busy"))
    return flags.select(by, F.when(F.col("over"), "completed").when(F.col("busy"), "running").otherwise("queued").alias("status"))


def document_flags(jobs: DataFrame) -> DataFrame:
    """(document_id, any_completed, any_incomplete)."""
    done = F.col("status") == "succeeded"
    return jobs.where("document_id is not null").groupBy("document_id").agg(F.bool_or(done).alias("any_completed"), F.bool_or(~done).alias("any_incomplete"))


def described(jobs: DataFrame) -> DataFrame:
    """Jobs with pages as a list of numbers, flags as booleans, and whether the result and the document are there."""
    done = F.col("status") == "succeeded"
    out = jobs.withColumn("pages", F.from_json("pages_json", "array<int>")).drop("pages_json")
    for flag in ("strict_pages", "delete_pdf"):
        out = out.withColumn(flag, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return out.withColumn("result_available", done & F.coalesce(F.col("result_path") != "", F.lit(False))).withColumn("document_ready", done & (F.col("reader_status") == "ready"))


def submitted(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request columns, id): the job that each request stands for: the stored one of its idempotency_key, else the first request's with that key; requests without a key are jobs of their own."""
    known = jobs.where("idempotency_key is not null").select("idempotency_key", F.col("id").alias("__known"))
    first = requests.where("idempotency_key is not null").groupBy("idempotency_key").agg(F.min("id").alias("__first"))
    joined = requests.join(known, "idempotency_key", "left").join(first, "idempotency_key", "left")
    return joined.withColumn("job_id", F.coalesce("__known", "__first", "id")).drop("__known", "__first").select(*requests.columns, "job_id")


def high_water(updates: DataFrame, by: str, progress: Column, order: Sequence[str]) -> DataFrame:
    """updates with progress, the most that their job has told so far."""
    from pyspark.sql import Window

    return updates.withColumn("progress", F.max(progress).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def publish_step(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(id, reader_status, reader_progress, reader_message) after publishing events (document_id or id, command, value, seq), one for each job, applied to where the job is.

    begin claims the newest completed job of a document that is neither ready nor building; page tells the share of value (done of total) below 100;
    ready and fail end it; invalidate makes a ready one pending again; recover takes interrupted ones back to pending.
    """
    state = jobs.select("id", "document_id", "status", "reader_status", "reader_progress", "reader_message", "finished_at")
    newest = latest_completed(jobs).select("id", F.lit(True).alias("newest"))
    e = events.select(F.col("id").alias("__id"), F.col("document_id").alias("__doc"), "command", "done", "total")
    both = state.join(newest, "id", "left").join(e, (F.col("id") == F.col("__id")) | (F.col("__id").isNull() & (F.col("document_id") == F.col("__doc"))), "left")
    command, now = F.col("command"), F.col("reader_status")
    done = F.col("status") == "succeeded"
    share = F.when(F.col("total") > 0, F.greatest(F.lit(0), F.least(F.floor(F.col("done") * 100 / F.col("total")), F.lit(99)))).otherwise(0).cast("int")
    moves = [
        ((command == "begin") & F.coalesce(F.col("newest"), F.lit(False)) & ~now.isin("ready", "building"), "building", F.lit(0), F.lit("Preparing reader data")),
        ((command == "page") & (now == "building"), "building", share, F.format_string("Preparing reader page %d of %d", "done", "total")),
        (command == "ready", "ready", F.lit(100), F.lit("Reader data is ready")),
        (command == "fail", "failed", F.lit(0), F.lit("Reader preparation failed")),
        ((command == "invalidate") & done & (now == "ready"), "pending", F.lit(0), F.lit("Reader data upgrade required")),
        ((command == "recover") & (now == "building"), "pending", F.lit(0), F.lit("Open the document to prepare reader data")),
    ]
    columns = []
    for name, place in (("reader_status", 0), ("reader_progress", 1), ("reader_message", 2)):
        value = F.when(F.lit(False), F.col(name))
        for which, status, progress, message in moves:
            value = value.when(which, (F.lit(status), progress, message)[place])
        columns.append(value.otherwise(F.col(name)).alias(name))
    return both.select("id", *columns)


def deletion(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, action) for jobs of documents (document_id) whose file is deleted: completed ones are kept, active ones wait for their worker, others go."""
    s = F.col("status")
    action = F.when(s == "succeeded", "keep").when(s.isin(list(ACTIVE)), "delete_requested").otherwise("remove")
    return jobs.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("id", "document_id", action.alias("action"))


def deletion_answer(actions: DataFrame) -> DataFrame:
    """(document_id, any, deferred) of what deletion says."""
    return actions.where("action != 'keep'").groupBy("document_id").agg(F.lit(True).alias("any"), F.bool_or(F.col("action") == "delete_requested").alias("deferred"))


def reprocessed(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """The newest job of each document (document_id, pages or null) as it is queued again, with all pages unless some are named."""
    newest = latest(jobs, time="created_at").join(documents.select("document_id", F.col("pages").alias("__pages")), "document_id")
    every = F.sequence(F.lit(1), F.col("page_count").cast("int"))
    return newest.select("id", "document_id", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.coalesce("__pages", every).alias("pages"), F.lit("pending").alias("reader_status"))


def backfill(jobs: DataFrame) -> DataFrame:
    """The completed job that counts for each file name: the newest."""
    return latest(jobs.where("status = 'succeeded'"), by="original_filename")


def cached_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files (relative_path, size, modified_at, filename or null, page_count or null) with their cache id and the newest job of the document whose folder they are in."""
    of_job = [c for c in ("id", "document_id", "original_filename", "page_count", "status", "reader_status") if c in jobs.columns]
    newest = latest(jobs, time="created_at").select(*[F.col(c).alias(f"__{c}") for c in of_job])
    document = F.nullif(F.regexp_extract("relative_path", "^([^/]+)/source\\.pdf$", 1), F.lit(""))
    joined = files.where(F.regexp_like("relative_path", F.lit(r"(?s)\.pdf$"))).withColumn("document_id", document).join(newest, F.col("document_id") == F.col("__document_id"), "left")
    return joined.select(T.short_hash(F.col("relative_path")).alias("cache_id"), "document_id", F.coalesce("__original_filename", "filename", F.regexp_replace("relative_path", "^.*/", "")).alias("filename"), "relative_path", "size", "modified_at", F.coalesce("__page_count", "page_count").alias("page_count"), F.col("__id").alias("job_id"), F.coalesce("__status", F.lit("cached")).alias("status"), F.col("__reader_status").alias("reader_status"))


def manifest(jobs: DataFrame, sources: DataFrame, manifests: DataFrame, version: int | None = None) -> DataFrame:
    """Manifests (document_id, schema_version, ...) of ready documents whose source (document_id) is there; those of another version are left out, if one is named."""
    wanted = manifests if version is None else manifests.where(F.col("schema_version") == version)
    ready_ = jobs.where("status = 'succeeded' and reader_status = 'ready'").select("document_id").distinct()
    return wanted.join(ready_, "document_id", "left_semi").join(sources.select("document_id").distinct(), "document_id", "left_semi")


def stale(jobs: DataFrame, manifests: DataFrame, version: int) -> DataFrame:
    """(document_id) of ready documents whose manifest is not there or of another version: they are to be built anew."""
    current = manifests.where(F.col("schema_version") == version).select("document_id")
    return jobs.where("status = 'succeeded' and reader_status = 'ready'").select("document_id").distinct().join(current, "document_id", "left_anti")


def upload_dedupe(files: DataFrame) -> DataFrame:
    """One file of each name, size and time, PDFs only, the first of them."""
    keys = ["name", "size", "modified_at"]
    return files.where(F.regexp_like("name", F.lit(r"(?i)\.pdf$"))).groupBy(*keys).agg(F.min("place").alias("place"))


def inspected(files: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """(path, size, sha256, problem) of files (path, content): no PDF, or too large; null if neither."""
    size = F.length("content")
    problem = F.when(size > most_bytes, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF")
    return files.select("path", size.alias("size"), F.sha2("content", 256).alias("sha256"), problem.alias("problem"))
