"""Caches, checkpoints, job tables and reader bundles on small tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ids
from tracewright.operators import jobs as J
from tracewright.plans import runtime
from tracewright.sinks import tables
from tracewright.sources import primitives

AT = datetime.datetime(2024, 1, 1)
CACHE = "document string, page_number int, entity_index int, fingerprint string, classification string, source string, model string, updated_at timestamp"


def test_cache_answers_for_one_fingerprint_and_keeps_the_latest(spark, tmp_path):
    path, later = str(tmp_path / "cache"), AT + datetime.timedelta(hours=1)
    tables.cache_put(spark.createDataFrame([("d", 1, 1, "a", "multi", "llm", None, AT), ("d", 1, 1, "b", "single", "llm", "m", later), ("d", 1, 2, "c", "plc_io", "llm", None, AT)], CACHE), path)
    asked = spark.createDataFrame([("d", 1, 1, "a", "x"), ("d", 1, 1, "b", "y"), ("d", 1, 2, "c", "z"), ("e", 1, 2, "c", "w")], "document string, page_number int, entity_index int, fingerprint string, extra string")
    cache = lambda: spark.read.schema(CACHE).parquet(path)
    assert {r["extra"]: r["classification"] for r in tables.cache_get(asked, cache()).collect()} == {"x": None, "y": "single", "z": "plc_io", "w": None}
    seen = []

    def classify(misses):
        seen.append(misses.count())
        return misses.withColumn("classification", F.lit("new"))

    got = tables.classify_or_cache(asked, cache(), classify, path, model="m")
    assert {r["extra"]: (r["classification"], r["cache_hit"]) for r in got.collect()} == {"x": ("new", False), "y": ("single", True), "z": ("plc_io", True), "w": ("new", False)} and seen == [2]
    assert {r["extra"]: r["classification"] for r in tables.cache_get(asked, cache()).collect()}["x"] == "new"
    seed = spark.createDataFrame([("d", 9, 9, "s", "multi", "seed", None, AT), ("f", 1, 1, "s", "multi", "seed", None, AT)], CACHE)
    assert {r["document"] for r in tables.cache_with_seed(cache(), seed).where("source = 'seed'").collect()} == {"f"}


def test_checkpoints_resume_their_own_document(spark, tmp_path):
    path, wanted = str(tmp_path / "check"), spark.createDataFrame([(1,), (2,), (3,)], "page int")
    assert tables.resume(spark, path, "d", 3, wanted)[1].count() == 3
    tables.checkpoint_pages(spark.createDataFrame([(2, "{}")], "page int, result string"), path, "d", 3)
    done, left = tables.resume(spark, path, "d", 3, wanted)
    assert [r["page"] for r in done.collect()] == [2] and sorted(r["page"] for r in left.collect()) == [1, 3]
    for other in (("e", 3), ("d", 4)):
        with pytest.raises(ValueError, match="belong"):
            tables.resume(spark, path, *other, wanted)


JOB = "id long, batch_id string, document_id string, status string, reader_status string, reader_progress int, reader_message string, created_at timestamp, finished_at timestamp, idempotency_key string, pages_json string, strict_pages int, delete_pdf int, result_path string, page_count int, original_filename string"


def job(i, status, document="d", reader="pending", hour=0, **more):
    row = {"id": i, "batch_id": "b", "document_id": document, "status": status, "reader_status": reader, "reader_progress": 5, "reader_message": "m", "created_at": AT + datetime.timedelta(hours=hour), "finished_at": AT + datetime.timedelta(hours=hour), "idempotency_key": None, "pages_json": "[1, 2]", "strict_pages": 1, "delete_pdf": None, "result_path": "p", "page_count": 2, "original_filename": "f.pdf"}
    return tuple({**row, **more}.values())


def test_publishing_moves(spark):
    jobs = spark.createDataFrame([job(1, "succeeded"), job(2, "succeeded", hour=1), job(3, "succeeded", "e", "building"), job(4, "succeeded", "f", "ready"), job(5, "failed", "g")], JOB)
    event = "id long, document_id string, command string, done int, total int"
    run = lambda *rows: {r["id"]: tuple(r)[1:] for r in J.publish_step(jobs, spark.createDataFrame(list(rows), event)).collect()}
    got = run((None, "d", "begin", 0, 0), (None, "e", "begin", 0, 0), (None, "f", "invalidate", 0, 0), (None, "g", "begin", 0, 0))
    assert got[1] == ("pending", 5, "m") and got[2] == ("building", 0, "Preparing reader data") and got[3] == ("building", 5, "m") and got[4] == ("pending", 0, "Reader data upgrade required") and got[5] == ("pending", 5, "m")
    assert run((3, None, "page", 3, 4))[3] == ("building", 75, "Preparing reader page 3 of 4") and run((3, None, "page", 9, 4))[3][1] == 99 and run((3, None, "page", 9, 0))[3][1] == 0
    assert run((3, None, "ready", 0, 0))[3] == ("ready", 100, "Reader data is ready") and run((3, None, "recover", 0, 0))[3][0] == "pending" and run((3, None, "fail", 0, 0))[3][0] == "failed"


def test_job_tables(spark):
    jobs = spark.createDataFrame([job(1, "succeeded", idempotency_key="k"), job(2, "running"), job(3, "queued", hour=2), job(4, "delete_requested"), job(5, "failed", "e", result_path="")], JOB)
    shown = {r["id"]: r for r in J.described(jobs).collect()}
    assert shown[1]["pages"] == [1, 2] and shown[1]["strict_pages"] is True and shown[1]["delete_pdf"] is False and shown[1]["result_available"] and not shown[2]["result_available"] and not shown[1]["document_ready"]
    acts = J.deletion(jobs, spark.createDataFrame([("d",)], "document_id string"))
    assert {r["id"]: r["action"] for r in acts.collect()} == {1: "keep", 2: "delete_requested", 3: "remove", 4: "delete_requested"}
    assert [tuple(r) for r in J.deletion_answer(acts).collect()] == [("d", True, True)]
    assert [tuple(r)[:5] for r in J.reprocessed(jobs, spark.createDataFrame([("d", None), ("e", [2])], "document_id string, pages array<int>")).orderBy("id").collect()] == [(3, "d", "queued", 0, [1, 2]), (5, "e", "queued", 0, [2])]
    asked = spark.createDataFrame([(10, "k"), (11, "n"), (12, "n"), (13, None)], "id long, idempotency_key string")
    assert {r["id"]: r["job_id"] for r in J.submitted(jobs, asked).collect()} == {10: 1, 11: 11, 12: 11, 13: 13}
    grown = tables.insert_jobs(jobs.select("id", "idempotency_key", "status"), asked, F.lit(AT))
    assert {r["id"]: r["status"] for r in grown.where("id > 9").collect()} == {11: "queued", 13: "queued"}
    assert [r["id"] for r in J.backfill(jobs).collect()] == [1] and J.recent(jobs, limit=0).count() == 1 and J.recent(jobs, batch_id="none").count() == 0
    ready = spark.createDataFrame([job(1, "succeeded", "d", "ready"), job(2, "succeeded", "e", "ready"), job(3, "succeeded", "f", "building")], JOB)
    manifests = spark.createDataFrame([("d", 5), ("e", 4), ("f", 5)], "document_id string, schema_version int")
    assert [r["document_id"] for r in J.manifest(ready, manifests.select("document_id"), manifests, 5).collect()] == ["d"] and [r["document_id"] for r in J.stale(ready, manifests, 5).collect()] == ["e"]
    files = spark.createDataFrame([("a.pdf", 1, 1, 0), ("a.pdf", 1, 1, 1), ("b.txt", 1, 1, 2), ("B.PDF", 1, 1, 3)], "name string, size int, modified_at int, place int")
    assert sorted(r["place"] for r in J.upload_dedupe(files).collect()) == [0, 3]
    seen = J.inspected(spark.createDataFrame([("x", bytearray(b"%PDF-1.7")), ("y", bytearray(b"no")), ("z", bytearray(b"%PDF-" + b"x" * 99))], "path string, content binary"), 50)
    assert {r["path"]: r["problem"] for r in seen.collect()} == {"x": None, "y": "no PDF", "z": "too large"}


def test_ranks_over_tasks(spark):
    rows = [(f"s/p{p}/{k}/{i}",) for p in (10, 9, 2) for k in ("wire", "net") for i in ("10", "9", "x", "1")]
    got = [r["id"] for r in ids.ranked(spark.createDataFrame(rows, "id string").repartition(5), tasks=4).orderBy("rank").collect()]
    assert got == [f"s/p{p}/{k}/{i}" for p in (2, 9, 10) for k in ("net", "wire") for i in ("x", "1", "9", "10")]
    assert [r["item"] for r in ids.listed(spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>"), "v").collect()] == ["a", "b"]


def test_reader_pages(spark, tmp_path):
    none = spark.createDataFrame([], "doc string, page int, id long, x0 double, y0 double, x1 double, y1 double")
    vectors = spark.createDataFrame([("d", 1, i, i, 0.0, 10.0, 5.0, 20.0) for i in range(4)] + [("d", 2, 9, 0, 0.0, 10.0, 5.0, 20.0)], "doc string, page int, id long, path_index int, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([("d", 1, 7, 1.0, 1.0, 2.0, 2.0)], none.schema)
    pages = spark.createDataFrame([("d", 1, 100.0), ("d", 2, 50.0)], "doc string, page int, height double")
    items = runtime.cut(primitives.reader_items(vectors, texts, none, none, pages, most=3))
    assert {(r["page"], r["kind"], r["id"], r["y0"], r["y1"]) for r in items.collect()} == {(1, "text", 7, 98.0, 99.0), (2, "vector", 9, 30.0, 40.0)}
    totals = spark.createDataFrame([("d", 1, "vector", 4), ("d", 1, "text", 1)], "doc string, page int, kind string, total int")
    assert {(r["kind"], r["indexed"], r["total"]) for r in primitives.item_counts(items, totals).collect()} == {("vector", 0, 4), ("text", 1, 1)}
    tables.reader_bundle(items, str(tmp_path / "out"))
    tables.reader_bundle(items.where("page = 2"), str(tmp_path / "out"))
    assert sorted(r["page"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 2]
