"""Parsing results (one JSON object for each document) as the nodes and edges of a graph.

Read with an explicit schema; entities, relations and links stay variants until the fields are taken, so fields that are not known
pass through in properties.

Defined cases: a file that is no JSON object is left out of read_results (and named by broken_results); a missing list is empty; an entity
without an id is left out; relations and links without an id are numbered by their place; null ends make an edge that valid_edges drops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators.graph import Store, valid_edges

_LIST = "array<variant>"
DIAGRAM = ", ".join(f"{name}: {_LIST}" for name in (*[f"{k}s" for k in config.ENTITY_KINDS], "relations", "hyperlinks", "transfers", "elements", "remaining_vectors", "remaining_text"))
RESULT = f"schema_version string, document struct<filename: string, page_count: int>, pages map<string, struct<page_type: string, diagram: struct<{DIAGRAM}>, info_table: variant, crosspage_relations: struct<hyperlinks: {_LIST}, transfers: {_LIST}>>>, symbol_overview variant, broken string"
#: Lists that a page's diagram must have to be taken for a whole one.
REQUIRED = ("elements", *[f"{k}s" for k in ("component", "endpoint", "wire", "net", "group")], "relations")
NODE_FIELDS = ("id", "type", "subclass", "page", "bbox", "title", "descriptions", "page_io")


def read_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """RESULT without its last column, and file: one row for each document."""
    rows = spark.read.schema(RESULT).option("columnNameOfCorruptRecord", "broken").json(path, multiLine=True)
    return rows.select("*", F.input_file_name().alias("file")).where("document is not null and broken is null").drop("broken")


def broken_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file: those that are no result."""
    rows = spark.read.schema(RESULT).option("columnNameOfCorruptRecord", "broken").json(path, multiLine=True)
    return rows.select(F.input_file_name().alias("file"), "document", "broken").where("document is null or broken is not null").select("file")


def result_of(results: DataFrame, document_id: str, stem: str) -> DataFrame:
    """The one result of a document: result.json in its folder, else the file named for it."""
    own, flat = F.col("file").endswith(f"/{document_id}/result.json"), F.col("file").endswith(f"/{stem}.json")
    return results.where(own | flat).orderBy(F.when(own, 0).otherwise(1), "file").limit(1)


def pages_of(results: DataFrame) -> DataFrame:
    """filename, stem, page, page_type, diagram, info_table: a row for each page, with links that older results keep beside the diagram."""
    pages = results.select(F.col("document.filename").alias("filename"), F.explode("pages").alias("key", "p"))
    old = lambda name: F.when(F.size(F.col(f"p.crosspage_relations.{name}")) > 0, F.col(f"p.crosspage_relations.{name}"))
    diagram = F.col("p.diagram")
    for name in ("hyperlinks", "transfers"):
        diagram = diagram.withField(name, F.coalesce(F.col(f"p.diagram.{name}"), old(name)))
    whole = F.when(F.col("p.diagram").isNotNull(), diagram)
    return pages.select("filename", T.stem(F.col("filename")).alias("stem"), F.col("key").try_cast("int").alias("page"), F.col("p.page_type").alias("page_type"), whole.alias("diagram"), F.col("p.info_table").alias("info_table")).where("page is not null")


def whole_pages(results: DataFrame) -> DataFrame:
    """pages_of those whose diagram has all REQUIRED lists."""
    ok = F.lit(True)
    for name in REQUIRED:
        ok &= F.col(f"diagram.{name}").isNotNull()
    return pages_of(results).where("diagram is not null").where(ok)


def field(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _listed(pages: DataFrame, name: str) -> DataFrame:
    return pages.select("filename", "stem", "page", F.posexplode(f"diagram.{name}").alias("place", "v"))


def nodes_of(results: DataFrame) -> DataFrame:
    """id, filename, page, kind, subclass, x0, y0, x1, y1, title, descriptions, page_io, properties (the whole record as JSON)."""
    pages, out = pages_of(results), None
    v = F.col("v")
    for kind in config.ENTITY_KINDS:
        corner = [field(v, f"bbox.{c}", "double").alias(c) for c in ("x0", "y0", "x1", "y1")]
        lists = [F.coalesce(field(v, name, "array<string>"), F.array().cast("array<string>")).alias(name) for name in ("title", "descriptions")]
        own = field(v, "subclass") if kind == "component" else F.lit(kind)
        rows = _listed(pages, f"{kind}s").where(field(v, "id").isNotNull())
        rows = rows.select(T.global_id(F.col("stem"), F.col("page"), F.lit(kind), field(v, "id")).alias("id"), "filename", "page", F.lit(kind).alias("kind"), own.alias("subclass"), *corner, *lists, field(v, "page_io").alias("page_io"), F.to_json(v).alias("properties"))
        out = rows if out is None else out.unionByName(rows)
    return out


def edges_of(results: DataFrame) -> DataFrame:
    """id, kind, source_id, target_id, source_page, target_page, filename, properties: relations within pages and links across them, valid or not."""
    pages, v = pages_of(results), F.col("v")
    known = lambda kind: F.coalesce(field(v, "id"), T.global_id(F.col("stem"), F.col("page"), F.lit(kind), F.col("place")))
    end = lambda name: T.reference_id(F.col("stem"), F.col("page"), field(v, name))
    out = _listed(pages, "relations").select(known("relation").alias("id"), field(v, "type").alias("kind"), end("source").alias("source_id"), end("target").alias("target_id"), F.col("page").alias("source_page"), F.col("page").alias("target_page"), "filename", F.lit("{}").alias("properties"))
    for kind in config.CROSS_PAGE_KINDS:
        page = lambda side: field(v, f"{side}_page", "int")
        component = lambda side: F.when(page(side).isNotNull() & field(v, f"{side}_component").isNotNull(), T.global_id(F.col("stem"), page(side), F.lit("component"), field(v, f"{side}_component")))
        rows = _listed(pages, f"{kind}s").select(known(kind).alias("id"), F.lit(kind).alias("kind"), component("source").alias("source_id"), component("target").alias("target_id"), page("source").alias("source_page"), page("target").alias("target_page"), "filename", F.to_json(v).alias("properties"))
        out = out.unionByName(rows)
    return out


def graph_of(results: DataFrame, document_ids: DataFrame | None = None) -> Store:
    """The store of results: edges have both ends. document_ids (filename, document_id) may name the documents."""
    documents = results.select(F.col("document.filename").alias("filename"), F.col("document.page_count").alias("page_count"))
    documents = documents.join(document_ids, "filename", "left") if document_ids is not None else documents.withColumn("document_id", F.lit(None).cast("string"))
    nodes = nodes_of(results)
    return Store(documents.select("filename", "document_id", "page_count"), nodes, valid_edges(edges_of(results), nodes))


def trace_index(results: DataFrame) -> DataFrame:
    """(filename, page, <kind>s, relations, transfers): what tracing needs of each page: eight fields of entities, connections and what nets and groups contain."""
    v = F.col("diagram")
    ends = lambda x: F.struct(*[field(x, f).alias(f) for f in ("type", "source", "target")])
    wanted = lambda r: (r["type"] == "connection") | (r["type"] == "contains") & F.regexp_like(r["source"], F.lit("^(net|group):"))
    relations = F.filter(F.transform(F.coalesce(v["relations"], F.array().cast(_LIST)), ends), wanted)
    transfers = F.transform(F.coalesce(v["transfers"], F.array().cast(_LIST)), lambda x: F.struct(*[field(x, f).alias(f) for f in ("source_page", "source_component", "target_page", "target_component")]))
    lists = [F.transform(F.coalesce(v[f"{k}s"], F.array().cast(_LIST)), lambda x: F.struct(*[(field(x, f, "array<string>") if f in ("title", "descriptions") else field(x, f)).alias(f) for f in NODE_FIELDS if f != "bbox"], F.struct(*[field(x, f"bbox.{c}", "double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"))).alias(f"{k}s") for k in config.ENTITY_KINDS]
    return pages_of(results).where("diagram is not null").select("filename", "page", *lists, relations.alias("relations"), transfers.alias("transfers"))


def symbol_overview(results: DataFrame) -> DataFrame:
    """(filename, symbols, records, pages): each symbol's shapes moved to its own origin, with width, height and whether dashed; records as symbol, name, description; and the pages of that type."""
    groups = F.try_variant_get(F.col("symbol_overview"), "$.symbols", "array<array<struct<type: string, points: array<array<double>>, path_meta: struct<dashes: string>>>>")
    records = F.try_variant_get(F.col("symbol_overview"), "$.records", _LIST)
    shapes = F.transform(groups, lambda g: F.filter(g, lambda s: F.size(s["points"]) > 0))

    def local(group: Column) -> Column:
        points = F.flatten(F.transform(group, lambda s: s["points"]))
        low = lambda i: F.coalesce(F.array_min(F.transform(points, lambda p: p[i])), F.lit(0.0))
        high = lambda i: F.coalesce(F.array_max(F.transform(points, lambda p: p[i])), F.lit(0.0))
        moved = F.transform(group, lambda s: F.struct(s["type"].alias("type"), F.transform(s["points"], lambda p: F.array(p[0] - low(0), p[1] - low(1))).alias("points"), T.is_dashed(s["path_meta"]["dashes"]).alias("dashed")))
        return F.struct(moved.alias("shapes"), (high(0) - low(0)).alias("width"), (high(1) - low(1)).alias("height"))

    described = lambda r: F.coalesce(F.array_join(field(r, "descriptions", "array<string>"), "; "), field(r, "descriptions"), F.lit(""))
    told = F.transform(records, lambda r: F.struct(F.coalesce(field(r, "symbol", "int"), F.lit(0)).alias("symbol"), F.coalesce(F.nullif(field(r, "type"), F.lit("")), F.lit("(unnamed)")).alias("name"), described(r).alias("description")))
    of_type = F.filter(F.map_entries("pages"), lambda e: (e["value"]["page_type"] == "symbol_overview") & e["key"].try_cast("int").isNotNull())
    return results.where("symbol_overview is not null").select(F.col("document.filename").alias("filename"), F.transform(shapes, local).alias("symbols"), told.alias("records"), F.array_sort(F.transform(of_type, lambda e: e["key"].cast("int"))).alias("pages"))
