"""Links of pages and the components that they start from and lead to.

links: doc, page, id, box of the annotation, target_page, tx0..ty1 (region shown, null if none); texts: doc, page, id, text, box;
components: doc, page, id, box; elements: doc, page, id, type.

Defined cases: a link to a page out of 1..page_count goes; without evidence a component stays null; ties as each function says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import boxes as B
from ..functions import text as T
from . import spatial

KEYS = ("doc", "page")
BOX = list(B.CORNERS)
TARGET = ["tx0", "ty0", "tx1", "ty1"]


def normalized(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links within the pages of their document (doc, page_count)."""
    return links.join(documents.select("doc", "page_count"), "doc").where(F.col("target_page").between(1, F.col("page_count"))).select(*links.columns)


def text_candidates(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, link, text, coverage, iou): texts that a link overlaps."""
    met = spatial.iou_join(links.select(*KEYS, "id", *BOX), texts.select(*KEYS, "id", *BOX), keys=KEYS)
    return met.select(*KEYS, F.col("a_id").alias("link"), F.col("b_id").alias("text"), "coverage", "iou")


def attach_sources(links: DataFrame, components: DataFrame, texts: DataFrame | None = None, matches: DataFrame | None = None, max_distance: float = config.LINK_COMPONENT) -> DataFrame:
    """links with source_component: of those that it overlaps, or whose matched texts (doc, page, text, component) it does, the one with most coverage, then iou, least area, id; else the nearest within max_distance, ties by id."""
    own, all_ = links.select(*KEYS, "id", *BOX), components.select(*KEYS, "id", *BOX)
    found = spatial.iou_join(own, all_, keys=KEYS).select(*KEYS, F.col("a_id").alias("id"), "coverage", "iou", B.area(spatial.Z).alias("area"), F.col("b_id").alias("component"))
    if texts is not None and matches is not None:
        told = text_candidates(links, texts).join(matches.select(*KEYS, "text", "component"), [*KEYS, "text"]).join(components.select(*KEYS, F.col("id").alias("component"), B.area(B.Box.named()).alias("area")), [*KEYS, "component"])
        found = found.unionByName(told.select(*KEYS, F.col("link").alias("id"), "coverage", "iou", "area", "component"))
    best = F.max(F.struct("coverage", "iou", (-F.col("area")).alias("a"), (-F.col("component")).alias("c"))).alias("x")
    overlapping = found.groupBy(*KEYS, "id").agg(best).select(*KEYS, "id", (-F.col("x.c")).alias("source_component"))
    rest = own.join(overlapping.select(*KEYS, "id"), [*KEYS, "id"], "left_anti")
    nearby = spatial.nearest(rest, all_, k=1, keys=KEYS, reach=max_distance).select(*KEYS, F.col("a_id").alias("id"), F.col("b_id").alias("source_component"))
    return links.join(overlapping.unionByName(nearby), [*KEYS, "id"], "left")


def target_components(links: DataFrame, components: DataFrame, max_distance: float = config.LINK_COMPONENT) -> DataFrame:
    """(doc, page, id, target_component): on the target page the component with the largest share of itself inside the region, then of the region, then least area and id; else the nearest within max_distance, then the smallest, then by id."""
    key = F.struct("page", "id")
    region = links.where("tx0 is not null").select("doc", F.col("target_page").alias("at"), key.alias("id"), *[F.col(t).alias(c) for t, c in zip(TARGET, BOX, strict=True)])
    there = components.select("doc", F.col("page").alias("at"), "id", *BOX)
    met = spatial.meet(region, there, keys=("doc", "at")).withColumn("o", B.overlap(spatial.A, spatial.Z)).where("o > 0")
    share = lambda box: F.when(B.area(box) > 0, F.col("o") / B.area(box)).otherwise(0.0)
    best = F.max(F.struct(share(spatial.Z).alias("p"), share(spatial.A).alias("q"), (-B.area(spatial.Z)).alias("a"), (-F.col("b_id")).alias("c"))).alias("x")
    over = met.groupBy("doc", "at", F.col("a_id").alias("id")).agg(best).select("doc", "at", "id", (-F.col("x.c")).alias("target_component"))
    rest = region.join(over.select("doc", "at", "id"), ["doc", "at", "id"], "left_anti")
    near = spatial.nearest(rest, there, k=1, keys=("doc", "at"), reach=max_distance, order=[B.area(spatial.Z)]).select("doc", "at", F.col("a_id").alias("id"), F.col("b_id").alias("target_component"))
    return over.unionByName(near).select("doc", F.col("id.page").alias("page"), F.col("id.id").alias("id"), "target_component")


def attach_targets(links: DataFrame, components: DataFrame, max_distance: float = config.LINK_COMPONENT) -> DataFrame:
    """links with target_component."""
    return links.join(target_components(links, components, max_distance), [*KEYS, "id"], "left")


def components_with(components: DataFrame, elements: DataFrame, kind: str = "arrow") -> DataFrame:
    """Components (element_ids) that hold an element of that type."""
    wanted = elements.where(F.col("type") == kind).select(*KEYS, F.col("id").alias("__element"))
    own = components.select(*KEYS, F.col("id"), F.explode("element_ids").alias("__element")).join(wanted, [*KEYS, "__element"], "left_semi").select(*KEYS, "id").distinct()
    return components.join(own, [*KEYS, "id"], "left_semi")


def split_transfers(links: DataFrame, components: DataFrame, elements: DataFrame) -> DataFrame:
    """links with kind: transfer where an arrow's component is the source, else hyperlink; without the action chain."""
    arrows = components_with(components, elements).select(*KEYS, F.col("id").alias("source_component"), F.lit(True).alias("__arrow"))
    out = links.drop("action_chain").join(arrows, [*KEYS, "source_component"], "left")
    return out.withColumn("kind", F.when(F.col("__arrow"), "transfer").otherwise("hyperlink")).drop("__arrow")


def attach_transfers(transfers: DataFrame, components: DataFrame, elements: DataFrame, max_distance: float = config.LINK_COMPONENT) -> DataFrame:
    """transfers with target_component, an arrow's only, and reason: why there is none."""
    arrows = components_with(components, elements)
    done = attach_targets(transfers, arrows, max_distance)
    other = target_components(transfers, components, max_distance).withColumnRenamed("target_component", "__other")
    there = lambda rows, name: rows.select("doc", F.col("page").alias("target_page"), F.lit(True).alias(name)).distinct()
    told = done.join(other, [*KEYS, "id"], "left").join(there(components, "__any"), ["doc", "target_page"], "left").join(there(arrows, "__arrows"), ["doc", "target_page"], "left")
    reason = F.when(F.col("target_component").isNotNull(), F.lit(None)).when(F.col("__other").isNotNull(), F.concat(F.lit("target region matched non-arrow component "), F.col("__other").cast("string"))).when(F.col("__any").isNull(), "target page has no diagram components").when(F.col("__arrows").isNull(), "target page has no arrow components").when(F.col("tx0").isNull(), "target bbox is unavailable").otherwise("target region did not match an arrow component")
    return told.withColumn("reason", reason).select(*transfers.columns, "target_component", "reason")


def cross_references(links: DataFrame, texts: DataFrame, documents: DataFrame, least: float = config.LINK_IOU) -> DataFrame:
    """(doc, page, text, target_page, label, zone, link, iou): texts that read as references, with the link to another page that overlaps them most, by at least that iou; ties by the link's id."""
    named = texts.withColumn("ref", T.cross_reference(F.col("text"))).where("ref is not null")
    away = normalized(links, documents).where("target_page != page")
    met = spatial.iou_join(named.select(*KEYS, "id", *BOX, "ref"), away.select(*KEYS, "id", *BOX, "target_page"), keys=KEYS).where(F.col("iou") >= least)
    best = met.groupBy(*KEYS, F.col("a_id").alias("text"), F.col("a_ref").alias("ref")).agg(F.max(F.struct("iou", (-F.col("b_id")).alias("n"), "b_target_page")).alias("x"))
    return best.select(*KEYS, "text", F.col("x.b_target_page").alias("target_page"), "ref.label", "ref.zone", (-F.col("x.n")).alias("link"), F.col("x.iou").alias("iou"))


def link_relations(links: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc, page, id, relation): the relation (doc, source_page, target_page, id, box) between the same pages whose box overlaps the link's most, over the smaller area."""
    rows = links.select("doc", F.col("page").alias("source_page"), "target_page", "id", *BOX)
    met = spatial.meet(rows, relations.select("doc", "source_page", "target_page", "id", *BOX), keys=("doc", "source_page", "target_page")).withColumn("s", B.overlap_ratio(spatial.A, spatial.Z)).where("s > 0")
    best = met.groupBy("doc", "source_page", F.col("a_id").alias("id")).agg(F.max(F.struct("s", (-F.col("b_id")).alias("n"))).alias("x"))
    return best.select("doc", F.col("source_page").alias("page"), "id", (-F.col("x.n")).alias("relation"))


def pipeline(links: DataFrame, documents: DataFrame, components: DataFrame, elements: DataFrame, texts: DataFrame | None = None, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hyperlinks, transfers) with their sources and targets."""
    split = split_transfers(attach_sources(normalized(links, documents), components, texts, matches), components, elements)
    hyperlinks = attach_targets(split.where("kind = 'hyperlink'"), components)
    return hyperlinks, attach_transfers(split.where("kind = 'transfer'"), components, elements)
