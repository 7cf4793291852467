"""Drawing primitives of pages, from rows of paths, text blocks and link annotations as a PDF reader lists them.

No PDF reader is part of the engine: its lists are the input. Defined cases: items of unknown kinds or without their points are left out, as are
spans without text or box and links without a target page; a null list is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import boxes as B
from ..functions import text as T

#: Points that each drawing item has, and the kind of path that it is. A rectangle is given by two corners.
ITEMS = {"l": ("line", 2), "c": ("curve", 4), "re": ("rect", 2), "qu": ("quad", 4)}


def _region(rows: DataFrame, region: tuple[float, float, float, float] | None) -> DataFrame:
    return rows if region is None else rows.where(B.intersects(B.Box.named(), B.Box(*[F.lit(float(v)) for v in region])))


def vectors(paths: DataFrame, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A row for each item of paths (doc, page, path_index, items: array of struct(op, points), meta columns): index, type, points, box and code; only those that meet the region, if one is given."""
    meta = [c for c in paths.columns if c not in ("items",)]
    rows = paths.select(*meta, F.posexplode("items").alias("item_index", "item"))
    op, given = F.col("item.op"), F.col("item.points")
    kind = F.when(F.lit(False), F.lit(""))
    good = F.lit(False)
    for name, (shape, n) in ITEMS.items():
        kind = kind.when(op == name, shape)
        good |= (op == name) & (F.size(given) == n)
    a, b = F.get(given, 0), F.get(given, 1)
    corners = F.array(B.point(a["x"], a["y"]), B.point(b["x"], a["y"]), B.point(b["x"], b["y"]), B.point(a["x"], b["y"]))
    rows = rows.where(good).withColumn("type", kind).withColumn("points", F.when(op == "re", corners).otherwise(F.transform(given, lambda p: B.point(p["x"], p["y"]))))
    rows = rows.select(*meta, "item_index", "type", "points", *B.shape_box(F.col("type"), F.col("points")).columns())
    return _region(rows.withColumn("code", path_code(F.col("type"), F.col("points"))), region)


def path_code(kind: Column, points: Column) -> Column:
    """The drawing commands of a path, with plain numbers."""
    at = lambda i: F.concat_ws(" ", T.plain_number(F.get(points, i)["x"]), T.plain_number(F.get(points, i)["y"]))
    size = F.concat_ws(" ", T.plain_number(F.get(points, 2)["x"] - F.get(points, 0)["x"]), T.plain_number(F.get(points, 2)["y"] - F.get(points, 0)["y"]))
    line = F.concat(at(0), F.lit(" m\n"), at(1), F.lit(" l"))
    curve = F.concat(F.concat_ws(" ", at(1), at(2), at(3)), F.lit(" c"))
    quad = F.concat(at(0), F.lit(" m\n"), at(1), F.lit(" l\n"), at(2), F.lit(" l\n"), at(3), F.lit(" l\nh"))
    return F.when(kind == "line", line).when(kind == "curve", curve).when(kind == "rect", F.concat(at(0), F.lit(" "), size, F.lit(" re"))).otherwise(quad)


def texts(blocks: DataFrame, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A row for each span of blocks (doc, page, block_index, type, lines: array of struct(dir: struct(x, y), spans: array of struct(text, bbox: array, size, font))): index within the page, text, box, font, direction and places."""
    lines = blocks.where("type = 0").select("doc", "page", "block_index", F.posexplode("lines").alias("line_index", "line"))
    spans = lines.select("doc", "page", "block_index", "line_index", F.col("line.dir").alias("dir"), F.posexplode("line.spans").alias("span_index", "span"))
    trimmed = F.regexp_replace(F.coalesce(F.col("span.text"), F.lit("")), r"(?U)^\s+|\s+$", "")
    box = [F.get(F.col("span.bbox"), i).cast("double").alias(c) for i, c in enumerate(B.CORNERS)]
    rows = spans.where((trimmed != "") & (F.size("span.bbox") >= 4)).select("doc", "page", "block_index", "line_index", "span_index", trimmed.alias("text"), *box, F.col("span.font").alias("font"), F.coalesce(F.col("span.size").cast("double"), F.lit(0.0)).alias("font_size"), F.coalesce(F.col("dir.x"), F.lit(1.0)).alias("dx"), F.coalesce(F.col("dir.y"), F.lit(0.0)).alias("dy"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc", "page").orderBy("block_index", "line_index", "span_index")
    return _region(rows, region).withColumn("index", F.row_number().over(order) - 1)


def public_page(value: Column, is_number: Column) -> Column:
    """A target page counted from 1: numbers count from 0, names from 1; null if there is none such."""
    n = value.try_cast("int")
    return F.when(is_number, F.when(n >= 0, n + 1)).otherwise(F.when(n >= 1, n))


def links(annotations: DataFrame) -> DataFrame:
    """Annotations (doc, page, index, from: box struct or null, target string, target_is_number, ...) within the document, with target_page and box; others go."""
    at = public_page(F.col("target"), F.col("target_is_number"))
    rest = [c for c in annotations.columns if c not in ("from", "target", "target_is_number")]
    return annotations.where(F.col("from").isNotNull() & at.isNotNull()).select(*rest, at.alias("target_page"), *B.Box.of(F.col("from")).columns())


def highlight_region(scripts: Column, view: Column, fit: Column, page_height: Column) -> Column:
    """struct(kind, x0, y0, x1, y1): the region that a link shows: the first highlight call of its scripts, flipped and rounded to six digits; else its view (x, y, width, height); else the whole page."""
    pattern = r"(?s)highlight\\?\([^\[]*\[([^\]]+)\]"
    calls = F.filter(F.transform(scripts, lambda s: F.regexp_extract(s, pattern, 1)), lambda s: s != "")
    n = F.transform(F.split(F.get(calls, 0), ","), lambda x: F.trim(x).try_cast("double"))
    r = lambda v: F.round(v, 6)
    shown = lambda kind, box: F.struct(F.lit(kind).alias("kind"), *[v.cast("double").alias(c) for v, c in zip(box, B.CORNERS, strict=True)])
    x0, y0, x1, y1 = (F.get(n, i) for i in range(4))
    whole = (F.size(n) == 4) & x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull() & page_height.isNotNull()
    call = shown("highlight", (r(F.least(x0, x1)), r(page_height - F.greatest(y0, y1)), r(F.greatest(x0, x1)), r(page_height - F.least(y0, y1))))
    v = [F.get(view, i) for i in range(4)]
    seen = shown("viewrect", (v[0], v[1], v[0] + v[2], v[1] + v[3]))
    none = F.lit(None).cast("double")
    return F.when(whole, call).when(F.size(view) == 4, seen).when(fit, shown("whole_page", (none, none, none, none)))


def action_chains(objects: DataFrame, starts: DataFrame) -> DataFrame:
    """(link, role, xref, depth): the objects (xref, refs: array of struct(role, xref)) that a link (link, xref) leads to over its action and the next ones, each once, at its least depth."""
    from ..plans.runtime import cut, small

    refs = objects.select(F.col("xref").alias("at"), F.explode("refs").alias("r")).select("at", "r.role", "r.xref")
    first = refs.where("role in ('A', 'Dest')").join(starts.select("link", F.col("xref").alias("at")), "at").select("link", "role", "xref", F.lit(0).alias("depth"))
    seen = frontier = cut(first.dropDuplicates(["link", "xref"]))
    follow, depth = cut(refs.where("role = 'Next'")), 0
    while not frontier.isEmpty():
        depth += 1
        step = follow.join(small(frontier.select("link", F.col("xref").alias("at"))), "at").select("link", "role", "xref", F.lit(depth).alias("depth")).dropDuplicates(["link", "xref"])
        frontier = cut(step.join(small(seen.select("link", "xref")), ["link", "xref"], "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def commands(kind: Column, points: Column) -> Column:
    """M, L, C and Z commands of a path."""
    at = lambda letter, i: F.struct(F.lit(letter).alias("op"), F.array(F.get(points, i)).alias("points"))
    curve = F.struct(F.lit("C").alias("op"), F.slice(points, 2, 3).alias("points"))
    none = F.struct(F.lit("Z").alias("op"), F.slice(points, 1, 0).alias("points"))
    return F.when(kind == "line", F.array(at("M", 0), at("L", 1))).when(kind == "curve", F.array(at("M", 0), curve)).otherwise(F.array(at("M", 0), at("L", 1), at("L", 2), at("L", 3), none))


def paint_operator(kind: Column, filled: Column, stroked: Column, even_odd: Column) -> Column:
    """How a path is painted: by its kind (fs, f or s, the last if null), else by whether it is filled and stroked."""
    fill = F.when(F.coalesce(even_odd, F.lit(False)), "f*").otherwise("f")
    t = F.coalesce(kind, F.lit("s"))
    told = F.when(t == "fs", "B").when(t == "f", fill).when(t == "s", "S")
    return told.when(filled & stroked, "B").when(filled, fill).otherwise("S")


def snippet(code: Column, most: int = config.SNIPPET) -> Column:
    """A code's first characters, with a mark where there are more."""
    return F.when(F.length(code) > most, F.concat(F.substring(code, 1, most), F.lit("\n...[truncated]"))).otherwise(code)


def reader_items(vectors_: DataFrame, texts_: DataFrame, images: DataFrame, links_: DataFrame, pages: DataFrame, most: int = config.VECTORS_ON_PAGE) -> DataFrame:
    """All items of pages (doc, page, height) in one table, with kind and boxes that count up from the bottom; no vectors on pages with more than most paths."""
    crowded = vectors_.groupBy("doc", "page").agg(F.count_distinct("path_index").alias("n")).where(F.col("n") > most).select("doc", "page")
    parts = ((vectors_.join(crowded, ["doc", "page"], "left_anti"), "vector"), (texts_, "text"), (images, "image"), (links_, "link"))
    out = None
    for rows, kind in parts:
        flat = rows.join(pages.select("doc", "page", "height"), ["doc", "page"])
        box = B.flipped(B.Box.named(), F.col("height"))
        flat = flat.select(*[c for c in flat.columns if c not in (*B.CORNERS, "height", "kind")], *box.columns(), F.lit(kind).alias("kind"))
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
    return out


def item_counts(items: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, page, kind, indexed, total): items of each kind on each page, beside how many the page has (doc, page, kind, total)."""
    own = items.groupBy("doc", "page", "kind").agg(F.count("*").alias("indexed"))
    return totals.join(own, ["doc", "page", "kind"], "left").select("doc", "page", "kind", F.coalesce("indexed", F.lit(0).cast("long")).alias("indexed"), "total")
