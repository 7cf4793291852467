"""Tables: cells and their texts, rows and columns, spans, splits within cells and HTML.

cells: keys, id, x0, y0, x1, y1; texts: keys, id, text, x0, y0, x1, y1.
Defined cases: a cell without width or height goes; texts that meet no cell go; ties as each function says; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import boxes as B
from ..plans.runtime import per_group
from . import intervals, spatial

KEYS = ("page",)
BOX = list(B.CORNERS)


def placed(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """cells with row, col, rowspan and colspan: where their edges are among all distinct edges of the table."""
    good = cells.where("x1 > x0 and y1 > y0")

    def places(low: str, high: str) -> DataFrame:
        edges = good.select(*keys, F.explode(F.array(low, high)).alias("v")).distinct()
        return edges.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)

    out = good
    for low, high, place, span in (("x0", "x1", "col", "colspan"), ("y0", "y1", "row", "rowspan")):
        at = places(low, high)
        out = out.join(at.select(*keys, F.col("v").alias(low), F.col("n").alias(place)), [*keys, low]).join(at.select(*keys, F.col("v").alias(high), F.col("n").alias("__to")), [*keys, high]).withColumn(span, F.col("__to") - F.col(place)).drop("__to")
    return out.select(*cells.columns, "row", "col", "rowspan", "colspan")


def bands(cells: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows, columns) of a table: keys, index, start, end."""
    good = cells.where("x1 > x0 and y1 > y0")
    return intervals.edges_of(good, keys, "y0", "y1"), intervals.edges_of(good, keys, "x0", "x1")


def slots(placed_cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, col, id): every place that a cell covers."""
    over = lambda at, n: F.explode(F.sequence(F.col(at), F.col(at) + F.col(n) - 1))
    return placed_cells.select(*keys, "id", over("row", "rowspan").alias("row"), "col", "colspan").select(*keys, "row", over("col", "colspan").alias("col"), "id")


def assigned(texts: DataFrame, placed_cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cell, and the columns of texts): each text in the cell that it overlaps most; ties to the fewer slots, the smaller cell, the smaller id."""
    met = spatial.meet(texts, placed_cells, keys=keys).withColumn("o", B.overlap(spatial.A, spatial.Z)).where("o > 0")
    best = F.max(F.struct("o", (-F.col("b_rowspan") * F.col("b_colspan")).alias("n"), (-B.area(spatial.Z)).alias("a"), (-F.col("b_id")).alias("c"))).alias("x")
    chosen = met.groupBy(*keys, F.col("a_id").alias("id")).agg(best).select(*keys, "id", (-F.col("x.c")).alias("cell"))
    return texts.join(chosen, [*keys, "id"]).select(*keys, "cell", *[c for c in texts.columns if c not in keys])


def _lines(rows: list[dict]) -> list[list[dict]]:
    """Texts in lines: each, from the top on, in the first line whose box so far it overlaps in height."""
    out: list[tuple[list[dict], list[float]]] = []
    for r in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["id"])):
        for line, reach in out:
            if min(r["y1"], reach[1]) - max(r["y0"], reach[0]) > 0:
                line.append(r)
                reach[:] = min(reach[0], r["y0"]), max(reach[1], r["y1"])
                break
        else:
            out.append(([r], [r["y0"], r["y1"]]))
    return [line for line, _ in sorted(out, key=lambda x: x[1][0])]


def read_text(rows: list[dict]) -> str:
    """Texts line by line, from left to right, with spaces between."""
    return " ".join(r["text"] for line in _lines(rows) for r in sorted(line, key=lambda r: (r["x0"], r["id"])) if r["text"]).strip()


def cell_texts(assigned_texts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cell, text, text_ids): the texts of each cell as read."""
    from pyspark.sql import types as T

    schema = T.StructType([*(assigned_texts.schema[k] for k in keys), assigned_texts.schema["cell"], T.StructField("text", T.StringType()), T.StructField("text_ids", T.ArrayType(T.LongType()))])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids = [r["id"] for r in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["id"]))]
        return pa.table([*[pa.array([rows[0][k]], table.schema.field(k).type) for k in (*keys, "cell")], pa.array([read_text(rows)], pa.string()), pa.array([ids], pa.list_(pa.int64()))], names=[*keys, "cell", "text", "text_ids"])

    return per_group(assigned_texts.select(*keys, "cell", "id", "text", *BOX), [*keys, "cell"], run, schema)


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html(placed_cells: DataFrame, texts: DataFrame, splits: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, html) of a table: spans as attributes, texts escaped, empty places before a row's last cell as empty cells; splits as their two sides around a label.

    texts: keys, cell, text; splits: keys, cell, nth, label, first_text, second_text.
    """
    span = lambda name: F.when(F.col(name) > 1, F.concat(F.lit(f'{name}="'), F.col(name).cast("string"), F.lit('"')))
    own = placed_cells.select(*keys, F.col("id").alias("cell"), "row", "col", "rowspan", "colspan").join(texts.select(*keys, "cell", "text"), [*keys, "cell"], "left")
    shown = _escaped(F.coalesce("text", F.lit("")))
    if splits is not None:
        side = F.concat_ws(" ", _escaped(F.col("first_text")), _escaped(F.col("label")), _escaped(F.col("second_text")))
        lines = splits.groupBy(*keys, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", side.alias("s")))), lambda x: x["s"]), "<br>").alias("__split"))
        own = own.join(lines, [*keys, "cell"], "left")
        shown = F.coalesce("__split", shown)
    attributes = F.concat_ws(" ", span("rowspan"), span("colspan"))
    td = F.concat(F.lit("    <td"), F.when(attributes != "", F.concat(F.lit(" "), attributes)).otherwise(""), F.lit(">"), shown, F.lit("</td>"))
    own = own.withColumn("td", td)
    # Of cells that begin at one place the last one is shown, as the only one.
    anchors = own.groupBy(*keys, "row", "col").agg(F.max(F.struct("cell", "td")).alias("x")).select(*keys, "row", "col", F.col("x.td").alias("td"))
    last = anchors.groupBy(*keys, "row").agg(F.max("col").alias("last"))
    covered = slots(placed_cells, keys).select(*keys, "row", "col").distinct()
    holes = last.select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("col")).join(covered, [*keys, "row", "col"], "left_anti").withColumn("td", F.lit("    <td></td>"))
    rows = anchors.unionByName(holes).groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "td"))), lambda x: x["td"]), "\n").alias("tds"))
    height = placed_cells.groupBy(*keys).agg(F.max(F.col("row") + F.col("rowspan")).alias("n"))
    every = height.select(*keys, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row")).join(rows, [*keys, "row"], "left")
    line = F.concat(F.lit("  <tr>\n"), F.when(F.col("tds").isNotNull(), F.concat("tds", F.lit("\n"))).otherwise(""), F.lit("  </tr>"))
    whole = every.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    return whole.select(*keys, F.concat(F.lit('<table border="1" cellspacing="0" cellpadding="4">\n'), "body", F.lit("\n</table>")).alias("html"))


SPLIT_KINDS = ("vertical", "horizontal", "left_diagonal", "right_diagonal")


def segments_of(vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, vector, nth, sx, sy, ex, ey): the straight steps of lines, rectangles and quads (keys, id, type, points)."""
    n = F.size("points")
    ring = F.when(F.col("type").isin("rect", "quad") & (n >= 4), F.concat(F.slice("points", 1, 4), F.slice("points", 1, 1))).otherwise(F.col("points"))
    step = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return vectors.where(n >= 2).select(*keys, F.col("id").alias("vector"), F.posexplode(step).alias("nth", "s")).select(*keys, "vector", "nth", F.col("s.p.x").alias("sx"), F.col("s.p.y").alias("sy"), F.col("s.q.x").alias("ex"), F.col("s.q.y").alias("ey"))


def split_kind() -> Column:
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    rises = (dx > 0) == (dy > 0)
    return F.when((dx == 0) & (dy != 0), "vertical").when((dy == 0) & (dx != 0), "horizontal").when((dx != 0) & (dy != 0), F.when(rises, "right_diagonal").otherwise("left_diagonal"))


def splitters(vectors: DataFrame, cells: DataFrame, assigned_texts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cell, kind, sx, sy, ex, ey, nth): segments inside cells of two texts or more, not on their outline; slanted ones from a side to another; in order of y, x, then the longest."""
    several = assigned_texts.groupBy(*keys, "cell").agg(F.count("*").alias("n")).where("n >= 2").select(*keys, F.col("cell").alias("id"))
    own = segments_of(vectors.where(F.col("type") != "curve"), keys).withColumn("kind", split_kind()).where("kind is not null")
    own = own.withColumns({"x0": F.least("sx", "ex"), "y0": F.least("sy", "ey"), "x1": F.greatest("sx", "ex"), "y1": F.greatest("sy", "ey")}).withColumn("id", F.struct("vector", "nth"))
    met = spatial.meet(own, cells.join(several, [*keys, "id"], "left_semi").select(*keys, "id", *BOX), keys=keys).where(B.contains(spatial.Z, spatial.A))
    on = lambda x, y: (F.col(x) == spatial.Z.x0, F.col(x) == spatial.Z.x1, F.col(y) == spatial.Z.y0, F.col(y) == spatial.Z.y1)
    s, e = on("a_sx", "a_sy"), on("a_ex", "a_ey")
    outline = (F.col("a_kind") == "vertical") & (s[0] | s[1]) | (F.col("a_kind") == "horizontal") & (s[2] | s[3])
    both = (s[0] | s[1] | s[2] | s[3]) & (e[0] | e[1] | e[2] | e[3])
    same = (s[0] == e[0]) & (s[1] == e[1]) & (s[2] == e[2]) & (s[3] == e[3])
    across = both & ~same & (s[0] | s[1] | e[0] | e[1]) & (s[2] | s[3] | e[2] | e[3])
    good = met.where(~outline & (~F.col("a_kind").isin("left_diagonal", "right_diagonal") | across))
    one = good.groupBy(*keys, F.col("b_id").alias("cell"), F.col("a_kind").alias("kind"), *[F.col(f"a_{c}").alias(c) for c in BOX]).agg(F.min(F.struct("a_id", "a_sx", "a_sy", "a_ex", "a_ey")).alias("x"))
    order = Window.partitionBy(*keys, "cell").orderBy("y0", "x0", F.desc(F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")), "x.a_id")
    return one.select(*keys, "cell", "kind", F.col("x.a_sx").alias("sx"), F.col("x.a_sy").alias("sy"), F.col("x.a_ex").alias("ex"), F.col("x.a_ey").alias("ey"), F.row_number().over(order).alias("nth"))


def subcells(splits: DataFrame, assigned_texts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, cell, nth, kind, label, first_ids, second_ids, first_text, second_text): splitters with texts on both sides; those that part the texts as an earlier one does are left out."""
    from pyspark.sql import types as T

    schema = T.StructType([*(splits.schema[k] for k in (*keys, "cell", "nth")), *T.StructType.fromDDL("kind string, label string, first_ids array<bigint>, second_ids array<bigint>, first_text string, second_text string").fields])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        texts, rows, seen = right.to_pylist(), [], set()
        middle = lambda r: ((r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2)
        for s in sorted(left.to_pylist(), key=lambda s: s["nth"]):

            def side(r: dict, s: dict = s) -> float:
                x, y = middle(r)
                if s["kind"] == "vertical":
                    return x - (s["sx"] + s["ex"]) / 2
                if s["kind"] == "horizontal":
                    return y - (s["sy"] + s["ey"]) / 2
                return (s["ex"] - s["sx"]) * (y - s["sy"]) - (s["ey"] - s["sy"]) * (x - s["sx"])

            parts = ([r for r in texts if side(r) <= 0], [r for r in texts if side(r) > 0])
            if not parts[0] or not parts[1]:
                continue
            axis = 1 if s["kind"] == "horizontal" else 0
            parts = sorted(parts, key=lambda p: sum(middle(r)[axis] for r in p) / len(p))
            ids = [[r["id"] for r in sorted(p, key=lambda r: (r["y0"], r["x0"], r["id"]))] for p in parts]
            sign = frozenset(map(tuple, ids))
            if sign not in seen:
                seen.add(sign)
                rows.append((s["nth"], s["kind"], f"<{s['kind']}>", *ids, *map(read_text, parts)))
        from pyspark.sql.pandas.types import to_arrow_type

        heads = [pa.array([k.as_py()] * len(rows), to_arrow_type(f.dataType)) for k, f in zip(key, schema.fields, strict=False)]
        types = [to_arrow_type(f.dataType) for f in schema.fields[len(keys) + 1 :]]
        return pa.table([*heads, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=[f.name for f in schema.fields])

    by = [*keys, "cell"]
    return splits.groupBy(*by).cogroup(assigned_texts.select(*by, "id", "text", *BOX).groupBy(*by)).applyInArrow(run, schema)


def reconstruct(cells: DataFrame, texts: DataFrame, vectors: DataFrame | None = None, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(cells, html): cells with their place, texts as read, and each table as HTML."""
    from ..plans.runtime import cut

    at = cut(placed(cells.select(*keys, "id", *BOX), keys))
    own = cut(assigned(texts.select(*keys, "id", "text", *BOX), at, keys))
    read = cut(cell_texts(own, keys))
    splits = None if vectors is None else cut(subcells(splitters(vectors, at, own, keys), own, keys))
    rows = at.join(read.withColumnRenamed("cell", "id"), [*keys, "id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return rows, html(at, read, splits, keys)


def symbol_column(grid: DataFrame, drawn: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, col): the column of a table in which most rows but the first have vectors, the first of such; drawn: keys, row, col of the cells that have some."""
    counts = drawn.where("row > 0").select(*keys, "row", "col").distinct().join(grid.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_semi").groupBy(*keys, "col").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("col")).alias("c"))).alias("x")).select(*keys, (-F.col("x.c")).alias("col"))


def cell_vectors(vectors: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS, tolerance: float = config.GRID_COORDINATE) -> DataFrame:
    """(keys, row, col, id): vectors whose centre is in a cell of the grid and that are no line of it."""
    met = spatial.meet(vectors.select(*keys, "id", *BOX), grid.select(*keys, F.struct("row", "col").alias("id"), *BOX), keys=keys).where(B.holds_centre(spatial.Z, spatial.A))
    upright = grid.select(*keys, F.explode(F.array("x0", "x1")).alias("v")).distinct().groupBy(*keys).agg(F.collect_set("v").alias("xs"))
    level = grid.select(*keys, F.explode(F.array("y0", "y1")).alias("v")).distinct().groupBy(*keys).agg(F.collect_set("v").alias("ys"))
    near = lambda edges, v: F.exists(edges, lambda e: F.abs(e - v) <= tolerance)
    line = F.when(F.abs(spatial.A.x1 - spatial.A.x0) <= tolerance, near(F.col("xs"), spatial.A.x0)).when(F.abs(spatial.A.y1 - spatial.A.y0) <= tolerance, near(F.col("ys"), spatial.A.y0)).otherwise(False)
    return met.join(upright, list(keys)).join(level, list(keys)).where(~line).select(*keys, F.col("b_id.row").alias("row"), F.col("b_id.col").alias("col"), F.col("a_id").alias("id"))


def symbol_records(grid: DataFrame, vectors: DataFrame, texts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, row, type, descriptions, vectors): of each row but the first with vectors in the symbol column: the text of the next column names it, those of later ones describe it."""
    drawn = cell_vectors(vectors, grid, keys)
    column = symbol_column(grid, drawn, keys).withColumnRenamed("col", "__at")
    shapes = drawn.join(column, list(keys)).where("col = __at and row > 0").groupBy(*keys, "row").agg(F.array_sort(F.collect_list("id")).alias("vectors"))
    cells = grid.select(*keys, (F.col("row") * 100_000 + F.col("col")).alias("id"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), *BOX)
    read = cell_texts(assigned(texts.select(*keys, "id", "text", *BOX), cells, keys), keys).select(*keys, F.floor(F.col("cell") / 100_000).cast("int").alias("row"), (F.col("cell") % 100_000).cast("int").alias("col"), "text")
    after = read.join(column, list(keys)).where("col > __at and text != ''")
    told = after.groupBy(*keys, "row").agg(F.max(F.when(F.col("col") == F.col("__at") + 1, F.col("text"))).alias("type"), F.transform(F.array_sort(F.collect_list(F.when(F.col("col") > F.col("__at") + 1, F.struct("col", "text")))), lambda x: x["text"]).alias("descriptions"))
    return shapes.join(told, [*keys, "row"], "left").select(*keys, "row", "type", F.coalesce("descriptions", F.array().cast("array<string>")).alias("descriptions"), "vectors")


def snapped_region(region: B.Box, vectors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, x0, y0, x1, y1): a region grown to the nearest lines that enclose it: upright ones that overlap it in height at its left and right, level ones above and below; its own side where there is none."""
    b = B.Box.named()
    upright, level = b.y1 - b.y0 >= b.x1 - b.x0, b.x1 - b.x0 >= b.y1 - b.y0
    high = upright & (F.least(b.y1, region.y1) > F.greatest(b.y0, region.y0))
    wide = level & (F.least(b.x1, region.x1) > F.greatest(b.x0, region.x0))
    found = vectors.groupBy(*keys).agg(F.max(F.when(high & (b.x1 <= region.x0), b.x1)).alias("l"), F.max(F.when(wide & (b.y1 <= region.y0), b.y1)).alias("t"), F.min(F.when(high & (b.x0 >= region.x1), b.x0)).alias("r"), F.min(F.when(wide & (b.y0 >= region.y1), b.y0)).alias("d"))
    return found.select(*keys, F.coalesce("l", region.x0).alias("x0"), F.coalesce("t", region.y0).alias("y0"), F.coalesce("r", region.x1).alias("x1"), F.coalesce("d", region.y1).alias("y1"))


def layout_regions(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, page, x0, y0, x1, y1): the region found on the first page of each size (to three digits), scaled to all pages of that size.

    pages: doc, page, width, height; found: doc, page and box.
    """
    size = [F.round("width", 3).alias("__w"), F.round("height", 3).alias("__h")]
    sized = pages.select("doc", "page", "width", "height", *size)
    first = sized.join(found, ["doc", "page"]).groupBy("__w", "__h").agg(F.min(F.struct("doc", "page", F.col("width").alias("w"), F.col("height").alias("h"), *BOX)).alias("f"))
    joined = sized.join(F.broadcast(first), ["__w", "__h"])
    sx, sy = F.col("width") / F.col("f.w"), F.col("height") / F.col("f.h")
    return joined.select("doc", "page", *[(F.col(f"f.{c}") * (sx if c[0] == "x" else sy)).alias(c) for c in BOX])
