"""Relations of a page's elements, endpoints and wires, and the components, nets and edges made of them.

elements: keys, id, type, x0, y0, x1, y1 and lists title, descriptions; endpoints: keys, id and box; segments: keys, wire, x0, y0, x1, y1 (lines' ends).
An element's geometry is its box; an endpoint's is the centre of its box where a wire is measured against it.
Edges are keys, type, source, target with source and target as kind:id.

Defined cases: ids are numbers, unique within the keys and type of thing; nulls meet nothing; rows that repeat give one edge; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import boxes as B
from ..functions import text as T
from ..plans.runtime import cut
from . import graph, spatial

KEYS = ("page",)
BOX = list(B.CORNERS)


def _ref(kind: str, column: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


def _number(reference: str) -> Column:
    return F.regexp_extract(reference, ":(.*)$", 1).try_cast("long")


def _edge(kind: str, source: Column, target: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), source.alias("source"), target.alias("target")]


def unique_edges(edges: DataFrame, keys: Sequence[str] = KEYS, order: str | None = None) -> DataFrame:
    """One edge of each type, source and target: the first by order, if that column is given."""
    by = [*keys, "type", "source", "target"]
    if order is None:
        return edges.dropDuplicates(by)
    rest = [c for c in edges.columns if c not in by and c != order]
    return edges.groupBy(*by).agg(F.min(F.struct(order, *rest)).alias("x")).select(*by, "x.*").select(*edges.columns)


def merge_adjacent_boxes(elements: DataFrame, margin: float = config.BOX_ADJACENCY, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(elements, aliases): boxes at most margin apart of which none covers another become one, in chains: the largest stays (then the smallest id) with the box and texts of all.

    aliases: keys, id, kept.
    """
    boxes = elements.where("type = 'box'")
    name = lambda c: F.struct(*keys, F.col(c).alias("id"))
    pairs = spatial.adjacent(boxes.select(*keys, "id", *BOX), margin, keys=keys)
    groups = cut(graph.components(pairs.select(name("a_id").alias("source_id"), name("b_id").alias("target_id"))).select("id.*", F.col("root.id").alias("group")))
    members = boxes.join(groups, [*keys, "id"])
    best = F.max(F.struct(B.area(B.Box.named()).alias("a"), (-F.col("id")).alias("n")))
    texts = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c]))).alias(c)
    merged = members.groupBy(*keys, "group").agg((-best["n"]).alias("kept"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), texts("title"), texts("descriptions"))
    merged = cut(merged)
    aliases = cut(groups.join(merged.select(*keys, "group", "kept"), [*keys, "group"]).where("id != kept").select(*keys, "id", "kept"))
    kept = elements.join(aliases.select(*keys, "id"), [*keys, "id"], "left_anti")
    new = merged.select(*keys, F.col("kept").alias("id"), F.struct(*BOX, "title", "descriptions").alias("__new"))
    joined = kept.join(new, [*keys, "id"], "left")
    columns = [F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in (*BOX, "title", "descriptions") else F.col(c) for c in elements.columns]
    return joined.select(*columns), aliases


def remap(edges: DataFrame, aliases: DataFrame, kind: str = "element", keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges with merged elements named by those kept, without contains edges of one to itself."""
    out = edges
    for end in ("source", "target"):
        known = aliases.select(*keys, _ref(kind, "id").alias(end), _ref(kind, "kept").alias("__to"))
        out = out.join(known, [*keys, end], "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    return out.where("not (type = 'contains' and source = target)").select(*edges.columns)


def endpoint_owners(elements: DataFrame, endpoints: DataFrame, tolerance: float = config.RELATION_POINT, keys: Sequence[str] = KEYS) -> DataFrame:
    """contains edges from the smallest element within the tolerance of each endpoint, ties by id."""
    near = spatial.meet(endpoints.select(*keys, "id", *BOX), elements.select(*keys, "id", *BOX), keys=keys, within=tolerance)
    best = near.groupBy(*keys, "a_id").agg(F.min(F.struct(B.area(spatial.Z).alias("a"), F.col("b_id").alias("b"))).alias("x"))
    return best.select(*keys, *_edge("contains", _ref("element", "x.b"), _ref("endpoint", "a_id")))


def parents(elements: DataFrame, share: float = config.CONTAINMENT_SHARE, keys: Sequence[str] = KEYS) -> DataFrame:
    """contains edges from the smallest strictly larger element that covers that share of each."""
    found = spatial.smallest_cover(elements.select(*keys, "id", *BOX), elements.select(*keys, "id", *BOX), share, keys=keys)
    return found.select(*keys, *_edge("contains", _ref("element", "parent"), _ref("element", "id")))


def _segment_distance() -> Column:
    """From the point (px, py) to the segment (sx0, sy0) - (sx1, sy1)."""
    px, py, x0, y0, x1, y1 = (F.col(c) for c in ("px", "py", "sx0", "sy0", "sx1", "sy1"))
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    ax, ay = px - x0 - t * dx, py - y0 - t * dy
    return F.sqrt(ax * ax + ay * ay)


def near_segments(points: DataFrame, segments: DataFrame, within: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, a_*, b_*, distance: points (id, box) whose centre is within of a segment (id, x0, y0, x1, y1 as drawn)."""
    ends = segments.withColumns({"sx0": F.col("x0"), "sy0": F.col("y0"), "sx1": F.col("x1"), "sy1": F.col("y1")})
    low = ends.withColumns({"x0": F.least("sx0", "sx1"), "y0": F.least("sy0", "sy1"), "x1": F.greatest("sx0", "sx1"), "y1": F.greatest("sy0", "sy1")})
    x, y = B.centre(B.Box.named())
    at = points.withColumns({"px": x, "py": y}).withColumns({"x0": F.col("px"), "x1": F.col("px"), "y0": F.col("py"), "y1": F.col("py")})
    met = spatial.meet(at, low, keys=keys, within=within)
    named = met.withColumns({"px": F.col("a_px"), "py": F.col("a_py"), **{c: F.col(f"b_{c}") for c in ("sx0", "sy0", "sx1", "sy1")}})
    return named.withColumn("distance", _segment_distance()).where(F.col("distance") <= within).drop("px", "py", "sx0", "sy0", "sx1", "sy1")


def wire_touches(segments: DataFrame, endpoints: DataFrame, edges: DataFrame, tolerance: float = config.RELATION_POINT, keys: Sequence[str] = KEYS) -> DataFrame:
    """wire_connection edges, not yet there, of wires with a line longer than twice the tolerance that meets an endpoint connected to some wire."""
    long = segments.withColumn("length", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))).where(F.col("length") > 2 * tolerance)
    long = long.select(*keys, F.monotonically_increasing_id().alias("id"), "wire", *BOX)
    connected = edges.where("type = 'wire_connection' and target like 'endpoint:%'").select(*keys, _number("target").alias("id")).distinct()
    met = near_segments(endpoints.join(connected, [*keys, "id"], "left_semi").select(*keys, "id", *BOX), long, tolerance, keys)
    made = met.select(*keys, *_edge("wire_connection", _ref("wire", "b_wire"), _ref("endpoint", "a_id"))).distinct()
    return made.join(edges.where("type = 'wire_connection'").select(*keys, "source", "target"), [*keys, "source", "target"], "left_anti").select(*keys, "type", "source", "target")


def endpoint_fallback(elements: DataFrame, endpoints: DataFrame, edges: DataFrame, margin: float = config.ENDPOINT_FALLBACK, keys: Sequence[str] = KEYS) -> DataFrame:
    """contains edges from the nearest element within the margin (then the smallest, then by id) to wires' endpoints that no element owns."""
    wired = edges.where("type in ('wire_connection', 'connection') and source like 'wire:%' and target like 'endpoint:%'").select(*keys, "target").distinct()
    owned = edges.where("type = 'contains' and source like 'element:%' and target like 'endpoint:%'").select(*keys, "target")
    free = wired.join(owned, [*keys, "target"], "left_anti").select(*keys, _number("target").alias("id"))
    near = spatial.nearest(endpoints.join(free, [*keys, "id"], "left_semi").select(*keys, "id", *BOX), elements.select(*keys, "id", *BOX), k=1, keys=keys, reach=margin, order=[B.area(spatial.Z)])
    return near.select(*keys, *_edge("contains", _ref("element", "b_id"), _ref("endpoint", "a_id")))


def organize(elements: DataFrame, endpoints: DataFrame, segments: DataFrame, connections: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(elements, edges): adjacent boxes merged, endpoints owned, elements nested, wires that touch endpoints connected, the rest of the endpoints to the nearest element."""
    merged, aliases = merge_adjacent_boxes(elements, keys=keys)
    merged = cut(merged)
    edges = remap(connections.select(*keys, "type", "source", "target"), aliases, keys=keys).unionByName(endpoint_owners(merged, endpoints, keys=keys)).unionByName(parents(merged, keys=keys))
    edges = cut(unique_edges(edges, keys))
    edges = cut(edges.unionByName(wire_touches(segments, endpoints, edges, keys=keys)))
    return merged, unique_edges(edges.unionByName(endpoint_fallback(merged, endpoints, edges, keys=keys)), keys)


def transfer_marks(wires: DataFrame, elements: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wires, elements, edges) with the texts of wire marks on the wire of their vector (wires.vectors holds wire_vector), and without marks and their edges."""
    marks = elements.where("type = 'wire_mark'")
    of = wires.select(*keys, F.col("id").alias("wire"), F.explode("vectors").alias("wire_vector")).dropDuplicates([*keys, "wire_vector"])
    texts = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", c))), lambda x: x[c])).alias(f"__{c}")
    told = marks.join(of, [*keys, "wire_vector"]).groupBy(*keys, F.col("wire").alias("id")).agg(texts("title"), texts("descriptions"))
    joined = wires.join(told, [*keys, "id"], "left")
    for c in ("title", "descriptions"):
        joined = joined.withColumn(c, T.text_list(F.col(c), F.col(f"__{c}")))
    gone = marks.select(*keys, _ref("element", "id").alias("__ref"))
    rest = edges
    for end in ("source", "target"):
        rest = rest.join(gone.withColumnRenamed("__ref", end), [*keys, end], "left_anti")
    return joined.select(*wires.columns), elements.where("type != 'wire_mark'"), rest.select(*edges.columns)


COMPOSED = "component long, element long, place int"


def compose(elements: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, component, element, place): elements that contains edges join, a component for each that none contains, in the order of ids; then for what is left, as cycles are.

    An element that two contain goes with the component that comes first. A page is composed in one task.
    """
    inside = edges.where("type = 'contains' and source like 'element:%' and target like 'element:%' and source != target").select(*keys, _number("source").alias("a"), _number("target").alias("b"))
    schema = ", ".join(f"{k} {elements.schema[k].dataType.simpleString()}" for k in keys) + ", " + COMPOSED

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = sorted(left["id"].to_pylist())
        children: dict[int, set[int]] = {i: set() for i in ids}
        contained = set()
        for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True):
            if a in children and b in children:
                children[a].add(b)
                contained.add(b)
        rows: list[tuple[int, int, int]] = []
        seen: set[int] = set()
        component = 0
        for root in [*(i for i in ids if i not in contained), *ids]:
            if root in seen:
                continue
            stack, place = [root], 0
            while stack:
                at = stack.pop()
                if at in seen:
                    continue
                seen.add(at)
                rows.append((component, at, place))
                place += 1
                stack.extend(sorted(children[at], key=str, reverse=True))
            component += 1
        out = [[k.as_py()] * len(rows) for k in key]
        return pa.table([*[pa.array(v, left.schema.field(n).type) for v, n in zip(out, keys, strict=True)], *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]], names=[*keys, "component", "element", "place"])

    return elements.groupBy(*keys).cogroup(inside.groupBy(*keys)).applyInArrow(run, schema)


def component_records(elements: DataFrame, composed: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each component: id, box of all its elements, element_ids in order, types, subclass, title, descriptions, endpoints."""
    own = composed.join(elements.withColumnRenamed("id", "element"), [*keys, "element"])
    inside = edges.where("type = 'contains' and source like 'element:%' and target like 'endpoint:%'").select(*keys, _number("source").alias("element"), _number("target").alias("endpoint"))
    ends = composed.join(inside, [*keys, "element"]).groupBy(*keys, "component").agg(F.array_sort(F.collect_set("endpoint")).alias("endpoints"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda x: x[c])
    rows = own.groupBy(*keys, "component").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), listed("element").alias("element_ids"), listed("type").alias("types"), listed("title").alias("t"), listed("descriptions").alias("d"))
    rows = rows.join(ends, [*keys, "component"], "left")
    return rows.select(*keys, F.col("component").alias("id"), *BOX, "element_ids", "types", T.subclass(F.col("types")).alias("subclass"), T.text_list(F.flatten("t")).alias("title"), T.text_list(F.flatten("d")).alias("descriptions"), F.coalesce("endpoints", F.array().cast("array<bigint>")).alias("endpoints"))


def net_names(nets: DataFrame, wires: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """nets with title: what all their wires' titles share, else their descriptions, else identifiers in these, as the first wire has them."""
    own = nets.select(*keys, "net", F.posexplode("wire_ids").alias("nth", "id")).join(wires.select(*keys, "id", "title", "descriptions"), [*keys, "id"])
    own = own.withColumn("tokens", T.identifiers(F.col("descriptions")))
    lists = own.groupBy(*keys, "net").agg(F.array_sort(F.collect_list(F.struct("nth", T.text_list(F.col("title")).alias("title"), T.text_list(F.col("descriptions")).alias("descriptions"), "tokens"))).alias("w"))
    shared = lambda f: F.aggregate(F.slice("w", F.lit(2), F.size("w")), F.get("w", 0)[f], lambda acc, x: F.array_intersect(acc, x[f]))
    fold = F.aggregate(F.slice("w", F.lit(2), F.size("w")), F.get("w", 0)["tokens"], lambda acc, x: F.filter(acc, lambda t: F.exists(x["tokens"], lambda o: F.lower(o) == F.lower(t))))
    title = F.when(F.size(shared("title")) > 0, shared("title")).when(F.size(shared("descriptions")) > 0, shared("descriptions")).otherwise(fold)
    return nets.join(lists.select(*keys, "net", title.alias("title")), [*keys, "net"], "left")


def final_relations(edges: DataFrame, composed: DataFrame, nets: DataFrame, components: DataFrame, groups: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Edges of the graph: wires' and components' connections to endpoints, and what nets and the smallest covering groups contain; each once."""
    wired = edges.where("type in ('wire_connection', 'connection') and source like 'wire:%' and target like 'endpoint:%'").select(*keys, *_edge("connection", F.col("source"), F.col("target")))
    owned = edges.where("type = 'contains' and source like 'element:%' and target like 'endpoint:%'").withColumn("element", _number("source")).join(composed.select(*keys, "element", "component"), [*keys, "element"]).select(*keys, *_edge("connection", _ref("component", "component"), F.col("target")))
    inside = nets.select(*keys, "net", F.explode("wire_ids").alias("wire")).select(*keys, *_edge("contains", _ref("net", "net"), _ref("wire", "wire")))
    around = spatial.smallest_cover(components.select(*keys, "id", *BOX), groups.select(*keys, F.col("id").cast("string").alias("id"), *BOX), keys=keys, larger=False)
    grouped = around.select(*keys, *_edge("contains", _ref("group", "parent"), _ref("component", "id")))
    return unique_edges(wired.unionByName(owned).unionByName(inside).unionByName(grouped), keys)


def handle(wires: DataFrame, elements: DataFrame, groups: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, nets, relations) of a page's intermediate edges."""
    wires, elements, edges = transfer_marks(wires, elements, edges, keys)
    composed = cut(compose(elements, edges, keys))
    components = cut(component_records(elements, composed, edges, keys))
    connections = edges.where("type in ('wire_connection', 'connection') and source like 'wire:%' and target like 'endpoint:%'").select(*keys, _number("source").alias("wire"), _number("target").alias("endpoint"))
    nets = cut(net_names(graph.wire_nets(wires.select(*keys, "id"), connections, keys), wires, keys))
    return components, nets, final_relations(edges, composed, nets, components, groups, keys)


# Where an arrow points.
POINTS = {"left": (-1.0, 0.0), "right": (1.0, 0.0), "up": (0.0, -1.0), "down": (0.0, 1.0)}


def page_io(arrows: DataFrame, connections: DataFrame, endpoints: DataFrame, wire_lines: DataFrame, cosine: float = config.FLOW_COSINE, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, component, page_io): input for arrows that point the way their wires leave, output against it; unknown where there is no such evidence or both.

    arrows: keys, component, element, direction; connections: keys, source, target (component or wire to endpoint); endpoints: keys, id and box;
    wire_lines: keys, wire, points.
    """
    tolerance = max(config.TOPOLOGY, config.RELATION_POINT)
    own = connections.where("source like 'component:%'").select(*keys, _number("source").alias("component"), "target").distinct()
    of_wire = connections.where("source like 'wire:%'").select(*keys, _number("source").alias("wire"), "target").distinct()
    x, y = B.centre(B.Box.named())
    at = endpoints.select(*keys, _ref("endpoint", "id").alias("target"), x.alias("px"), y.alias("py"))
    joined = arrows.join(own, [*keys, "component"]).join(of_wire, [*keys, "target"]).join(at, [*keys, "target"]).join(wire_lines, [*keys, "wire"])
    here = B.point(F.col("px"), F.col("py"))

    def leaving(points: Column) -> Column:
        """The way from here to the first point that is not here, if the line starts here."""
        away = F.filter(F.slice(points, F.lit(2), F.size(points)), lambda p: B.distance(p, here) > tolerance)
        return F.when((F.size(points) >= 2) & (B.distance(F.get(points, 0), here) <= tolerance), F.get(away, 0))

    ways = F.filter(F.array(leaving(F.col("points")), leaving(F.reverse("points"))), lambda p: p.isNotNull())
    told = joined.withColumn("way", F.explode(ways))
    ax = F.coalesce(*[F.when(F.col("direction") == d, v[0]) for d, v in POINTS.items()])
    ay = F.coalesce(*[F.when(F.col("direction") == d, v[1]) for d, v in POINTS.items()])
    score = B.cosine(ax, ay, F.col("way.x") - F.col("px"), F.col("way.y") - F.col("py"))
    evidence = told.withColumn("io", F.when(score >= cosine, "input").when(score <= -cosine, "output")).where("io is not null").select(*keys, "component", "element", "io").distinct()
    arrow = evidence.groupBy(*keys, "component", "element").agg(F.count_distinct("io").alias("n"), F.min("io").alias("io")).select(*keys, "component", "element", F.when(F.col("n") == 1, F.col("io")).alias("io"))
    every = arrows.select(*keys, "component", "element").distinct().join(arrow, [*keys, "component", "element"], "left")
    return every.groupBy(*keys, "component").agg(F.count_distinct("io").alias("n"), F.min("io").alias("io")).select(*keys, "component", F.when(F.col("n") == 1, F.col("io")).otherwise("unknown").alias("page_io"))
