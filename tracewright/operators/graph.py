"""Property-graph operators over a store of typed nodes and edges, which are used both ways.

nodes: id, kind and whatever else a node has; edges: id, kind, source_id, target_id and whatever else.
A trace is a loop of frontiers. Each step reads the adjacency once, against a frontier and a set of seen nodes that are broadcast
while they are small, and writes what it found; nothing grows on the driver.

Defined cases: null ids join nothing; nodes that repeat count once; edges that repeat are kept apart by their rows; an empty
store gives an empty trace of a start that is not there; columns besides those named pass through where a result has whole rows.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..plans.runtime import cut, small


class Store(NamedTuple):
    """documents (filename, document_id), nodes and edges."""

    documents: DataFrame
    nodes: DataFrame
    edges: DataFrame


class DocumentNotFound(LookupError):
    """The start is of no document that the store has."""


class StartNotFound(ValueError):
    """The document is there and the start is not."""


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are stored nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def adjacency(nodes: DataFrame, edges: DataFrame, omit: Collection[str] = ()) -> DataFrame:
    """(a, b, b_kind, edge_id) in both directions, a loop twice, without edges or nodes of omitted kinds."""
    kept = nodes.where(~F.col("kind").isin(list(omit))) if omit else nodes
    used = edges.where(~F.col("kind").isin(list(omit))) if omit else edges
    both = used.select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("x"), F.col("id").alias("edge_id")).select("x.a", "x.b", "edge_id")
    ids = kept.select("id", "kind").distinct()
    return both.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b"), F.col("kind").alias("b_kind")), "b").select("a", "b", "b_kind", "edge_id")


def _expand(near: DataFrame, start: DataFrame, max_hops: int, skip: Collection[str]) -> DataFrame:
    """(id, hop) reached from start (id). near: a, b, b_kind."""
    free = F.col("b_kind").isin(list(skip)) if skip else F.lit(False)
    seen = cut(start.select("id", F.lit(0).alias("hop")))
    layer = seen

    def step(frontier: DataFrame, known: DataFrame, which: Column, hop: int) -> DataFrame:
        found = near.where(which).join(small(frontier.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        return cut(found.join(small(known.select("id")), "id", "left_anti").select("id", F.lit(hop).alias("hop")))

    for hop in range(max_hops + 1):
        wave = layer
        while skip:
            wave = step(wave, seen, free, hop)
            if wave.isEmpty():
                break
            seen, layer = seen.union(wave), layer.union(wave)
        if hop == max_hops:
            break
        layer = step(layer, seen, ~free, hop + 1)
        if layer.isEmpty():
            break
        seen = cut(seen.union(layer))
    return seen


def trace(nodes: DataFrame, edges: DataFrame, start: str, max_hops: int, *, skip: Collection[str] = (), omit: Collection[str] = ()) -> DataFrame:
    """(id, kind, hop) reached from start. Nodes of skipped kinds join the hop of who reaches them, in chains, at the last hop too."""
    seen = _expand(cut(adjacency(nodes, edges, omit)), nodes.where(F.col("id") == start).select("id").distinct(), max_hops, skip)
    return nodes.select("id", "kind").distinct().join(small(seen), "id").select("id", "kind", "hop")


def select_output(near: DataFrame, reached: DataFrame, start: str, skip: Collection[str]) -> DataFrame:
    """(id, kind, hop) of reached (same columns) that a result shows: counted nodes and the start, skipped nodes on shortest ways to
    them, and skipped nodes with two or more edges to nodes shown so far, judged at once."""
    if not skip:
        return reached
    free = F.col("kind").isin(list(skip))
    shown = cut(reached.where(~free | (F.col("id") == start)))
    hidden = cut(reached.where(free & (F.col("id") != start)))
    if hidden.isEmpty():
        return shown
    inside = cut(near.join(small(reached.select(F.col("id").alias("a"))), "a", "left_semi").join(small(hidden.select(F.col("id").alias("b"), F.col("kind").alias("kind"), F.col("hop").alias("above"))), "b"))
    frontier = shown.where(F.col("id") != start)
    while True:
        own = frontier.select(F.col("id").alias("a"), (F.col("hop") - F.when(free, 0).otherwise(1)).alias("above"))
        found = inside.join(small(own), ["a", "above"]).select(F.col("b").alias("id"), "kind", F.col("above").alias("hop")).distinct()
        frontier = cut(found.join(small(shown.select("id")), "id", "left_anti"))
        if frontier.isEmpty():
            break
        shown = cut(shown.union(frontier))
    rest = hidden.join(small(shown.select("id")), "id", "left_anti")
    ties = near.join(small(rest.select(F.col("id").alias("a"))), "a", "left_semi").join(small(shown.select(F.col("id").alias("b"))), "b", "left_semi").groupBy("a").agg(F.count("*").alias("n")).where("n >= 2")
    return shown.union(rest.join(small(ties.select(F.col("a").alias("id"))), "id", "left_semi"))


def induced_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends in selected (id, hop), with hop, the later end's. Of links across pages with equal kind and ends only the smallest id."""
    hops = selected.select("id", "hop")
    inside = edges.join(small(hops.select(F.col("id").alias("source_id"), F.col("hop").alias("h1"))), "source_id").join(small(hops.select(F.col("id").alias("target_id"), F.col("hop").alias("h2"))), "target_id")
    inside = inside.withColumn("hop", F.greatest("h1", "h2")).drop("h1", "h2")
    across = F.col("kind").isin(list(config.CROSS_PAGE_KINDS))
    columns = [c for c in inside.columns if c not in ("kind", "source_id", "target_id")]
    first = F.min(F.struct(T.id_order(F.col("id")).alias("__order"), *columns)).alias("x")
    one = inside.where(across).groupBy("kind", "source_id", "target_id").agg(first).select("kind", "source_id", "target_id", *[F.col(f"x.{c}").alias(c) for c in columns])
    return inside.where(~across).unionByName(one).select(*edges.columns, "hop")


def _sorted_ids(ids: Column) -> Column:
    """Distinct ids of a collected list, in the order of ids."""
    ordered = F.array_sort(F.transform(F.array_distinct(ids), lambda x: F.struct(T.id_order(x).alias("o"), x.alias("x"))))
    return F.transform(ordered, lambda x: x["x"])


def open_ends(nodes: DataFrame, edges: DataFrame, selected: DataFrame, kind: str = "endpoint", *, omit: Collection[str] = ()) -> DataFrame:
    """Nodes of that kind with neighbours inside and outside of selected (id): id, sources and candidates, sorted, n_sources, n_candidates."""
    near = adjacency(nodes, edges, omit).join(nodes.where(F.col("kind") == kind).select(F.col("id").alias("a")).distinct(), "a", "left_semi").select("a", "b").distinct()
    marked = near.join(small(selected.select(F.col("id").alias("b"), F.lit(True).alias("inside")).distinct()), "b", "left")
    inside = F.coalesce("inside", F.lit(False))
    listed = marked.groupBy(F.col("a").alias("id")).agg(F.count(F.when(inside, 1)).alias("n_sources"), F.count(F.when(~inside, 1)).alias("n_candidates"), F.collect_list(F.when(inside, F.col("b"))).alias("s"), F.collect_list(F.when(~inside, F.col("b"))).alias("c"))
    return listed.where("n_sources > 0 and n_candidates > 0").select("id", _sorted_ids(F.col("s")).alias("sources"), _sorted_ids(F.col("c")).alias("candidates"), "n_sources", "n_candidates")


def start_of(store: Store, *, start_id: str | None = None, file: str | None = None, page: int | None = None, kind: str | None = None, local_id: int | str | None = None) -> str:
    """The global id of a start named either way, which the store has: else StartNotFound, or DocumentNotFound where its document is not there either."""
    if start_id is None:
        if file is None or page is None or kind is None or local_id is None:
            raise ValueError("start needs a global id, or file, page, kind and id")
        start_id = store.nodes.sparkSession.range(1).select(T.global_id(T.stem(F.lit(file)), F.lit(int(page)), F.lit(kind), F.lit(str(local_id)))).first()[0]
    if store.nodes.where(F.col("id") == start_id).isEmpty():
        document = start_id.rsplit("/", 3)[0]
        if store.documents.where(T.stem(F.col("filename")) == document).isEmpty():
            raise DocumentNotFound(f"no graph of {document}")
        raise StartNotFound(f"{start_id} was not found")
    return start_id


def check_request(start_id: str | None, max_hops: int, skip: Collection[str], omit: Collection[str], direction: str, form: str) -> None:
    """ValueError for a request that no trace answers."""
    skipped, omitted = set(skip), set(omit)
    if direction not in ("any", *config.ARROW_IO):
        raise ValueError("direction must be any, upstream or downstream")
    if not 0 <= max_hops <= config.MAX_HOPS:
        raise ValueError(f"max_hops must be 0..{config.MAX_HOPS}")
    if not skipped <= set(config.SKIPPABLE):
        raise ValueError(f"skip may only contain {sorted(config.SKIPPABLE)}")
    if not omitted <= set(config.OMITTABLE):
        raise ValueError(f"omit may only contain {sorted(config.OMITTABLE)}")
    if skipped & omitted:
        raise ValueError(f"{sorted(skipped & omitted)} cannot be both skipped and omitted")
    if form not in ("subgraph", "hops"):
        raise ValueError("form must be subgraph or hops")
    if start_id is not None and start_id.count("/") > 1 and start_id.rsplit("/", 2)[-2] in omitted:
        raise ValueError("the start is of an omitted kind")


class Traced(NamedTuple):
    """What a trace answers: its start, whole rows of nodes and of edges with their hop, and the open endpoints."""

    start: str
    nodes: DataFrame
    edges: DataFrame
    open_endpoints: DataFrame

    def reached_hops(self) -> int:
        return self.nodes.agg(F.max("hop")).first()[0]

    def pages(self, *by: str) -> DataFrame:
        """A row for each page (and each value of by, such as hop) with sorted lists: nodes by kind, relations, transfers and hyperlinks on their source page."""
        own = [c for c in self.nodes.columns]
        order = lambda x: T.id_order(x)
        pick = lambda value, which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct(order(F.col("id")).alias("o"), value.alias("v"))))), lambda x: x["v"])
        kinds = [pick(F.struct(*own), F.col("kind") == k).alias(f"{k}s") for k in config.ENTITY_KINDS]
        nodes = self.nodes.groupBy("page", *by).agg(*kinds)
        relation = F.struct("id", "kind", "source_id", "target_id")
        link = F.struct("id", *[c for c in self.edges.columns if c not in ("id", "kind", "filename", "hop")])
        across = F.col("kind").isin(list(config.CROSS_PAGE_KINDS))
        lists = [pick(relation, ~across).alias("relations"), *[pick(link, F.col("kind") == k).alias(f"{k}s") for k in config.CROSS_PAGE_KINDS]]
        edges = self.edges.withColumn("page", F.col("source_page")).groupBy("page", *by).agg(*lists)
        joined = nodes.join(edges, ["page", *by], "full_outer")
        filled = [F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in joined.columns if c not in ("page", *by)]
        return joined.select("page", *by, *filled).orderBy(*by, "page")

    def hops(self) -> DataFrame:
        return self.pages("hop")


def trace_document(store: Store, *, start_id: str | None = None, file: str | None = None, page: int | None = None, kind: str | None = None, local_id: int | str | None = None, max_hops: int = 1, skip: Collection[str] = config.DEFAULT_SKIP, omit: Collection[str] = config.DEFAULT_OMIT, direction: str = "any", form: str = "subgraph") -> Traced:
    """The trace from a global id, or from a file's page, kind and local id; up- or downstream along page streams, or any way."""
    check_request(start_id, max_hops, skip, omit, direction, form)
    start = start_of(store, start_id=start_id, file=file, page=page, kind=kind, local_id=local_id)
    check_request(start, max_hops, skip, omit, direction, form)
    filename = store.nodes.where(F.col("id") == start).select("filename").first()[0]
    edges = store.edges.where(F.col("kind").isin(list(config.EDGE_KINDS)))
    if direction == "any":
        near = cut(adjacency(store.nodes.where(F.col("filename") == filename), edges.where(F.col("filename") == filename), omit))
        reached = cut(small(_expand(near, store.nodes.where(F.col("id") == start).select("id"), max_hops, skip)).join(store.nodes.select("id", "kind").distinct(), "id").select("id", "kind", "hop"))
        selected = cut(select_output(near, reached, start, skip))
        kept = induced_edges(edges.where(~F.col("kind").isin(list(omit))) if omit else edges, selected)
    else:
        from .pages import directed_trace

        own = Store(store.documents, store.nodes.where(F.col("filename") == filename), edges.where(F.col("filename") == filename))
        selected, walked = directed_trace(own, start, config.ARROW_IO[direction], max_hops, skip=skip, omit=omit)
        hops = [selected.select(F.col("id").alias(c), F.col("hop").alias(h)) for c, h in (("source_id", "h1"), ("target_id", "h2"))]
        kept = edges.join(small(walked), "id", "left_semi").join(small(hops[0]), "source_id").join(small(hops[1]), "target_id").withColumn("hop", F.greatest("h1", "h2")).select(*edges.columns, "hop")
    ends = open_ends(store.nodes, edges, selected, omit=omit)
    return Traced(start, store.nodes.join(small(selected.select("id", "hop")), "id"), kept, ends)


def related(nodes: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(id, other): neighbours of items (id) over one edge, and what shares an endpoint with them."""
    near = adjacency(nodes, edges).select("a", "b", "b_kind").distinct()
    one = near.join(small(items.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("a").alias("id"), F.col("b").alias("other"), "b_kind")
    through = one.where("b_kind = 'endpoint'").select("id", F.col("other").alias("a")).join(near, "a").select("id", F.col("b").alias("other")).where("id != other")
    return one.select("id", "other").union(through).distinct()


def exits(nodes: DataFrame, edges: DataFrame, selected: DataFrame) -> DataFrame:
    """(kind, id, source, target): where a trace may go on: open endpoints, nets with wires in and out of selected (id), and links from a node inside to one outside, each pair once."""
    inside = small(selected.select("id").distinct())
    ends = open_ends(nodes, edges, selected).select(F.lit("endpoint").alias("kind"), "id", F.explode("sources").alias("source"), "candidates").select("kind", "id", "source", F.explode("candidates").alias("target"))
    wires = edges.where("kind = 'contains'").join(nodes.where("kind = 'net'").select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").select(F.col("source_id").alias("net"), F.col("target_id").alias("wire")).distinct()
    known = wires.join(inside.withColumnRenamed("id", "wire"), "wire", "left_semi").select("net", F.col("wire").alias("source"))
    unknown = wires.join(inside.withColumnRenamed("id", "wire"), "wire", "left_anti").select("net", F.col("wire").alias("target"))
    nets = known.join(unknown, "net").select(F.lit("net").alias("kind"), F.col("net").alias("id"), "source", "target")
    links = edges.where("kind = 'transfer'")
    both = links.select("id", F.col("source_id").alias("source"), F.col("target_id").alias("target")).union(links.select("id", "target_id", "source_id"))
    out = both.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_anti")
    transfers = out.groupBy("source", "target").agg(F.min("id").alias("id")).select(F.lit("transfer").alias("kind"), "id", "source", "target")
    return ends.union(nets).union(transfers)


def step_through(nodes: DataFrame, edges: DataFrame, ports: DataFrame, seen: DataFrame, *, skip: Collection[str] = ("endpoint",), omit: Collection[str] = ()) -> DataFrame:
    """(id, kind, hop) of one hop from chosen exits (id) to nodes not in seen (id): endpoints are always walked through; hop 0 are those walked, 1 those found."""
    rest = nodes.join(small(seen.select("id").distinct()), "id", "left_anti").unionByName(nodes.join(small(ports.select("id").distinct()), "id", "left_semi")).dropDuplicates(["id"])
    near = cut(adjacency(rest, edges, omit))
    reached = _expand(near, ports.select("id").distinct(), 1, {*skip, "endpoint"})
    return rest.select("id", "kind").join(small(reached), "id").select("id", "kind", "hop")


def directional_exits(out: DataFrame, distances: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of exits (kind, id, source, target) that head for a target arrow (id): nearer to one of them than their source is.

    Transfers only leave from a target arrow; where the source reaches no target arrow all its exits pass. distances: source (arrow), id, distance.
    """
    aims = distances.join(small(targets.select(F.col("id").alias("source")).distinct()), "source", "left_semi").select(F.col("source").alias("aim"), F.col("id").alias("node"), F.col("distance").alias("d"))
    across = out.where("kind = 'transfer'").join(small(targets.select(F.col("id").alias("source")).distinct()), "source", "left_semi")
    inside = out.where("kind != 'transfer'")
    at = inside.join(aims.select(F.col("node").alias("source"), "aim", F.col("d").alias("from")), "source", "left")
    to = at.join(aims.select(F.col("node").alias("target"), "aim", F.col("d").alias("to")), ["target", "aim"], "left")
    judged = to.groupBy("kind", "id", "source", "target").agg(F.max(F.col("from").isNotNull()).alias("aims"), F.max(F.coalesce(F.col("to") < F.col("from"), F.lit(False))).alias("nearer"))
    return judged.where("not aims or nearer").select(*out.columns).union(across.select(*out.columns))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each component, by alternating large and small stars; ids in source_id and target_id, of any type with an order.

    The least neighbours of a round are a table of their own, broadcast behind a count, so a hub's edges are not drawn to one task.
    """
    ends = edges.where("source_id is not null and target_id is not null")
    stars = cut(ends.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).where("u != v").distinct())
    before = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = small(cut(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m"))))
        large = cut(both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = small(cut(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))))
        tight = large.join(least, F.col("u") == F.col("c")).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        stars = cut(tight.where("u != v").distinct())
    ids = ends.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return ids.join(stars.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def wire_nets(wires: DataFrame, connections: DataFrame, keys: Sequence[str] = ("page",)) -> DataFrame:
    """(keys, net, wire_ids, endpoints): wires (keys, id) that share endpoints, in groups of two or more, numbered by their first wire.

    connections: keys, wire, endpoint. Wire and endpoint lists are in order.
    """
    known = connections.join(wires.select(*keys, F.col("id").alias("wire")), [*keys, "wire"], "left_semi").distinct()
    hub = known.groupBy(*keys, "endpoint").agg(F.min("wire").alias("first"))
    name = lambda c: F.struct(*keys, F.col(c).alias("wire"))
    links = known.join(hub, [*keys, "endpoint"]).where("wire != first").select(name("wire").alias("source_id"), name("first").alias("target_id"))
    groups = cut(components(links).select("id.*", F.col("root.wire").alias("first")))
    listed = groups.groupBy(*keys, "first").agg(F.array_sort(F.collect_list("wire")).alias("wire_ids"))
    ends = groups.join(known, [*keys, "wire"]).groupBy(*keys, "first").agg(F.array_sort(F.collect_set("endpoint")).alias("endpoints"))
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1
    return listed.join(ends, [*keys, "first"]).select(*keys, number.alias("net"), "wire_ids", "endpoints")
