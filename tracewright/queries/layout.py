"""Queries of pages' things: measures of boxes, relations, links and tables, over the boxes of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..operators import graph, links, relations, tables
from .base import read, register
from .core import BOX_SQL, GRAPH_SQL, PAIR_SQL, START, boxes, edges_of, nodes_of

BOX = list(B.CORNERS)


@register(f"""WITH b AS ({BOX_SQL}) SELECT id, round(sqrt(pow(greatest(x0 - 540, 500 - x1, 0), 2) + pow(greatest(y0 - 540, 500 - y1, 0), 2)), 6) AS gap,
    round(sqrt(pow((x0 + x1) / 2 - 520, 2) + pow((y0 + y1) / 2 - 520, 2)), 6) AS centre, (x0 - 500) / 40 AS rx0, (y1 - 500) / 40 AS ry1, x0 - (x1 - x0) * 0.125 AS ex0, y1 + (y1 - y0) * 0.125 AS ey1, x0 <= 540 AND x1 >= 500 AND y0 <= 540 AND y1 >= 500 AS meets,
    round(greatest(least(x1, 540) - greatest(x0, 500), 0) * greatest(least(y1, 540) - greatest(y0, 500), 0) / least(1600, (x1 - x0) * (y1 - y0)), 6) AS ratio, x1 - x0 <= 20 AND y1 - y0 <= 20 AS tiny FROM b""")
def box_measures(spark, sf_dir):
    a, z = B.Box.named(), B.Box(*[F.lit(v) for v in (500.0, 500.0, 540.0, 540.0)])
    inside, grown = B.relative(a, z), B.expand(a, 0.25)
    r = lambda v: F.round(v, 6)
    return boxes(spark, sf_dir).select("id", r(B.gap(a, z)).alias("gap"), r(B.centre_distance(a, z)).alias("centre"), inside.x0.alias("rx0"), inside.y1.alias("ry1"), grown.x0.alias("ex0"), grown.y1.alias("ey1"), B.intersects(a, z).alias("meets"), r(B.overlap_ratio(a, z)).alias("ratio"), B.is_tiny(a, F.lit(3), F.lit(0)).alias("tiny"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("id % 3 = 0")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).where("id % 3 != 0")


OWNER_SQL = f"{PAIR_SQL}, o AS (SELECT page, a_id AS endpoint, arg_min(b_id, struct_pack(a := ba, b := b_id)) AS element FROM m WHERE a_id % 3 <> 0 AND b_id % 3 = 0 AND sqrt(gx * gx + gy * gy) <= 0.1 GROUP BY page, a_id)"


@register(f"{OWNER_SQL} SELECT page, 'contains' AS type, 'element:' || element AS source, 'endpoint:' || endpoint AS target FROM o")
def endpoint_owners(spark, sf_dir):
    return relations.endpoint_owners(elements(spark, sf_dir), endpoints(spark, sf_dir))


@register(f"""{OWNER_SQL} SELECT page, 'contains' AS type, 'element:' || arg_min(b_id, struct_pack(d := sqrt(gx * gx + gy * gy), a := ba, b := b_id)) AS source, 'endpoint:' || a_id AS target FROM m
    WHERE a_id % 3 <> 0 AND b_id % 3 = 0 AND sqrt(gx * gx + gy * gy) <= 5 AND (page, a_id) NOT IN (SELECT (page, endpoint) FROM o) GROUP BY page, a_id""")
def endpoint_fallback(spark, sf_dir):
    own, ends = elements(spark, sf_dir), endpoints(spark, sf_dir)
    wired = ends.select("page", F.lit("wire_connection").alias("type"), F.lit("wire:1").alias("source"), F.concat(F.lit("endpoint:"), "id").alias("target"))
    return relations.endpoint_fallback(own, ends, wired.unionByName(relations.endpoint_owners(own, ends)))


NET_SQL = "c AS (SELECT p_brand AS page, p_partkey AS wire, p_size % 20 AS endpoint FROM part UNION SELECT p_brand, p_partkey, 100 + p_partkey % 31 FROM part)"


@register(f"""WITH RECURSIVE {NET_SQL}, l AS MATERIALIZED (SELECT DISTINCT a.page, a.wire AS a, b.wire AS b FROM c a JOIN c b ON a.page = b.page AND a.endpoint = b.endpoint AND a.wire <> b.wire),
    w AS (SELECT page, wire, wire AS r FROM c UNION SELECT l.page, l.b, w.r FROM w JOIN l ON l.page = w.page AND l.a = w.wire WHERE w.r < l.b),
    g AS (SELECT page, wire, min(r) AS root FROM w GROUP BY ALL), n AS (SELECT page, root, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1), k AS (SELECT page, root, row_number() OVER (PARTITION BY page ORDER BY root) - 1 AS net FROM n)
    SELECT g.page, CAST(k.net AS BIGINT) AS net, count(DISTINCT g.wire) AS wires, min(g.wire) AS first, count(DISTINCT c.endpoint) AS endpoints FROM g JOIN k USING (page, root) JOIN c ON c.page = g.page AND c.wire = g.wire GROUP BY ALL""")
def wire_nets(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    c = p.select(F.col("p_brand").alias("page"), k.alias("wire"), (F.col("p_size") % 20).cast("long").alias("endpoint")).unionByName(p.select(F.col("p_brand").alias("page"), k.alias("wire"), (100 + k % 31).alias("endpoint")))
    found = graph.wire_nets(p.select(F.col("p_brand").alias("page"), k.alias("id")), c)
    return found.select("page", F.col("net").cast("long").alias("net"), F.size("wire_ids").cast("long").alias("wires"), F.get("wire_ids", 0).alias("first"), F.size("endpoints").cast("long").alias("endpoints"))


def link_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links (parts not divisible by 3) lead to the page of the region two sizes on; the others are components."""
    b = boxes(spark, sf_dir).withColumns({"doc": F.lit("d"), "page": F.regexp_extract("page", "([0-9]+)$", 1).cast("int")})
    own = b.where("id % 3 != 0").withColumn("target_page", (F.col("page") % 5 + F.floor(F.col("page") / 10) * 10 + 1).cast("int"))
    own = own.withColumns({"tx0": F.col("x0") + 10, "ty0": F.col("y0") + 10, "tx1": F.col("x1") + 20, "ty1": F.col("y1") + 20})
    return own, b.where("id % 3 = 0")


@register(f"""{PAIR_SQL}, f AS (SELECT page, a_id, arg_max(b_id, struct_pack(c := o / ba, i := o / (aa + ba - o), a := -ba, n := -b_id)) AS component FROM m WHERE a_id % 3 <> 0 AND b_id % 3 = 0 AND o > 0 GROUP BY page, a_id),
    n AS (SELECT page, a_id, arg_min(b_id, struct_pack(d := sqrt(gx * gx + gy * gy), n := b_id)) AS component FROM m WHERE a_id % 3 <> 0 AND b_id % 3 = 0 AND sqrt(gx * gx + gy * gy) <= 70 GROUP BY page, a_id)
    SELECT b.id, coalesce(f.component, n.component) AS source_component FROM b LEFT JOIN f ON f.a_id = b.id LEFT JOIN n ON n.a_id = b.id WHERE b.id % 3 <> 0""")
def link_sources(spark, sf_dir):
    own, components = link_tables(spark, sf_dir)
    return links.attach_sources(own, components).select("id", "source_component")


@register(f"""WITH b AS (SELECT *, CAST(regexp_extract(page, '([0-9]+)$', 1) AS INT) AS p FROM ({BOX_SQL}) x), t AS (SELECT id, p % 5 + p // 10 * 10 + 1 AS p, x0 + 10 AS x0, y0 + 10 AS y0, x1 + 20 AS x1, y1 + 20 AS y1 FROM b WHERE id % 3 <> 0),
    m AS (SELECT t.id, c.id AS c, greatest(least(t.x1, c.x1) - greatest(t.x0, c.x0), 0) * greatest(least(t.y1, c.y1) - greatest(t.y0, c.y0), 0) AS o, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca, (t.x1 - t.x0) * (t.y1 - t.y0) AS ta,
          sqrt(pow(greatest(t.x0 - c.x1, c.x0 - t.x1, 0), 2) + pow(greatest(t.y0 - c.y1, c.y0 - t.y1, 0), 2)) AS d FROM t JOIN b c ON c.p = t.p AND c.id % 3 = 0),
    f AS (SELECT id, arg_max(c, struct_pack(s := o / ca, r := o / ta, a := -ca, n := -c)) AS c FROM m WHERE o > 0 GROUP BY id), n AS (SELECT id, arg_min(c, struct_pack(d := d, a := ca, n := c)) AS c FROM m WHERE d <= 70 GROUP BY id)
    SELECT t.id, coalesce(f.c, n.c) AS target_component FROM t LEFT JOIN f USING (id) LEFT JOIN n USING (id)""")
def link_targets(spark, sf_dir):
    own, components = link_tables(spark, sf_dir)
    return links.attach_targets(own, components).select("id", "target_component")


@register(f"""{PAIR_SQL} SELECT a_id AS text, arg_max(b_id, struct_pack(i := o / (aa + ba - o), n := -b_id)) AS link, 'K' || a_id % 7 AS label FROM m WHERE a_id % 3 = 0 AND b_id % 3 <> 0 AND o / (aa + ba - o) >= 0.05 GROUP BY a_id""")
def cross_reference_links(spark, sf_dir):
    own, texts = link_tables(spark, sf_dir)
    named = texts.withColumn("text", F.concat(F.lit("K"), F.col("id") % 7, F.lit("/a1")))
    away = own.withColumn("target_page", F.lit(99))
    found = links.cross_references(away, named, spark.createDataFrame([("d", 99)], "doc string, page_count int"), 0.05)
    return found.select("text", "link", "label")


CELL_SQL = "SELECT o_custkey % 50 AS page, o_orderkey AS id, CAST(o_custkey % 4 AS DOUBLE) AS x0, CAST(o_orderkey % 6 AS DOUBLE) AS y0, CAST(o_custkey % 4 + 1 + o_orderkey % 2 AS DOUBLE) AS x1, CAST(o_orderkey % 6 + o_custkey % 3 AS DOUBLE) AS y1 FROM orders"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    box = {"x0": c % 4, "y0": k % 6, "x1": c % 4 + 1 + k % 2, "y1": k % 6 + c % 3}
    return read(spark, sf_dir, "orders").select((c % 50).alias("page"), k.alias("id"), *[v.cast("double").alias(n) for n, v in box.items()])


PLACED_SQL = f"""c AS (SELECT * FROM ({CELL_SQL}) x WHERE x1 > x0 AND y1 > y0), ex AS (SELECT page, v, row_number() OVER (PARTITION BY page ORDER BY v) - 1 AS n FROM (SELECT page, x0 AS v FROM c UNION SELECT page, x1 FROM c) u),
    ey AS (SELECT page, v, row_number() OVER (PARTITION BY page ORDER BY v) - 1 AS n FROM (SELECT page, y0 AS v FROM c UNION SELECT page, y1 FROM c) u),
    p AS (SELECT c.*, b.n AS "row", a.n AS col, bb.n - b.n AS rowspan, aa.n - a.n AS colspan FROM c JOIN ex a ON a.page = c.page AND a.v = x0 JOIN ex aa ON aa.page = c.page AND aa.v = x1 JOIN ey b ON b.page = c.page AND b.v = y0 JOIN ey bb ON bb.page = c.page AND bb.v = y1)"""


@register(f'WITH {PLACED_SQL} SELECT id, "row", col, rowspan, colspan FROM p')
def table_places(spark, sf_dir):
    return tables.placed(cells(spark, sf_dir)).select("id", *[F.col(c).cast("long").alias(c) for c in ("row", "col", "rowspan", "colspan")])


@register(f'WITH {PLACED_SQL}, s AS (SELECT page, unnest(range("row", "row" + rowspan)) AS r, col, colspan, id FROM p), t AS (SELECT page, r, unnest(range(col, col + colspan)) AS c, id FROM s) SELECT page, r AS "row", c AS col, count(*) AS n FROM t GROUP BY ALL')
def table_slots(spark, sf_dir):
    found = tables.slots(tables.placed(cells(spark, sf_dir)))
    return found.groupBy("page", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.count("*").alias("n"))


@register(f"{PAIR_SQL} SELECT a_id AS id, arg_max(b_id, struct_pack(o := o, s := -(1 + b_id % 2), a := -ba, n := -b_id)) AS cell FROM m WHERE a_id % 3 <> 0 AND b_id % 3 = 0 AND o > 0 GROUP BY a_id")
def text_to_cell(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"rowspan": F.lit(1), "colspan": (1 + F.col("id") % 2).cast("int"), "text": F.col("id").cast("string")})
    return tables.assigned(b.where("id % 3 != 0"), b.where("id % 3 = 0")).select("id", "cell")


@register(f"""WITH {GRAPH_SQL}, near AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), one AS (SELECT DISTINCT b FROM near WHERE a = 'w1'),
    two AS (SELECT DISTINCT n.b FROM one JOIN nodes k ON k.id = one.b AND k.kind = 'endpoint' JOIN near n ON n.a = one.b WHERE n.b <> 'w1') SELECT 'w1' AS id, b AS other FROM one UNION SELECT 'w1', b FROM two""")
def related_nodes(spark, sf_dir):
    return graph.related(nodes_of(spark, sf_dir), edges_of(spark, sf_dir), spark.createDataFrame([("w1",)], "id string"))


@register("""WITH t AS (SELECT l_partkey, l_suppkey, upper(l_returnflag) || l_linenumber AS a, 'B' || l_quantity AS b FROM lineitem), x AS (SELECT l_partkey, list_intersect(list(DISTINCT a), ['R1', 'N2', 'A3']) AS s FROM t GROUP BY l_partkey) SELECT l_partkey, array_to_string(list_sort(s), ' ') AS shared FROM x""")
def common_tokens(spark, sf_dir):
    own = read(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.upper("l_returnflag"), F.col("l_linenumber").cast("string")).alias("a"))
    wanted = F.array(*[F.lit(v) for v in ("R1", "N2", "A3")])
    return own.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.array_intersect(F.collect_set("a"), wanted)), " ").alias("shared"))


@register(r"""SELECT p_partkey, rtrim(rtrim(printf('%.6f', p_retailprice / 7), '0'), '.') AS plain, starts_with(d, 'doc_') AND NOT regexp_matches(d, '[^A-Za-z0-9_-]') AS valid, 'data:image/png;base64,' || to_base64(encode(p_name)) AS url
    FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'doc_' || p_partkey WHEN 1 THEN 'doc ' || p_partkey ELSE 'doc_' || p_name END AS d FROM part) x""")
def text_forms(spark, sf_dir):
    k = F.col("p_partkey")
    d = F.when(k % 3 == 0, F.concat(F.lit("doc_"), k)).when(k % 3 == 1, F.concat(F.lit("doc "), k)).otherwise(F.concat(F.lit("doc_"), "p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", T.plain_number(F.col("p_retailprice") / 7).alias("plain"), T.is_document_id(d).alias("valid"), T.data_url(F.encode("p_name", "UTF-8")).alias("url"))


@register(f"""WITH b AS ({BOX_SQL}), g AS (SELECT *, [6.0, 4.0, 4.0, 8.0][id % 4 + 1] AS least FROM b), i AS (SELECT page, id, id % 4 AS k, x0 - greatest((least - (x1 - x0)) / 2, 0) AS x0, x1 + greatest((least - (x1 - x0)) / 2, 0) AS x1, y0 - greatest((least - (y1 - y0)) / 2, 0) AS y0, y1 + greatest((least - (y1 - y0)) / 2, 0) AS y1 FROM g)
    SELECT p.id AS point, count(*) AS n, arg_min(i.id, struct_pack(k := -i.k, a := (i.x1 - i.x0) * (i.y1 - i.y0), n := i.id)) AS first FROM b p JOIN i ON i.page = p.page AND p.x0 BETWEEN i.x0 AND i.x1 AND p.y0 BETWEEN i.y0 AND i.y1 GROUP BY p.id""")
def hit_test(spark, sf_dir):
    from ..operators import spatial

    b = boxes(spark, sf_dir)
    kinds = F.array(*[F.lit(k) for k in ("vector", "image", "text", "link")])
    items = b.withColumn("kind", F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")))
    found = spatial.hits(items, b.select("page", "id", F.col("x0").alias("x"), F.col("y0").alias("y")))
    return found.groupBy("point").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("first"))
