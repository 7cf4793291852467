"""Every query with SQL against DuckDB on the same tables; the folds against plain Python."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from tracewright import queries
from tracewright.operators import graph, intervals, spatial

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(queries.SQL[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_suppression_keeps_the_heaviest(spark):
    df = spark.createDataFrame([(1, "p", 0.0, 0.0, 10.0, 10.0, 5), (2, "p", 1.0, 1.0, 9.0, 9.0, 4), (3, "p", 50.0, 0.0, 60.0, 10.0, 1)], "id long, page string, x0 double, y0 double, x1 double, y1 double, w int")
    assert sorted(r["id"] for r in spatial.suppress(df, weight="w").collect()) == [1, 3]


def test_running_mean_clusters(spark):
    df = spark.createDataFrame([("p", v) for v in (1.0, 1.5, 2.0, 5.0)], "page string, y double")
    assert sorted((r["cluster"], r["members"]) for r in intervals.running_mean_clusters(df, "page", "y", 0.8).collect()) == [(0, 3), (1, 1)]


def test_trace_absorbs_free_kinds_at_the_last_hop(spark):
    nodes = spark.createDataFrame([("a", "c"), ("b", "e"), ("c", "w"), ("d", "e"), ("f", "c"), ("g", "x")], "id string, kind string")
    edges = spark.createDataFrame([("1", "k", "a", "b"), ("2", "k", "b", "c"), ("3", "k", "c", "d"), ("4", "k", "d", "f"), ("5", "k", "a", "g")], "id string, kind string, source_id string, target_id string")
    got = {r["id"]: r["hop"] for r in graph.trace(nodes, edges, "a", 1, skip=["e"], omit=["x"]).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_components_match_union_find(spark):
    pairs = [(f"v{i}", f"v{(i * 7) % 50}") for i in range(0, 50, 3)]
    up: dict = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        up[find(a)] = find(b)
    groups = defaultdict(list)
    for v in list(up):
        groups[find(v)].append(v)
    want = {v: min(g) for g in groups.values() for v in g}
    assert dict(graph.components(spark.createDataFrame(pairs, "source_id string, target_id string")).collect()) == want
