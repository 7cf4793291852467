"""Queries over boxes against their SQL where pages are crowded, and the work that joins of boxes take there."""

from __future__ import annotations

import duckdb
import pytest

from tracewright import queries
from tracewright.operators import spatial
from tracewright.queries.core import boxes

#: Queries over the boxes of parts.
QUERIES = [
    "iou_join",
    "coverage_parent",
    "endpoint_fallback",
    "text_to_cell",
    "cross_reference_links",
    "endpoint_owners",
    "link_sources",
    "dwithin_join",
    "hit_test",
    "link_targets",
    "nearest_k_band",
    "proximity_assignment",
]


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """A table of parts on two pages, 4500 on each, half of them of one size: many boxes of one area within others."""
    folder = tmp_path_factory.mktemp("crowded")
    duckdb.execute(f"""COPY (SELECT * REPLACE (k AS p_partkey, CASE WHEN k % 28 < 14 THEN 'Brand#11' ELSE 'Brand#12' END AS p_brand, CASE WHEN k % 3 = 0 THEN 48 WHEN k % 3 = 1 THEN 1 + k % 9 ELSE p_size END AS p_size)
        FROM (SELECT *, row_number() OVER (ORDER BY p_partkey, r) * 7 AS k FROM '/root/testdata/sf0.01/part.parquet', range(5) r(r)) x WHERE k < 63000) TO '{folder}/part.parquet' (FORMAT parquet)""")
    return str(folder)


def equals_its_sql(spark, name, folder):
    got = queries.QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
        cursor = con.execute(queries.SQL[name])
        names = [d[0] for d in cursor.description]
        expected = sorted(cursor.fetchall(), key=str)
    assert expected
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == expected


@pytest.mark.parametrize("name", QUERIES)
def test_crowded_pages_equal_the_sql(spark, crowded, name):
    equals_its_sql(spark, name, crowded)


def test_containers_of_one_area_go_by_id(spark, tmp_path):
    duckdb.execute(f"""COPY (SELECT * REPLACE ('Brand#11' AS p_brand, CASE WHEN p_partkey % 3 = 0 THEN 48 ELSE 7 END AS p_size) FROM '/root/testdata/sf0.1/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)""")
    equals_its_sql(spark, "containment_assignment", str(tmp_path))
    boxes = [(1, 1, 4.0, 4.0, 5.0, 5.0), (1, 2, 0.0, 0.0, 6.0, 6.0), (1, 3, 1.0, 1.0, 7.0, 7.0), (1, 4, 1.5, 1.5, 7.5, 7.5)]
    b = spark.createDataFrame(boxes, "page int, id long, x0 double, y0 double, x1 double, y1 double")
    found = lambda **how: [r["container"] for r in spatial.smallest_container(b.where("id = 1"), b.where("id > 1"), **how).collect()]
    assert found() == [4] and found(ties_by_centre=False) == [2]


@pytest.mark.parametrize("within", [0.0, 1.0, 30.0, 70.0])
def test_small_boxes_do_not_meet_over_the_whole_page(spark, crowded, within):
    """As many pairs share a cell as lie near each other, not as a page has: 4500 * 4500 on each."""
    b = boxes(spark, crowded)
    left, right = spatial._levelled(b, "a", ["page"], within), spatial._levelled(b, "b", ["page"], 0.0)
    by = ["page", *[c for c in left.columns if c.startswith("__") and c in right.columns]]
    assert left.select(by).join(right.select(by), by).count() < 3_000_000


def test_joins_are_not_broadcast(spark, crowded):
    b = boxes(spark, crowded)
    assert "Broadcast" not in spatial.meet(b, b)._jdf.queryExecution().toString()


@pytest.mark.parametrize("search", [lambda b: spatial.nearest_band(b, b), lambda b: spatial.assign_by_proximity(b, b, 30.0)])
def test_searches_begin_near_on_crowded_pages(spark, crowded, monkeypatch, search):
    reaches, meet = [], spatial.meet
    monkeypatch.setattr(spatial, "meet", lambda a, b, **how: reaches.append(how["within"]) or meet(a, b, **how))
    search(boxes(spark, crowded))
    assert 0 < reaches[0] < 25
