"""Text matching, relations, links, tables, geometry and symbol matching on small drawn pages."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import boxes as B
from tracewright.functions import text as T
from tracewright.kernels import faces, sets
from tracewright.operators import assignment, geometry, graph, intervals, links, matching, relations, spatial
from tracewright.operators import tables as tab
from tracewright.sources import primitives

BOX = "x0 double, y0 double, x1 double, y1 double"


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


# Joins of boxes.


def plain_gap(a, b):
    return math.hypot(max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0))


def some_boxes(rng, n):
    out = []
    for i in range(n):
        x, y, size = rng.uniform(-500, 3000), rng.uniform(-500, 3000), rng.choice((0, 1, 10, 100, 2000, 9000))
        out.append((rng.choice((1, 2)), i, x, y, x + rng.uniform(0, size), y + rng.uniform(0, size), "extra"))
    return out


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(2)
    a, b = some_boxes(rng, 150), some_boxes(rng, 150)
    a += [(1, 900, None, 0.0, 1.0, 1.0, "n"), (None, 901, 0.0, 0.0, 1.0, 1.0, "n"), (1, 902, float("nan"), 0.0, 1.0, 1.0, "n"), (1, 903, 0.0, 0.0, float("inf"), 1.0, "n")]
    ddl = f"page int, id long, {BOX}, x string"
    for within in (0.0, 37.5):
        got = sorted((r["a_id"], r["b_id"]) for r in spatial.meet(frame(spark, a, ddl), frame(spark, b, ddl), within=within).collect())
        assert got == sorted((p[1], q[1]) for p in a[:150] for q in b if p[0] == q[0] and plain_gap(p[2:6], q[2:6]) <= within)
    assert spatial.meet(frame(spark, a, ddl).limit(0), frame(spark, b, ddl)).count() == 0


def test_nearest_widens_until_it_has_enough(spark):
    rows = [(1, i, 10.0**i, 0.0, 10.0**i + 1, 1.0) for i in range(7)] + [(2, 1, 0.0, 0.0, 1.0, 1.0)]
    df = frame(spark, rows, f"page int, id long, {BOX}")
    asked = frame(spark, [(1, 50, 0.0, 0.0, 0.0, 0.0), (2, 50, 0.0, 0.0, 0.0, 0.0), (3, 50, 0.0, 0.0, 0.0, 0.0)], f"page int, id long, {BOX}")
    assert sorted((r["page"], r["b_id"], r["rank"]) for r in spatial.nearest(asked, df, k=5).collect()) == [(1, i, i + 1) for i in range(5)] + [(2, 1, 1)]


def test_nearest_band_takes_the_nearest_alone(spark):
    boxes = [(1, 1, 1.6, 0.0, 2.0, 1.0), (1, 2, 1.3, 0.0, 2.0, 1.0), (1, 3, 1.1, 0.0, 2.0, 1.0), (1, 4, 1.12, 0.0, 2.0, 1.0)]
    got = spatial.nearest_band(frame(spark, [(1, 9, 0.0, 0.0, 1.0, 1.0)], f"page int, id long, {BOX}"), frame(spark, boxes, f"page int, id long, {BOX}")).collect()
    assert [(r["b_id"], r["rank"]) for r in got] == [(3, 1), (4, 2)]


def test_coverage_of_boxes_lines_and_points(spark):
    parents = [(1, 100, 4.0, -5.0, 15.0, 15.0), (1, 101, 4.1, -5.0, 15.1, 15.0)]
    children = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 3.0, 10.0, 3.0), (1, 3, 20.0, 0.0, 20.0, 0.0), (1, 4, 5.0, 5.0, 5.0, 5.0)]
    ddl = f"page int, id long, {BOX}"
    assert sorted((r["id"], r["parent"]) for r in spatial.smallest_cover(frame(spark, children, ddl), frame(spark, parents, ddl)).collect()) == [(1, 100), (2, 100), (4, 100)]


def test_selection_hits_and_packing(spark):
    items = frame(spark, [(1, 1, "vector", 0.0, 0.0, 5.0, 5.0), (1, 2, "text", 0.0, 0.0, 9.0, 9.0), (1, 3, "link", 2.0, 2.0, 3.0, 3.0), (2, 4, "image", 0.0, 0.0, 50.0, 50.0)], f"page int, id long, kind string, {BOX}")
    area = B.Box(*[F.lit(v) for v in (-0.2, -0.2, 6.0, 6.0)])
    assert sorted(r["id"] for r in spatial.selected(items, area).collect()) == [1, 3, 4]
    got = spatial.hits(items, frame(spark, [(1, 7, 2.5, 2.5)], "page int, id long, x double, y double"))
    assert [(r["id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(3, 1), (2, 2), (1, 3)]
    packs = frame(spark, [(1, 5, 1, 0.0, 0.0, [1, 2]), (1, 9, 0, 0.0, 0.0, [2, 3]), (1, 1, 2, 0.0, 0.0, [4]), (1, 1, 3, 0.0, 0.0, None)], "page int, weight int, symbol int, x0 double, y0 double, members array<int>")
    assert sorted(r["symbol"] for r in spatial.pack_sets(packs).collect()) == [0, 2, 3]
    far = frame(spark, [(1, i, float(x), 0.0, x + 1.0, 1.0) for i, x in enumerate((0, 1, 50, 100))], f"page int, id long, {BOX}")
    assert [(r["id"], r["anchor"]) for r in spatial.anchors(far).orderBy("anchor").collect()] == [(0, 0), (3, 1), (2, 2)]


def test_votes_on_sizes_and_marks(spark):
    sizes = frame(spark, [(1, i, s) for i, s in enumerate((4.0, 4.2, 4.1, 8.0, 8.3, 20.0))], "page int, id long, size double")
    assert sorted(r["id"] for r in intervals.size_vote(sizes, ["page"], "size").collect()) == [0, 1, 2]
    marks = frame(spark, [(1, i, a, n) for i, (a, n) in enumerate(((45.0, 5.0), (46.0, 5.1), (135.0, 5.0), (44.0, 9.0)))], "page int, id long, angle double, length double")
    assert sorted(r["id"] for r in intervals.mark_vote(marks, ["page"]).collect()) == [0, 1]


def test_grid_of_a_table(spark):
    cells = [(1, float(x), float(y), x + 10.0, y + 5.0) for x in (0, 10, 20) for y in (0, 5)]
    cells[0] = (1, 0.3, 0.0, 10.2, 5.0)
    faces_ = frame(spark, [*cells, (1, 12.0, 1.0, 14.0, 2.0)], f"page int, {BOX}")
    got = intervals.grid(faces_, frame(spark, [(1, 0.0, 0.0, 30.0, 10.0)], f"page int, {BOX}")).collect()
    assert sorted((r["row"], r["col"]) for r in got) == sorted(itertools.product(range(2), range(3)))


# Numbers and shapes as columns.


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def pts(*xy):
    return F.array(*[B.point(F.lit(float(x)), F.lit(float(y))) for x, y in xy])


def test_shapes(spark):
    bent = B.cubic_box(pts((0, 0), (0, 10), (10, 10), (10, 0)))
    got = value(spark, bent.struct())
    ts = [i / 1000 for i in range(1001)]
    top = max(3 * (1 - t) ** 2 * t * 10 + 3 * (1 - t) * t * t * 10 for t in ts)
    assert (got["x0"], got["y0"], got["x1"]) == (0.0, 0.0, 10.0) and math.isclose(got["y1"], top, rel_tol=1e-5)
    turned = value(spark, B.transformed(pts((1, 0), (0, 2)), degrees=F.lit(90.0), scale=F.lit(2.0), dx=F.lit(5.0), dy=F.lit(6.0), mirrored=F.lit(True)))
    assert [(round(p["x"], 9), round(p["y"], 9)) for p in turned] == [(5.0, 4.0), (1.0, 6.0)]
    fit = value(spark, B.rigid_fit(pts((0, 0), (4, 0), (4, 3)), pts((10, 10), (10, 14), (7, 14))))
    assert math.isclose(fit["angle"], math.pi / 2) and fit["error"] < 1e-9
    assert value(spark, B.fixed_fit(pts((0, 0), (1, 0)), pts((5, 5), (8, 5)), degrees=F.lit(0.0), scale=F.lit(2.0), mirrored=F.lit(False)))["error"] == 0.5
    ring = pts(*[(10 * math.cos(k * math.pi / 16), 10 * math.sin(k * math.pi / 16)) for k in range(32)])
    assert value(spark, B.looks_like_circle(ring)) and not value(spark, B.looks_like_circle(pts((0, 0), (9, 0), (9, 1), (0, 1))))
    assert value(spark, B.looks_like_box(pts((0, 0), (10, 0), (10, 5), (0, 5)))) and not value(spark, B.looks_like_box(pts((0, 0), (10, 0), (5, 5))))
    for way, tip in {"right": ((0, 0), (0, 4), (6, 2)), "left": ((6, 0), (6, 4), (0, 2)), "down": ((0, 0), (4, 0), (2, 6)), "up": ((0, 6), (4, 6), (2, 0)), None: ((0, 0), (4, 0), (2, 3.46))}.items():
        assert value(spark, B.arrow_direction(pts(*tip))) == way
    assert [(p["x"], p["y"]) for p in value(spark, B.extended(pts((0, 0), (10, 0))))] == [(-2.0, 0.0), (12.0, 0.0)]
    assert [(p["x"], p["y"]) for p in value(spark, B.without_repeats(pts((0, 0), (0.5, 0), (5, 0), (0.1, 0.1))))] == [(0.0, 0.0), (5.0, 0.0)]
    assert value(spark, B.line_angle(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y")))) == 45.0
    with pytest.raises(Exception, match="non-zero"):
        value(spark, B.relative(B.Box(*[F.lit(1.0)] * 4), B.Box(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).struct())


def test_text_functions(spark):
    for text, role in {"-K1": "device_tag", "+A1": "device_tag", "=B2": "device_tag", "IP54": "parameter", "2.A:3": "cross_reference", "13 14": "pin_label", "24 V DC": "parameter", "Contactor": "description", "": "description", "/3.B": "description", " A/12 ": "description", "1/2.B": "cross_reference", "12345": "description"}.items():
        assert value(spark, T.semantic_role(F.lit(text))) == role, text
    assert value(spark, T.semantic_role(F.lit(None).cast("string"))) == "description"
    for text, kind in {"PLC IO": "plc_io", "plc-io x": "plc_io", "PLC": None, "MULTIPLE": None, "multi line": "multi", "Symbol Overviews": "symbol_overview", "a single": "single"}.items():
        assert value(spark, T.page_type(F.lit(text))) == kind, text
    for number, text in {1.5: "1.5", -0.0000001: "0", 100.0: "100", 1 / 3: "0.333333"}.items():
        assert value(spark, T.plain_number(F.lit(number))) == text
    for name, slug in {" Plan ä/1 ": "Plan_ä_1", "  ": "document", "a-b_c": "a-b_c"}.items():
        assert value(spark, T.slug(F.lit(name))) == slug
    for name, stem in {"a/b/plan.v2.pdf": "plan.v2", "plan": "plan", ".hidden": ".hidden"}.items():
        assert value(spark, T.stem(F.lit(name))) == stem
    good = '{"diagram_type": " Multi", "confidence": "0.5", "reasoning": "so"}'
    assert tuple(value(spark, T.reply(F.lit(f"Sure:\n{good} done")))) == ("multi", 0.5, "so")
    for bad in ("none", '{"diagram_type": "x", "confidence": 1, "reasoning": "so"}', '{"diagram_type": "multi", "confidence": 2, "reasoning": "so"}', '{"diagram_type": "multi", "confidence": 1, "reasoning": " "}'):
        assert value(spark, T.reply(F.lit(bad))) is None
    for raw, pages in {"[3, 1, 3]": [1, 3], "2,1": [1, 2], "": [], "9": None, "x": None, "0": None}.items():
        assert value(spark, T.page_list(F.lit(raw), F.lit(5))) == pages, raw
    for dashes, kind in {"[3 3] 0": "dashed", "[9 1 .7 1] 0": "dash_dotted", "[] 0": "solid", None: "solid", " none ": "solid"}.items():
        assert value(spark, T.dash_type(F.lit(dashes).cast("string"))) == kind
    assert value(spark, T.identifiers(F.array(F.lit("use BK-1 and bk-1, 24R01 or 12"), F.lit("X9")))) == ["BK-1", "24R01", "X9"]
    assert [value(spark, T.marker_match(F.lit(t), F.lit("K"))) for t in ("-K", "K12", "KA", "k.1")] == [0, 1, None, 1]
    assert value(spark, T.reference_id(F.lit("s"), F.lit(3), F.lit("wire:9"))) == "s/p3/wire/9" and value(spark, T.reference_id(F.lit("s"), F.lit(3), F.lit("page:9"))) == "page:9"
    assert value(spark, T.document_of_request(F.lit(""), F.lit("/api/v1/documents/doc_1/file"))) == "doc_1"


# Texts.

TEXT = f"page int, id long, text string, {BOX}, font_size double, dx double, dy double, block_index int, line_index int, span_index int"
TARGET = f"page int, id long, type string, {BOX}, symbol_id int"


def spans(spark, rows):
    return frame(spark, [(1, i, t, *map(float, b), float(f), 1.0, 0.0, None, None, None) for i, t, b, f in rows], TEXT)


def targets(spark, rows):
    return frame(spark, [(1, i, k, *map(float, b), s) for i, k, b, s in rows], TARGET)


def matched(found):
    rows = found.collect()
    return {(r["target_kind"], r["target"], r["text"], r["role"]) for r in rows if r["what"] == "match"}, {(r["target"], r["text"]) for r in rows if r["what"] == "told"}, [r["text"] for r in rows if r["what"] == "rest"]


def test_texts_go_to_the_nearest_edge(spark):
    texts = spans(spark, [(4, "-K1", (11, 0, 18, 5), 9), (5, "Contactor", (11, 7, 25, 12), 7), (6, "unmatched", (80, 80, 95, 85), 7)])
    things = targets(spark, [(0, "symbol", (0, 0, 10, 10), None), (1, "symbol", (30, 0, 40, 10), None)])
    found = assignment.match_texts(texts, things, targets(spark, []))
    assert matched(found) == ({("component", 0, "-K1", "title"), ("component", 0, "Contactor", "description")}, {(0, "-K1: Contactor")}, ["unmatched"])
    assert {r["text"]: r["semantic_role"] for r in assignment.semantic_matches(found).collect()} == {"-K1": "device_tag", "Contactor": "description"}
    assert {(r["text"], r["target"]) for r in assignment.text_owners(found).collect()} == {(4, 0), (5, 0)}


def test_stages_take_texts_in_turn(spark):
    texts = spans(spark, [(0, "BK 10 mm2", (13, 7, 28, 11), 5), (1, "40R002", (13, 12, 23, 16), 5), (2, "12", (50, 50, 54, 54), 5), (3, "inside", (60, 20, 75, 25), 5)])
    things = targets(spark, [(7, "wire_mark", (10, 10, 12, 12), None), (8, "box", (0, 0, 100, 100), None)])
    got = matched(assignment.match_texts(texts, things, targets(spark, [(3, "endpoint", (55, 50, 57, 54), None), (4, "endpoint", (70, 50, 72, 54), None)])))
    assert got[0] == {("component", 7, "BK 10 mm2 40R002", "description"), ("endpoint", 3, "12", "description"), ("component", 8, "inside", "description")} and got[2] == []


def test_symbols_are_matched_by_markers_as_a_whole(spark):
    texts = spans(spark, [(0, "-K1", (0, 20, 8, 25), 5), (1, "-K2", (100, 20, 108, 25), 5), (2, "-Q7", (50, 60, 58, 65), 5)])
    things = targets(spark, [(0, "symbol", (0, 0, 10, 10), 5), (1, "symbol", (20, 0, 90, 10), 5), (2, "symbol", (50, 40, 60, 50), 6)])
    records = frame(spark, [(5, "Relay K"), (6, "Q switch")], "symbol int, type string")
    assert {(t, x) for _, t, x, _ in matched(assignment.match_texts(texts, things, targets(spark, []), records))[0]} == {(0, "-K1"), (1, "-K2"), (2, "-Q7")}
    rng = random.Random(4)
    for _ in range(60):
        rows, columns = rng.randint(1, 5), rng.randint(1, 5)
        pairs = [(r, c, (float(rng.randint(0, 1)), rng.uniform(0, 30))) for r in range(rows) for c in range(columns) if rng.random() < 0.6]
        cost = {(r, c): v for r, c, v in pairs}
        got = sets.cheapest_matching(pairs, rows, columns)
        assert len({r for r, _ in got}) == len({c for _, c in got}) == len(got) and set(got) <= set(cost)
        total = lambda m: (-len(m), sum(cost[p][0] for p in m), sum(cost[p][1] for p in m))
        every = [m for n in range(min(rows, columns) + 1) for m in itertools.combinations(cost, n) if len({r for r, _ in m}) == len({c for _, c in m}) == n]
        best = min(map(total, every))
        assert total(got)[:2] == best[:2] and math.isclose(total(got)[2], best[2], abs_tol=1e-6)


def test_rules_are_not_negative():
    with pytest.raises(ValueError, match="negative"):
        assignment.Rules(near=-1.0)


# Relations.

ELEMENT = f"page int, id long, type string, {BOX}, title array<string>, descriptions array<string>, wire_vector long"


def element(i, kind, b, title=(), descriptions=(), vector=None):
    return (1, i, kind, *map(float, b), list(title), list(descriptions), vector)


def test_boxes_that_touch_become_one(spark):
    rows = [element(0, "box", (0, 0, 10, 10), ["a"]), element(1, "box", (10.5, 0, 30, 10), ["b", "a"]), element(2, "box", (2, 2, 3, 3)), element(3, "box", (31, 0, 35, 10), ["c"]), element(4, "symbol", (36, 0, 37, 10))]
    merged, aliases = relations.merge_adjacent_boxes(frame(spark, rows, ELEMENT))
    got = {r["id"]: (r["x0"], r["x1"], r["title"]) for r in merged.collect()}
    assert got == {1: (0.0, 35.0, ["a", "b", "c"]), 2: (2.0, 3.0, []), 4: (36.0, 37.0, [])} and sorted((r["id"], r["kept"]) for r in aliases.collect()) == [(0, 1), (3, 1)]
    edges = frame(spark, [(1, "contains", "element:1", "element:0"), (1, "contains", "element:3", "endpoint:5")], "page int, type string, source string, target string")
    assert [(r["source"], r["target"]) for r in relations.remap(edges, aliases).collect()] == [("element:1", "endpoint:5")]


def test_page_from_elements_to_relations(spark):
    elements = frame(spark, [element(0, "symbol", (0, 0, 20, 20), ["-K1"]), element(1, "symbol", (2, 2, 10, 10), descriptions=["x"]), element(2, "arrow", (100, 0, 110, 10)), element(3, "wire_mark", (50, 4, 52, 6), ["BK1"], vector=77), element(4, "box", (300, 0, 310, 10))], ELEMENT)
    ends = frame(spark, [(1, 0, 20.05, 5.0, 20.05, 5.0), (1, 1, 98.0, 5.0, 98.0, 5.0), (1, 2, 60.0, 5.0, 60.0, 5.0), (1, 3, 60.0, 50.0, 60.0, 50.0)], f"page int, id long, {BOX}")
    wires = frame(spark, [(1, 10, [77, 78], ["W"], ["24V BK-1"]), (1, 11, [79], ["W"], ["BK-1 x"]), (1, 12, [80], [], [])], "page int, id long, vectors array<long>, title array<string>, descriptions array<string>")
    segments = frame(spark, [(1, 10, 20.0, 5.0, 98.0, 5.0), (1, 11, 60.0, 5.0, 60.0, 50.0), (1, 12, 200.0, 0.0, 210.0, 0.0)], f"page int, wire long, {BOX}")
    known = frame(spark, [(1, "wire_connection", "wire:10", "endpoint:0"), (1, "wire_connection", "wire:10", "endpoint:1"), (1, "wire_connection", "wire:11", "endpoint:2"), (1, "wire_connection", "wire:11", "endpoint:3")], "page int, type string, source string, target string")
    merged, edges = relations.organize(elements, ends, segments, known)
    got = {(r["type"], r["source"], r["target"]) for r in edges.collect()}
    assert {("contains", "element:0", "element:1"), ("contains", "element:0", "endpoint:0"), ("contains", "element:2", "endpoint:1"), ("wire_connection", "wire:10", "endpoint:2")} <= got
    groups = frame(spark, [(1, 5, -1.0, -1.0, 50.0, 50.0), (1, 6, -9.0, -9.0, 500.0, 500.0)], f"page int, id long, {BOX}")
    components, nets, final = relations.handle(wires, merged, groups, edges)
    parts = {r["id"]: r for r in components.collect()}
    assert [parts[i]["element_ids"] for i in sorted(parts)] == [[0, 1], [2], [4]] and parts[0]["subclass"] == "assembly" and parts[1]["subclass"] == "arrow" and parts[0]["title"] == ["-K1"] and parts[0]["endpoints"] == [0]
    assert [(r["wire_ids"], r["endpoints"], r["title"]) for r in nets.collect()] == [([10, 11], [0, 1, 2, 3], ["W"])]
    told = {(r["type"], r["source"], r["target"]) for r in final.collect()}
    assert {("connection", "component:0", "endpoint:0"), ("contains", "net:0", "wire:11"), ("contains", "group:5", "component:0"), ("contains", "group:6", "component:1")} <= told


def test_nets_are_named_by_what_wires_share(spark):
    wires = [(1, 1, ["A", "B"], []), (1, 2, ["B"], []), (1, 3, [], ["x BK-1"]), (1, 4, [], ["bk-1 y"]), (1, 5, [], ["same"]), (1, 6, [], ["same"])]
    nets = [(1, 0, [1, 2]), (1, 1, [3, 4]), (1, 2, [5, 6])]
    got = relations.net_names(frame(spark, nets, "page int, net int, wire_ids array<long>"), frame(spark, wires, "page int, id long, title array<string>, descriptions array<string>"))
    assert {r["net"]: r["title"] for r in got.collect()} == {0: ["B"], 1: ["BK-1"], 2: ["same"]}


def test_composition_of_shared_and_circular_elements(spark):
    elements = frame(spark, [element(i, "symbol", (0, 0, 1, 1)) for i in range(7)], ELEMENT)
    edges = frame(spark, [(1, "contains", f"element:{a}", f"element:{b}") for a, b in ((0, 2), (1, 2), (1, 3), (4, 5), (5, 4), (2, 6))], "page int, type string, source string, target string")
    got = {r["element"]: r["component"] for r in relations.compose(elements, edges).collect()}
    assert got == {0: 0, 2: 0, 6: 0, 1: 1, 3: 1, 4: 2, 5: 2}


def test_page_io_of_arrows(spark):
    cases = [("right", (10, 0), "input"), ("right", (-10, 0), "output"), ("left", (-10, 0), "input"), ("left", (10, 0), "output"), ("down", (0, 10), "input"), ("down", (0, -10), "output"), ("up", (0, -10), "input"), ("up", (0, 10), "output"), ("right", (0, 10), "unknown")]
    pages = [(p, [[(0, 0), end]], way, want) for p, (way, end, want) in enumerate(cases)]
    pages += [(20, [[(10, 0), (0, 0)]], "right", "input"), (21, [[(0, 0), (10, 0), (-20, 20)]], "right", "input"), (22, [[(0, 0), (10, 0)], [(0, 0), (-10, 0)]], "right", "unknown"), (23, [], "right", "unknown")]
    arrows = frame(spark, [(p, 3, 11, way) for p, _, way, _ in pages], "page int, component long, element long, direction string")
    connections = frame(spark, [(p, "component:3", "endpoint:5") for p, *_ in pages] + [(p, f"wire:{i}", "endpoint:5") for p, lines, _, _ in pages for i, _ in enumerate(lines)], "page int, source string, target string")
    ends = frame(spark, [(p, 5, 0.0, 0.0, 0.0, 0.0) for p, *_ in pages], f"page int, id long, {BOX}")
    lines = frame(spark, [(p, i, [(float(x), float(y)) for x, y in line]) for p, all_, _, _ in pages for i, line in enumerate(all_)], "page int, wire long, points array<struct<x: double, y: double>>")
    assert {r["page"]: r["page_io"] for r in relations.page_io(arrows, connections, ends, lines).collect()} == {p: want for p, _, _, want in pages}


# Links.

LINK = f"doc string, page int, id long, {BOX}, target_page int, tx0 double, ty0 double, tx1 double, ty1 double, action_chain string"


def a_link(i, page, b, to, region=None):
    return ("d", page, i, *map(float, b), to, *(map(float, region) if region else [None] * 4), "chain")


def test_links_from_and_to_components(spark):
    rows = [a_link(0, 2, (0, 0, 10, 10), 4, (4, 4, 11, 11)), a_link(1, 2, (100, 0, 110, 10), 4, (40, 40, 50, 50)), a_link(2, 2, (0, 0, 9, 9), 9, (0, 0, 5, 5)), a_link(3, 2, (500, 500, 501, 501), 4), a_link(4, 2, (0, 0, 1, 1), 99)]
    components = frame(spark, [("d", 2, 6, 0.0, 0.0, 10.0, 10.0, [11]), ("d", 2, 7, 120.0, 0.0, 130.0, 10.0, [11, 12]), ("d", 4, 3, 0.0, 0.0, 20.0, 20.0, [10]), ("d", 4, 4, 4.0, 4.0, 11.0, 11.0, [11]), ("d", 4, 5, 40.0, 40.0, 50.0, 50.0, [10])], f"doc string, page int, id long, {BOX}, element_ids array<long>")
    elements = frame(spark, [("d", 2, 11, "arrow"), ("d", 2, 12, "symbol"), ("d", 4, 10, "symbol"), ("d", 4, 11, "arrow")], "doc string, page int, id long, type string")
    hyper, transfers = links.pipeline(frame(spark, rows, LINK), frame(spark, [("d", 10)], "doc string, page_count int"), components, elements)
    got = {r["id"]: (r["source_component"], r["target_component"], r["reason"]) for r in transfers.collect()}
    assert got == {0: (6, 4, None), 1: (7, 4, None), 2: (6, None, "target page has no diagram components")}
    assert [(r["id"], r["source_component"], r["target_component"]) for r in hyper.collect()] == [(3, None, None)] and "action_chain" not in hyper.columns
    near = links.attach_transfers(frame(spark, rows[:3], LINK), components, elements, 5.0)
    assert {r["id"]: (r["target_component"], r["reason"]) for r in near.collect()} == {0: (4, None), 1: (None, "target region matched non-arrow component 5"), 2: (None, "target page has no diagram components")}


def test_texts_that_refer_elsewhere(spark):
    rows = [a_link(0, 2, (0, 0, 10, 10), 4), a_link(1, 2, (0, 0, 9, 10), 5), a_link(2, 2, (0, 0, 10, 10), 2)]
    texts = frame(spark, [("d", 2, 8, "K12 / b3", 0.0, 0.0, 10.0, 10.0), ("d", 2, 9, "plain", 0.0, 0.0, 10.0, 10.0)], f"doc string, page int, id long, text string, {BOX}")
    got = links.cross_references(frame(spark, rows, LINK), texts, frame(spark, [("d", 10)], "doc string, page_count int")).collect()
    assert [(r["text"], r["link"], r["target_page"], r["label"], r["zone"], r["iou"]) for r in got] == [(8, 0, 4, "K12", "B3", 1.0)]


# Tables.


def test_table_with_spans_and_splits(spark):
    cells = frame(spark, [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 10.0, 0.0, 30.0, 10.0), (1, 2, 0.0, 10.0, 10.0, 30.0), (1, 3, 20.0, 10.0, 30.0, 20.0), (1, 4, 5.0, 5.0, 5.0, 9.0)], f"page int, id long, {BOX}")
    texts = frame(spark, [(1, 0, "b", 5.0, 1.0, 7.0, 3.0), (1, 1, "a", 1.0, 1.5, 3.0, 3.0), (1, 2, "c<", 1.0, 5.0, 3.0, 7.0), (1, 3, "left", 11.0, 2.0, 14.0, 4.0), (1, 4, "right", 24.0, 2.0, 28.0, 4.0), (1, 5, "out", 90.0, 90.0, 91.0, 91.0)], f"page int, id long, text string, {BOX}")
    line = lambda i, *p: (1, i, "line", [(float(x), float(y)) for x, y in p])
    vectors = frame(spark, [line(0, (20, 1), (20, 9)), line(1, (21, 1), (21, 9)), line(2, (10, 0), (10, 10)), line(3, (15, 20), (16, 30))], "page int, id long, type string, points array<struct<x: double, y: double>>")
    rows, html = tab.reconstruct(cells, texts, vectors)
    got = {r["id"]: (r["row"], r["col"], r["rowspan"], r["colspan"], r["text"]) for r in rows.collect()}
    assert got == {0: (0, 0, 1, 1, "a b c<"), 1: (0, 1, 1, 2, "left right"), 2: (1, 0, 2, 1, ""), 3: (1, 2, 1, 1, "")}
    want = ['<table border="1" cellspacing="0" cellpadding="4">', "  <tr>", "    <td>a b c&lt;</td>", '    <td colspan="2">left &lt;vertical&gt; right</td>', "  </tr>", "  <tr>", '    <td rowspan="2"></td>', "    <td></td>", "    <td></td>", "  </tr>", "  <tr>", "  </tr>", "</table>"]
    assert html.first()["html"].split("\n") == want


def test_symbol_table(spark):
    grid = frame(spark, [(1, r, c, c * 10.0, r * 10.0, c * 10 + 10.0, r * 10 + 10.0) for r in range(3) for c in range(4)], f"page int, row int, col int, {BOX}")
    vectors = frame(spark, [(1, 0, 12.0, 12.0, 14.0, 14.0), (1, 1, 12.0, 22.0, 14.0, 24.0), (1, 2, 2.0, 22.0, 4.0, 24.0), (1, 3, 10.0, 0.0, 10.1, 30.0)], f"page int, id long, {BOX}")
    texts = frame(spark, [(1, 0, "K", 22.0, 12.0, 24.0, 14.0), (1, 1, "relay", 32.0, 12.0, 34.0, 14.0), (1, 2, "Q", 22.0, 22.0, 24.0, 24.0)], f"page int, id long, text string, {BOX}")
    got = sorted((r["row"], r["type"], r["descriptions"], r["vectors"]) for r in tab.symbol_records(grid, vectors, texts).collect())
    assert got == [(1, "K", ["relay"], [0]), (2, "Q", [], [1])]


# Geometry.

VECTOR = f"page int, id long, type string, points array<struct<x: double, y: double>>, {BOX}, dashes string, path_index int"


def vector(i, kind, points, dashes="[] 0", path=None, page=1):
    xs, ys = [float(x) for x, _ in points], [float(y) for _, y in points]
    return (page, i, kind, list(zip(xs, ys, strict=True)), min(xs), min(ys), max(xs), max(ys), dashes, path)


def arc(x, y, r, k):
    h = 0.5523 * r
    turn = lambda px, py: [(px, py), (-py, px), (-px, -py), (py, -px)][k]
    return [(x + a, y + b) for a, b in (turn(r, 0), turn(r, h), turn(h, r), turn(0, r))]


def test_faces_of_crossing_lines(spark):
    cross = [(0, 0, 30, 0), (0, 10, 30, 10), (0, 20, 30, 20), (0, 0, 0, 20), (15, -3, 15, 20), (30, 0, 30, 20), (40, 0, 50, 0), (5, 2, 9, 2)]
    found = faces.faces([tuple(map(float, s)) for s in cross], 1.0)
    assert [tuple(map(min, zip(*ring, strict=True))) + tuple(map(max, zip(*ring, strict=True))) for ring, _ in found] == [(0, 0, 15, 10), (15, 0, 30, 10), (0, 10, 15, 20), (15, 10, 30, 20)]
    assert found[0][1] == {0, 1, 3, 4}
    triangle = faces.faces([(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 5.0, 8.0), (5.0, 8.0, 0.0, 0.0), (5.0, 8.0, 5.0, 30.0)])
    assert len(triangle) == 1 and triangle[0][1] == {0, 1, 2}
    rows = [vector(i, "line", [s[:2], s[2:]]) for i, s in enumerate(cross)] + [vector(20, "rect", [(100, 0), (110, 0), (110, 10), (100, 10)])]
    got = geometry.cells(frame(spark, rows, VECTOR)).collect()
    assert [(r["x0"], r["y0"]) for r in sorted(got, key=lambda r: r["nth"])] == [(0, 0), (15, 0), (100, 0), (0, 10), (15, 10)]
    assert geometry.cells(frame(spark, rows[:1], VECTOR)).count() == 0 and geometry.cells(frame(spark, [], VECTOR)).count() == 0


def test_boxes_circles_and_pins(spark):
    rows = [vector(0, "rect", [(0, 0), (40, 0), (40, 20), (0, 20)]), vector(1, "rect", [(100, 0), (140, 0), (140, 20), (100, 20)], "[3 3] 0"), vector(2, "rect", [(200, 0), (240, 0), (240, 20), (200, 20)], "[9 1 1 1] 0")]
    rows += [vector(10 + 4 * n + k, "curve", arc(20 + 30 * n, 100, r, k), path=n) for n, r in enumerate((3, 3.1, 9)) for k in range(4)]
    rows += [vector(40 + k, "line", p, path=50) for k, p in enumerate(([(0, 200), (0, 204)], [(0, 204), (6, 202)], [(6, 202), (0, 200)]))]
    rows += [vector(60, "line", [(300, 300), (400, 300)]), vector(61, "line", [(350, 303), (356, 297)]), vector(62, "line", [(330, 303), (336, 297)]), vector(63, "line", [(310, 303), (316, 297)]), vector(64, "line", [(316, 297), (330, 290)])]
    df = frame(spark, rows, VECTOR)
    assert [r["vectors"] for r in geometry.boxes(df).where("y0 = 0").collect()] == [[0]]
    assert [r["vectors"] for r in geometry.dashed_faces(df).collect()] == [[1]] and [r["vectors"] for r in geometry.dashed_faces(df, "dash_dotted").collect()] == [[2]]
    assert sorted(r["path_index"] for r in geometry.circles(df).collect()) == [0, 1, 2]
    assert sorted(r["path_index"] for r in geometry.circle_pins(df).collect()) == [0, 1]
    arrows = geometry.arrow_pins(df)
    assert [(r["direction"], r["vectors"]) for r in arrows.collect()] == [("right", [40, 41, 42])]
    assert sorted((r["id"], r["wire_vector"]) for r in geometry.wire_marks(df).collect()) == [(61, 60), (62, 60)]
    doubled = frame(spark, [*rows, vector(45, "line", [(0, 200.02), (0, 203.9)])], VECTOR)
    left = {r["id"] for r in geometry.without_arrow_lines(doubled, arrows).collect()}
    assert not left & {40, 41, 42, 45} and {0, 60, 61} <= left
    classes = {r["id"]: r for r in geometry.vector_classes(df).collect()}
    assert classes[0]["axis_linear"] and classes[1]["dashed_linear"] and not classes[1]["boundary"] and classes[10]["boundary"] and not classes[61]["axis_linear"] and classes[2]["dash_type"] == "dash_dotted"


def test_entities_wires_and_ends(spark):
    line = lambda i, a, b: vector(i, "line", [a, b])
    rows = [line(0, (0, 0), (20, 0)), line(1, (20, 0), (20, 20)), line(2, (10, 0), (10, 9)), line(3, (100, 0), (104, 0)), line(4, (20, 20), (23, 23)), line(5, (23, 23), (60, 23)), line(6, (106, 0), (109, 0))]
    df = frame(spark, rows, VECTOR)
    assert [r["ids"] for r in sorted(geometry.entities(df).collect(), key=lambda r: r["entity"])] == [[0, 1, 2, 4, 5], [3], [6]]
    assert [r["ids"] for r in sorted(geometry.entities(df, gap=8.0).collect(), key=lambda r: r["entity"])] == [[0, 1, 2, 4, 5], [3, 6]]
    square = [line(10 + k, a, b) for k, (a, b) in enumerate((((0, 0), (50, 0)), ((50, 0), (50, 50)), ((50, 50), (0, 50)), ((0, 50), (0, 0))))]
    inner = [line(20, (10, 10), (20, 10)), line(21, (80, 80), (90, 80))]
    assert [r["ids"] for r in sorted(geometry.entities(frame(spark, square + inner, VECTOR), contained=True).collect(), key=lambda r: r["entity"])] == [[10, 11, 12, 13, 20], [21]]
    wires = {r["wire"]: (r["ids"], [(p["x"], p["y"]) for p in r["free"]]) for r in geometry.wires(df).collect()}
    assert wires == {0: ([0, 1, 2, 4], [(0.0, 0.0), (10.0, 9.0), (23.0, 23.0)]), 1: ([5], [(23.0, 23.0), (60.0, 23.0)])}
    points = frame(spark, [(1, 0, 5.0, 1.0), (1, 1, 5.004, 1.004), (1, 2, 0.0, 9.0), (1, 3, 7.0, 1.0)], "page int, wire long, x double, y double")
    ends = geometry.endpoints(points)
    assert sorted((r["id"], r["x"], r["wires"]) for r in ends.collect()) == [(0, 5.0, [0, 1]), (1, 7.0, [3]), (2, 0.0, [2])]
    circles = frame(spark, [(1, 0, 4.0, 0.0, 6.0, 2.0), (1, 1, 8.0, 0.0, 9.0, 2.0)], f"page int, id long, {BOX}")
    assert sorted(tuple(r)[1:] for r in geometry.graphical_endpoints(ends, circles).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_frame_of_a_page(spark):
    rows = [vector(0, "rect", [(10, 10), (90, 10), (90, 60), (10, 60)]), vector(1, "line", [(20, 20), (30, 20)]), vector(2, "line", [(5, 30), (50, 30)]), vector(3, "line", [(10, 10.5), (80, 10.5)]), vector(4, "line", [(200, 0), (210, 0)])]
    pages = frame(spark, [(1, 0.0, 0.0, 100.0, 80.0), (2, 0.0, 0.0, 200.0, 100.0)], f"page int, {BOX}")
    found = geometry.frame(frame(spark, rows, VECTOR), pages)
    got = {r["page"]: tuple(r)[1:] for r in found.collect()}
    assert got[1][:4] == (10.0, 10.0, 90.0, 60.0) and got[1][4] == 60.0 and got[2] == (1.0, 1.0, 199.0, 99.0, 99.0)
    region = frame(spark, [(1, 10.0, 10.0, 90.0, 60.0)], f"page int, {BOX}")
    assert sorted(r["id"] for r in geometry.content_vectors(frame(spark, rows, VECTOR), region).collect()) == [0, 1, 2]
    cut = {r["id"]: (r["type"], r["x0"], r["x1"]) for r in geometry.content_vectors(frame(spark, rows, VECTOR), region, clip=True).collect()}
    assert cut == {0: ("rect", 10.0, 90.0), 1: ("line", 20.0, 30.0), 2: ("line", 10.0, 50.0), 3: ("line", 10.0, 80.0)}


def test_lines_that_bound_tables(spark):
    rows = [vector(0, "quad", [(0, 0), (5, 0), (5, 5), (0, 5)]), vector(1, "line", [(5, 0), (0, 0)]), vector(2, "line", [(0, 9), (9, 9)]), vector(3, "line", [(0, 0), (9, 9)]), vector(4, "curve", arc(0, 0, 3, 0), path=1), vector(5, "line", [(1, 1), (1, 9)], path=1)]
    assert [r["id"] for r in geometry.table_vectors(frame(spark, rows, VECTOR)).collect()] == [2]


# Symbols.

SHAPE = "symbol int, id long, type string, dashed boolean, points array<struct<x: double, y: double>>"


def moved(points, degrees, scale, dx, dy, mirrored=False):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    xy = [((-x if mirrored else x) * scale, y * scale) for x, y in points]
    return [(c * x - s * y + dx, s * x + c * y + dy) for x, y in xy]


def test_symbols_turned_scaled_and_mirrored(spark):
    symbols = {0: [("line", [(0, 0), (10, 0)]), ("line", [(10, 0), (10, 6)]), ("line", [(0, 0), (4, 9)])], 1: [("rect", [(0, 0), (8, 0), (8, 4), (0, 4)]), ("line", [(8, 2), (14, 2)])]}
    shapes = frame(spark, [(s, i, k, False, [(float(x), float(y)) for x, y in p]) for s, parts in symbols.items() for i, (k, p) in enumerate(parts)], SHAPE)
    places = [(90, 1.3, 100, 40, False), (270, 0.8, 220, 160, False), (180, 1.5, 360, 120, True)]
    rows, n, want = [], 0, set()
    for s, parts in symbols.items():
        for turn in places:
            ids = []
            for k, p in parts:
                q = moved(p, *turn[:2], turn[2] + 400 * s, turn[3], turn[4])
                rows.append((1, n, k, False, q[::-1] if n % 2 else q))
                ids.append(n)
                n += 1
            want.add((s, tuple(ids)))
    rows.append((1, n, "line", False, [(900.0, 900.0), (910.0, 905.0)]))
    vectors = frame(spark, rows, "page int, id long, type string, dashed boolean, points array<struct<x: double, y: double>>")
    assert {(r["symbol"], tuple(r["members"])) for r in matching.found_symbols(shapes, vectors).collect()} == want
    none = matching.found_symbols(shapes.withColumn("dashed", F.lit(True)), vectors)
    assert none.count() == 0
    best = matching.shape_matches(shapes.where("symbol = 1 and id = 0"), vectors).where("id = 9").collect()
    assert {round(r["scale"], 6) for r in best} == {1.3} and all(r["error"] < 1e-9 for r in best)
    twin = shapes.unionByName(shapes.where("symbol = 0").select(F.lit(5).alias("symbol"), "id", "type", "dashed", F.transform("points", lambda p: B.point(p["x"] + 50, p["y"] - 7)).alias("points")))
    assert {r["symbol"]: r["kept"] for r in matching.same_symbols(twin).collect()} == {0: 0, 1: 1, 5: 0}
    left = frame(spark, [(1, 0, [(0.0, 0.0), (5.0, 0.0)]), (1, 1, [(0.0, 0.1), (5.0, 0.1)])], "page int, id long, points array<struct<x: double, y: double>>")
    assert [(r["a"], r["b"]) for r in matching.paired_lines(left, left.select("page", (F.col("id") + 10).alias("id"), F.reverse("points").alias("points"))).collect()] == [(0, 10), (1, 11)]


# Primitives.


def test_primitives_of_pages(spark):
    item = "array<struct<op: string, points: array<struct<x: double, y: double>>>>"
    paths = frame(spark, [("d", 1, 0, "[] 0", [("l", [(0.0, 0.0), (5.0, 0.1234567)]), ("re", [(1.0, 1.0), (4.0, 3.0)]), ("zz", []), ("c", [(0.0, 0.0)])]), ("d", 1, 1, None, None)], f"doc string, page int, path_index int, dashes string, items {item}")
    got = {r["item_index"]: r for r in primitives.vectors(paths).collect()}
    assert {i: r["type"] for i, r in got.items()} == {0: "line", 1: "rect"} and got[0]["code"] == "0 0 m\n5 0.123457 l" and got[1]["code"] == "1 1 3 2 re" and len(got[1]["points"]) == 4
    assert primitives.vectors(paths, (4.5, -1.0, 9.0, 9.0)).count() == 1
    span = "array<struct<dir: struct<x: double, y: double>, spans: array<struct<text: string, bbox: array<double>, size: double, font: string>>>>"
    blocks = frame(spark, [("d", 1, 0, 0, [((1.0, 0.0), [(" a ", [0.0, 0.0, 1.0, 1.0], 9.0, "f"), ("  ", [0.0, 0.0, 1.0, 1.0], 9.0, "f")]), (None, [("b", [5.0, 5.0, 6.0, 6.0], None, "f"), ("c", [1.0], 1.0, "f")])]), ("d", 1, 1, 1, [((1.0, 0.0), [("image", [0.0, 0.0, 1.0, 1.0], 9.0, "f")])])], f"doc string, page int, block_index int, type int, lines {span}")
    assert [(r["index"], r["text"], r["font_size"], r["dx"]) for r in primitives.texts(blocks).orderBy("index").collect()] == [(0, "a", 9.0, 1.0), (1, "b", 0.0, 1.0)]
    marks = frame(spark, [("d", 1, 0, (0.0, 0.0, 1.0, 1.0), "4", True), ("d", 1, 1, (0.0, 0.0, 1.0, 1.0), "4", False), ("d", 1, 2, (0.0, 0.0, 1.0, 1.0), "-1", True), ("d", 1, 3, None, "4", True), ("d", 1, 4, (0.0, 0.0, 1.0, 1.0), "x", False)], "doc string, page int, index int, `from` struct<x0: double, y0: double, x1: double, y1: double>, target string, target_is_number boolean")
    assert {r["index"]: r["target_page"] for r in primitives.links(marks).collect()} == {0: 5, 1: 4}
    region = lambda scripts, view, fit, h=100.0: value(spark, primitives.highlight_region(F.array(*[F.lit(s) for s in scripts]).cast("array<string>"), F.array(*[F.lit(v) for v in view]).cast("array<double>"), F.lit(fit), F.lit(h)))
    assert tuple(region(["x", "a.highlight('p', [1, 2, 3.0000004, 4])"], [], False)) == ("highlight", 1.0, 96.0, 3.0, 98.0)
    assert tuple(region(["x"], [1.0, 2.0, 3.0, 4.0], True)) == ("viewrect", 1.0, 2.0, 4.0, 6.0) and region([], [], True)["kind"] == "whole_page" and region([], [], False) is None
    objects = frame(spark, [(1, [("A", 2)]), (2, [("Next", 3)]), (3, [("Next", 2), ("Next", 4)]), (4, [])], "xref int, refs array<struct<role: string, xref: int>>")
    chain = primitives.action_chains(objects, frame(spark, [(9, 1)], "link int, xref int"))
    assert sorted((r["xref"], r["depth"]) for r in chain.collect()) == [(2, 0), (3, 1), (4, 2)]
    assert value(spark, primitives.snippet(F.lit("x" * 2000))) == "x" * 1800 + "\n...[truncated]"
    assert [c["op"] for c in value(spark, primitives.commands(F.lit("rect"), pts((0, 0), (1, 0), (1, 1), (0, 1))))] == ["M", "L", "L", "L", "Z"]
    assert [value(spark, primitives.paint_operator(F.lit(k), F.lit(f), F.lit(s), F.lit(e))) for k, f, s, e in (("fs", True, True, False), ("f", True, False, True), (None, True, True, False))] == ["B", "f*", "S"]


def test_nets_number_by_first_wire(spark):
    wires = frame(spark, [(1, i) for i in (3, 5, 7, 9)], "page int, id long")
    connections = frame(spark, [(1, 9, 1), (1, 5, 1), (1, 5, 2), (1, 3, 4), (1, 7, 4), (1, 99, 4)], "page int, wire long, endpoint long")
    assert sorted((r["net"], r["wire_ids"], r["endpoints"]) for r in graph.wire_nets(wires, connections).collect()) == [(0, [3, 7], [4]), (1, [5, 9], [1, 2])]
