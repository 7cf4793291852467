"""Page streams on drawn graphs; the job machine against its table of moves, in batch and as a stream."""

from __future__ import annotations

import random
from collections import defaultdict, deque

from tracewright import queries
from tracewright.operators import pages
from tracewright.streaming import jobs

COMMAND = "job_id long, seq long, command string, value long"


def test_arrows_end_a_way_and_groups_are_not_entered(spark):
    names = {"in0": "input", "w0": None, "c1": None, "w1": None, "c2": None, "w2": None, "out3": "output", "c6": None, "in7": "input", "out4": "output"}
    nodes = spark.createDataFrame([(n, 1, "component", io) for n, io in names.items()] + [("g0", 1, "group", None), ("far", 2, "component", None)], "id string, page int, kind string, page_io string")
    ways = "in0-w0 w0-c1 c1-w1 w1-c2 c2-w2 w2-out3 in0-c6 c6-in7 g0-c1 g0-out4 c2-far"
    edges = spark.createDataFrame([tuple(w.split("-")) for w in ways.split()], "source_id string, target_id string")
    found = {(r["source"], r["id"]): r["distance"] for r in pages.arrow_distances(nodes, edges).collect()}
    assert found["out3", "in0"] == found["in0", "out3"] == 6 and found["in0", "in7"] == 2
    assert ("in7", "c1") not in found and ("out4", "c1") not in found and ("in0", "far") not in found
    stream = {(r["source"], r["target"]): r["distance"] for r in pages.page_stream(nodes, edges).collect()}
    assert stream == {("in0", "out3"): 6, ("in0", "out4"): None, ("in7", "out3"): None, ("in7", "out4"): None}


def plain_distances(nodes, edges):
    """A search from every arrow until its queue is empty, over (id, page, kind, page_io) and (source_id, target_id)."""
    page, arrows = {n: p for n, p, kind, _ in nodes if kind != "group"}, {n for n, _, kind, io in nodes if io is not None and kind != "group"}
    near = defaultdict(set)
    for a, b in edges:
        if a != b and a in page and b in page and page[a] == page[b]:
            near[a].add(b)
            near[b].add(a)
    found = {}
    for source in arrows:
        found[source, source], queue = 0, deque([source])
        while queue:
            at = queue.popleft()
            for b in near[at] if at == source or at not in arrows else ():
                if (source, b) not in found:
                    found[source, b] = found[source, at] + 1
                    queue.append(b)
    return found


def test_searches_run_until_nothing_is_new(spark):
    nodes, edges = queries.core.stream_graph(spark, "/root/testdata/sf0.001")
    want = plain_distances([tuple(r) for r in nodes.select("id", "page", "kind", "page_io").collect()], [tuple(r) for r in edges.collect()])
    assert max(want.values()) > 4
    assert {(r["source"], r["id"]): r["distance"] for r in pages.arrow_distances(nodes, edges).collect()} == want
    io = {r["id"]: (r["page"], r["page_io"]) for r in nodes.where("page_io is not null").collect()}
    pairs = {(a, b): want.get((a, b)) for a in io for b in io if io[a] == (io[b][0], "input") and io[b][1] == "output"}
    assert {(r["source"], r["target"]): r["distance"] for r in pages.page_stream(nodes, edges).collect()} == pairs


def test_no_way_is_too_long(spark):
    names = [f"n{i:02}" for i in range(61)]
    nodes = spark.createDataFrame([(n, 1, "component", {0: "input", 60: "output"}.get(i)) for i, n in enumerate(names)], "id string, page int, kind string, page_io string")
    edges = spark.createDataFrame([(f"e{a}", a, b) for a, b in zip(names, names[1:], strict=False)], "id string, source_id string, target_id string")
    assert [tuple(r) for r in pages.page_stream(nodes, edges).collect()] == [("n00", "n60", 60)]
    assert [r["distance"] for r in pages.page_stream(nodes, edges, 59).collect()] == [None]


def folded(rows):
    states = {}
    for job, _, command, value in sorted(rows, key=lambda r: r[1]):
        states[job] = jobs.move(*states.get(job, ("none", 0)), command, value)
    return states


def test_failed_jobs_keep_progress_and_resume():
    rows = [(1, i, c, v) for i, (c, v) in enumerate([("submit", None), ("claim", None), ("progress", 47), ("fail", None), ("resume", None), ("claim", None)])]
    assert folded(rows[:4]) == {1: ("failed", 47)} and folded(rows) == {1: ("running", 47)}
    assert jobs.move("delete_requested", 5, "succeed", None) == ("none", 100) and jobs.move("succeeded", 100, "pause", None) == ("succeeded", 100)


def test_chunks_and_streams_give_the_fold(spark, tmp_path):
    dice = random.Random(3)
    commands = sorted({c for c, _ in jobs.MOVES}) + [None, "unknown", "submit", "claim", "progress"]
    rows = [(dice.randrange(9), i, dice.choice(commands), dice.choice([None, dice.randrange(100)])) for i in range(800)]
    want = folded(rows)
    df = spark.createDataFrame(rows, COMMAND)
    for chunk in (1, 7, 10_000):
        assert {r["job_id"]: (r["status"], r["progress"]) for r in jobs.job_states(df, chunk).collect()} == want
    assert jobs.job_states(df.limit(0)).count() == 0
    for part in range(2):  # the second file repeats some of the first
        df.where(f"seq between {part * 300} and {400 + part * 400}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.stream_states(spark.readStream.schema(COMMAND).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        latest = {}
        query.foreachBatch(lambda batch, _: latest.update({r["job_id"]: (r["status"], r["progress"]) for r in batch.collect()})).start().awaitTermination(120)
    assert {k: want[k] for k in latest} == latest and len(latest) == len(want)
