"""What the n-gram join holds on disk at a time: its written tables, and what it shuffles."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, components, ngram_join


@pytest.fixture(scope="module")
def near_copies(spark):
    """20 documents with two near copies each, and 60 that share most of their words with one another."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(20)]
    passage = " ".join(word() for _ in range(60))
    rows = [(10 * i + k, t + f" more{k}" * (k > 0)) for i, t in enumerate(texts) for k in range(3)]
    rows += [(1000 + i, passage + " " + " ".join(word() for _ in range(i % 30))) for i in range(60)]
    return common.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "near-copies")


def found(docs):
    return sorted(tuple(r) for r in ngram_join.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect())


def test_tables_that_nothing_reads_any_more_are_deleted(spark, near_copies, tmp_path, monkeypatch):
    written, write = [], common.materialize

    def spied(df, tag):
        out = write(df, tag)
        written.append((tag, Path(out.inputFiles()[0].removeprefix("file:")).parent))
        return out

    for module in (common, ngram_join, components):
        monkeypatch.setattr(module, "materialize", spied)
    ngram_join.one_of_each(near_copies).write.parquet(str(tmp_path / "out"))
    tags, left = {t for t, _ in written}, {t for t, path in written if path.exists()}
    assert {"listed", "shared-parts", "sets", "neighbours"} <= tags
    assert not left & {"listed", "shared-parts", "spare", "members", "weighed", "sets", "classes"}
    assert sum(path.exists() for t, path in written if t == "neighbours") <= 1


def test_parts_are_counted_in_passes(spark, near_copies, monkeypatch):
    want = found(near_copies)
    assert sum(c != i for i, _, c in want) > 40
    monkeypatch.setattr(ngram_join, "PARTS", 1000)
    monkeypatch.setattr(ngram_join, "release", lambda session: None)
    counted, write = [], common.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, tag: (counted.append(df.count()) if tag == "shared-parts" else None, write(df, tag))[1])
    assert found(near_copies) == want
    assert len(counted) > 1 and max(counted) < 0.6 * sum(counted)


def test_blocks_of_a_large_neighbourhood_meet_in_passes(spark, near_copies, monkeypatch):
    want = found(near_copies)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 1500)
    sent, meet = [], ngram_join._meetings

    def spied(sets, percent):
        sent.append(sets.agg(F.sum(F.greatest(F.size("tokens"), F.lit(ngram_join.LEAST)))).first()[0] or 0)
        return meet(sets, percent)

    monkeypatch.setattr(ngram_join, "_meetings", spied)
    assert found(near_copies) == want
    once = sum(sent)
    sent.clear()
    monkeypatch.setattr(ngram_join, "MEETING_TOKENS", 1)
    monkeypatch.setattr(ngram_join, "release", lambda session: None)
    assert found(near_copies) == want
    assert len(sent) > 2 and sum(sent) == once and max(sent) < once / 2
