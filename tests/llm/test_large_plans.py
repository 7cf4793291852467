"""Plans of large inputs, forced on small ones: what they shuffle, and that they give the same rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, ngram_join, suffix_dedup


@pytest.fixture(scope="module")
def texts(spark):
    """Documents of different words, a fifth of which share a passage with another."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(i, " ".join([*[word() for _ in range(60)], *([passages[i % 12]] if i % 5 == 0 else []), *[word() for _ in range(60)]])) for i in range(300)]
    return common.materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "large-plans")


def test_a_filter_holds_its_keys_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**63), 2**63 - 1, 50_000), rng.integers(-(2**63), 2**63 - 1, 200_000)
    table = common.key_filter(spark.createDataFrame([(k,) for k in keys.tolist()], "k long"), len(keys))
    assert table.nbytes == 8 * 10_000 and common.held(table, keys).all() and common.held(table, others).mean() < 0.03
    assert not common.held(common.key_filter(spark.createDataFrame([], "k long"), 0), others).any()


def test_suffix_dedup_sends_contexts_of_repeated_anchors_only(spark, texts, monkeypatch):
    want = sorted(map(str, suffix_dedup.deduplicate(texts).collect()))
    sent, judged = [], suffix_dedup._judged
    monkeypatch.setattr(suffix_dedup, "_judged", lambda contexts, length: sent.append(contexts.count()) or judged(contexts, length))
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", 20)
    monkeypatch.setattr(suffix_dedup, "SPANS", 30)
    assert sorted(map(str, suffix_dedup.deduplicate(texts).collect())) == want
    every = sum(len(suffix_dedup.anchors(r["text"].encode())[0]) for r in texts.collect())
    assert 100 < sent[0] < every / 4


def test_ngram_join_shuffles_shared_parts_only(spark, texts, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    near = [(1000 + 10 * i + k, t + f" more{k}") for i, t in rows[:40] for k in range(3)]
    docs = common.materialize(spark.createDataFrame([*rows, *near], "doc_id long, text string").repartition(3), "near-copies")
    found = lambda: sorted(tuple(r) for r in ngram_join.similar_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    want = found()
    assert sum(c != i for i, _, c in want) == 120
    sent, parts = [], ngram_join._held_parts

    def spied(listed, several, n):
        out = parts(listed, several, n)
        sent.append((out.count(), listed.agg(F.sum(F.size("signatures"))).first()[0]))
        return out

    monkeypatch.setattr(ngram_join, "_held_parts", spied)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(ngram_join, "MEMBERS", 50)
    assert found() == want
    assert 0 < sent[0][0] < sent[0][1] / 2
