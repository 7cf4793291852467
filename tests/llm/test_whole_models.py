"""Models hold every n-gram."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark import SparkContext
from pyspark.sql.classic.dataframe import DataFrame

from tracewright.llm import pitman_yor, quality


def test_a_model_holds_more_than_two_million_ngrams(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9E00, 105_000))) for _ in range(20)]
    model = quality.fit(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"))["x"]
    assert len(model.grams[quality.ORDER - 1].hashes) == len(np.unique(np.concatenate([quality.codes(t) for t in texts]))) > 2_000_000


def test_every_word_has_a_context_of_its_own(spark, monkeypatch):
    """More words than 1 << 19: none of them is a member of a class of rare words."""
    rows = [(i, " ".join(f"{k:x}" for k in range(i * 20_000, (i + 1) * 20_000))) for i in range(36)]
    seen, fit_pairs = [], pitman_yor.fit_pairs
    monkeypatch.setattr(pitman_yor, "fit_pairs", lambda ranges, pairs, *a: seen.append((pairs.words, a[0])) or fit_pairs(ranges, pairs, *a))
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    known = 20_000 * sum(not r["held_out"] for r in got)
    words, customers = seen[0]
    assert words == known + 1 > 1 << 19 and customers[words] == 0
    assert len(got) == 36 and all(r["score"] < 0 for r in got)


def test_no_array_of_all_words_on_the_driver(spark, monkeypatch):
    """240 000 words in blocks: what is broadcast, gathered by Arrow or collected is less than a byte for each."""
    monkeypatch.setattr(pitman_yor, "RANGE_TOKENS", 40_000)
    rows = [(i, " ".join(f"{k:x}" for k in range(i * 15_000, (i + 1) * 15_000)) + " the end") for i in range(24)]
    sizes, broadcast, to_arrow, collect = [], SparkContext.broadcast, DataFrame.toArrow, DataFrame.collect
    bare = len(pickle.dumps(pitman_yor.Spelling.uniform())) + 400 * 257 * 4  # contexts of two symbols: hexadecimal digits and a few letters

    def gathered(df):
        got = to_arrow(df)
        sizes.append(got.nbytes)
        return got

    def collected(df):
        got = collect(df)
        sizes.append(sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in got for v in r))
        return got

    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sizes.append(len(pickle.dumps(value)) - bare) or broadcast(sc, value))
    monkeypatch.setattr(DataFrame, "toArrow", gathered)
    monkeypatch.setattr(DataFrame, "collect", collected)
    scores = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert max(sizes) < 240_000
    monkeypatch.undo()
    got = scores.collect()
    known = 15_000 * sum(not r["held_out"] for r in got)
    assert known == 240_000 and len(got) == 24
    for r in got:
        assert r["n_tokens"] == 15_003 and r["n_known"] == (3 if r["held_out"] else 15_003) and r["score"] < 0
