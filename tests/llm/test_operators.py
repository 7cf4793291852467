"""The training-data operators against plain Python on small tables."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import common, components, deep_shallow, exact_dedup, html_extract, mixing, ngram_join, packing, pitman_yor, quality, suffix_dedup, token_count, warc
from tracewright.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, label string, row string, key string"


def texts() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out: list = [None, "", " \n\t", "One", "one  TWO", "One two", "ünï ÇA …", "x" * 30_000, "a\x00b", "same words here again " * 40]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        out.append(" ".join(base))
        if i % 3 == 0:
            changed = list(base)
            changed[rng.randrange(len(changed))] = "CHANGED"
            out.append(" ".join(changed))
        if i % 4 == 0:
            out.append("  ".join(base))
            out.append(" ".join(base))
        if i % 5 == 0:
            out.append(" ".join(base[:20]) + " " + passage + " " + " ".join(base[20:]) + "\n" + passage)
    long = [rng.choice(words) for _ in range(9000)]
    out += [" ".join(long), " ".join(long[:4500] + ["new"] + long[4500:])]
    sources = ["hot"] * 3 + ["b", "a", None, "é"]
    langs = ["en", "en", "de", None]
    rows = [(i, t, langs[i % 4], sources[i % 7], len(t or ""), 1, "x", "y", "z") for i, t in enumerate(out)]
    return [*rows, rows[12], rows[0], (None, "no id here", None, None, 0, 0, "", "", "")]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.materialize(spark.createDataFrame(rows, SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return out


# 1


def test_mix_nears_targets_and_repeats(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    targets = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    assert math.isclose(sum(targets.values()), sum(sizes.values()))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["copies"], r["size"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in got)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=30), st.floats(0.01, 0.99), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_pivot_keeps_the_sum(sizes, p, seed):
    f = mixing.pivot(sizes, [p] * len(sizes), random.Random(seed), False)
    assert sum(0 < x < 1 for x in f) <= 1
    assert math.isclose(sum(s * x for s, x in zip(sizes, f, strict=True)), p * sum(sizes), rel_tol=1e-9)


def test_pivot_is_unbiased():
    sizes = [3, 1, 4, 1, 5]
    mean = np.mean([mixing.pivot(sizes, [0.3] * 5, random.Random(i), True) for i in range(4000)], 0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_water_fill_caps():
    assert mixing.water_fill([10, 0, 1000], [5, 2, 1]) == [30.0, 0.0, 980.0]


# 2


def brute_statistics(text):
    words = [w for w in (text or "").encode().split()]
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(docs, rows, empty):
    judged = quality.judge(docs)
    got = by_id(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "label")
    for r in rows:
        want = brute_statistics(r[1])
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        for g in got[r[0]]:
            assert g[:5] == want and g[5] == failed and not (failed and g[6]) and g[7] >= 0 and g[8] == r[6]
    assert judged.count() == len(rows) and quality.judge(empty).count() == 0
    assert quality.good_documents(docs).columns == docs.columns


@given(st.text("ab #\n", max_size=80))
@settings(max_examples=200, deadline=None)
def test_word_statistics(text):
    assert quality.word_statistics(text) == brute_statistics(text)


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_kneser_ney_sums_to_one_and_backs_off(spark, most):
    rows = [("en", t) for t in ("the cat sat on the mat.", "a dog, a log", "the log", "\U0001f600 a")] + [(None, "xyz")]
    models = quality.fit(spark.createDataFrame(rows, "lang string, text string"), model_grams=most)
    model = models["en"]
    for context in ("the", " ca", "zzz", "\0\0\0"):
        last = quality.codes(context + "a")[3] >> np.uint64(16)
        every = (last << np.uint64(16)) + np.arange(1 << 16, dtype=np.uint64)
        assert math.isclose((10 ** model.log10(every)).sum(), 1, rel_tol=1e-3)
    assert model.log10(quality.codes("the cat")).mean() > model.log10(quality.codes("xq9zv#%")).mean()
    assert max(len(g.hashes) for g in model.grams[1:]) <= most
    assert models[None].log10(quality.codes("xyz")).sum() > models["en"].log10(quality.codes("xyz")).sum()


def test_bands_reject_on_both_sides(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = [(i, "en", " ".join(rng.choice(words) for _ in range(200)), 1) for i in range(200)]
    rows += [(1000, "en", " ".join("".join(rng.choice("QXZJKVWPYG#0123456789") for _ in range(9)) for _ in range(200)), 0)]
    rows += [(1001, "en", " ".join(("et" * (1 + i % 2)) + str(i % 7) for i in range(20)) + " " + "t " * 300, 0)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string, good int")).collect()}
    assert got[1000]["log_perplexity"] > got[1000]["upper_band"] and not got[1000]["kept"]
    assert got[1001]["log_perplexity"] < got[1001]["lower_band"] and not got[1001]["kept"]
    assert sum(got[i]["kept"] for i in range(200)) >= 198


CLASHING = "doc_id long, text string, lang string, source string, n_words int, kept string, __n int, __d int, __key int, copies string, `a b` int"


def test_clashing_names_of_columns_pass_through(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(90)]
    texts_ = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(50)]
    rows = [(i % 60, texts_[i % 50], "en", "ab"[i % 2], i, f"k{i}", -i, 7, 8, "c", 9) for i in range(80)]
    df = spark.createDataFrame(rows, CLASHING)
    for f in (quality.good_documents, exact_dedup.without_copies, lambda d: ngram_join.one_of_each(d, size=5, percent=80), mixing.mixed_documents):
        got = f(df)
        assert got.schema == df.schema and got.count() > 0
        assert {tuple(r) for r in got.collect()} <= set(rows)
    judged = quality.judge(df)
    assert [c for c in judged.columns if c not in quality.RESULT] == ["doc_id", "text", "lang", "source", "__n", "__d", "__key", "copies", "a b"]
    assert dict(judged.dtypes)["kept"] == "boolean"


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_copies_of_rows_that_repeat(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rows = [(1, "a", i) for i in range(10)] + [(None, "a", 20), (None, "a", 21), (2, "b", 30), (3, None, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(4)
    key = {r["text"]: r["x"] for r in docs.select("text", common.row_key().alias("x")).collect()}
    decided = [(1, key["a"], c) for c in (3, 2, 2, 1, 1, 1, 0, 0, 0, 0)] + [(None, key["a"], 2), (None, key["a"], 0), (2, key["b"], 0), (3, key[None], 2)]
    got = Counter((r["doc_id"], r["text"], r["k"]) for r in common.apply_copies(docs, spark.createDataFrame(decided, "doc_id long, row_key long, copies int")).collect())
    assert sorted(got[1, "a", i] for i in range(10)) == sorted((3, 2, 2, 1, 1, 1, 0, 0, 0, 0))
    assert sorted((got[None, "a", 20], got[None, "a", 21])) == [0, 2] and got[2, "b", 30] == 0 and got[3, None, 40] == 2


# 3


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        n = min(len(words), size)
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(math.inf if r[0] is None else r[0])
    return [(r[0], len(sets[i]), r[0] if not sets[i] else None if (m := min(ids[find(i)])) == math.inf else m) for i, r in enumerate(rows)]


@pytest.mark.parametrize("size, percent, block", [(3, 90, None), (5, 80, None), (3, 90, 300)])
def test_ngram_join(docs, rows, monkeypatch, size, percent, block):
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", block)
    got = ngram_join.similar_components(docs, size=size, percent=percent)
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(brute_components(rows, size, percent), key=key)


def test_ngram_join_chains_in_large_neighbourhoods(spark, monkeypatch):
    """A chain of small changes, a star of copies around one text, and two clusters that share parts but do not link."""
    rng = random.Random(3)
    made, text = [], [f"w{rng.randrange(9999)}" for _ in range(120)]
    for i in range(150):
        text = list(text)
        text[rng.randrange(120)] = f"n{i}"
        made.append((i, " ".join(text)))
    hub = [f"h{k}" for k in range(150)]
    for i in range(150, 300):
        own = list(hub)
        for _ in range(rng.choice((1, 2, 3, 5))):
            own[rng.randrange(150)] = f"q{rng.randrange(10**6)}"
        made.append((i, " ".join(own)))
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 3000)
    got = ngram_join.similar_components(spark.createDataFrame(made, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == sorted(brute_components(made, 3, 90))


def test_one_of_each(docs, rows, empty):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    want = Counter(i for i, n, c in brute_components(rows, 3, 90) if i == c and n == 0) + Counter({i: 1 for i, n, c in brute_components(rows, 3, 90) if i == c and n})
    assert ids == want
    assert ngram_join.similar_components(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: i // 10 * 10 for i in range(41) if i % 10 and i != 40}, **{k: 100 for k in range(101, 140)}}


# 4


def test_packing_holds_every_id_once(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    want = sorted([[*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows])
    got = packing.pack(docs, path).collect()
    sequences, texts_ = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        texts_[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    whole = []
    for own in texts_.values():
        parts = sorted(own, key=lambda p: p[0])
        starts = [p[0] for p in parts]
        for k in range(starts.count(0)):  # repeated rows come in turn
            whole.append([i for p in parts[k :: starts.count(0)] for i in p[1]])
            assert len(whole[-1]) == parts[0][2]
    assert sorted(whole) == want
    assert packing.pack(empty, path).count() == 0


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_tokenizers(text):
    words = _words()
    whole = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(words[w] for w in text.encode().split()), "<u4").tolist() == whole


def test_ids_are_those_of_the_tokenizer_as_loaded(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x21, 0x250) if not chr(c).isspace()]
    texts = ["end <|endoftext|> more", "<|startoftext|>", "a<|endoftext|>B.<|endoftext|>", "<|ENDOFTEXT|>", "İstanbul İ. x-İ", *letters, *(f"A{c}b" for c in letters), *(f"{c}." for c in letters)]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert [got[i] for i in range(len(texts))] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert 49407 in got[0] and 49406 in got[1]


_WORDS: list = []


def _words():
    if not _WORDS:
        from tokenizers import Tokenizer

        path = tokenizer("word_bpe_49k.json")
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            assert packing.splits_plainly(file.read())
        _WORDS.append(packing.WordIds(t, True))
    return _WORDS[0]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
@settings(max_examples=100, deadline=None)
def test_shortest_pack_first_as_piece_by_piece(histogram):
    packs: list[list[int]] = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = [p for p in packs if sum(p) + size <= 64]
            if fits:
                min(fits, key=sum).append(size)
            else:
                packs.append([size])
    patterns = packing.shortest_pack_first(histogram, 64)
    used = Counter()
    for count, pattern in patterns:
        assert sum(s * k for s, k in pattern) <= 64
        for s, k in pattern:
            used[s] += count * k
    assert used == Counter(histogram)
    assert sorted(sum(s * k for s, k in p) for c, p in patterns for _ in range(c)) == sorted(map(sum, packs))


# 5


@given(st.lists(st.binary(max_size=30), max_size=30), st.booleans())
@settings(max_examples=200, deadline=None)
def test_deep_shallow_sorts(strings, few):
    strings = [bytes(c % 2 for c in s) for s in strings] if few else strings
    for shallow in (0, 3):
        order, shared = deep_shallow.sort(strings, 0, shallow)
        ordered = [strings[i] for i in order]
        assert ordered == sorted(strings) and sorted(order) == list(range(len(strings)))
        assert shared[1:] == [deep_shallow.common(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]


def brute_repeats(rows, length=100):
    order = sorted({(math.inf if r[0] is None else r[0], (r[1] or "").encode()) for r in rows})
    seen, out = set(), {}
    for d, data in order:
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out[d, data] = (len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block", [None, 3])
def test_suffix_dedup(docs, rows, empty, monkeypatch, block):
    if block:
        monkeypatch.setattr(suffix_dedup, "BLOCK_ROWS", block)
        monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 20)
    want = brute_repeats(rows)
    got = suffix_dedup.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("data", 256)).collect()
    key = lambda t: (str(t[0]), *t[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *want[math.inf if r[0] is None else r[0], (r[1] or "").encode()]) for r in rows), key=key)
    assert suffix_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("limit", [0])
def test_suffix_dedup_without_broadcasts(docs, monkeypatch, limit):
    want = sorted(map(str, suffix_dedup.deduplicate(docs).select("doc_id", "n_removed", "data").collect()))
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", limit)
    assert sorted(map(str, suffix_dedup.deduplicate(docs).select("doc_id", "n_removed", "data").collect())) == want


# 6


def test_pitman_yor(docs, rows, empty):
    train, N = Counter(), 0
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    for r in rows:
        if not held(r[0]):
            train.update(tokens(r[1]))
    N, V = sum(train.values()), len(train)
    got = by_id(pitman_yor.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    totals = [0.0, 0.0]
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((train[w] + 1) / (N + V + 1)) for w in own)
        for g in got[r[0]]:
            assert g[:4] == (held(r[0]), len(own), sum(train[w] > 0 for w in own), N) and math.isclose(g[4], base, rel_tol=1e-9)
            if g[0]:
                totals[0] += g[4]
                totals[1] += g[5]
    assert totals[1] > totals[0]  # words follow words here
    again = by_id(pitman_yor.score(docs.repartition(7)), "score")
    assert all(abs(x - y) < 0.05 * (1 + abs(x)) for i, own in got.items() for x, y in zip(sorted(g[5] for g in own), sorted(g[0] for g in again[i]), strict=True))
    assert pitman_yor.score(empty).count() == 0
    nothing = pitman_yor.score(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert nothing and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in nothing)


def test_pitman_yor_beats_the_base_score_where_words_are_many(spark):
    rng = np.random.default_rng(2)
    made = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 80) if k < 10**9)) for i in range(300)]
    got = pitman_yor.score(spark.createDataFrame(made, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]


def test_pitman_yor_learns_what_follows_what(spark):
    """Texts that go round in a ring of words, and texts in two copies among others in one."""
    rng = random.Random(6)
    ring = [f"r{i}" for i in range(40)]
    made = [(i, " ".join(ring[(k + j) % 40] for j in range(60))) for i in range(120) for k in [rng.randrange(40)]]
    own = [" ".join(f"x{rng.randrange(3000)}" for _ in range(80)) for _ in range(60)]
    made += [(1000 + i, own[i % 60] if i < 80 else " ".join(f"x{rng.randrange(3000)}" for _ in range(80))) for i in range(140)]
    got = {r["doc_id"]: r for r in pitman_yor.score(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    ringed = [r for i, r in got.items() if i < 1000 and r["held_out"]]
    assert all(r["score"] > 0.35 * r["base_score"] for r in ringed) and len(ringed) > 9
    twice = {1000 + i for i in range(80) if i % 60 < 20}
    trained = lambda i: not got[i]["held_out"]
    both = [got[i]["score"] for i in twice if trained(i) and all(trained(j) for j in twice if (j - i) % 60 == 0)]
    once = [r["score"] for i, r in got.items() if i >= 1000 and i not in twice and trained(i)]
    assert len(both) > 9 and sorted(both)[len(both) // 10] > sorted(once)[-len(once) // 10]


@pytest.mark.parametrize("heavy", [1 << 19, 40])
def test_pitman_yor_against_restaurants_in_dictionaries(docs, rows, monkeypatch, heavy):
    """Pairs counted, and scores added up, in plain Python from the same draws; probabilities after each context sum to one."""
    monkeypatch.setattr(pitman_yor, "HEAVY", heavy)
    monkeypatch.setattr(pitman_yor, "BATCH_TOKENS", 3000)
    monkeypatch.setattr(pitman_yor, "RANGE_TOKENS", 2500)
    seen = {}
    fit_pairs, fit = pitman_yor.fit_pairs, pitman_yor.fit
    monkeypatch.setattr(pitman_yor, "fit_pairs", lambda ranges, *a: seen.setdefault("pairs", (ranges, fit_pairs(ranges, *a)))[1])
    monkeypatch.setattr(pitman_yor, "fit", lambda *a, **k: seen.setdefault("fit", fit(*a, **k)))
    got = by_id(pitman_yor.score(docs), "score")
    ranges, (m, samples) = seen["pairs"]
    model, dishes, least = seen["fit"]
    log_p = {r["hash"]: (r["log_p"], r["n"]) for r in dishes.collect()}
    signed = lambda w: int(np.uint64(pitman_yor._hash(w)).view(np.int64))
    frequent = sorted((h for h, (_, n) in log_p.items() if n >= least), key=lambda h: h % 2**64)
    place = {h: i for i, h in enumerate(frequent)}
    K = len(frequent)
    assert K == m.pairs.words and (K <= heavy)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    ids = lambda t: [K + 1, *[place.get(signed(w), K) for w in tokens(t)]]
    counts, contexts = Counter(), Counter()
    for r in rows:
        if not held(r[0]):
            own = ids(r[1])
            counts.update(zip(own, own[1:], strict=False))
            contexts.update(own[:-1])
    found, tables = {}, [Counter() for _ in samples]
    for r in ranges.collect():
        codes, c = pitman_yor.from_gaps(r["codes"], r["n"]), pitman_yor.unpacked(r["counts"], r["n"], 4).astype(np.int64)
        u, w = m.pairs.of(codes)
        found |= {(int(a), int(b)): int(k) for a, b, k in zip(u, w, c, strict=True) if k}
        for t, (sweep, before, above, *_) in zip(tables, samples, strict=True):
            drawn = pitman_yor._draw(m, u[c > 0], w[c > 0], c[c > 0], before, above, np.random.default_rng([pitman_yor.SEED, sweep, r["part"], 7]), pitman_yor.stirling(m.d))
            t.update({(int(a), int(b)): int(k) for a, b, k in zip(u[c > 0], w[c > 0], drawn, strict=True)})
    assert found == dict(counts) and all(m.customers[u] == n for u, n in contexts.items())

    def after(u, w):
        return sum((counts[u, w] - m.d * t[u, w] + (1 + m.d * per[u]) * parent[w]) / (1 + contexts[u]) for t, (*_, per, parent) in zip(tables, samples, strict=True)) / len(samples)

    for u in (K + 1, 0, K, K // 2):
        assert math.isclose(sum(after(u, w) for w in range(K + 1)), 1, rel_tol=1e-6)
    mass = 1 - sum(10 ** log_p[h][0] for h in frequent)
    for r in rows:
        own = ids(r[1])
        want = sum(math.log10(after(u, w)) for u, w in zip(own, own[1:], strict=False))
        want += sum(log_p.get(signed(w), (model.log_unknown,))[0] - math.log10(mass) for w in tokens(r[1]) if signed(w) not in place)
        assert all(abs(g[0] - want) < 0.001 * len(own) for g in got[r[0]])


def test_log_gamma():
    x = np.concatenate([np.linspace(1e-9, 20, 500), [1e3, 1e7, 1e12]])
    want = np.array([math.lgamma(v) for v in x])
    assert np.all(np.abs(pitman_yor.log_gamma(x) - want) < 1e-9 * (1 + np.abs(want)))


def test_many_customers_sit_as_the_restaurant_says():
    """Metropolis steps, many of them, against the Stirling numbers, for as many customers as these are known for."""
    d, rng = 0.6, np.random.default_rng(3)
    for new in (0.05, 3.0, 40.0):
        log_s = pitman_yor.stirling(d, 200)[200, 1:] + np.arange(1, 201) * math.log(new)
        want = np.exp(log_s - log_s.max())
        want /= want.sum()
        drawn = pitman_yor._metropolis(np.full(4000, 200), np.full(4000, math.log(new)), d, rng, ((math.inf, 60),))
        mean, spread = (want * np.arange(1, 201)).sum(), math.sqrt((want * (np.arange(1, 201) - (want * np.arange(1, 201)).sum()) ** 2).sum())
        assert abs(drawn.mean() - mean) < 0.2 * spread + 0.02 and abs(drawn.std() - spread) < 0.25 * spread + 0.05


def test_pitman_yor_sums_to_one(docs):
    words = common.materialize(pitman_yor.count_words(docs.select(common.as_bytes().alias("data"))), "test-words")
    model, dishes, _ = pitman_yor.fit(words)
    assert math.isclose(dishes.agg(F.sum(F.pow(F.lit(10.0), F.col("log_p")))).first()[0] + 10**model.log_unknown, 1, rel_tol=1e-4)


def test_table_counts_follow_the_restaurant():
    """Sampled table counts against seating customers one by one, where one dish has all of them."""
    d, rng = 0.5, np.random.default_rng(1)
    counts = np.full(20_000, 6)
    drawn = pitman_yor.draw_tables(counts, np.full(20_000, math.log(1.0)), d, rng, pitman_yor.stirling(d))
    s = np.exp(pitman_yor.stirling(d)[6, 1:7])
    assert np.abs(np.bincount(drawn, minlength=7)[1:] / 20_000 - s / s.sum()).max() < 0.02


# 7


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "<p>same</p>"), (2, "http://b/2", "<p>same</p>"), (3, "http://c/3\r\nX: y", "ünï"), (4, None, None), (5, "http://e/5", None), (None, "http://f/6", "<p>same</p>"), (7, "u", "line\r\n\r\nline"), (2, "http://b/2", "<p>same</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = common.shared_path(spark, "test-warc")
    index = warc.write(df, folder)
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.read(index, folder).collect()}
    for page_id, _, html in pages:
        data = (html or "").encode()
        r = got[page_id, len(data)]
        assert r["payload_digest"] == warc.digest_of(data)
        revisit = {2: 1, 5: 4, None: 1}.get(page_id)
        assert (r["record_type"], r["refers_to"]) == (("revisit", revisit) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else data)
    some = index.where("page_id in (1, 7)")
    assert sorted(r["page_id"] for r in warc.read(some, folder).collect()) == [1, 7]
    one = index.first()
    with open(one["file"] if one["file"].startswith("/") else one["file"].removeprefix("file:"), "rb") as file:
        assert gzip.decompress(file.read()).startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(df.limit(0)).count() == 0
    assert warc.round_trip(df, least_bytes=100).where("record_type = 'response'").count() == len(pages)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_warc_one_response_for_a_payload(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    long = "é" * 3_000_000
    rows = [(1, "u", "x", "p")] * 5 + [(2, "v", "x", "q"), (1, "a", "x", "r"), (9, "w", None, ""), (9, "w", None, ""), (None, None, "", ""), (3, "long", long, ""), (4, "long", long, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(4)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["payload_digest"]].append(r)
    assert sorted(len(v) for v in by.values()) == [2, 3, 7]
    for data, first in ((b"x", 1), (b"", 9), (long.encode(), 3)):
        own = by[warc.digest_of(data)]
        assert [(r["page_id"], r["refers_to"], r["payload_bytes"]) for r in own if r["record_type"] == "response"] == [(first, None, len(data))]
        assert all(r["refers_to"] == first and r["payload_bytes"] == len(data) for r in own if r["record_type"] == "revisit")
    folder = common.shared_path(spark, "test-warc")
    files = {r["file"] for r in warc.write(df, folder).collect()}
    data = b"".join(gzip.decompress(open(f, "rb").read()) for f in files)
    ids = [x for x in data.split(b"\r\n") if x.startswith(b"WARC-Record-ID: ")]
    refers = {x.removeprefix(b"WARC-Refers-To: ") for x in data.split(b"\r\n") if x.startswith(b"WARC-Refers-To: ")}
    assert len(ids) == len(set(ids)) == len(rows) and refers <= {x.removeprefix(b"WARC-Record-ID: ") for x in ids}


def test_reads_coalesce():
    assert [(a, b) for a, b, _ in warc.reads([(0, 10), (12, 5), (100, 10), (17, 3)], gap=5, most=1000)] == [(0, 20), (100, 110)]
    assert len(warc.reads([(0, 10), (10, 10), (20, 10)], gap=5, most=20)) == 2


# 8


def test_html_words_of_classes_drop_no_line_of_the_article():
    body = "<article><h1>T</h1><p class='comment'>one <span class='share'>share-price</span></p><section class='related-work'><p>two</section><div class='comments'><p>three</div></article>"
    assert html_extract.Page(page(body)).text([]) == "T\none share-price\ntwo"


@pytest.mark.parametrize("unit", ["<p title=\"x>a", "<div>a", "<ul><li>a", "<a ", "</td>", "<header>a", "<p x='", "<!-", "<td>a"])
def test_html_takes_time_in_proportion_to_the_page(unit):
    import time

    def seconds(n):
        began = time.process_time()
        html_extract.Page(unit * n).text(["div>div"])
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 12 * max(0.02, min(seconds(8_000), seconds(8_000)))


@pytest.mark.parametrize("limit", [0, 300_000])
def test_html_every_template_of_a_host_counts(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_PATHS", limit)
    rows = [(10 * t + i, "http://h/x", f"<body><div class='menu'>m m m m</div><div class='t{'abcdefgh'[t]}'><p>text {i} of template</div><div class='x'><p>{'noise ' * (0 if i else 3)}</div></body>", "extra") for t in range(8) for i in range(4)]
    rows += rows[:1]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    paths = html_extract.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).first()["paths"]
    assert len(paths) >= 8 and {p for p in paths if ".t" in p} == {f"div.t{c}" for c in "abcdefgh"}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page(body):
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></ul></nav>{body}<footer>foot &copy;</footer></body></html>"


def test_html_extraction(spark):
    article = "<article class='post-12'><h1>Head &amp; line</h1><div class='share-bar'>Share</div><p>First <b>bold</b>,\n para<br>graph with enough words to count.<p>Second &lt;p&gt; one, unclosed with more words here<ul><li>item one<li>item two</ul><script>var x='<p>no</p>';</script><form><p>mail</p></form></article>"
    want = "Head & line\nFirst bold, para graph with enough words to count.\nSecond <p> one, unclosed with more words here\nitem one\nitem two"
    made = [(i, f"http://h.example/{i}", page(article + "<aside>side bar text that goes on</aside><div class='ad'>buy</div><section id='comments'><p>I disagree with all of this at length</p></section>")) for i in range(6)]
    made += [(10, "http://h.example/x", page("<div class='story'><p>No article here but a story that is long enough.</p></div>")), (11, None, None), (12, "http://e.example/", ""), (13, "http://e.example/2", "just text &eacute;"), (14, "http://t.example/", "<html><body><article><h1>Cut</h1><p><b>Bold.<br><p>rest of it")]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert all(got[i] == want for i in range(6))
    assert got[10] == "No article here but a story that is long enough."
    assert got[11] == got[12] == "" and got[13] == "just text é" and got[14] == "Cut\nBold.\nrest of it"
    assert html_extract.extract(df.limit(0)).count() == 0


LEAD, BODY = "A lead that stands before the body.", " ".join(f"Sentence {k} of the body goes on for some more words." for k in range(20))


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>Title</h1><p>{}</p><div class='entry-content'><p>{}</p></div></article>",
        "<div class='wrap'><h1>Title</h1><p>{}</p><div class='entry-content'><p>{}</p></div></div>",
        "<div><h1>Title</h1><p>{}</p></div><div><div><p>{}</p></div></div>",
    ],
)
def test_html_title_and_lead_outside_the_body_container(body):
    assert html_extract.Page(page(body.format(LEAD, BODY))).text([]) == f"Title\n{LEAD}\n{BODY}"


def test_html_votes_drop_no_lead(spark):
    bare = page(f"<article><div class='entry-content'><p>{BODY}</p></div></article>")
    whole = page(f"<article><h1>Title</h1><p>{LEAD}</p><div class='entry-content'><p>{BODY}</p></div></article>")
    parts = page(f"<div class='post'><article class='one'><p>{BODY}</p></article><article class='two'><p>{LEAD}</p></article></div>")
    df = spark.createDataFrame([(i, f"http://h.example/{i}", bare) for i in range(5)] + [(5, "http://h.example/5", whole), (6, "http://h.example/6", parts)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {**dict.fromkeys(range(5), BODY), 5: f"Title\n{LEAD}\n{BODY}", 6: f"{BODY}\n{LEAD}"}


@pytest.mark.parametrize(
    "body",
    [
        "<div class='layout no-sidebar'><h1>Title</h1><p>{}</p><p>{}</p></div>",
        "<div id='page' class='has-sidebar'><article><h1>Title</h1><p>{}</p><p>{}</p></article><div class='sidebar'><p>Other words</p></div></div>",
        "<div class='page-sidebar-right'><article><h1>Title</h1><p>{}</p><p>{}</p></article><div class='sidebar'><p>Other words</p></div></div>",
        "<div class='notice-board'><h1>Title</h1><p>{}</p><p>{}</p></div>",
        "<article><h1>Title</h1><section id='related-work'><p>{}</p></section><p>{}</p></article>",
        "<article><h1>Title</h1><p>{}</p><noscript><p>{}</p></noscript></article>",
        "<article><h1>Title</h1><dialog><p>{}</p></dialog><object><p>{}</p></object></article>",
        "<article><h1>Title</h1><p>{}</p><p>{}</p></article><div id='comments'><article><p>No.</p></article></div><div class='ad'>" + 9 * "Buy this and more of it. " + "</div>",
        "<h1>Title</h1><p>{}</p><p>{}</p><div id='comments'>" + 99 * "<p>I disagree with all of this at length</p>" + "</div>",
    ],
)
def test_html_marks_around_the_article_do_not_drop_it(body):
    assert html_extract.Page(page(body.format(LEAD, BODY))).text([]) == f"Title\n{LEAD}\n{BODY}"


def test_html_keeps_formulas():
    assert html_extract.Page(page(f"<article><p>{BODY} <math><mi>x</mi></math></p></article>")).text([]) == f"{BODY} x"


# 9


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.read_pieces(tokenizer("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_count.MARK, prepend_scheme="always", split=True)
    got = by_id(token_count.count_tokens(docs, tokenizer("piece_bpe_32k.model")), "n_tokens")
    for r in rows:
        assert set(got[r[0]]) == {(len(t.encode(r[1] or "").ids),)}
    assert token_count.count_tokens(empty, tokenizer("piece_bpe_32k.model")).count() == 0


@given(st.text("abc ▁é", max_size=30))
@settings(max_examples=200, deadline=None)
def test_ties_fall_as_in_the_tokenizer(text):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -3.0), ("▁a", -2.0), ("abc", -4.0), ("aa", -1.0), *((f"<0x{i:02X}>", -9.0) for i in range(256))]
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    assert token_count.Counter(vocabulary).of(text)[0] == len(t.encode(text).ids)


# 10


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode().translate(None, b" \t\n\x0b\x0c\r")].append((-len(r[1] or ""), math.inf if r[0] is None else r[0]))
    out = []
    for text, own in groups.items():
        best = min(own)
        for k, (_, d) in enumerate(sorted(own)):
            out.append((None if d == math.inf else d, None if best[1] == math.inf else best[1], len(own), k == 0, hashlib.sha256(text).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: bytes([len(c) % 2])])
def test_exact_dedup(docs, rows, empty, digest):
    got = exact_dedup.exact_groups(docs, digest)
    key = lambda t: tuple(map(str, t))
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=key) == sorted(brute_groups(rows), key=key)
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[3] for x in brute_groups(rows))


@given(st.binary(max_size=200), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_cuts_cover(head, seed):
    data = head + np.random.default_rng(seed).integers(0, 256, 100_000, np.uint8).tobytes()
    ends = exact_dedup.cuts(data)
    assert ends == sorted(set(ends)) and ends[-1] == len(data) and max(np.diff([0, *ends])) <= exact_dedup.MOST
    assert set(e - len(head) for e in ends[-10:]) & set(exact_dedup.cuts(data[len(head) :]))


def test_shared_folder_is_the_sessions(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.shared_root(spark) == (named.rstrip("/") if named else common.shared_root(spark))


# pipeline


def plain_log_perplexities(texts):
    """-log10 of each text under a modified Kneser-Ney model of all of them, over 4-grams of UTF-16 units held in dictionaries, and the units scored."""
    grams = []
    for text in texts:
        symbols = [0, 0, 0, *np.frombuffer(text.encode("utf-16-le"), "<u2").tolist(), 0]
        grams.append([tuple(symbols[i : i + 4]) for i in range(len(symbols) - 3)])
    levels = {4: Counter(g for own in grams for g in own)}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p = {(): 2.0**-16}
    for k in (1, 2, 3, 4):
        of = Counter(levels[k].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else None
        d = {c: 0.5 if y is None or not of[c] else min(max(c - (c + 1) * y * of[c + 1] / of[c], 0), c - 0.01) for c in (1, 2, 3)}
        total, spare = Counter(), defaultdict(float)
        for g, n in levels[k].items():
            total[g[:-1]] += n
            spare[g[:-1]] += d[min(n, 3)]
        p.update({g: (max(n - d[min(n, 3)], 0) + spare[g[:-1]] * p[g[1:]]) / total[g[:-1]] for g, n in levels[k].items()})
    return [(-sum(math.log10(p[g]) for g in own), len(own)) for own in grams]


def plainly_good(rows):
    by, out = defaultdict(list), []
    for r in rows:
        by[r[2]].append(r)
    middle = lambda values: sorted(values)[(len(values) + 1) // 2 - 1]
    for own in by.values():
        counted = [brute_statistics(r[1]) for r in own]
        logs = plain_log_perplexities([r[1] or "" for r in own])
        ok = [w[0] >= 10 and 100 * w[4] <= 20 * w[0] for w in counted]
        for below, above, values in ((3.0, 5.0, [x / max(1, w[0]) for (x, _), w in zip(logs, counted, strict=True)]), (3.5, 6.0, [x / n for x, n in logs])):
            binned = [math.floor(x * 1000 + 0.5) / 1000 for x in values]
            centre = middle(binned)
            spread = max(0.01, 1.4826 * middle([abs(x - centre) for x in binned]))
            widths = [spread * math.sqrt(1 + 800 / n) for _, n in logs]
            ok = [good and -below * w <= x - centre <= above * w for good, x, w in zip(ok, values, widths, strict=True)]
        out.extend(r for r, good in zip(own, ok, strict=True) if good)
    return out


def test_verdict_of_quality_against_plain_python(docs, rows):
    kept = sorted(str(r["doc_id"]) for r in quality.judge(docs).where("kept").collect())
    assert kept == sorted(str(r[0]) for r in plainly_good(rows))


def test_pipeline_against_plain_python(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    odd = [(1000, " ".join("".join(rng.choice("abab") for _ in range(12)) for _ in range(400)), "en", "hot", 0, 1, "", "", "")]
    given_rows = rows + odd
    spark.createDataFrame(given_rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    good = plainly_good(given_rows)
    groups = defaultdict(list)
    for r in good:
        groups["".join(r[1].split())].append(r)
    single = [min(own, key=lambda r: (-len(r[1]), r[0])) for own in groups.values()]
    left = [r for r, (i, _, component) in zip(single, brute_components(single, 5, 80), strict=True) if i == component]
    base = [r for r in given_rows if (w := brute_statistics(r[1]))[0] >= 10 and 100 * w[4] <= 20 * w[0]]
    assert len(given_rows) > len(base) > len(good) > len(single) > len(left) > 20  # every stage has work
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in left:
        sizes[r[3]] += len(r[1].split())
        largest[r[3]] = max(largest[r[3]], len(r[1].split()))
    names = [*sorted(s for s in sizes if s is not None), None]
    targets = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    texts_ = {r[0]: r for r in left}
    assert set(pieces) <= set(texts_)
    for i, (_, text, _, source, *_) in texts_.items():
        copies = sum(start == 0 for start, _ in pieces[i])
        share = targets[source] / sizes[source]
        assert math.floor(share + 1e-9) <= copies <= math.ceil(share - 1e-9)
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert sorted(pieces[i]) == sorted((k, ids[k : k + packing.LENGTH]) for k in range(0, len(ids), packing.LENGTH) for _ in range(copies))
        taken[source] += copies * len(text.split())
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in names)
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)]).tolist()
        assert [at for at, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= packing.LENGTH


@pytest.mark.parametrize("limit", [0, 10_000])
def test_targets_of_any_number_of_sources(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    rng = random.Random(limit * 0 + 5)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice([None, "", "é", "z", "\U0001f600", "￿", *[f"s{k}" for k in range(40)]])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    targets = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    got = mixing.mix(df).collect()
    assert len(got) == 600 and all(r["target"] == targets[r["source"]] and r["source_size"] == sizes[r["source"]] for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 40 for s in names)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 3])
def test_ngram_join_with_some_or_no_common_tokens(docs, rows, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.similar_components(docs).select("doc_id", "component_id").collect()}
    assert got == {(i, c) for i, _, c in brute_components(rows, 3, 90)}
