"""Quality rules: n-gram perplexity with lower and upper bands for each language.

Spark counts the n-grams of four characters (UTF-16 code units, as they are written) in all texts, and from them the
continuation counts of the shorter ones, their discounts and the mass of each context: a modified Kneser-Ney model for each language,
held in arrays sorted by a hash of the n-gram with a directory of its first bits. A model holds all n-grams, unless fit() is
asked for fewer: then the most frequent, and what the others would have is left to their contexts' back-off, so probabilities
sum to one and those of the n-grams held are the same however many are left out. Statistics cover all texts.

A text has two perplexities: by word and by character. Bands: the median of the language's, widened by a number of
robust deviations below and above, more for short texts; documents outside of either are rejected.

Defined cases: a null text has no words and fails the base rules; a null lang is a language of its own; rows that repeat are
counted and judged each; an empty table gives an empty result; a very long text is scored as a whole, in stretches of STRETCH
characters; other columns pass through judge() untouched, but those that have the name of a column of the result, which are left
out there; good_documents() returns all columns as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apply_copies, batch_of, lean, materialize, numbered, place_of

ORDER, UNIT_BITS = 4, 16
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Robust deviations from the median that the bands by word and by character allow below and above.
BY_WORD, BY_CHARACTER = (3.0, 5.0), (3.5, 6.0)
#: Characters of a text whose perplexity is as uncertain as languages' texts differ: bands are wider for short texts.
SHORT = 800
#: Deviation taken at least, in log10 of perplexity, where nearly all documents agree, and the width of the bins in which medians are found.
LEAST_SPREAD, BIN = 0.01, 0.001
#: Models of so many bytes are broadcast at a time; languages beyond take further passes.
BROADCAST_BYTES = 256_000_000
#: N-grams that a task gathers before it adds them up, and that are scored at a time.
GATHERED, STRETCH = 4_000_000, 1_000_000
_HASH = np.uint64(0x9E3779B97F4A7C15)
_UNIT = np.uint64(UNIT_BITS)


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << (UNIT_BITS * k)) - 1)


def units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def codes(text: str) -> np.ndarray:
    """The n-grams of a text, an end after it and blanks before, as numbers of ORDER times UNIT_BITS bits."""
    own = units(text)
    symbols = np.zeros(len(own) + ORDER, np.uint64)
    symbols[ORDER - 1 : -1] = own
    n, out = len(own) + 1, np.zeros(len(own) + 1, np.uint64)
    for k in range(ORDER):
        out = (out << _UNIT) | symbols[k : k + n]
    return out


def _source(docs: DataFrame) -> list[Column]:
    return [F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, code, n over all of docs."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed: dict = {}
        fresh: dict = {}
        held = 0

        def add_up() -> None:
            for lang, parts in fresh.items():
                old = summed.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                code, back = np.unique(np.concatenate([old[0], found]), return_inverse=True)
                summed[lang] = code, np.bincount(back, np.concatenate([old[1], n]), len(code)).astype(np.int64)
            fresh.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (code, n) in summed.items():
                for at in range(0, len(code), 100_000):
                    yield batch_of(schema, [[lang] * len(code[at : at + 100_000]), code[at : at + 100_000].view(np.int64), n[at : at + 100_000]])
            summed.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = codes(text.as_py())
                fresh.setdefault(lang, []).append(own)
                held += len(own)
                if held > GATHERED:
                    add_up()
                    held = 0
                    if sum(len(c) for c, _ in summed.values()) > GATHERED:
                        yield from told()
        add_up()
        yield from told()

    return docs.select(_source(docs)).mapInArrow(lean(run), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class HashArrays:
    """Values by key: keys sorted by hash, found through a directory of the hash's first bits."""

    hashes: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashArrays:
        h = (keys.astype(np.uint64) + np.uint64(1)) * _HASH
        order = np.argsort(h, kind="stable")
        bits = max(1, int(len(keys)).bit_length())
        starts = np.searchsorted(h[order], np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(64 - bits) if bits < 64 else np.zeros(1, np.uint64)).astype(np.int32)
        starts[-1] = len(keys)
        return HashArrays(h[order], values[order].astype(np.float32), starts, 64 - bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, NaN for keys that are not there."""
        h = (keys.astype(np.uint64) + np.uint64(1)) * _HASH
        bucket = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(keys), np.nan, np.float32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.hashes[at[todo]] == h[todo]
            hit = todo[same]
            out[hit] = self.values[at[hit]]
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


def discounts(ones: int, twos: int, threes: int, fours: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2, 3 and more, of how many n-grams occur once to four times."""
    c = [0, ones, twos, threes, fours]
    if not (c[1] and c[2]):
        return [0.5, 0.5, 0.5]
    y = c[1] / (c[1] + 2 * c[2])
    return [min(k - 0.01, max(0.0, k - (k + 1) * y * c[k + 1] / c[k])) if c[k] else 0.5 for k in (1, 2, 3)]


@dataclass
class KneserNey:
    """log10 probabilities of the n-grams of each order and log10 weights of their contexts."""

    grams: list[HashArrays]
    backoffs: list[HashArrays]
    unseen: float

    @staticmethod
    def of(shares: Sequence[tuple[np.ndarray, np.ndarray]], weights: Sequence[tuple[np.ndarray, np.ndarray]]) -> KneserNey:
        """From each order's n-grams with their discounted shares of their context, and contexts with the mass left to back off."""
        model = KneserNey([], [], -UNIT_BITS * math.log10(2))
        for k, ((code, share), (context, weight)) in enumerate(zip(shares, weights, strict=True), 1):
            model.backoffs.append(HashArrays.of(context, np.log10(np.maximum(weight, 1e-12))))
            below = 10.0 ** model.log10(code & _mask(k - 1), k - 1)
            left = 10.0 ** np.nan_to_num(model.backoffs[-1].get(code >> _UNIT), nan=0.0)
            model.grams.append(HashArrays.of(code, np.log10(np.maximum(share + left * below, 1e-12))))
        return model

    def log10(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log10 probability of the last unit of each n-gram of that order."""
        if not order:
            return np.full(len(code), self.unseen)
        out = self.grams[order - 1].get(code).astype(np.float64)
        todo = np.flatnonzero(np.isnan(out))
        more = np.zeros(len(todo))
        for k in range(order - 1, -1, -1):
            if not len(todo):
                break
            longer = code[todo] & _mask(k + 1)
            more += np.nan_to_num(self.backoffs[k].get(longer >> _UNIT), nan=0.0)
            found = self.grams[k - 1].get(longer & _mask(k)) if k else np.full(len(todo), self.unseen)
            out[todo] = found + more
            missing = np.isnan(found)
            todo, more = todo[missing], more[missing]
        return out

    @property
    def nbytes(self) -> int:
        return sum(x.hashes.nbytes + x.values.nbytes + x.starts.nbytes for x in [*self.grams, *self.backoffs])


def _arrays(df: DataFrame, value: str) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Of rows lang, code and value: for each language its codes in order and their values."""
    table = df.select("lang", "code", value).toArrow().combine_chunks()
    if not table.num_rows:
        return {}
    lang = table["lang"].combine_chunks().dictionary_encode(null_encoding="encode")
    which, code, values = lang.indices.to_numpy(), table["code"].to_numpy().view(np.uint64), table[value].to_numpy()
    order = np.lexsort((code, which))
    which, code, values = which[order], code[order], values[order]
    starts = np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(which))
    names = lang.dictionary.to_pylist()
    return {names[which[a]]: (code[a:b], values[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)}


def fit(docs: DataFrame, *, model_grams: int | None = None) -> dict[str | None, KneserNey]:
    """A model for each language, of counts over all of docs. The n-grams that models hold come to the driver: all, or model_grams of an order at most."""
    most = math.inf if model_grams is None else model_grams
    level = materialize(count_ngrams(docs), "ngrams")
    shares: list[dict] = [{}] * ORDER
    weights: list[dict] = [{}] * ORDER
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuation counts
            level = materialize(level.groupBy("lang", F.col("code").bitwiseAND(F.lit(int(_mask(k)))).alias("code")).agg(F.count("*").alias("n")), f"ngrams-{k}")
        step = F.floor(8 * F.log2("n"))
        kinds: dict = {}
        for r in level.groupBy("lang", step.alias("step")).agg(F.count("*").alias("m"), *[F.count(F.when(F.col("n") == i, 1)).alias(f"c{i}") for i in range(1, 5)]).collect():
            kinds.setdefault(r["lang"], []).append(r)
        rules = []
        for lang, found in kinds.items():
            least, held = math.inf, 0
            for r in sorted(found, key=lambda r: -r["step"]):
                held += r["m"]
                if held > most and k > 1:
                    break
                least = r["step"]
            rules.append((lang, float(least), *discounts(*[sum(r[f"c{i}"] for r in found) for i in range(1, 5)])))
        if not rules:
            return {}
        rule = level.sparkSession.createDataFrame(rules, "__lang string, least double, d1 double, d2 double, d3 double")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftrightunsigned("code", UNIT_BITS) if k > 1 else F.lit(0).cast("long")
        told = level.join(F.broadcast(rule), F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", "code", context.alias("context"), "n", F.when(step >= F.col("least"), F.col("n") - cut).alias("left"))
        sums = materialize(told.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("left").alias("held")).where("held is not null"), f"contexts-{k}")
        weights[k - 1] = _arrays(sums.select("lang", F.col("context").alias("code"), (1 - F.col("held") / F.col("total")).alias("weight")), "weight")
        of = sums.select(F.col("lang").alias("__lang"), F.col("context").alias("__context"), "total")
        held_grams = told.where("left is not null").join(of, F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("context") == F.col("__context")))
        shares[k - 1] = _arrays(held_grams.select("lang", "code", (F.col("left") / F.col("total")).alias("share")), "share")
    none = (np.zeros(0, np.uint64), np.zeros(0))
    return {lang: KneserNey.of([s.get(lang, none) for s in shares], [w.get(lang, none) for w in weights]) for lang in shares[0]}


def word_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split():
            seen.add(line)
    repeat = 0
    if n > WINDOW:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, n)
        if len(numbers) < n:  # without any repeated word no window repeats
            h = np.zeros(n - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : n - WINDOW + 1 + k] * _HASH + np.uint64(k + 1)
            order = np.argsort(h, kind="stable")
            equal = h[order][1:] == h[order][:-1]
            if equal.any():
                twice = np.zeros(len(h), np.bool_)
                twice[order[1:][equal]] = True
                twice[order[:-1][equal]] = True
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.flatnonzero(twice), 1)
                np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
                repeat = int(np.count_nonzero(np.cumsum(edge[:n])))
    return n, chars, symbols, dup, repeat


MEASURES = (*((n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("log_perplexity", T.DoubleType()), ("log_perplexity_char", T.DoubleType()), ("n_scored", T.LongType()))
#: Columns of the result of judge() besides those of docs.
RESULT = (*(n for n, _ in MEASURES), "lower_band", "upper_band", "lower_band_char", "upper_band_char", "base_failed", "kept")


def _batches_of_models(models: dict) -> list[dict]:
    out: list[dict] = [{}]
    held = 0
    for lang, model in models.items():
        if out[-1] and held + model.nbytes > BROADCAST_BYTES:
            out.append({})
            held = 0
        out[-1][lang] = model
        held += model.nbytes
    return out


def _log_probability(model: KneserNey, text: str) -> tuple[float, int]:
    """log10 probability of a whole text, its end included, and the number of units scored."""
    code = codes(text)
    return float(sum(model.log10(code[at : at + STRETCH]).sum() for at in range(0, len(code), STRETCH))), len(code)


def score(rows: DataFrame, models: dict[str | None, KneserNey]) -> DataFrame:
    """rows with MEASURES in place of their last columns, lang and text.

    log_perplexity is -log10 of the text's probability for each word, log_perplexity_char for each of the n_scored units, the end included.
    """
    sc, parts, groups = rows.sparkSession.sparkContext, [], _batches_of_models(models)
    for group in groups:
        shipped = sc.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            table = shipped.value
            for batch in batches:
                langs, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
                out = []
                for lang, text in zip(langs, texts, strict=True):
                    text = text.as_py()
                    counted = word_statistics(text)
                    log, n = _log_probability(table[lang], text) if lang in table else (0.0, 1)
                    out.append((*counted, -log / max(1, counted[0]), -log / n, n))
                columns = [pa.array([r[i] for r in out], pa.float64() if t == T.DoubleType() else pa.int64()) for i, (_, t) in enumerate(MEASURES)]
                yield pa.record_batch([*batch.columns[:-2], *columns], names=[*batch.schema.names[:-2], *(m for m, _ in MEASURES)])

        lang = F.col("__lang")
        source = rows if len(groups) == 1 else rows.where(F.coalesce(lang.isin([x for x in group if x is not None]), F.lit(None in group)))
        out = T.StructType([*rows.schema.fields[:-2], *(T.StructField(n, t) for n, t in MEASURES)])
        parts.append(source.mapInArrow(lean(run), out))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def bands(scored: DataFrame, measure: str) -> dict[str | None, tuple[float, float]]:
    """Median and robust deviation of that measure for each language, over all documents."""
    by: dict = {}
    for r in scored.groupBy("__band", F.round(F.col(measure) / BIN).cast("long").alias("bin")).count().collect():
        by.setdefault(r["__band"], []).append((r["bin"] * BIN, r["count"]))

    def middle(pairs: list[tuple[float, int]]) -> float:
        half, run = sum(c for _, c in pairs) / 2, 0
        for value, c in sorted(pairs):
            run += c
            if run >= half:
                return value
        return 0.0

    out = {}
    for lang, pairs in by.items():
        centre = middle(pairs)
        out[lang] = (centre, max(LEAST_SPREAD, 1.4826 * middle([(abs(v - centre), c) for v, c in pairs])))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _judged(docs: DataFrame, keep: Sequence[str] | None, by_word: tuple[float, float], by_character: tuple[float, float]) -> tuple[DataFrame, list[Column]]:
    plain, back = numbered(docs)
    chosen = [i for i, c in enumerate(docs.columns) if keep is None or c in keep]
    lang, text = place_of(docs, "lang").cast("string"), F.coalesce(place_of(docs, "text").cast("string"), F.lit(""))
    models = fit(plain.select(lang.alias("lang"), text.alias("text"))) or {None: KneserNey([], [], 0.0)}
    rows = plain.select(*[f"__column{i}" for i in chosen], lang.alias("__band"), lang.alias("__lang"), text.alias("__text"))
    scored = materialize(score(rows, models), "scored")  # texts are scored once, for the bands and for the verdict
    wide = F.sqrt(1 + F.lit(float(SHORT)) / F.col("n_scored"))
    ok = F.lit(True)
    for measure, suffix, (below, above) in (("log_perplexity", "", by_word), ("log_perplexity_char", "_char", by_character)):
        table = [(lang, *band) for lang, band in bands(scored, measure).items()] or [(None, 0.0, 1.0)]
        table = docs.sparkSession.createDataFrame(table, "__told string, __centre double, __spread double")
        scored = scored.join(F.broadcast(table), F.col("__band").eqNullSafe(F.col("__told")), "left")
        scored = scored.withColumn(f"lower_band{suffix}", F.col("__centre") - below * F.col("__spread") * wide).withColumn(f"upper_band{suffix}", F.col("__centre") + above * F.col("__spread") * wide).drop("__told", "__centre", "__spread")
        ok &= F.col(measure).between(F.col(f"lower_band{suffix}"), F.col(f"upper_band{suffix}"))
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ok), [back[i] for i in chosen]


def judge(docs: DataFrame, *, keep: Sequence[str] | None = None, by_word: tuple[float, float] = BY_WORD, by_character: tuple[float, float] = BY_CHARACTER) -> DataFrame:
    """The columns of docs, or those of them in keep, with RESULT: MEASURES, the language's bands, base_failed and kept."""
    judged, back = _judged(docs, keep, by_word, by_character)
    names = [c for c in docs.columns if keep is None or c in keep]
    return judged.select(*[c for c, n in zip(back, names, strict=True) if n.lower() not in RESULT], *RESULT)


def good_documents(docs: DataFrame, *, by_word: tuple[float, float] = BY_WORD, by_character: tuple[float, float] = BY_CHARACTER) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Only verdicts are written on the way, not texts; of rows equal in doc_id and text but not in lang as many stay as are kept."""
    plain, _ = numbered(docs)
    text = place_of(docs, "text")
    judged = judge(plain.select(place_of(docs, "doc_id").alias("doc_id"), place_of(docs, "lang").alias("lang"), text.alias("text"), F.xxhash64(text).alias("row_key")), keep=["doc_id", "row_key"], by_word=by_word, by_character=by_character)
    return apply_copies(docs, judged.select("doc_id", "row_key", F.col("kept").cast("int").alias("copies")))
