"""Scoring texts with a hierarchical Pitman-Yor model.

Restaurants, from the base up: bytes without context, bytes after one byte, bytes after two bytes (each context's parent
drops its first byte; marks stand for a word's begin and end); words without context, whose base is the spelling under the byte
restaurants; and words after a word, whose parent is the restaurant without context. The end of a text is the empty word; the context of
a text's first word is its own. A restaurant's tables are its parent's customers. A dish's table count is drawn from its
Chinese-restaurant conditional given the parent, by Gibbs steps: up to EXACT customers straight from generalised Stirling numbers, beyond by
Metropolis steps with the same target, whose proposals seat a restaurant exactly, from one new table to the next. Predictive
probabilities are averaged over the samples after the burn-in.

All words of training are dishes and contexts of their own after a word. Words that training did not have are one there, RARE, and one event, as in
the base score: a new table whose spelling is no known word's. With a lower HEAVY, words rarer than the HEAVY most frequent ones are RARE too, and
told apart by the restaurant without context.

Counting and scoring cover all texts. Texts are cut into batches of about BATCH_TOKENS tokens. Words are dealt into blocks by their hashes; a batch sends its
distinct words to their blocks, which answer with numbers and counts. Then it sends its distinct pairs, sorted and as gaps, to ranges, one for each block of contexts with
each block of words; a range adds up the batches' counts, samples its pairs, and answers each batch with its pairs' probabilities in their order. So a pair is
shuffled once for each batch that has it, in a few bytes, and texts are not shuffled. Numbers of all contexts and words are kept by block, and a range gets those
that it needs: no process holds all of them. The driver holds the byte restaurants and how many words have each count. Files and shuffles that nothing reads any
more are deleted on the way. Random numbers follow from the ranges of pairs, the blocks and the buckets of words, so reruns agree.

Defined cases: a null text is empty and has the end only; a null doc_id is taken for the empty name when the rows held out
are chosen; rows that repeat count each; a very long text is scored as a whole, in a batch of its own size; an empty table gives an empty
result; other columns are not read, whatever their names. Words meet by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, forget, lean, materialize, release

MARK = 256
SYMBOLS = 257
EXACT = 256
#: Metropolis steps where so many tables are likely at most: few where there are many, as proposals are nearly right there.
METROPOLIS = ((50, 5), (500, 2), (math.inf, 1))
#: Words, the most frequent ones, with contexts and dishes of their own after a word: all, unless it is set lower.
HEAVY = 1 << 31
MEMO = 200_000
SWEEPS, BURN_IN, DRAWS, SEED = 3, 1, 1, 11
#: Sweeps of the restaurants after a word, of which the first BURN_IN_PAIRS are not kept.
SWEEPS_PAIRS, BURN_IN_PAIRS = 2, 0
STRENGTH = 1.0
FOLDS, HELD_OUT = 7, 2
#: Tokens of a batch, tokens whose pairs are a range, and words of a bucket, about.
BATCH_TOKENS, RANGE_TOKENS, BUCKET_WORDS = 2_000_000, 4_000_000, 50_000
#: Words with more than EXACT customers go into buckets of their own, so many: their many tables take long, however few such words there are.
CROWDED_WORDS = 6_000
#: Steps of the answers, in log10 of probability.
STEP = 1 / 2048


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers: [c, t] for t tables of c customers with discount d."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            t = np.arange(1, most + 1)
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300))
            stay[t > c] = -np.inf
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def draw_tables(c: np.ndarray, log_new: np.ndarray, d: float, rng: np.random.Generator, table: np.ndarray, tiers: tuple | None = None) -> np.ndarray:
    """A table count for each dish with c customers, where a new table weighs exp(log_new)."""
    t = np.minimum(c, 1).astype(np.int64)
    for n in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        own = np.flatnonzero(c == n)
        k = np.arange(1, n + 1)
        for part in np.array_split(own, max(1, len(own) * n // 4_000_000)):
            w = table[n, 1 : n + 1] + k * log_new[part, None]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            t[part] = 1 + (w < rng.random(len(part))[:, None] * w[:, -1:]).sum(1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        t[many] = _metropolis(c[many], log_new[many], d, rng, tiers or METROPOLIS)
    return t


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, to about 1e-10: Stirling's series from 8 on, by recurrence below."""
    x, less = np.asarray(x, float), np.zeros(np.shape(x))
    for _ in range(8):
        low = x < 8
        less += np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - less


def _seated(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers seated one by one with discount d and strength a: from each new table to the next, the wait is beta-geometric."""
    at, tables = np.ones(len(c)), np.ones(len(c), np.int64)
    todo = np.arange(len(c))
    while len(todo):
        own = tables[todo]
        share = rng.beta(np.maximum(a[todo] + d * own, 1e-12), np.maximum(at[todo] - d * own, 1e-9))
        wait = np.minimum(rng.geometric(np.clip(share, 1e-15, 1.0)).astype(float), 1e15)
        at[todo] += wait
        todo = todo[at[todo] <= c[todo]]
        tables[todo] += 1
    return tables


def _strength(c: np.ndarray, new: np.ndarray, d: float) -> np.ndarray:
    """The strength a that, with d times the mean number of tables of c customers seated with it, makes new."""
    low, high = np.full(len(c), -d + 1e-9), np.maximum(new, 1e-6)
    for _ in range(40):
        a = (low + high) / 2
        above = log_gamma(a + 1) - log_gamma(a + d) + log_gamma(a + d + c) - log_gamma(a + c) > np.log(new)
        low, high = np.where(above, low, a), np.where(above, a, high)
    return (low + high) / 2


def _metropolis(c: np.ndarray, log_new: np.ndarray, d: float, rng: np.random.Generator, tiers: tuple) -> np.ndarray:
    """Tables where t of them weigh S(c, t) exp(t log_new), S the generalised Stirling numbers.

    Proposals weigh S(c, t) times the product of a + k d for k below t, so in the ratio of the two S drops out. a makes the two most alike where most
    proposals are.
    """
    new = np.exp(np.clip(log_new, -50, 50))
    a = _strength(c, new, d)
    t, done = np.zeros(len(c), np.int64), np.zeros(len(c), np.bool_)
    for most, steps in tiers:
        own = np.flatnonzero(~done & ((new - a) / d <= most))
        done[own] = True
        if len(own):
            t[own] = _steps(c[own], a[own], new[own], d, steps, rng)
    return t


def _steps(c: np.ndarray, a: np.ndarray, new: np.ndarray, d: float, steps: int, rng: np.random.Generator) -> np.ndarray:
    log_w = lambda t: t * (np.log(new) - math.log(d)) - log_gamma(a / d + t)
    t = _seated(c, a, d, rng)
    w = log_w(t)
    for _ in range(steps):
        other = _seated(c, a, d, rng)
        v = log_w(other)
        take = np.log(np.maximum(rng.random(len(c)), 1e-300)) < v - w
        t, w = np.where(take, other, t), np.where(take, v, w)
    return t


def discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05


@dataclass
class Spelling:
    """Averaged predictive probabilities of a byte or mark after two, one or no symbols."""

    one: np.ndarray  # [previous, symbol]
    row: np.ndarray  # of the context of two, or -1
    two: np.ndarray  # [row, symbol]

    @staticmethod
    def uniform() -> Spelling:
        return Spelling(np.full((SYMBOLS, SYMBOLS), 1 / SYMBOLS, np.float32), np.full(SYMBOLS * SYMBOLS, -1, np.int32), np.zeros((0, SYMBOLS), np.float32))

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        symbols, starts, before, earlier = _spelled(words)
        rows = self.row[earlier * SYMBOLS + before]
        p = np.where(rows >= 0, self.two[rows, symbols] if len(self.two) else 0.0, self.one[before, symbols])
        return np.add.reduceat(np.log10(p.astype(np.float64)), starts)


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words, each with an end; where the words start; the symbol before each and the one before that."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    symbols = np.full(int(ends[-1]), MARK, np.int64)
    inside = np.ones(len(symbols), np.bool_)
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8)
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[starts] = MARK
    earlier = np.empty_like(symbols)
    earlier[1:] = before[:-1]
    earlier[starts] = MARK
    return symbols, starts, before, earlier


class ByteRestaurants:
    """The three levels of bytes, resampled from the customers that the words' tables send."""

    def __init__(self) -> None:
        self.totals = [np.zeros(1), np.zeros(SYMBOLS), np.zeros(SYMBOLS * SYMBOLS)]
        self.p = [np.full(SYMBOLS, 1 / SYMBOLS), np.full((SYMBOLS, SYMBOLS), 1 / SYMBOLS)]

    def sweep(self, code: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Spelling:
        """code: (earlier, before, symbol) as one number; n: its customers."""
        if not len(code):
            return Spelling.uniform()
        levels = [(code % SYMBOLS, n), (code % SYMBOLS**2, n), (code, n)]
        kept: list = [None] * 3
        for k in (2, 1, 0):
            code_k, n_k = levels[k]
            d = discount(float((n_k == 1).sum()), float((n_k == 2).sum()))
            context, symbol = code_k // SYMBOLS, code_k % SYMBOLS
            parent = np.full(len(code_k), 1 / SYMBOLS) if k == 0 else self.p[0][symbol] if k == 1 else self.p[1][context % SYMBOLS, symbol]
            new = np.log((STRENGTH + d * self.totals[k][context]) * parent)
            t = draw_tables(n_k, new, d, rng, stirling(d))
            self.totals[k] = np.bincount(context, t, minlength=SYMBOLS**k)
            kept[k] = (context, symbol, n_k, t, d)
            if k:
                up, where = np.unique(code_k % SYMBOLS**k, return_inverse=True)
                levels[k - 1] = (up, np.bincount(where, t).astype(np.int64))
        for k in (0, 1, 2):
            context, symbol, n_k, t, d = kept[k]
            seen, row = np.unique(context, return_inverse=True)
            customers = np.bincount(row, n_k)
            below = np.full((1, SYMBOLS), 1 / SYMBOLS) if k == 0 else self.p[0][None, :] if k == 1 else self.p[1][seen % SYMBOLS]
            p = (STRENGTH + d * self.totals[k][seen])[:, None] * below
            p[row, symbol] += n_k - d * t
            p /= (STRENGTH + customers)[:, None]
            if k == 0:
                self.p[0] = p[0]
            elif k == 1:
                self.p[1] = np.repeat(self.p[0][None, :], SYMBOLS, 0)
                self.p[1][seen] = p
            else:
                rows = np.full(SYMBOLS * SYMBOLS, -1, np.int32)
                rows[seen] = np.arange(len(seen))
                return Spelling(self.p[1].astype(np.float32), rows, p.astype(np.float32))
        raise AssertionError


def average(models: list[Spelling]) -> Spelling:
    """All samples come from the same words, so they have the same contexts."""
    return Spelling(sum(m.one for m in models) / len(models), models[0].row, sum(m.two for m in models) / len(models))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def count_words(data: DataFrame) -> DataFrame:
    """word, n over a column of bytes; the end of each text is the empty word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
            counts[b""] += batch.num_rows
            if len(counts) > 2 * MEMO:
                yield batch_of(schema, [list(counts.keys()), list(counts.values())])
                counts.clear()
        yield batch_of(schema, [list(counts.keys()), list(counts.values())])

    return data.mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class WordModel:
    """The word restaurant, but for its dishes, and the spelling below it."""

    tokens: int
    kinds: int
    d: float
    tables: float
    spelling: Spelling
    log_unknown: float = 0.0

    @property
    def new(self) -> float:
        return STRENGTH + self.d * self.tables

    @property
    def whole(self) -> float:
        return STRENGTH + self.tokens


def in_buckets(vocabulary: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """bucket, words, n: the vocabulary (word, n) dealt into buckets by a hash, crowded words apart, in order of the words. sizes: counts and how many words have each."""
    parts = [max(1, -(-sum(k for n, k in sizes if (n > EXACT) == crowded) // words)) for crowded, words in ((False, BUCKET_WORDS), (True, CROWDED_WORDS))]
    h = F.xxhash64("word")
    bucket = F.when(F.col("n") > EXACT, -1 - F.pmod(h, F.lit(parts[1]))).otherwise(F.pmod(h, F.lit(parts[0])))
    dealt = vocabulary.groupBy((bucket + parts[1]).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("x"))
    return materialize(dealt.select("bucket", F.transform("x", lambda x: x["word"]).alias("words"), F.transform("x", lambda x: x["n"]).alias("n")), "buckets")


def _of_bucket(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    for bucket, words, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
        yield bucket, words.as_py(), np.asarray(n.values.to_numpy(zero_copy_only=False), np.int64)


def fit(vocabulary: DataFrame, *, seed: int = SEED) -> tuple[WordModel, DataFrame, int]:
    """The model without context, the dishes (hash, n, log_p, spelled) and the least count of a heavy word. vocabulary: word, n."""
    spark = vocabulary.sparkSession
    sizes = sorted((r["n"], r["kinds"]) for r in vocabulary.groupBy("n").agg(F.count("*").alias("kinds")).collect())
    tokens, kinds = sum(n * k for n, k in sizes), sum(k for _, k in sizes)
    by = dict(sizes)
    d = discount(by.get(1, 0), by.get(2, 0))
    least, held = (sizes[-1][0] + 1 if sizes else 1), 0
    for n, k in reversed(sizes):
        held += k
        if held > HEAVY:
            break
        least = n
    buckets = in_buckets(vocabulary, sizes)
    model = WordModel(tokens, kinds, d, float(kinds), Spelling.uniform())
    restaurants, samples, tables = ByteRestaurants(), [], []
    cells = pa.schema([("code", pa.int64()), ("n", pa.int64())])
    for sweep in range(SWEEPS):
        shipped = spark.sparkContext.broadcast(model)

        def sample(batches: Iterator[pa.RecordBatch], shipped=shipped, sweep=sweep) -> Iterator[pa.RecordBatch]:
            m, log_s = shipped.value, stirling(shipped.value.d)
            for batch in batches:
                for bucket, words, n in _of_bucket(batch):
                    rng = np.random.default_rng([seed, sweep, bucket])
                    t = draw_tables(n, m.spelling.log10(words) * math.log(10) + math.log(m.new), m.d, rng, log_s)
                    symbols, starts, before, earlier = _spelled(words)
                    each = np.repeat(t, np.diff(np.append(starts, len(symbols))))
                    code, where = np.unique((earlier * SYMBOLS + before) * SYMBOLS + symbols, return_inverse=True)
                    # A last row carries the number of tables.
                    yield batch_of(cells, [np.append(code, -1), np.append(np.bincount(where, each).astype(np.int64), t.sum())])

        found = buckets.mapInArrow(lean(sample), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        shipped.destroy()
        code, n = found["code"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(code)
        code, n = code[order], n[order]
        total = float(n[0]) if len(code) and code[0] == -1 else 0.0
        spelling = restaurants.sweep(code[code >= 0], n[code >= 0], np.random.default_rng([seed, sweep, 1 << 20]))
        model = WordModel(tokens, kinds, d, total, spelling)
        if sweep >= BURN_IN:
            samples.append(spelling)
            tables.append(total)
    model = WordModel(tokens, kinds, d, float(np.mean(tables)), average(samples))
    shipped = spark.sparkContext.broadcast(model)
    dish = pa.schema([("hash", pa.int64()), ("n", pa.int64()), ("seated", pa.float64()), ("spelled", pa.float64())])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_s = shipped.value, stirling(shipped.value.d)
        for batch in batches:
            for bucket, words, n in _of_bucket(batch):
                rng = np.random.default_rng([seed, SWEEPS, bucket])
                base = m.spelling.log10(words)
                log_new = base * math.log(10) + math.log(m.new)
                seated = np.mean([n - m.d * draw_tables(n, log_new, m.d, rng, log_s) for _ in range(DRAWS)], 0)
                yield batch_of(dish, [np.array([_hash(w) for w in words], np.uint64).view(np.int64), n, seated, 10.0**base])

    dishes = materialize(buckets.mapInArrow(lean(seat), "hash long, n long, seated double, spelled double"), "dishes")
    shipped.destroy()
    forget(buckets)
    total, known = dishes.agg(F.coalesce(F.sum(F.col("n") - F.col("seated")), F.lit(0.0)), F.coalesce(F.sum("spelled"), F.lit(0.0))).first()
    model.tables = total / d
    model.log_unknown = math.log10(model.new / model.whole * max(1e-12, 1.0 - known))
    log_p = F.log10((F.col("seated") + F.lit(model.new) * F.col("spelled")) / F.lit(model.whole))
    return model, dishes.select("hash", "n", log_p.alias("log_p"), "spelled"), least


# Words and pairs: blocks of words by their hashes, ranges of pairs by the blocks of context and word.


def _blocks_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash; blocks follow the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


@dataclass
class Pairs:
    """Numbers of pairs of contexts (a word, RARE or the start of a text) and dishes (a word or RARE); RARE comes after all words, the start after that.

    Words are numbered in the order of their hashes, block by block; a range has the pairs of a block of contexts and a block of dishes. RARE and the start are in the last block.
    """

    starts: np.ndarray  # the first word of each block, and the number of words

    @property
    def words(self) -> int:
        return int(self.starts[-1])

    @property
    def blocks(self) -> int:
        return len(self.starts) - 1

    @property
    def side(self) -> int:
        return int(np.diff(self.starts).max()) + 2

    def size(self, axis: int, block: int) -> int:
        """Contexts (axis 0) or dishes (axis 1) of a block."""
        return int(self.starts[block + 1] - self.starts[block]) + (2 - axis if block == self.blocks - 1 else 0)

    def _block(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.starts[1:], ids, "right"), self.blocks - 1)

    def numbers(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        i, j, side = self._block(context), self._block(word), np.uint64(self.side)
        part = (i * self.blocks + j).astype(np.uint64)
        return (part * side + (context - self.starts[i]).astype(np.uint64)) * side + (word - self.starts[j]).astype(np.uint64)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, u, w = self._apart(numbers)
        return self.starts[part // self.blocks] + u, self.starts[part % self.blocks] + w

    def within(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and dishes as places in their blocks."""
        return self._apart(numbers)[1:]

    def _apart(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, w = np.divmod(numbers, np.uint64(self.side))
        part, u = np.divmod(rest, np.uint64(self.side))
        return part.astype(np.int64), u.astype(np.int64), w.astype(np.int64)

    def cuts(self, numbers: np.ndarray) -> np.ndarray:
        """Where each range begins among sorted numbers, and their end."""
        edges = np.arange(self.blocks**2, dtype=np.uint64) * np.uint64(self.side**2)
        return np.append(np.searchsorted(numbers, edges), len(numbers))


def packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers of that many bytes, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    if not n:
        return np.zeros(0, f"<u{width}")
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n)


def gaps(numbers: np.ndarray) -> bytes:
    return packed(np.diff(numbers, prepend=np.zeros(1, numbers.dtype)), 8)


def from_gaps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, 8), dtype=np.uint64)


def reals(values: np.ndarray) -> bytes:
    return packed(np.ascontiguousarray(values, np.float64).view("<u8"), 8)


def from_reals(data: bytes, n: int) -> np.ndarray:
    return unpacked(data, n, 8).view(np.float64)


def bits(places: np.ndarray, size: int) -> bytes:
    """Which of so many places are there."""
    there = np.zeros(size, np.bool_)
    there[places] = True
    return packed(np.packbits(there), 1)


def from_bits(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(unpacked(data, -(-size // 8), 1), count=size).view(np.bool_)


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table[c].to_pylist() for c in names), strict=True)


KNOWN = "block int, rows long, words long, customers long, ends long, own_ends long, mass double, spelled_mass double, hashes binary, counts binary, light binary, spelled binary"


def _known(dishes: DataFrame, least: int, blocks: int) -> DataFrame:
    """KNOWN: the dishes of each block in the order of their hashes, log_p of the rare ones (light) and the spelled probabilities of the others, with sums over the others."""
    spark = dishes.sparkSession
    end = np.uint64(_hash(b""))
    schema = pa.schema([*[(c, pa.int32() if c == "block" else pa.int64()) for c in ("block", "rows", "words", "customers", "ends", "own_ends")], ("mass", pa.float64()), ("spelled_mass", pa.float64()), *[(c, pa.binary()) for c in ("hashes", "counts", "light", "spelled")]])

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = table.filter(pc.greater(table["n"], 0))
        hashes = table["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, n, log_p, spelled = hashes[order], *(table[c].to_numpy()[order] for c in ("n", "log_p", "spelled"))
        own, ends = n >= least, hashes == end
        values = [block, len(n), int(own.sum()), int(n[own].sum()), int(n[ends].sum()), int(n[ends & own].sum()), float((10.0 ** log_p[own]).sum()), float(spelled[own].sum())]
        values += [gaps(hashes), packed(n, 8), reals(log_p[~own]), reals(spelled[own])]
        return pa.Table.from_batches([batch_of(schema, [[v] for v in values])])

    block = F.shiftright(F.shiftrightunsigned("hash", 32) * F.lit(blocks), 32).cast("int").alias("block")
    # A row for each block, so that none is missing.
    each = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("log_p"), F.lit(0.0).alias("spelled"))
    return materialize(dishes.select(block, "hash", "n", "log_p", "spelled").unionByName(each).groupBy("block").applyInArrow(run, KNOWN), "known")


WORDS = "batch long, block int, docs long, n long, one binary, two binary, out binary, ids array<long>"


def _scan(source: DataFrame, blocks: int) -> DataFrame:
    """WORDS: rows of block -1 for batches: docs documents, n tokens, each one's place among the batch's words (one), the tokens of each document (two), which are held out (out), their
    ids; rows of a block for the batch's words there: n of them, as gaps of hashes (one)."""
    schema = pa.schema([("batch", pa.int64()), ("block", pa.int32()), ("docs", pa.int64()), ("n", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("out", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        number, row, n_held = TaskContext.get().partitionId() << 33, 0, 0
        ids, out, held = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            words, place = np.unique(np.concatenate(held), return_inverse=True)
            batch = number + row - len(held)
            rows = [{"batch": batch, "block": -1, "docs": len(held), "n": len(place), "one": packed(place, 4), "two": packed(lengths, 4), "out": packed(np.array(out), 1), "ids": ids}]
            cuts = np.searchsorted(_blocks_of(words, blocks), np.arange(blocks + 1)).tolist()
            rows += [{"batch": batch, "block": k, "n": b - a, "one": gaps(words[a:b])} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            if len(memo) > MEMO:
                memo.clear()
            texts = [words_of(t.as_py()) for t in batch.column(2)]
            for words in texts:
                words.append(b"")
            unseen = list(set().union(*texts) - memo.keys())
            memo.update(zip(unseen, map(_hash, unseen), strict=True))
            for id_, out_, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                ids.append(id_)
                out.append(out_)
                held.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
                row += 1
                n_held += len(words)
                if n_held >= BATCH_TOKENS:
                    yield from flush()
                    ids, out, held, n_held = [], [], [], 0
        if held:
            yield from flush()

    return materialize(source.mapInArrow(lean(run), WORDS), "words")


NAMES = "batch long, block int, n long, places binary, counts binary, n_light long, light binary"


def _named(words: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """NAMES: for the words of each batch in a block their places among those that are not RARE (their number for RARE), their counts in training, and log_p of those that are RARE and known."""
    schema = pa.schema([("batch", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("n_light", pa.int64()), ("light", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rows, own_words, data, counts, light = next(_rows(right, "rows", "words", "hashes", "counts", "light"))
            hashes, n = np.append(from_gaps(data, rows), np.uint64(0)), np.append(unpacked(counts, rows, 8).astype(np.int64), 0)
            own = n >= least
            own[-1] = False
            names = np.where(own, np.cumsum(own) - 1, own_words)
            log_p = np.full(rows + 1, np.nan)
            log_p[:-1][~own[:-1]] = from_reals(light, rows - own_words)
            for batch, block, k, one in _rows(left, "batch", "block", "n", "one"):
                h = from_gaps(one, k)
                at = np.searchsorted(hashes[:-1], h)
                at = np.where((at < rows) & (hashes[at] == h), at, rows)  # the last stands for words that training did not have
                rare = log_p[at][~own[at] & (at < rows)]
                out.append(batch_of(schema, [[batch], [block], [k], [packed(names[at], 4)], [packed(n[at], 8)], [len(rare)], [reals(rare)]]))
        return pa.Table.from_batches(out, schema)

    return words.where("block >= 0").select("batch", "block", "n", "one").groupBy("block").cogroup(known.select("block", "rows", "words", "hashes", "counts", "light").groupBy("block")).applyInArrow(run, NAMES)


BATCHES = "batch long, docs long, n long, one binary, two binary, out binary, ids array<long>, known array<long>, base array<double>, more array<double>"
SCAN = f"part int, sum_n long, gaps binary, sums binary, {BATCHES}"


def _paired(words: DataFrame, names: DataFrame, pairs: Pairs, total: float, unknown: float, rare_mass: float) -> DataFrame:
    """SCAN: rows of part -1 for batches, as in WORDS, but each token's place among the batch's pairs (one), with each document's known tokens, base score and what its RARE words add; rows of
    a part for the batch's pairs in a range: sum_n of them, as gaps, with their counts in training (sums)."""
    schema = pa.schema([("part", pa.int32()), ("sum_n", pa.int64()), ("gaps", pa.binary()), ("sums", pa.binary()), ("batch", pa.int64()), ("docs", pa.int64()), ("n", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("out", pa.binary()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("more", pa.list_(pa.float64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("block", "ascending")])
        names, counts, more = [], [], []
        for block, k, places, n, n_light, light in _rows(right, "block", "n", "places", "counts", "n_light", "light"):
            place, own = unpacked(places, k, 4).astype(np.int64), int(pairs.starts[block + 1] - pairs.starts[block])
            names.append(np.where(place < own, place + pairs.starts[block], pairs.words))
            counts.append(unpacked(n, k, 8).astype(np.int64))
            extra = np.where(place < own, 0.0, unknown - rare_mass)
            extra[(place >= own) & (counts[-1] > 0)] = from_reals(light, n_light) - rare_mass
            more.append(extra)
        name, count, extra = map(np.concatenate, (names, counts, more))
        batch, docs, n, one, two, out = next(_rows(left, "batch", "docs", "n", "one", "two", "out"))
        place, lengths = unpacked(one, n, 4).astype(np.int64), unpacked(two, docs, 4).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        base, seen = np.log10((count + 1) / total), (count > 0).astype(np.int64)
        told = [np.add.reduceat(x[place], begin) for x in (seen, base, extra)]
        word = name[place]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[begin] = pairs.words + 1
        numbers, place = np.unique(pairs.numbers(context, word), return_inverse=True)
        train = np.repeat(1 - unpacked(out, docs, 1).astype(np.float64), lengths)
        sums = np.bincount(place, train, len(numbers)).astype(np.int64)
        head = {"part": -1, "batch": batch, "docs": docs, "n": n, "one": packed(place, 4), "two": two, "out": out, "ids": left["ids"][0], "known": told[0], "base": told[1], "more": told[2]}
        rows, cuts = [], pairs.cuts(numbers).tolist()
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b > a:
                rows.append({"part": part, "batch": batch, "sum_n": b - a, "gaps": gaps(numbers[a:b]), "sums": packed(sums[a:b], 4)})
        first = pa.record_batch([pa.array([head[f.name].as_py() if f.name == "ids" else head.get(f.name)], f.type) for f in schema], schema=schema)
        return pa.Table.from_batches([first, pa.RecordBatch.from_pylist(rows, schema=schema)])

    heads = words.where("block < 0").select("batch", "docs", "n", "one", "two", "out", "ids")
    return materialize(heads.groupBy("batch").cogroup(names.groupBy("batch")).applyInArrow(run, SCAN), "scan")


RANGES = "part int, n long, codes binary, counts binary, contexts binary, words binary, batches array<long>, sizes array<long>, places array<binary>"


def _ranges(scan: DataFrame, pairs: Pairs) -> DataFrame:
    """RANGES: the pairs of each range with their counts over all batches, which contexts and words of its blocks they have, and for each batch the places of its own among them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("batch", "ascending")])
        rows = list(_rows(table, "sum_n", "gaps", "sums"))
        own = [from_gaps(one, n) for n, one, _ in rows]
        codes, place = np.unique(np.concatenate(own), return_inverse=True)
        counts = np.bincount(place, np.concatenate([unpacked(two, n, 4) for n, _, two in rows]), len(codes)).astype(np.int64)
        cuts = np.cumsum([n for n, _, _ in rows])[:-1]
        places = [packed(np.diff(p, prepend=0), 4) for p in np.split(place, cuts)]
        part = table["part"][0].as_py()
        there = [bits(x, pairs.size(axis, block)) for axis, (x, block) in enumerate(zip(pairs.within(codes), divmod(part, pairs.blocks), strict=True))]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
        values = [part, len(codes), gaps(codes), packed(counts, 4), *there, table["batch"].to_pylist(), [n for n, _, _ in rows], places]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["part", "n", "codes", "counts", "contexts", "words", "batches", "sizes", "places"])

    return materialize(scan.where("part >= 0").select("batch", "part", "sum_n", "gaps", "sums").groupBy("part").applyInArrow(run, RANGES), "ranges")


class Spread:
    """A number for each context (axis 0) or dish (axis 1) after a word, kept in Spark: block, values. Looked up on the driver, all of them are gathered; only tests do."""

    def __init__(self, pairs: Pairs, axis: int, blocks: DataFrame) -> None:
        self.pairs, self.axis, self.blocks = pairs, axis, blocks.select("block", "values")

    @cached_property
    def whole(self) -> np.ndarray:
        return np.concatenate([from_reals(bytes(r["values"]), self.pairs.size(self.axis, r["block"])) for r in sorted(self.blocks.collect())])

    def __getitem__(self, at):
        return self.whole[at]


def _beginnings(known: DataFrame, pairs: Pairs, least: int, rare: int, texts: int) -> tuple[Spread, Spread]:
    """The customers of each context, and the parent's base probability of each dish: how it is spelled, and for RARE what is left."""
    spelled = known.agg(F.sum("spelled_mass")).first()[0]
    rest = max(1e-12, 1.0 - spelled)
    schema = pa.schema([("axis", pa.int32()), ("block", pa.int32()), ("values", pa.binary())])
    end = np.uint64(_hash(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows, own, hashes, counts, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = block == pairs.blocks - 1
                n = unpacked(counts, rows, 8).astype(np.int64)
                n = np.where(from_gaps(hashes, rows) == end, 0, n)[n >= least]
                yield batch_of(schema, [[0, 1], [block, block], [reals(np.append(n, [rare, texts] if last else [])), reals(np.append(from_reals(p, own), [rest] if last else []) / (spelled + rest))]])

    made = materialize(known.select("block", "rows", "words", "hashes", "counts", "spelled").mapInArrow(lean(run), "axis int, block int, values binary"), "beginnings")
    return Spread(pairs, 0, made.where("axis = 0")), Spread(pairs, 1, made.where("axis = 1"))


GIVEN = "part int, place int, n long, values binary"


def _given(ranges: DataFrame, pairs: Pairs, spreads: list[Spread]) -> DataFrame:
    """GIVEN: the numbers of each range's contexts or words in each of spreads (place), in their order; of none that it does not have."""
    schema = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("values", pa.binary())])
    axes = [s.axis for s in spreads]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            place, block, data = next(_rows(left, "place", "block", "values"))
            size = pairs.size(axes[place], block)
            values = from_reals(data, size)
            for part, there in _rows(right, "part", "there"):
                own = values[from_bits(there, size)]
                out.append(batch_of(schema, [[part], [place], [len(own)], [reals(own)]]))
        return pa.Table.from_batches(out, schema)

    given = [s.blocks.select(F.lit(k).alias("place"), "block", "values") for k, s in enumerate(spreads)]
    needs = [F.struct(F.lit(k).alias("place"), (F.floor(F.col("part") / pairs.blocks) if s.axis == 0 else F.pmod("part", F.lit(pairs.blocks))).cast("int").alias("block"), F.col("words" if s.axis else "contexts").alias("there")) for k, s in enumerate(spreads)]
    wanted = ranges.select("part", F.explode(F.array(*needs)).alias("x")).select("part", "x.*")
    return reduce(DataFrame.unionByName, given).groupBy("place", "block").cogroup(wanted.groupBy("place", "block")).applyInArrow(run, GIVEN)


def _spread_out(given: pa.Table, pairs: Pairs, part: int, u: np.ndarray, w: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """The numbers given to a range, by their place in the block."""
    out, blocks = [], divmod(part, pairs.blocks)
    for (n, data), axis in zip(_rows(given.sort_by([("place", "ascending")]), "n", "values"), axes, strict=True):
        there = np.zeros(pairs.size(axis, blocks[axis]), np.bool_)
        there[w if axis else u] = True
        values = np.zeros(len(there))
        values[there] = from_reals(data, n)
        out.append(values)
    return out


@dataclass
class PairModel:
    """The restaurants after a word, but for their dishes: customers and tables of each context, and the parent's probabilities."""

    pairs: Pairs
    d: float
    customers: Spread | None = None
    tables: Spread | None = None
    parent: Spread | None = None


def _draw(m: PairModel, context: np.ndarray, word: np.ndarray, c: np.ndarray, tables: np.ndarray, parent: np.ndarray, rng: np.random.Generator, log_s: np.ndarray) -> np.ndarray:
    return draw_tables(c, np.log((STRENGTH + m.d * tables[context]) * parent[word]), m.d, rng, log_s)


SUMS = "axis int, block int, values binary, ones long, twos long, seen long"


def _sweep(ranges: DataFrame, m: PairModel, seed: int, sweep: int) -> DataFrame:
    """SUMS: tables of each context (axis 0) and each word (axis 1) after one draw of every pair, and how many have one, two, any. Before all sweeps, each pair has a table."""
    pairs, bare = m.pairs, PairModel(m.pairs, m.d)
    schema = pa.schema([("axis", pa.int32()), ("block", pa.int32()), ("values", pa.binary())])
    all_sums = pa.schema([*schema, ("ones", pa.int64()), ("twos", pa.int64()), ("seen", pa.int64())])

    def summed(part: int, u: np.ndarray, w: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        blocks = divmod(part, pairs.blocks)
        return batch_of(schema, [[0, 1], list(blocks), [packed(np.bincount(x, t, pairs.size(axis, blocks[axis])), 4) for axis, x in enumerate((u, w))]])

    def ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = unpacked(counts, n, 4)
                yield summed(part, *pairs.within(from_gaps(codes, n)[c > 0]), np.ones(int((c > 0).sum())))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part, n, codes, counts = next(_rows(left, "part", "n", "codes", "counts"))
        u, w = pairs.within(from_gaps(codes, n))
        tables, parent = _spread_out(right, pairs, part, u, w, [0, 1])
        c = unpacked(counts, n, 4).astype(np.int64)
        u, w, c = u[c > 0], w[c > 0], c[c > 0]
        return pa.Table.from_batches([summed(part, u, w, _draw(bare, u, w, c, tables, parent, np.random.default_rng([seed, sweep, part, 7]), stirling(bare.d)))])

    def add(table: pa.Table) -> pa.Table:
        axis, block = table["axis"][0].as_py(), table["block"][0].as_py()
        whole = np.zeros(pairs.size(axis, block), np.int64)
        for data in table["values"]:
            if data.is_valid:
                whole += unpacked(data.as_py(), len(whole), 4).astype(np.int64)
        return pa.Table.from_batches([batch_of(all_sums, [[axis], [block], [reals(whole)], [int((whole == 1).sum())], [int((whole == 2).sum())], [int((whole > 0).sum())]])])

    own = ranges.select("part", "n", "codes", "counts")
    layout = "axis int, block int, values binary"
    drawn = own.mapInArrow(lean(ones), layout) if sweep < 0 else own.groupBy("part").cogroup(_given(ranges, pairs, [m.tables, m.parent]).groupBy("part")).applyInArrow(run, layout)
    # A row for each block, so that none is missing.
    each = ranges.sparkSession.range(2 * pairs.blocks).select(F.pmod("id", F.lit(2)).cast("int").alias("axis"), F.floor(F.col("id") / 2).cast("int").alias("block"), F.lit(None).cast("binary").alias("values"))
    return materialize(drawn.unionByName(each).groupBy("axis", "block").applyInArrow(add, SUMS), "sums")


def _pair_discount(ranges: DataFrame) -> float:
    """From the pairs that occur once and twice in training."""
    schema = pa.schema([("ones", pa.int64()), ("twos", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [unpacked(counts, n, 4) for n, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch_of(schema, [[int((x == 1).sum()) for x in c], [int((x == 2).sum()) for x in c]])

    ones, twos = ranges.select("n", "counts").mapInArrow(lean(run), "ones long, twos long").agg(F.coalesce(F.sum("ones"), F.lit(0)), F.coalesce(F.sum("twos"), F.lit(0))).first()
    return discount(float(ones), float(twos))


def _parent(sums: DataFrame, base: Spread, seed: int, sweep: int) -> Spread:
    """Predictive probabilities of the restaurant without context, of words and RARE, whose customers are tables after a word."""
    pairs, customers = base.pairs, sums.where("axis = 1")
    ones, twos, seen = customers.agg(F.sum("ones"), F.sum("twos"), F.sum("seen")).first()
    d = discount(float(ones), float(twos))
    schema = pa.schema([("block", pa.int32()), ("seated", pa.binary()), ("base", pa.binary()), ("tables", pa.int64()), ("customers", pa.int64())])
    out = pa.schema([("block", pa.int32()), ("values", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, data = next(_rows(left, "block", "values"))
        size = pairs.size(1, block)
        c, own = from_reals(data, size).astype(np.int64), from_reals(right["values"][0].as_py(), size)
        new = (STRENGTH + d * seen) * np.maximum(own, 1e-300)
        words = size - (block == pairs.blocks - 1)
        t = np.zeros(size, np.int64)
        t[:words] = draw_tables(c[:words], np.log(new[:words]), d, np.random.default_rng([seed, sweep, 1 << 21, block]), stirling(d), ((50, 3), (math.inf, 1)))
        if words < size and c[-1]:  # RARE is many words: its tables, as many as hundreds of thousands, are their mean number
            mean = (new[-1:] - _strength(c[-1:], new[-1:], d)) / d
            t[-1] = int(np.clip(np.rint(mean[0]), 1, c[-1]))
        return pa.Table.from_batches([batch_of(schema, [[block], [reals(c - d * t)], [reals(own)], [int(t.sum())], [int(c.sum())]])])

    seated = materialize(customers.select("block", "values").groupBy("block").cogroup(base.blocks.groupBy("block")).applyInArrow(run, "block int, seated binary, base binary, tables long, customers long"), "seated")
    tables, total = seated.agg(F.sum("tables"), F.sum("customers")).first()

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = pairs.size(1, block)
                yield batch_of(out, [[block], [reals((from_reals(data, size) + (STRENGTH + d * tables) * from_reals(own, size)) / (total + STRENGTH))]])

    return Spread(pairs, 1, seated.select("block", "seated", "base").mapInArrow(lean(shares), "block int, values binary"))


def fit_pairs(ranges: DataFrame, pairs: Pairs, customers: Spread, base: Spread, seed: int) -> tuple[PairModel, list[tuple[int, Spread, Spread, Spread, Spread]]]:
    """The restaurants after a word, and for each sample kept what its draws were made with and what they gave: sweep, tables before, parent before, tables, parent."""
    m = PairModel(pairs, _pair_discount(ranges), customers)
    samples = []
    for sweep in range(-1, SWEEPS_PAIRS):
        sums = _sweep(ranges, m, seed, sweep)
        release(ranges.sparkSession)
        tables, parent = Spread(pairs, 0, sums.where("axis = 0")), _parent(sums, base, seed, sweep if sweep >= 0 else -1 + (1 << 10))
        if sweep >= BURN_IN_PAIRS:
            samples.append((sweep, m.tables, m.parent, tables, parent))
        m = PairModel(pairs, m.d, customers, tables, parent)
    return m, samples


ANSWER = "batch long, part int, n long, answer binary"


def _answers(ranges: DataFrame, m: PairModel, samples: list, seed: int) -> DataFrame:
    """ANSWER: -log10 probabilities of each batch's pairs in a range, in steps of STEP, averaged over the samples."""
    pairs, bare = m.pairs, PairModel(m.pairs, m.d)
    schema = pa.schema([("batch", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("answer", pa.binary())])
    spreads = list(dict.fromkeys([m.customers, *(s for _, *own in samples for s in own)]))
    axes, kept = [s.axis for s in spreads], [(sweep, *map(spreads.index, own)) for sweep, *own in samples]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part, n, codes, counts, batches, sizes, places = next(_rows(left, "part", "n", "codes", "counts", "batches", "sizes", "places"))
        c = unpacked(counts, n, 4).astype(np.int64)
        u, w = pairs.within(from_gaps(codes, n))
        given, log_s = _spread_out(right, pairs, part, u, w, axes), stirling(bare.d)
        seen, whole, p = c > 0, STRENGTH + given[0][u], np.zeros(n)
        for sweep, *own in kept:
            before, above, tables, parent = (given[k] for k in own)
            t = np.zeros(n)
            t[seen] = _draw(bare, u[seen], w[seen], c[seen], before, above, np.random.default_rng([seed, sweep, part, 7]), log_s)
            p += (c - bare.d * t + (STRENGTH + bare.d * tables[u]) * parent[w]) / whole
        steps = np.clip(np.rint(-np.log10(p / len(kept)) / STEP), 0, 65535).astype(np.int64)
        answers = [packed(steps[np.cumsum(unpacked(x, size, 4).astype(np.int64))], 2) for size, x in zip(sizes, places, strict=True)]
        return pa.Table.from_batches([batch_of(schema, [batches, [part] * len(sizes), sizes, answers])])

    own = ranges.select("part", "n", "codes", "counts", "batches", "sizes", "places")
    return own.groupBy("part").cogroup(_given(ranges, pairs, spreads).groupBy("part")).applyInArrow(run, ANSWER)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(batches: DataFrame, answers: DataFrame, tokens: int) -> DataFrame:
    """RESULT: each document with the sum of log10 probabilities of its pairs."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("part", "ascending")])
        log = np.concatenate([unpacked(a, n, 2) for n, a in _rows(right, "n", "answer")]) * -STEP
        n, docs, one, two, out = next(_rows(left, "n", "docs", "one", "two", "out"))
        place, lengths = unpacked(one, n, 4), unpacked(two, docs, 4).astype(np.int64)
        ids, known, base, more = (left[c].combine_chunks().flatten() for c in ("ids", "known", "base", "more"))
        sums = np.add.reduceat(log[place], np.cumsum(lengths) - lengths) + more.to_numpy()
        return pa.Table.from_batches([batch_of(schema, [ids, unpacked(out, docs, 1).astype(np.bool_), lengths, known, np.full(docs, tokens), base, sums])])

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, RESULT)


def score(docs: DataFrame, *, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), as_bytes().alias("data"))
    vocabulary = materialize(count_words(source.where(~F.col("held_out")).select("data")), "vocabulary")
    model, dishes, least = fit(vocabulary, seed=seed)
    forget(vocabulary)
    blocks = max(1, math.ceil(math.sqrt(model.tokens / RANGE_TOKENS)))
    known = _known(dishes, least, blocks)
    told = known.select("block", "words", "customers", "ends", "own_ends", "mass").orderBy("block").collect()
    pairs = Pairs(np.cumsum([0, *(r["words"] for r in told)]))
    texts = sum(r["ends"] for r in told)
    rare = model.tokens - sum(r["customers"] for r in told) - (0 if any(r["own_ends"] for r in told) else texts)
    # What the words are that RARE stands for: their share of its mass without context.
    rare_mass = math.log10(max(1e-300, 1.0 - sum(r["mass"] for r in told)))
    customers, base = _beginnings(known, pairs, least, rare, texts)
    words = _scan(source, blocks)
    release(spark)
    first = _paired(words, _named(words, known, least), pairs, float(model.tokens + model.kinds + 1), model.log_unknown, rare_mass)
    forget(words, known)
    release(spark)
    ranges = _ranges(first, pairs)
    batches = materialize(first.where("part < 0").select("batch", "docs", "n", "one", "two", "out", "ids", "known", "base", "more"), "batches")
    forget(first)
    release(spark)
    m, samples = fit_pairs(ranges, pairs, customers, base, seed)
    release(spark)
    answers = materialize(_answers(ranges, m, samples, seed), "answers")
    release(spark)
    return _scores(batches, answers, model.tokens)
