"""Exact self-join of documents on the Jaccard similarity of word n-grams, as components, with a token-group matrix.

1. Documents with equal sets are one class; only the classes go on.
2. Similar classes are brought together: the tokens of a set are dealt into k + 1 parts by a hash, where sets of that size
   which link differ in at most k tokens, so two linked sets agree in a whole part (and some parts are spare, for those without tokens). Tokens
   found in many documents are left out first, so a shared passage does not make neighbours. Classes that share a part, in chains,
   are a neighbourhood; every link lies within one.
3. In a neighbourhood, sets are split into groups of one smallest token. Rows of the token-group matrix hold each
   group's union of tokens; they bound the overlap of a query with any member, and only groups whose bound reaches the
   threshold are opened and compared.
4. A large neighbourhood is dealt into blocks. Each block joins its own members and sends hubs of its components on to
   wider blocks; then every set outside a neighbourhood's largest component meets all blocks. So two sets either are in
   one component already or have been compared.

Tokens are 64-bit hashes of n-grams, sets meet by 128-bit hashes.

Defined cases: a null or empty text, or one without words, has an empty set and is its own component; with fewer
words than an n-gram the whole sequence is its one token; rows that repeat are one class; a null doc_id comes after all others;
an empty table gives an empty result; a very long text is one set; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .common import Memo, apply_copies, as_bytes, batch_of, forget, give_back, held, kept, key_filter, lean, materialize, release, row_key, small
from .components import components

SIZE, PERCENT = 3, 90
#: Tokens that a block holds, about, where a set counts as LEAST at least; a neighbourhood with more has several.
BLOCK_TOKENS, LEAST = 150_000, 150
#: Common tokens (8 bytes each) that are broadcast.
BROADCAST_KEYS = 4_000_000
#: Sets to compare that are told to all tasks at once (33 bytes each); with more, they are taken from the texts in several passes, dealt by their key.
MEMBERS = 2_000_000
#: Parts that are counted at a time, up to PASSES times; a pass shuffles its share of them, and that shuffle is deleted before the next.
PARTS, PASSES = 5_000_000, 4
#: Tokens that meet at a time in large neighbourhoods, or as many as these hold themselves if that is more; blocks meet in passes, and what a pass shuffles is deleted before the next.
MEETING_TOKENS = 20_000_000
#: Bits of a part's hash that are kept, the upper ones: parts that agree by chance only bring strangers together.
_PART_BITS = np.uint64(0xFFFFFFFFFFFF0000)
HUBS = 4
#: Blocks of more bytes than that make their worker give memory back.
LARGE_BYTES = 400_000
#: Documents that make a token common, among those of a task with so many tokens.
OFTEN, AT_ONCE = 8, 4_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SEEDS = (np.uint64(0), _A, _B)
_S29, _S32, _S40 = np.uint64(29), np.uint64(32), np.uint64(40)


class WordHashes(Memo):
    room = 100_000

    def __missing__(self, word: bytes) -> int:
        return self.put(word, xxhash.xxh3_64_intdigest(word))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _A
    return x ^ (x >> _S29)


def token_set(data: bytes, memo: WordHashes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the n-grams."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, size)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = _mixed(out * _B + h[k : n - size + 1 + k])
    return np.unique(out)


class Levels:
    """Bands of set sizes in which sets that link are in one band or the next, and the number of parts of each."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges, self.counts = percent, [1], {}

    def band(self, n: int) -> int:
        e = self.edges
        while e[-1] <= n:
            e.append(max(e[-1] + 1, e[-1] * 100 // self.percent + 1))
        return int(np.searchsorted(e, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Parts and spare parts of a band: sets that link agree in at least one part more than there are spare ones."""
        if band not in self.counts:
            while len(self.edges) < band + 2:
                self.band(self.edges[-1])
            most, least = self.edges[band + 1] - 1, self.edges[max(0, band - 1)]
            differ = 2 * most * (100 - self.percent) // (100 + self.percent)
            spare = 0
            for _ in range(4 if differ else 0):  # few sets have more empty parts than that
                m = differ + 1 + spare
                empty = m * math.exp(-least / m)
                spare = math.ceil(empty + 4 * math.sqrt(empty))
            self.counts[band] = (differ + 1 + spare, spare)
        return self.counts[band]


def signatures(tokens: np.ndarray, levels: Levels, common: np.ndarray) -> np.ndarray:
    """A hash for each part of the set that has tokens, at its own band and the next.

    Tokens in common (sorted) are left out of both sets, which does not make them differ more. If two sets then have so many
    parts without tokens that only those may agree, both are dealt once more, as a whole, by other hashes.
    """
    out, band = [], levels.band(len(tokens))
    rare = tokens[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens] if len(common) else tokens
    for level in (band, band + 1):
        m, spare = levels.parts(level)
        if m > 1:  # else only equal sets link
            for turn in range(3):
                sums, empty = _parts(tokens if turn else rare, m, _salt(level, turn), _SEEDS[turn])
                out.append(sums[~empty])
                if empty.sum() <= spare:
                    break
            else:
                out.append(np.array([_salt(level, 3)]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _salt(level: int, part: int) -> np.uint64:
    return np.uint64((level * 0x9E3779B97F4A7C15 + part * 0xC2B2AE3D27D4EB4F + 1) % 2**64)


def _parts(tokens: np.ndarray, m: int, salt: np.uint64, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        x = _mixed(tokens ^ seed) if seed else tokens
        part = ((x >> _S40) % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=m)
        sums = np.zeros(m, np.uint64)
        there = count > 0
        starts = (np.cumsum(count) - count)[there]
        sums[there] = np.add.reduceat(_mixed(tokens * _B)[order], starts)
        return _mixed(sums + _mixed(np.arange(1, m + 1, dtype=np.uint64) * _C + salt)), ~there


def _links(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    inter = inter.astype(np.int64)
    return 100 * inter >= percent * (a + b - inter)


def compare(sets: list[np.ndarray], percent: int = PERCENT, queries: np.ndarray | None = None, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets that link, by the token-group matrix.

    With queries (a mask), only pairs of a query and a set of another label.
    """
    n = len(sets)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < 2:
        return none
    sizes = np.fromiter(map(len, sets), np.int64, n)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    often = np.bincount(column) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    width = int(often.sum())
    # The groups: sets of one smallest token.
    firsts, group = np.unique(np.array([s[0] for s in sets]), return_inverse=True)
    g = len(firsts)
    low, high = np.full(g, np.iinfo(np.int64).max), np.zeros(g, np.int64)
    np.minimum.at(low, group, sizes)
    np.maximum.at(high, group, sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 2048

    def chunks() -> Iterator[np.ndarray]:
        for at in range(0, width, step):
            a, b = np.searchsorted(column, (at, at + step))
            part = np.zeros((n, min(step, width - at)), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            yield part

    asked = np.arange(n) if queries is None else np.flatnonzero(queries)
    bound = np.zeros((len(asked), g), np.float32)
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(g))
    for part in chunks():
        union = np.maximum.reduceat(part[by_group], starts)  # rows of the token-group matrix
        bound += part[asked] @ union.T
    most = np.minimum(bound, high[None, :])
    opened = _links(most, sizes[asked][:, None], low[None, :], percent)
    if queries is None:  # a set always reaches its own group
        alone = np.bincount(group, minlength=g) == 1
        opened[np.arange(n), group] &= ~alone[group]
    which = np.flatnonzero(opened.any(1))
    members = np.flatnonzero(opened.any(0)[group])
    if not len(which) or not len(members):
        return none
    inter = np.zeros((len(which), len(members)), np.float32)
    for part in chunks():
        inter += part[asked[which]] @ part[members].T
    i, j = asked[which][:, None], members[None, :]
    hit = opened[which][:, group[members]] & _links(inter, sizes[i], sizes[j], percent)
    hit &= i < j if queries is None else (i != j) if labels is None else labels[i] != labels[j]
    a, b = np.nonzero(hit)
    return asked[which][a], members[b]


def _roots(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    lists = table["tokens"].combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _common_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted tokens that OFTEN documents or more of some task have, over all of docs; of more than BROADCAST_KEYS the most frequent.

    Any set of tokens keeps the join exact; these would make strangers of one neighbourhood, the most frequent ones most of all.
    """

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        sets.clear()
        found.sort()
        first = np.flatnonzero(np.diff(found, prepend=~found[:1]) != 0)
        times = np.diff(np.append(first, len(found)))
        many = times >= OFTEN
        return pa.record_batch([pa.array(found[first[many]].view(np.int64)), pa.array(times[many])], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sets, held = kept("hashes", WordHashes), [], 0
        for batch in batches:
            for data in batch.column(0):
                sets.append(token_set(data.as_py(), memo, size))
                held += len(sets[-1])
            if held > AT_ONCE:
                yield often(sets)
                held = 0
        yield often(sets)

    found = docs.select(as_bytes().alias("data")).mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = materialize(found.select("token", F.floor(8 * F.log2("n")).alias("level")), "common-tokens")
    levels = sorted(((r["level"], r["count"]) for r in found.groupBy("level").count().collect()), reverse=True)
    least, held = float("inf"), 0
    for level, count in levels:
        held += count
        if held > BROADCAST_KEYS:
            break
        least = level
    return np.sort(found.where(F.col("level") >= F.lit(least)).select("token").toArrow().column(0).to_numpy().view(np.uint64))


def _listed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    common = docs.sparkSession.sparkContext.broadcast(_common_tokens(docs, size))
    schema = pa.schema([("row", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signatures", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, levels = kept("hashes", WordHashes), Levels(percent)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            counts, keys, parts, at = [], [], [], [0]
            for data in batch.column(3):
                tokens = token_set(data.as_py(), memo, size)
                counts.append(len(tokens))
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                if len(tokens):
                    parts.append(signatures(tokens, levels, common.value))
                at.append(at[-1] + (len(parts[-1]) if len(tokens) else 0))
            flat = np.concatenate(parts) & _PART_BITS if parts else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))
            new = batch_of(schema, [range(row, row + batch.num_rows), counts, keys, lists])
            row += batch.num_rows
            yield pa.record_batch([*batch.columns[:3], *new.columns], names=["doc_id", "key", "row_key", *schema.names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), row_key().alias("row_key"), as_bytes().alias("data"))
    return materialize(source.mapInArrow(lean(run), "doc_id long, key long, row_key long, row long, n_shingles long, set_key binary, signatures array<long>"), "listed")


def _shared_parts(own: DataFrame, passes: int) -> DataFrame:
    """s, first, last, m: the signatures that m rows of own (row, signatures) have, more than one, with the first and the last of those rows."""
    out = None
    for p in range(passes):
        # The lower bits are cut off, and the upper ones deal out the shuffle.
        parts = own.select("row", F.explode("signatures").alias("s")).where(F.pmod(F.shiftright("s", 16), F.lit(passes)) == p)
        shared = materialize(parts.groupBy("s").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("m")).where("m > 1"), "shared-parts")
        if passes > 1:
            release(own.sparkSession)
        out = shared if out is None else out.union(shared)
    return out


def _held_parts(listed: DataFrame, several: DataFrame, n: int) -> DataFrame:
    """row, s: the signatures in listed (row, signatures) that are in several (n rows, __s), and one in a hundred others."""
    table = listed.sparkSession.sparkContext.broadcast(key_filter(several.select("__s"), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy()
            row = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().fill_null(0).to_numpy())
            pick = held(table.value, flat)
            yield pa.record_batch([pa.array(row[pick]), pa.array(flat[pick])], names=["row", "s"])

    return listed.select("row", "signatures").mapInArrow(lean(run), "row long, s long")


def _token_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """row, place, n, tokens, large of the rows of docs whose key is in members (key, row, place, n, large)."""
    passes = max(1, -(-members.count() // MEMBERS))
    source = docs.select(F.xxhash64("doc_id", "text").alias("key"), as_bytes().alias("data"))
    own = lambda rows, p: rows.where(F.pmod("key", F.lit(passes)) == p) if passes > 1 else rows
    out = None
    for p in range(passes):
        sets = _sets_told(own(source, p), own(members, p), size)
        out = sets if out is None else out.unionByName(sets)
    return out


def _sets_told(source: DataFrame, members: DataFrame, size: int) -> DataFrame:
    told = members.select("key", "row", "place", "n", "large").toArrow().sort_by("key")
    known = source.sparkSession.sparkContext.broadcast([told[c].to_numpy() for c in told.column_names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (table, row, place, n, large) = kept("hashes", WordHashes), known.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            first, last = np.searchsorted(table, keys), np.searchsorted(table, keys, "right")
            pick = np.flatnonzero(last > first)
            found = [token_set(batch.column(1)[i].as_py(), memo, size).view(np.int64) for i in pick.tolist()]
            # A key that rows of different classes share is in the table for each of them.
            times = (last - first)[pick]
            at = np.repeat(first[pick] - np.cumsum(times) + times, times) + np.arange(times.sum())
            sets = [found[k] for k in np.repeat(np.arange(len(pick)), times).tolist()]
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            yield pa.record_batch([pa.array(row[at]), pa.array(place[at]), pa.array(n[at]), tokens, pa.array(large[at])], names=["row", "place", "n", "tokens", "large"])

    return source.mapInArrow(lean(run), "row long, place long, n long, tokens array<long>, large boolean")


EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("place", pa.int64()), ("hub", pa.bool_())])


def _joined_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """For each set its component's first member in its block (u, v, place), and whether it is one of the component's hubs. sets: row, place, block, tokens."""

    def run(table: pa.Table) -> pa.Table:
        rows = table["row"].to_numpy()
        pairs = compare(_sets_of(table), percent)
        root = _roots(len(rows), pairs)
        degree = np.bincount(np.concatenate(pairs), minlength=len(rows))
        hub = np.zeros(len(rows), np.bool_)
        order = np.lexsort((rows, -degree, root))
        starts = np.flatnonzero(np.diff(root[order], prepend=-1))
        nth = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        hub[order[nth < HUBS]] = True
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, root, rows)
        if table.nbytes > LARGE_BYTES:
            give_back()
        return pa.table([rows, least[root], table["place"].to_numpy(), hub], schema=EDGE)

    return sets.groupBy("place", "block").applyInArrow(run, "u long, v long, place long, hub boolean")


def _meetings(sets: DataFrame, percent: int) -> DataFrame:
    """Links between queries and members of other labels. sets: row, place, block, tokens, label, query."""

    def run(table: pa.Table) -> pa.Table:
        rows, label = table["row"].to_numpy(), table["label"].to_numpy()
        i, j = compare(_sets_of(table), percent, table["query"].to_numpy(zero_copy_only=False), label)
        if table.nbytes > LARGE_BYTES:
            give_back()
        return pa.table([label[i], label[j]], names=["u", "v"])

    return sets.groupBy("place", "block", "chunk").applyInArrow(run, "u long, v long")


def _large(sets: DataFrame, percent: int) -> DataFrame:
    """v, root within large neighbourhoods. sets: row, place, n, tokens."""
    edges, active, before = None, sets, -1
    while True:
        tokens = active.groupBy("place").agg(F.sum("n").alias("all"), F.count("*").alias("m"))
        widest, count = tokens.agg(F.max("all"), F.sum("m")).first()
        dealt = active.drop("block").join(small(tokens.select("place", "all")), "place").withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("all") / BLOCK_TOKENS)))
        found = materialize(_joined_blocks(dealt.select("row", "place", "block", "tokens"), percent), "block-links")
        new = found.select("u", "v")
        edges = new if edges is None else edges.union(new)
        if widest <= BLOCK_TOKENS or before >= 0 and count > 0.7 * before:
            break
        before = count
        hubs = found.where("hub").select(F.col("u").alias("row"))
        active = sets.join(small(hubs), "row", "left_semi")
    rooted = components(edges, "large-stars")
    # Labels without the sets; few sets are outside the largest component of their place.
    labels = sets.select("row", "place", "n").join(rooted, F.col("row") == F.col("v"), "left").withColumn("label", F.coalesce("root", "row")).drop("v", "root")
    labels = materialize(labels, "labels")
    per = labels.groupBy("place", "label").agg(F.count("*").alias("m"))
    largest = per.groupBy("place").agg(F.max(F.struct("m", "label")).alias("x")).select("place", F.col("x.label").alias("main"))
    whole = labels.groupBy("place").agg(F.sum("n").alias("all"))
    told = materialize(labels.join(largest, "place").join(whole, "place").withColumn("out", F.col("label") != F.col("main")).select("row", "label", "all", "out"), "told")
    labelled = sets.join(small(told), "row")
    rest = labelled.where("out")
    asked = labels.join(told.where("out").select("row"), "row").groupBy("place").agg(F.sum("n").alias("asked"))
    blocks, cut = F.ceil(F.col("all") / BLOCK_TOKENS), F.ceil(F.col("asked") / BLOCK_TOKENS)
    columns = ["row", "place", "tokens", "label", "query", "block", "chunk"]
    queries = rest.join(small(asked), "place").withColumn("query", F.lit(True)).withColumn("chunk", F.pmod(F.xxhash64("row"), cut)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    members = labelled.join(small(asked), "place").withColumn("query", F.lit(False)).withColumn("block", F.pmod(F.xxhash64("row"), blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
    met, least = whole.join(asked, "place").agg(F.sum(blocks * F.col("asked") + cut * F.col("all")), F.sum("all")).first()
    passes = -(-met // max(least, MEETING_TOKENS)) if met else 1
    for p in range(passes):
        if passes > 1:
            release(sets.sparkSession)
        own = F.pmod("block", F.lit(passes)) == p
        edges = edges.union(materialize(_meetings(queries.where(own).select(columns).union(members.where(own).select(columns)), percent).distinct(), "crossed"))
    return components(edges, "large-final")


def similar_components(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, row, row_key: a row for each row of docs."""
    listed = _listed(docs, size, percent)
    # Nulls are taken for the largest id.
    largest = F.lit(2**63 - 1)
    classes = materialize(listed.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("rep"), F.min(F.coalesce("doc_id", largest)).alias("least"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")), "classes")
    # The rows that only repeat a class, and the parts that several share, are small beside all parts: broadcast if so, joined else.
    repeated = classes.where("copies > 1").select(F.col("set_key").alias("__set"), "rep")
    spare = materialize(listed.select("row", "set_key").join(repeated, F.col("set_key") == F.col("__set")).where("row != rep").select(F.col("row").alias("__row")), "spare")
    own = listed.join(small(spare), F.col("row") == F.col("__row"), "left_anti").select("row", "signatures")
    parts = own.select("row", F.explode("signatures").alias("s"))
    passes = max(1, min(PASSES, -(-(listed.agg(F.sum(F.size("signatures"))).first()[0] or 0) // PARTS)))
    shared = _shared_parts(own, passes)
    several = shared.where("m > 2").select(F.col("s").alias("__s"), "first")
    n = several.count()
    # Beyond what is broadcast, only parts that several are likely to share are shuffled once more.
    several, parts = (F.broadcast(several), parts) if n <= C.BROADCAST_ROWS else (several, _held_parts(own, several, n))
    near = shared.where("m = 2").select(F.col("first").alias("v"), F.col("last").alias("u")).union(parts.join(several, F.col("s") == F.col("__s")).select(F.col("first").alias("v"), F.col("row").alias("u")))
    around = components(near, "neighbours")
    # From here on nothing reads signatures.
    signed, listed = listed, materialize(listed.drop("signatures"), "rows")
    forget(signed, spare, shared)
    if passes > 1:
        release(docs.sparkSession)
    places = around.select(F.col("v").alias("row"), F.col("root").alias("place")).union(around.select(F.col("root").alias("row"), F.col("root").alias("place")).distinct())
    members = materialize(places.join(listed.select("row", "key", F.greatest("n_shingles", F.lit(LEAST)).alias("n")), "row"), "members")
    weight = members.groupBy("place").agg(F.sum("n").alias("all"))
    weighed = materialize(members.join(weight, "place").withColumn("large", F.col("all") > BLOCK_TOKENS).drop("all"), "weighed")
    sets = materialize(_token_sets(docs, weighed, size), "sets")
    forget(members, weighed)
    found = materialize(_joined_blocks(sets.where("not large").select("row", "place", F.lit(0).alias("block"), "tokens"), percent).select(F.col("u").alias("v"), F.col("v").alias("root")), "links")
    large = sets.where("large").drop("large")
    if not large.isEmpty():
        found = found.union(_large(large, percent))
    ids = classes.join(found, F.col("rep") == F.col("v"), "left").withColumn("root", F.coalesce("root", "rep"))
    linked = materialize(ids.select("set_key", "least", "copies", "root"), "linked")
    forget(sets, classes)
    if passes > 1:
        release(docs.sparkSession)
    by_root = linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("m"), F.max("copies").alias("c")).where("m > 1 or c > 1")
    of_class = linked.join(by_root.select("root", "component"), "root").select(F.col("set_key").alias("__set"), "component")
    out = listed.select("doc_id", "row_key", "row", "n_shingles", "set_key").join(of_class, F.col("set_key") == F.col("__set"), "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(component == largest, F.lit(None)).otherwise(component).alias("component_id"), "row", "row_key")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The row of the smallest doc_id of each component; documents without words stay, and so do rows without an id unless they repeat."""
    found = similar_components(docs, **options)
    empty = F.col("n_shingles") == 0
    apart = Window.partitionBy(F.coalesce("component_id", "row_key"), empty).orderBy("row")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    chosen = found.where(first).withColumn("nth", F.row_number().over(apart))
    decided = chosen.select("doc_id", "row_key", (empty | (F.col("nth") == 1)).cast("int").alias("copies"))
    return apply_copies(docs, decided.union(found.where(~first).select("doc_id", "row_key", F.lit(0))))
