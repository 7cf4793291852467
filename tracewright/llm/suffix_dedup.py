"""Removing repeated substrings, exact to the byte, with suffixes sorted by deep-shallow sorting.

A byte goes if a string of LENGTH bytes around it also starts earlier. Strings are brought together by an anchor: of
the GRAM-byte grams inside a string, the first with the least hash. Equal strings have equal anchors, and a string's
neighbours mostly share one, so a text has about two anchors for each LENGTH - GRAM bytes. Only anchors whose gram is found twice
matter: contexts are taken of those in a filter of their hashes, which every task has, and of one in a hundred others, which
meet nothing. Contexts meet in tasks by the anchor's hash; there the suffixes from the anchor on, and the mirrored ones
before it, are sorted (see deep_shallow), and the lengths that neighbours share tell which strings are equal. A hot
anchor's contexts are dealt into blocks; the strings that come first in their block meet once more, by their digest.

Texts equal as a whole are pre-aggregated: all but the first of them go, for all their strings start earlier.

Defined cases: a null text is empty; a text shorter than LENGTH stays; a null doc_id comes after all others; of rows that
share a doc_id the order is by a hash of the text, and rows equal in both are one document with one result; an empty
table gives an empty result; a very long text is one document, its anchors spread over tasks; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, held, key_filter, lean, materialize, small
from .deep_shallow import sort

LENGTH, GRAM = 100, 24
#: Contexts in one task's group, about, and contexts of a hot anchor in one block.
GROUP_ROWS, BLOCK_ROWS = 1000, 500
#: Keys (8 bytes each) of whole copies that are broadcast; with more, copies are sorted like other texts.
BROADCAST_KEYS = 8_000_000
#: Documents and runs to remove that are broadcast at once; with more, documents are cut in several passes, dealt by their key.
SPANS = 8_000_000
_TABLE = np.random.default_rng(20240612).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_M = 0x9E3779B97F4A7C15


def gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A hash of each gram of data, by doubling."""
    widths, h, width = [], _TABLE[np.frombuffer(data, np.uint8)], 1
    while True:
        if gram & width:
            widths.append((width, h))
        if 2 * width > gram:
            break
        h = h[:-width] * np.uint64(pow(_M, width, 1 << 64)) + h[width:]
        width *= 2
    n = len(data) - gram + 1
    out, at = np.zeros(n, np.uint64), 0
    for width, h in widths:
        out = out * np.uint64(pow(_M, width, 1 << 64)) + h[at : at + n]
        at += width
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last string start of each run of strings that share an anchor."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = gram_hashes(data, gram)
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: n], low[span - width : span - width + n])
    place = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], n) - 1
    return h[place[first]], place[first], first, last


def repeats(contexts: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[list[int]]:
    """For each context of one anchor, in document order, the offsets of its strings that an earlier context has too.

    A context is (before, strings, bytes): the bytes before the anchor, the number of strings, and the bytes that they
    cover. An offset counts from the start of the context.
    """
    firsts: dict[tuple[int, bytes], int] = {}
    own, out = [], []
    for i, (before, strings, data) in enumerate(contexts):
        if firsts.setdefault((before, data), i) == i:
            own.append(i)
            out.append([])
        else:
            out.append(list(range(strings)))
    if len(own) < 2:
        return out
    after, shared_after = sort([contexts[i][2][contexts[i][0] :] for i in own], gram)
    ahead, shared_ahead = sort([contexts[i][2][: contexts[i][0]][::-1] for i in own])
    rank_after, rank_ahead = [0] * len(own), [0] * len(own)
    least = min(contexts[i][0] - contexts[i][1] + 1 for i in own)
    most = max(contexts[i][0] for i in own)
    for offset in range(least, most + 1):  # bytes between a string's start and the anchor
        for order, shared, rank, depth in ((after, shared_after, rank_after, length - offset), (ahead, shared_ahead, rank_ahead, offset)):
            run = 0
            for place, (k, agree) in enumerate(zip(order, shared, strict=True)):
                if agree < depth:
                    run = place
                rank[k] = run
        seen = set()
        for k, i in enumerate(own):
            before, strings, _ = contexts[i]
            if before - strings < offset <= before:
                key = (rank_after[k], rank_ahead[k])
                if key in seen:
                    out[i].append(before - offset)
                else:
                    seen.add(key)
    return out


def _ordered(docs: DataFrame) -> DataFrame:
    """key, d and tie (the order of documents), data."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64("text").alias("tie"), as_bytes().alias("data"))


def _array(df: DataFrame) -> np.ndarray:
    return np.sort(df.toArrow().column(0).to_numpy())


def _inside(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys if len(table) else np.zeros(len(keys), np.bool_)


def whole_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key of each document of at least length bytes whose text an earlier one has as a whole."""
    texts = _ordered(docs).where(F.length("data") >= length).select("key", "d", F.sha2("data", 256).alias("t"))
    first = texts.groupBy("t").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select(F.col("t").alias("__t"), "first")
    first = small(materialize(first, "copied-texts"))
    return materialize(texts.join(first, F.col("t") == F.col("__t")).where("d > first").select("key").distinct(), "whole-copies")


RUN = "key long, start long, stop long"


def _contexts(source: DataFrame, gone, dups, groups: int, length: int) -> DataFrame:
    """h, block, key, d, tie, start, before, strings, context, for the anchors in dups: a filter of their hashes, and the hot ones with their numbers."""
    block_rows = BLOCK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = gone.value
        repeated, hashes, times = dups.value
        names = ["h", "grp", "block", "key", "d", "tie", "start", "before", "strings", "context"]
        for batch in batches:
            keys, ds, ties = (batch.column(i).to_numpy() for i in range(3))
            out: list[list] = [[] for _ in names]
            size = 0
            drop = _inside(skipped, keys)
            for r in np.flatnonzero(~drop).tolist():
                data = batch.column(3)[r].as_py()
                h, place, first, last = anchors(data, length)
                h = h.view(np.int64)
                pick = held(repeated, h)
                h, place, first, last = h[pick], place[pick], first[pick], last[pick]
                if not len(h):
                    continue
                hot, n = _inside(hashes, h), np.ones(len(h), np.int64)
                n[hot] = times[np.searchsorted(hashes, h[hot])]
                blocks = np.where(hot, 1 + ((h ^ keys[r]).view(np.uint64) * np.uint64(_M) >> np.uint64(33)).astype(np.int64) % np.maximum(1, -(-n // block_rows)), 0)
                out[0].extend(h.tolist())
                out[1].extend(np.where(hot, h, h % groups).tolist())
                out[2].extend(blocks.tolist())
                for column, value in zip(out[3:6], (keys[r], ds[r], ties[r]), strict=True):
                    column.extend([int(value)] * len(h))
                out[6].extend(first.tolist())
                out[7].extend((place - first).tolist())
                out[8].extend((last - first + 1).tolist())
                cut = [data[a : b + length] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                out[9].extend(cut)
                size += sum(map(len, cut))
                if size > 16_000_000:
                    yield pa.record_batch([pa.array(c, pa.binary() if k == 9 else pa.int64()) for k, c in enumerate(out)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.record_batch([pa.array(c, pa.binary() if k == 9 else pa.int64()) for k, c in enumerate(out)], names=names)

    return source.mapInArrow(lean(run), "h long, grp long, block long, key long, d long, tie long, start long, before long, strings long, context binary")


FOUND = [("key", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("tie", pa.int64()), ("digest", pa.binary())]
FOUND_DDL = "key long, start long, stop long, h long, d long, tie long, digest binary"


def _judged(contexts: DataFrame, length: int) -> DataFrame:
    """Runs of bytes that go (digest null), and of hot anchors the strings that come first in their block (with a digest)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("h", "d", "tie", "start")])
        same = np.ones(max(0, table.num_rows - 1), np.bool_)
        for c in ("h", "key", "start"):  # of rows that are one document
            same &= np.diff(table[c].to_numpy()) == 0
        table = table.filter(pa.array(np.append(np.ones(min(1, table.num_rows), np.bool_), ~same)))
        h, block, key, d, tie, start, before, strings = (table[c].to_numpy() for c in ("h", "block", "key", "d", "tie", "start", "before", "strings"))
        data = table["context"].to_pylist()
        out: list[list] = [[] for _ in FOUND]
        edges = np.append(np.flatnonzero(np.diff(h, prepend=~h[:1])), len(h)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2 and not block[a]:
                continue
            found = repeats(list(zip(before[a:b].tolist(), strings[a:b].tolist(), data[a:b], strict=True)), length)
            for i, offsets in enumerate(found, a):
                at, here = int(start[i]), sorted(offsets)
                if here:
                    low = high = here[0]
                    for o in [*here[1:], None]:
                        if o is not None and o <= high + 1:
                            high = o
                            continue
                        for column, value in zip(out, (int(key[i]), at + low, at + high + length, None, None, None, None), strict=True):
                            column.append(value)
                        low = high = o
                if block[i]:
                    known = set(here)
                    for o in range(int(strings[i])):
                        if o not in known:
                            digest = hashlib.blake2b(data[i][o : o + length], digest_size=16).digest()
                            for column, value in zip(out, (int(key[i]), at + o, at + o + length, int(h[i]), int(d[i]), int(tie[i]), digest), strict=True):
                                column.append(value)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(out, FOUND, strict=True)], names=[n for n, _ in FOUND])

    return contexts.groupBy("grp", "block").applyInArrow(run, FOUND_DDL)


def repeated_runs(docs: DataFrame, copies: np.ndarray, *, length: int = LENGTH) -> DataFrame:
    """key, start, stop: runs of bytes that start earlier too, of the documents whose key is not in copies."""
    sc = docs.sparkSession.sparkContext
    source, gone = _ordered(docs), sc.broadcast(copies)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped = gone.value
        for batch in batches:
            keep = np.flatnonzero(~_inside(skipped, batch.column(0).to_numpy())).tolist()
            found = [anchors(batch.column(3)[r].as_py(), length)[0] for r in keep]
            h, n = np.unique(np.concatenate(found).view(np.int64), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(h), pa.array(n)], names=["h", "n"])

    dup = materialize(source.mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    kinds, rows = dup.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, rows // GROUP_ROWS)
    hot = dup.where(F.col("n") > BLOCK_ROWS).toArrow()
    h, n = hot["h"].to_numpy(), hot["n"].to_numpy()
    order = np.argsort(h)
    contexts = _contexts(source, gone, sc.broadcast((key_filter(dup.select("h"), kinds), h[order], n[order])), groups, length)
    found = materialize(_judged(contexts, length), "judged")
    runs = found.where("digest is null").select("key", "start", "stop")
    hot = found.where("digest is not null")
    first = hot.groupBy("h", "digest").agg(F.min(F.struct("d", "tie", "start")).alias("x"), F.count("*").alias("m")).where("m > 1").select(F.col("h").alias("__h"), F.col("digest").alias("__g"), "x")
    late = hot.join(first, (F.col("h") == F.col("__h")) & (F.col("digest") == F.col("__g"))).where(F.struct("d", "tie", "start") != F.col("x")).select("key", "start", "stop")
    return runs.union(late)


def union_of(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the given ones cover."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable").tolist():
        a, b = int(starts[k]), int(stops[k])
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def merged(runs: DataFrame) -> DataFrame:
    """key, runs, with the runs of a document that overlap or touch made one."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for listed in batch.column(1):
                pairs = listed.values
                out.append([{"start": a, "stop": b} for a, b in union_of(pairs.field(0).to_numpy(), pairs.field(1).to_numpy())])
            yield pa.record_batch([batch.column(0), pa.array(out, span)], names=["key", "runs"])

    return runs.mapInArrow(lean(run), "key long, runs array<struct<start: long, stop: long>>")


def deduplicate(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, data (the bytes that stay), n_bytes, n_removed, spans (runs removed): a row for each row of docs."""
    copies = whole_copies(docs, length)
    few_copies = copies.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    skipped = _array(copies) if few_copies else np.zeros(0, np.int64)
    runs = materialize(merged(repeated_runs(docs, skipped, length=length).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))), "runs")
    size = runs.agg(F.count("*") + F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    passes = max(1, -(-size // SPANS))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), as_bytes().alias("data"))
    own = lambda rows, p: rows.where(F.pmod("key", F.lit(passes)) == p) if passes > 1 else rows
    gone, out = docs.sparkSession.sparkContext.broadcast(skipped), None
    for p in range(passes):
        done = _cut(own(source, p), own(runs, p), gone)
        out = done if out is None else out.unionByName(done)
    return out


def _cut(source: DataFrame, runs: DataFrame, gone) -> DataFrame:
    """What deduplicate() returns of source (doc_id, key, data), with the runs of its documents; those in gone (keys, broadcast) go as a whole."""
    got = runs.toArrow().combine_chunks()
    keys = got["key"].to_numpy()
    order = np.argsort(keys)
    lists = got["runs"].combine_chunks() if got.num_rows else None
    starts, stops = ((lists.values.field(i).to_numpy().astype(np.int32) for i in (0, 1)) if lists is not None else (np.zeros(0, np.int32),) * 2)
    table = source.sparkSession.sparkContext.broadcast((keys[order], order, lists.offsets.to_numpy() if lists is not None else np.zeros(1, np.int32), starts, stops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipped, (known, order, offsets, starts, stops) = gone.value, table.value
        for batch in batches:
            keys = batch.column(1).to_numpy()
            copied, hit, at = _inside(skipped, keys).tolist(), _inside(known, keys).tolist(), np.searchsorted(known, keys)
            out: list[list] = [[], [], [], []]
            for r in range(batch.num_rows):
                data = batch.column(2)[r].as_py()
                spans = []
                if copied[r]:
                    spans = [(0, len(data))]
                elif hit[r]:
                    k = order[at[r]]
                    spans = union_of(starts[offsets[k] : offsets[k + 1]], stops[offsets[k] : offsets[k + 1]])
                ends = [0, *[x for span in spans for x in span], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                for column, value in zip(out, (kept, len(data), len(data) - len(kept), [{"start": a, "stop": b} for a, b in spans]), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], span)], names=["doc_id", "data", "n_bytes", "n_removed", "spans"])

    return source.mapInArrow(lean(run), "doc_id long, data binary, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>")
