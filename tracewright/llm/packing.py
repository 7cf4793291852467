"""Packing token ids into sequences: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most a sequence. The histogram of piece lengths (at most as many rows as a sequence
has tokens) is packed on the driver, longest length first, each into the pack with the fewest tokens that has room. Packs
of one pattern are counted, not listed. Patterns then meet the pieces by rank among pieces of their length; ranks are
counted in each task and shifted by the counts of earlier tasks, so no task sees all the pieces of a length.

Defined cases: a null text is empty and yields the end id alone; rows that repeat are packed each by itself; an empty
table gives an empty result; a very long text is cut into as many pieces as it needs; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, as_bytes, batch_of, kept, lean, materialize

LENGTH, END_ID = 4096, 2
# How the tokenizer of this vocabulary splits a word, for words of the letters below U+0250.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
LATIN = "\u0250"
# Without U+0130, whose lower case is two characters, of which one is no letter.
PLAIN = r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+"


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else one from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class WordIds(Memo):
    """Ids (little-endian, four bytes each) of a word. The tokenizer never joins across white space, so a text's ids are its words' ids in turn.

    Plain words are lower-cased and split here and merged by the tokenizer's model, where that is what the tokenizer
    does (plain is set); all other words go through the whole tokenizer, as do those that hold a special token.
    """

    room = 500_000

    def __init__(self, tokenizer, plain: bool):
        import regex

        self.tokenizer, self.plain, self.parts = tokenizer, plain, PartIds(tokenizer.model)
        self.matches, self.split = regex.compile(PLAIN).fullmatch, regex.compile(SPLIT).findall
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: bytes) -> bytes:
        text, part = word.decode("utf-8", "replace"), self.parts.__getitem__
        if not self.plain:
            ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        elif (low := text.lower()).isalpha() and max(text) < LATIN:
            ids = part(low)
        elif text[-1] in ".," and (stem := low[:-1]).isalpha() and max(text) < LATIN:
            ids = part(stem) + part(text[-1])
        elif self.matches(text) and not any(s in text for s in self.special):
            ids = b"".join(map(part, self.split(low)))
        else:
            ids = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.put(word, ids)


class PartIds(Memo):
    """Ids of what the splitting rule leaves: words with another ending share their stem."""

    room = 200_000

    def __init__(self, model):
        self.model, self.letters = model, str.maketrans(byte_letters())

    def __missing__(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return self.put(part, packed([t.id for t in self.model.tokenize(letters)]))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def splits_plainly(definition: str) -> bool:
    """Whether the tokenizer is the kind that WordIds can split for."""
    import json

    d = json.loads(definition)
    steps = [x.get("type") for x in (d.get("normalizer") or {}).get("normalizers", [])]
    split = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    pattern = (split[0].get("pattern") or {}).get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    # Special tokens are looked for as they are written, and in no word that is letters with at most a point or comma.
    special = all(not t["normalized"] and any(not c.isalpha() and c not in ".," for c in t["content"]) for t in d.get("added_tokens", []))
    return special and steps == ["NFC", "Replace", "Lowercase"] and pattern == SPLIT and [x.get("type") for x in split[1:]] == ["ByteLevel"]


def pieces(docs: DataFrame, tokenizer_path: str, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, with the task and the rank among its pieces of that length."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    shipped, plain = docs.sparkSession.sparkContext.broadcast(definition), splits_plainly(definition)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        def words() -> WordIds:
            return WordIds(Tokenizer.from_str(shipped.value), plain)

        memo, seen = kept(("ids", tokenizer_path), words), Counter()
        task = TaskContext.get().partitionId()
        end, step = np.array([end_id], "<u4").tobytes(), 4 * length
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = b"".join(map(memo.__getitem__, text.as_py().split())) + end
                for at in range(0, len(data), step):
                    piece = data[at : at + step]
                    n = len(piece) // 4
                    for column, value in zip(out, (doc_id, at // 4, n, piece, zlib.crc32(piece), len(data) // 4, task, seen[n]), strict=True):
                        column.append(value)
                    seen[n] += 1
                held += len(data)
                if held > 16_000_000:
                    yield batch_of(schema, out)
                    out, held = [[] for _ in schema], 0
            yield batch_of(schema, out)

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(lean(run), "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, task long, place long")
    return materialize(made, "pieces")


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(count, ((piece length, times), ...)) of each pattern.

    As if piece by piece, longest first, each went to the pack with the fewest tokens that has room, or else to a new one;
    equal packs move together.
    """
    open_: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    fills: list[int] = []

    def put(fill: int, count: int, pattern: tuple) -> None:
        if not open_[fill]:
            heapq.heappush(fills, fill)
        open_[fill].append((count, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and fills and fills[0] + size <= length:
            fill = fills[0]
            count, pattern = open_[fill].pop()
            if not open_[fill]:
                heapq.heappop(fills)
            # More of the same go into a pack while it stays the shortest.
            used = min(count, left)
            head = pattern[:-1] + ((size, pattern[-1][1] + 1),) if pattern[-1][0] == size else (*pattern, (size, 1))
            put(fill + size, used, head)
            if count > used:
                put(fill, count - used, pattern)
            left -= used
        if left:
            times = length // size
            full, rest = divmod(left, times)
            if full:
                put(size * times, full, ((size, times),))
            if rest:
                put(size * rest, 1, ((size, rest),))
    return [(count, pattern) for fill in sorted(open_) for count, pattern in open_[fill]]


def placements(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, times): where the pieces of that length and rank go."""
    out, next_rank, sequence = [], Counter(), 0
    for count, pattern in patterns:
        at = 0
        for size, times in pattern:
            first = next_rank[size]
            next_rank[size] += count * times
            out.append((size, first, next_rank[size], sequence, at, times))
            at += size * times
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path, length=length, end_id=end_id)
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = placements(shortest_pack_first(histogram, length))
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 0, 1)], "length long, first long, beyond long, sequence long, at long, times long")
    ranked = cut.join(shifts.select("task", "length", "shift"), ["task", "length"]).withColumn("rank", F.col("shift") + F.col("place"))
    # The table has a row for each length in each pattern, bounded by the histogram and not by the documents.
    found = ranked.join(F.broadcast(table), "length").where("rank >= first and rank < beyond")
    nth = F.col("rank") - F.col("first")
    return found.select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("times") * F.col("length")).cast("long").alias("offset"))
