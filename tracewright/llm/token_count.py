"""Token counts by a Viterbi search that keeps no path.

The vocabulary is one of pieces and scores, read as a unigram model. An Aho-Corasick automaton lists the pieces that end
at each character, longest first; the search carries the best score and its number of pieces. Rules of the unigram
tokenizer: a later candidate wins only if it is strictly better, so of equal ones the piece that starts first stays; a
character without a piece of its own costs the least score less 10; an unknown character counts as its UTF-8 bytes. Spaces become
the mark U+2581 and a text gets one in front. Texts are split before each mark, and words are counted one by one and remembered:
a run of marks is not searched as a whole. All pieces of the file are pieces here, control, byte and unused ones too.

Defined cases: a null or empty text has no tokens; a very long text is counted whole, a long word is searched and not
remembered; rows that repeat are counted each; an empty table gives an empty
result; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batch_of, kept, lean

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: The longest word that is remembered.
LONGEST = 64


def read_pieces(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(Memo):
    """(pieces, score) of a word, mark in front."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def search(self, text: str) -> tuple[int, float]:
        n, unknown = len(text), self.unknown
        best, count, single = [0.0] + [float("-inf")] * n, [0] * (n + 1), [False] * (n + 1)
        settled = 0
        for last, (size, score) in self.automaton.iter(text):
            end = last + 1
            while settled < last:
                settled += 1
                if not single[settled] and (c := best[settled - 1] + unknown) > best[settled]:
                    best[settled], count[settled] = c, count[settled - 1] + len(text[settled - 1].encode("utf-8", "replace"))
            c = best[end - size] + score
            if c > best[end]:
                best[end], count[end] = c, count[end - size] + 1
            if size == 1:
                single[end] = True
        while settled < n:
            settled += 1
            if not single[settled] and (c := best[settled - 1] + unknown) > best[settled]:
                best[settled], count[settled] = c, count[settled - 1] + len(text[settled - 1].encode("utf-8", "replace"))
        return count[n], best[n]

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.search(MARK + word)
        return self.put(word, found) if len(word) <= LONGEST else found

    def of(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            words = words[1:]
        found = [self[w] for w in words]
        return sum(c for c, _ in found), sum(s for _, s in found)


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, score: a row for each row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_pieces(vocabulary_path))
    schema = pa.schema([("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("pieces", vocabulary_path), lambda: Counter(shipped.value))
        for batch in batches:
            found = [counter.of(text.as_py() or "") for text in batch.column(1)]
            new = batch_of(schema, [[c for c, _ in found], [s for _, s in found]])
            yield pa.record_batch([batch.column(0), *new.columns], names=["doc_id", *schema.names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lean(run), "doc_id long, n_tokens long, score double")
