"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a stretch of
text; dynamic programming over its positions carries the best score and the
number of pieces on the best path, no path is kept. Ties are the tokenizer's:
starts are tried from left to right, and a later candidate must score strictly
higher. A character without a piece of its own costs the lowest score less 10
and counts as its UTF-8 bytes.

Stretches begin at each space and are scored once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, prepare

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class PieceCounts(Remembered):
    """Number of pieces of a stretch that follows a space, remembered up to a bound."""

    def __init__(self, vocab: list[tuple[str, float]], most: int = 150_000):
        import ahocorasick

        super().__init__(most)
        self.found = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY

    def make(self, stretch: str) -> int:
        return self.count(SPACE + stretch)

    def count(self, text: str) -> int:
        """Pieces on the best path through ``text``.

        The automaton reports matches by their ends, longest first within an
        end, that is in order of their starts; so a strictly higher score is
        asked of each later one. An unknown character is a candidate from the
        last start of its end.
        """
        score, pieces, single = [0.0] + [0.0] * len(text), [0] * (len(text) + 1), 0
        fresh = True  # no path to the present position yet

        def unknown(end: int) -> None:
            cost = score[end - 1] + self.unknown
            if fresh or cost > score[end]:
                score[end], pieces[end] = cost, pieces[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))

        at = 0
        for last, (length, gain) in self.found.iter(text):
            end = last + 1
            while at < end:
                if at and single != at:
                    unknown(at)
                at, fresh = at + 1, True
            start = end - length
            if fresh or score[start] + gain > score[end]:
                score[end], pieces[end], fresh = score[start] + gain, pieces[start] + 1, False
            if length == 1:
                single = end
        while at < len(text):
            if at and single != at:
                unknown(at)
            at, fresh = at + 1, True
        if at and single != at:
            unknown(at)
        return pieces[len(text)]


_KEPT: dict[int, PieceCounts] = {}


def piece_counts(shared: Broadcast) -> PieceCounts:
    """One per worker process and vocabulary."""
    key = hash(tuple(shared.value))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = PieceCounts(shared.value)
    return _KEPT[key]


def count_tokens(docs: DataFrame, vocab: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs`` (doc_id, text, …).

    Null and empty texts have none; texts are counted whole, however long; a
    null id is kept. Repeated rows are counted alike; an empty table gives an
    empty result; other columns are ignored. A text is cut at each space, as a
    tokenizer with ``split`` does, so pieces with a space after their first
    character (runs of spaces in some vocabularies) are never used.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # a vocabulary's size doesn't follow the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = piece_counts(shared).__getitem__
        for batch in batches:
            n = []
            for text in batch.column(1):
                text = (text.as_py() or "").replace(SPACE, " ")
                n.append(sum(map(get, (text[1:] if text[0] == " " else text).split(" "))) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long")
