"""Best-fit packing of tokenised documents into sequences of bounded length.

Best-fit decreasing takes items from long to short and puts each into the open
bin that it fills best. Items of one length are alike, and so are bins with the
same room, hence the driver plans on counts: one number per length, found with
one distributed count. A segment tree over remaining capacities finds the
tightest open room in logarithmic time. The plan's size depends on the capacity
alone, never on the number of documents; each piece then finds its place by its
rank among pieces of its length.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, cut, prepare

CAPACITY = 2048
END_ID = 0


class RoomTree:
    """A segment tree over the rooms 0..capacity: which of them any open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.any[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that an open bin has."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.any[2 * at])
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, first rank, last rank + 1, pieces per bin, first bin,
    offset of the first piece in its bin): the piece of rank r in such a run goes
    to bin ``first + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    """
    tree, open_bins, runs, bins = RoomTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, many = capacity, bins, -(-left // (capacity // length))
                bins += many
            else:
                first, many = open_bins[room].pop()
                tree.add(room, -1)
            per = room // length
            full = min(many, left // per)
            for n, k in ((full, per), (min(1, many - full), left - full * per if full < many else 0)):
                if n and k:
                    runs.append((length, rank, rank + n * k, k, first, capacity - room))
                    open_bins.setdefault(room - k * length, []).append((first, n))
                    tree.add(room - k * length, 1)
                    rank, left, first, many = rank + n * k, left - n * k, first + n, many - n
            if many:
                open_bins.setdefault(room, []).append((first, many))
                tree.add(room, 1)
    return runs


def _byte_letters() -> list[str]:
    """Byte-level tokenizers' character for each byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ChunkIds(Remembered):
    """Ids of stretches without white space, as little-endian 32-bit numbers.

    White space ends every pre-token of these tokenizers, so a text's ids are its
    stretches' ids in a row; most stretches are words that recur. Letters and
    punctuation are pre-tokens apart, so a word's closing punctuation is looked
    up by itself; Latin words go to the model without the steps before it, which
    for them are lower case and the bytes' letters.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__(most)
        tokenizer = Tokenizer.from_file(path)
        steps = [json.loads(x.__getstate__()) if x else {} for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
        parts = [y for x in steps for y in x.get("normalizers", x.get("pretokenizers", []))]
        self.plain = {x["type"] for x in parts} == {"NFC", "Replace", "Lowercase", "Split", "ByteLevel"} and any(r"|[\p{L}]+|" in str(x.get("pattern", {}).get("Regex")) for x in parts)
        self.encode, self.model, self.letters = tokenizer.encode, tokenizer.model, _byte_letters()

    def word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def make(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        word = text.rstrip(".,;:!?")
        low = word.lower()
        if not (self.plain and len(text) <= 100 and low.isalpha() and max(word) < "\u0250"):
            return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        ids = self.word(low)
        return ids if len(word) == len(text) else ids + self[text[len(word) :].encode()]


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One per worker process and tokenizer."""
    return ChunkIds(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and then ``end_id``, cut into pieces of ``capacity`` ids.

    Returns (doc_id, piece, start, length, ids); ids is binary, little-endian
    unsigned 32-bit. A null text counts as empty and gives one piece of one id.
    """
    prepare(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = chunk_ids(tokenizer).__getitem__
        for batch in batches:
            out, held = ([], [], [], [], []), 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(map(get, (text.as_py() or "").encode().split())) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, part)):
                        column.append(value)
                    held += len(part)
                    if held > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)
                        out, held = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    names = ["doc_id", "piece", "start", "length", "ids"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, carry: list[Column | str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and a gapless ``offset`` to rows with a ``length``.

    ``carry`` names the columns, or expressions over them, to keep beside length
    (all by default); what is not carried is never stored or shuffled. Rows are
    stored once, ranked among those of equal length (per stored partition, so a
    length that a third of all rows share is split) and placed by the plan. An
    empty table gives an empty result; repeated rows are places of their own.
    """
    spark = pieces.sparkSession
    prepare(spark)
    kept = pieces.select("length", *(carry or [c for c in pieces.columns if c != "length"]))
    rows = cut(kept.withColumn("_slot", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_slot", 33))
    tally = cut(rows.groupBy("length", "_part").agg(F.count("*").alias("_n")))
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("_n")).collect()}  # at most one row per length
    plan = best_fit_plan(counts, capacity)
    runs = spark.createDataFrame(plan, "length long, _from long, _to long, _per long, _bin long, _offset long")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("length", "_part").orderBy("_slot")
    ranked = rows.withColumn("_own", F.row_number().over(own) - 1).join(base, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_own"))
    placed = ranked.alias("p").join(F.broadcast(runs).alias("r"), F.expr("p.length = r.length and p._rank >= r._from and p._rank < r._to"))
    at = F.col("_rank") - F.col("_from")
    return placed.select(
        *[F.col(f"p.{c}") for c in kept.columns],
        (F.col("_bin") + F.floor(at / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_per") * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, carry: list[Column | str] | None = None) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text, …) and pack the pieces; the ids themselves are carried unless ``carry`` says otherwise.

    A null or empty text is one piece that holds ``end_id`` alone; a long one is
    cut into pieces of ``capacity`` ids; a null id is kept. Repeated rows are
    documents of their own; an empty table gives an empty result; other columns
    are ignored. The plan is broadcast: some rows for each length up to
    ``capacity``, whatever the number of documents.
    """
    return pack(tokenized_pieces(docs, tokenizer, capacity, end_id), capacity, carry)
