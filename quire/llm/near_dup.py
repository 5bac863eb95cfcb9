"""Near-duplicate documents by a multi-index Hamming join of b-bit minwise signatures.

A document's signature has one byte (b = 8) for each of ``chunks * chunk_size``
minwise hashes. Two signatures that differ in at most t symbols, with
t = 2 * chunks - 1, have some chunk in which they differ in one symbol or none
(pigeonhole). Each chunk is therefore indexed once for each symbol that may be
wrong, with that symbol left out: equal keys are exactly the pairs of chunks
within one error, so every pair within distance t meets. Most pairs beyond t
meet as well: at similarity 0.8 a chunk of 7 is within one error with
probability 0.577, and all 12 chunks fail in 3 of 100,000 cases.

Documents with equal sets are one vertex. Documents under one key are first
compared with the smallest of them, a star instead of all pairs. Keys whose
members are then still apart are gone through again, for links between the parts:
such keys that share members are a family, which is compared as a whole or key by
key, whichever takes fewer comparisons. Either way the pairs that share a key
count and no others, so the result is one of both. Members of one part lie in
blocks of their own, which aren't compared with each other. Tasks hold hashes of
shingles and return the few links that join parts, never the pairs they compared.
All links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, cut, dealt_blocks, mixed, prepare, small, tidy, word_hashes

CHUNKS, CHUNK_SIZE = 12, 7


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``width`` words.

    A-Z is lower-cased, words end at ASCII white space. Fewer words than
    ``width`` are one shingle, no words give none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out + h[k : k + n]) * np.uint64(0x2545F4914F6CDD1D)
    return np.unique(out)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, (2, n), dtype=np.uint64)
    return r[0] * np.uint64(2) + np.uint64(1), r[1]


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = 1024) -> bytes:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), rows):
        np.minimum(low, (found[at : at + rows, None] * a + b).min(axis=0), out=low)
    return (mixed(low) & np.uint64(255)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, width: int, chunks: int, chunk_size: int) -> DataFrame:
    """(doc_id, n_shingles, fp, sig): set size, 128-bit fingerprint of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = word_hashes(), multipliers(chunks * chunk_size)
        for batch in batches:
            n, fp, sig = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width, hashes)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(s, a, b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp binary, sig binary")


def index_keys(reps: DataFrame, chunks: int, chunk_size: int) -> DataFrame:
    """(key, rep, n): one key for each chunk and each of its symbols left out."""
    if chunk_size != 7 or chunks * chunk_size >= 1 << 15:
        raise ValueError("a key holds the chunk's number and six symbols in 63 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(many, chunks, chunk_size).astype(np.int64)
            keys = np.empty((many, chunks, chunk_size), np.int64)
            for j in range(chunk_size):
                key = np.arange(chunks, dtype=np.int64) * chunk_size + j
                for i in range(chunk_size):
                    if i != j:
                        key = key << 8 | sig[:, :, i]
                keys[:, :, j] = key
            per = chunks * chunk_size
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), per)), pa.array(np.repeat(np.asarray(batch.column(1)), per))], ["key", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "key long, rep long, n long")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= similarity * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(small(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = word_hashes(), OrderedDict()

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            text = text.as_py()
            key = (doc, len(text or ""), hash(text))
            if key not in recent:
                recent[key] = shingles(text, width, hashes)
                if len(recent) > 64:
                    recent.popitem(last=False)
            else:
                recent.move_to_end(key)
            return recent[key]

        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(batch.num_rows):
                x, y = of(a[i], batch.column(2)[i]), of(b[i], batch.column(3)[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) for the documents of ``ids`` (rep): the hashes of ``shingles`` as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(x.as_py(), width, hashes).tobytes() for x in batch.column(1)], pa.binary())], ["rep", "shingles"])

    return docs.join(small(ids.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(run, "rep long, shingles binary")


def links_between(members: DataFrame, docs: DataFrame, width: int, similarity: int, chunks: int, chunk_size: int) -> DataFrame:
    """Links (a, b) that join labels within the units of ``members`` (unit, rep, label, n), of pairs that share a key.

    A task counts what sets share by postings of their shingles and returns a
    forest of the links it finds: fewer rows than members, whatever the number
    of pairs.
    """
    dealt = cut(dealt_blocks(members))
    sets = cut(shingle_sets(docs, dealt.select("rep").distinct(), width))
    a, b = multipliers(chunks * chunk_size)

    def share_key(x: bytes, y: bytes) -> bool:
        same = np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)
        return bool((same.reshape(chunks, chunk_size).sum(axis=1) >= chunk_size - 1).any())

    def found(reps: list[int], sides: list[int], labels: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sizes, sides = np.array([len(x) for x in sets]), np.array(sides)
        tokens, code = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(code, kind="stable")
        postings, starts = owner[order], np.searchsorted(code[order], np.arange(len(tokens) + 1))
        counts, ends, low = starts[1:] - starts[:-1], np.cumsum(sizes), sides.min()
        one = low == sides.max()
        root = {x: x for x in labels}
        known: dict[int, bytes] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def sketch(i: int) -> bytes:
            if i not in known:
                known[i] = signature(sets[i], a, b)
            return known[i]

        for i in range(len(sets)):
            if one or sides[i] == low:
                own = code[ends[i] - sizes[i] : ends[i]]
                n = counts[own]
                at = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(postings[at], minlength=len(sets))
                hit = (both > 0) & (100 * both >= similarity * (sizes + sizes[i] - both))
                for j in np.flatnonzero(hit):
                    x, y = find(labels[i]), find(labels[j])
                    if x != y and share_key(sketch(i), sketch(int(j))):
                        root[max(x, y)] = min(x, y)
                        yield min(reps[i], reps[j]), max(reps[i], reps[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, ([], [], [], [])

        def close() -> pa.RecordBatch:
            pairs = list(found(*own)) if len(own[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for task, side, rep, label, x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if task != at:
                    yield close()
                    at, own = task, ([], [], [], [])
                for column, value in zip(own, (rep, side, label, np.frombuffer(x, np.uint64))):
                    column.append(value)
        yield close()

    rows = dealt.join(sets, "rep").select("task", "side", "rep", "label", "shingles").repartition("task").sortWithinPartitions("task", "side", "rep")
    return rows.mapInArrow(run, "a long, b long").distinct()


def units(apart: DataFrame) -> DataFrame:
    """(unit, rep, label, n) from ``apart`` (key, rep, n, label), keys of several labels: families, or their keys if these take fewer comparisons.

    Keys with the same members are one unit.
    """
    key = apart.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"))
    key = cut(key.select("key", "first", F.xxhash64(F.lit(1), "first", "last", "size", "x").alias("unit")))
    keyed = cut(apart.join(small(key), "key").select("unit", "first", "rep", "label", "n").distinct())
    family = connected_components(keyed.select(F.col("first").alias("a"), F.col("rep").alias("b"))).select(F.col("id").alias("first"), F.col("component").alias("family"))
    keyed = cut(keyed.join(small(cut(family)), "first").drop("first"))
    whole = keyed.select(F.xxhash64(F.lit(0), "family").alias("unit"), "family", "rep", "label", "n").distinct()

    def comparisons(x: DataFrame) -> DataFrame:
        """(family, cost): pairs of different labels in the units of each family, twice."""
        per = x.groupBy("family", "unit", "label").agg(F.count("*").cast("double").alias("m"))
        per = per.groupBy("family", "unit").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("cost"))
        return per.groupBy("family").agg(F.sum("cost").alias("cost"))

    better = comparisons(keyed).join(comparisons(whole).withColumnRenamed("cost", "cost_whole"), "family").where("cost < cost_whole").select("family")
    better = small(cut(better))
    return whole.join(better, "family", "left_anti").unionByName(keyed.join(better, "family", "left_semi").select(whole.columns)).select("unit", "rep", "label", "n")


@tidy
def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, chunks: int = CHUNKS, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Group ``docs`` (doc_id, text, ...) by links of Jaccard similarity >= similarity / 100.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links, itself included), kept (doc_id is that
    one). Null and empty texts, and texts of white space, have no shingles and
    link with nothing. Rows that repeat a doc_id are one document that has each
    of their texts. A null doc_id links with nothing, has a null component_id and
    is kept. An empty table gives an empty result; other columns are ignored.
    Texts are read whole, however long.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = cut(sketches(docs, width, chunks, chunk_size))
    some = made.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("fp", F.col("n_shingles").alias("n"), "sig").agg(F.min("doc_id").alias("rep"))
    same = some.groupBy("fp", "doc_id").agg(F.lit(1).alias("_")).join(reps.select("fp", "rep"), "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    index = index_keys(reps, chunks, chunk_size)
    low = cut(index.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1"))
    met = cut(index.join(small(low), "key"))
    stars = cut(met.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut(confirmed(stars, docs, width, similarity))

    # a key of two is settled by its star; larger ones may hold several parts still
    label = cut(connected_components(links).select(F.col("id").alias("rep"), F.col("component").alias("label")))
    met = met.where("size > 2").join(small(label), "rep", "left").select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))
    several = met.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    apart = cut(met.join(small(cut(several)), "key", "left_semi"))
    more = cut(links_between(cut(units(apart)), docs, width, similarity, chunks, chunk_size))

    label = connected_components(links.unionByName(more).unionByName(same))
    out = made.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
