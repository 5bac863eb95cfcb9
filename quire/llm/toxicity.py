"""Toxicity scores by a factorization machine over hashed terms.

score(text) = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct
terms of the text. The factors v let two terms weigh together what neither does
alone: a term without any effect of its own can matter beside another one. Terms
are hashed to buckets; those that the fit sends to zero are left out of the
model, so scoring looks up few of a text's words.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, those with
the lowest hashes of their ids); scores are computed for every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, cut, mixed, prepare

TRAIN_ROWS = 20_000
BUCKET_BITS, FACTORS, BATCH, DROPOUT = 22, 4, 128, 0.7
#: Fewest training texts of a term, and the size of weight and factors from which the second descent keeps it; chosen on validation rows, see the README.
MIN_TEXTS, KEEP_FROM = 3, 0.2
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class TermBuckets(Remembered):
    """Buckets of words, stripped of punctuation at their ends; -1 for those that ``known`` lacks."""

    def __init__(self, known: dict[int, int] | None = None, most: int = 100_000):
        super().__init__(most)
        self.known = known

    def make(self, word: bytes) -> int:
        term = word.strip(_EDGE)
        bucket = xxhash.xxh64_intdigest(term) >> (64 - BUCKET_BITS) if term else -1
        return bucket if self.known is None else self.known.get(bucket, -1)


def term_buckets(text: str | None, buckets: TermBuckets) -> set[int]:
    found = set(map(buckets.__getitem__, set((text or "").lower().encode().split())))
    found.discard(-1)
    return found


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, active: list[int]) -> float:
        """``active``: positions of a text's terms among ``buckets``."""
        z = self.bias
        if active:
            v = self.factors[active]
            z += self.weights[active].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def one_of_copies(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Places of rows of which no earlier one has the same label and four smallest hashes: a group of near copies mostly counts once."""
    seen, keep = set(), []
    for i, terms in enumerate(rows):
        h = terms.astype(np.uint64)
        key = (labels[i], *(int(mixed(h + np.uint64(k << 40)).min()) if len(h) else -1 for k in range(1, 5)))
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return np.array(keep, np.int64)


def descend(model: Model, flat: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int, rate: float, rate_v: float, l1: float, l1_v: float, decay: float) -> Model:
    """``model`` after ``steps`` batches of AdaGrad on the logistic loss, with soft thresholds l1 for weights and l1_v for factors.

    ``flat`` holds the texts' terms as positions among the model's buckets, text
    i from starts[i] on. In each epoch half of the texts, at random, lose most
    of their terms (DROPOUT), so that a term has to tell by itself what its
    companions tell as well.
    """
    random = np.random.Generator(np.random.PCG64(11))
    bias, w, v = model.bias, model.weights.copy(), model.factors.copy()
    gb, gw, gv = 1e-2, np.full(w.shape, 1e-2), np.full(v.shape, 1e-2)
    n, columns = len(labels), range(v.shape[1])
    batches = max(1, n // BATCH)
    for _ in range(-(-steps // batches)):
        for block in np.array_split(random.permutation(n), batches):
            many = starts[block + 1] - starts[block]
            row = np.repeat(np.arange(len(block)), many)
            at = np.arange(many.sum()) + np.repeat(starts[block] - np.cumsum(many) + many, many)
            lost = random.choice([0, DROPOUT], len(block))  # half of the texts are seen whole
            there = random.random(len(at)) >= lost[row]
            row = row[there]
            used, term = np.unique(flat[at[there]], return_inverse=True)
            vu = v[used]
            sums = np.stack([np.bincount(row, vu[term, c], len(block)) for c in columns], axis=1)
            pairs = 0.5 * ((sums**2).sum(axis=1) - np.bincount(row, (vu**2).sum(axis=1)[term], len(block)))
            y = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[used][term], len(block)) + pairs, -30, 30)))
            e = (y - labels[block]) / len(block)
            gb += e.sum() ** 2
            bias -= rate * e.sum() / np.sqrt(gb)
            dw = np.bincount(term, e[row], len(used))
            dv = np.stack([np.bincount(term, e[row] * sums[row, c], len(used)) for c in columns], axis=1) - dw[:, None] * vu + decay * vu
            gw[used] += dw**2
            gv[used] += dv**2
            for x, d, g, step, shrink in ((w, dw, gw, rate, l1), (v, dv, gv, rate_v, l1_v)):
                step = step / np.sqrt(g[used])
                moved = x[used] - step * d
                x[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
    return Model(float(bias), model.buckets, w, v)


def fit(rows: list[np.ndarray], labels: np.ndarray, min_texts: int = MIN_TEXTS, keep_from: float = KEEP_FROM) -> Model:
    """A factorization machine for the terms of ``rows``; near copies count once.

    Every term of ``min_texts`` texts or more takes part, whatever it tells by
    itself. A first descent has soft thresholds, which send to zero what neither
    alone nor in pairs lowers the loss. Terms whose weight and factors then
    measure ``keep_from`` or more stay, and a second descent without thresholds
    starts anew on them. Without rows of both labels only the bias is set.
    """
    keep = one_of_copies(rows, labels)
    rows, labels = [rows[i] for i in keep], labels[keep]
    n, positive = len(rows), int(labels.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    none = Model(bias, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    if not 0 < positive < n:
        return none
    flat, of = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])

    def started(buckets: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
        place = np.full(1 << BUCKET_BITS, -1, np.int64)
        place[buckets] = np.arange(len(buckets))
        there = place[flat] >= 0
        factors = np.random.Generator(np.random.PCG64(12)).normal(0, 0.02, (len(buckets), FACTORS))
        return Model(bias, buckets, np.zeros(len(buckets)), factors), place[flat[there]], np.searchsorted(of[there], np.arange(n + 1))

    chosen = np.flatnonzero(np.bincount(flat, minlength=1 << BUCKET_BITS) >= min_texts)
    if not len(chosen):
        return none
    first = descend(*started(chosen), labels, steps=1500, rate=0.2, rate_v=0.05, l1=2e-3, l1_v=1e-3, decay=0)
    tells = np.abs(first.weights) + np.sqrt((first.factors**2).sum(axis=1))
    chosen = chosen[tells >= keep_from]
    if not len(chosen):
        return none
    return descend(*started(chosen), labels, steps=4000, rate=0.2, rate_v=0.1, l1=0, l1_v=0, decay=1e-4)


def held_out(doc_id: Column) -> Column:
    """Rows that no model sees: CRC-32 of the id as text is divisible by 5; so are null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on documents with a label that are not held out; at most ``rows`` of them.

    Rows that repeat a doc_id count once, with the least of their term sets; an
    id with both labels counts once for each.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("doc_id")))
    some = cut(some.distinct().orderBy(F.xxhash64("doc_id"), "toxic").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = TermBuckets()
        for batch in batches:
            terms = [np.array(sorted(term_buckets(x.as_py(), buckets)), np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), batch.column(2)], ["doc_id", "terms", "toxic"])

    found = docs.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, terms binary, toxic int")
    # one row for each labelled id, of which there are at most ``rows``
    found = found.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms"))
    known = sorted((r.doc_id, r.terms, r.toxic) for r in found.toLocalIterator())
    return fit([np.frombuffer(t, np.int32).astype(np.int64) for _, t, _ in known], np.array([y for _, _, y in known], float))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...).

    A null or empty text has the score of a text without any known term.
    Repeated rows get equal scores; texts are read whole, however long; ids,
    languages and sources are not read, and other columns are ignored. A null id
    counts as held out. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of MIN_TEXTS training texts at most, whatever the size of the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        buckets = TermBuckets({int(b): i for i, b in enumerate(model.buckets)})
        for batch in batches:
            scores = [model.score(sorted(term_buckets(x.as_py(), buckets))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) and score ``docs``; see ``score_documents``. Empty tables give empty results."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prepare(docs.sparkSession)
    return score_documents(docs, train(docs, labels, rows))
