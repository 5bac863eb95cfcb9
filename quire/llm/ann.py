"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised by codebooks of their own; a cell is a
pair of centroids. Codebooks are fitted on a bounded sample, by splitting at the
median along the main direction, so that each centroid stands for as many vectors
and a dense group gets as many centroids as its rows call for. All vectors are put
into cells. A query walks pairs of centroids by their summed squared distance, from a
heap, until the cells that it has passed hold enough vectors; these are reranked
by their distance in double precision.

How many are enough is told by an audit: AUDIT queries are compared with all
vectors, and as many are reranked as it takes to reach RECALL of their true
neighbours. Up to LEAST vectors are always reranked, so small tables are searched
exactly.

Equal vectors are one entry, with the few ids that can be in a result. Neighbouring
cells are gathered in groups, PIECES of them until a group is as large as a block
may be; a full cell that many queries visit is several groups. A query goes to each
group once, whatever number of its cells it visits, and only the nearest of each
group leave it. So up to PIECES blocks of vectors, rows grow with the queries, and
beyond that with the queries and the blocks; comparisons grow with what is reranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare, small, stored, tidy

#: Vectors that the codebooks are fitted on at most, and numbers in these; entries of a cell that are aimed at; most bits of a half's codebook.
SAMPLE, SAMPLE_NUMBERS, CELL, MOST_BITS = 32_768, 4_000_000, 64, 9
#: Queries compared with all vectors, share of their neighbours to be reached, entries that are reranked in any case.
AUDIT, RECALL, LEAST = 128, 0.98, 4096
#: Numbers in a block of entries or of queries at most, about; groups of cells that are aimed at, if these are smaller than blocks.
BLOCK_NUMBERS, PIECES = 1 << 21, 64
#: Pairs of entries and queries that are compared exactly at once.
PAIRS = 1 << 14


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, e): distinct rows that take part."""
    kind = vectors.schema[vec_col].dataType
    keep = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind if keep else "array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)).distinct()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def codebook(x: np.ndarray, bits: int) -> np.ndarray:
    """The means of the parts of ``x`` that ``bits`` splits at the median along the main direction leave."""
    parts = [x]
    for _ in range(bits):
        split = []
        for p in parts:
            c = p - p.mean(axis=0)
            v = c[np.argmax((c * c).sum(axis=1))] if len(c) else np.zeros(x.shape[1])
            for _ in range(8):  # power iteration
                v = c.T @ (c @ v)
                v = v / max(float(np.sqrt(v @ v)), 1e-300)
            order = np.argsort(c @ v, kind="stable")
            split += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = split
    return np.stack([p.mean(axis=0) for p in parts])


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` and ``y``, to rounding."""
    with np.errstate(all="ignore"):
        return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x`` and rows of ``y``, one by one, summed in order; powers of two keep squares from over- and underflow."""
    d = x - y
    top = np.abs(d).max(axis=1, initial=0.0)
    power = np.where(top > 0, np.frexp(top)[1], 0)
    d = np.ldexp(d, -power[:, None])
    total = np.zeros(len(d))
    for column in d.T:
        total += column * column
    return np.ldexp(np.sqrt(total), power)


def nearest(q: np.ndarray, e: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q`` the ``k`` nearest rows of ``e``, equal distances by ``first``: its number, theirs and their distances."""
    norms, slack = (e * e).sum(axis=1), 1e-14 * q.shape[1]
    for at in range(0, len(q), 256):
        rough = squares(q[at : at + 256], e)
        for i, row in enumerate(rough):
            chosen = np.arange(len(e))
            if len(e) > k:
                with np.errstate(all="ignore"):
                    bound = np.partition(row, k - 1)[k - 1] + 4 * slack * (q[at + i] @ q[at + i] + norms.max())
                if np.isfinite(bound):
                    chosen = np.flatnonzero(row <= bound)
            far = exact(np.broadcast_to(q[at + i], (len(chosen), q.shape[1])), e[chosen])
            order = np.lexsort((first[chosen], far))[:k]
            yield at + i, chosen[order], far[order]


def closest(q: np.ndarray, e: np.ndarray, first: np.ndarray, visits: Iterable[tuple[int, int, np.ndarray]], k: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``e`` and distances: for each query the ``k`` nearest of the entries that it visits, equal distances by ``first``.

    ``visits`` are ranges of ``e`` that don't overlap, each with the queries that visit
    it. Rough squares, with their error on either side, tell which pairs are compared
    exactly: those that can be nearer than the k-th that is known. ``scale`` is the
    power of two that keeps squares from overflow.
    """
    a, b = np.ldexp(q, -scale), np.ldexp(e, -scale)
    slack, aa, bb = 4e-14 * q.shape[1], (a * a).sum(axis=1), (b * b).sum(axis=1)
    best, bound = np.full((len(q), k), np.inf), np.full(len(q), np.inf)
    found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, low = (np.concatenate(x) for x in zip(*pending))
        i, j = i[low <= bound[i]], j[low <= bound[i]]
        far = [exact(q[i[at : at + PAIRS]], e[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
        i, j, far = (np.concatenate(x) for x in ([found[0], i], [found[1], j], [found[2], *far]))
        order = np.lexsort((first[j], far, i))
        i, j, far = i[order], j[order], far[order]
        near = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[near], j[near], far[near]

    for start, stop, asked in visits:
        for at in range(start, stop, 1024):
            piece = slice(at, min(at + 1024, stop))
            for of in range(0, len(asked), 256):
                n = asked[of : of + 256]
                sums = aa[n][:, None] + bb[piece]
                rough, error = np.maximum(sums - 2 * (a[n] @ b[piece].T), 0), slack * sums + 1e-300
                low = rough - error
                some = np.flatnonzero((low <= bound[n][:, None]).any(axis=1))
                if not len(some):
                    continue
                n, low = n[some], low[some]
                best[n] = np.partition(np.concatenate([best[n], (rough + error)[some]], axis=1), k - 1, axis=1)[:, :k]
                bound[n] = best[n].max(axis=1)
                i, j = np.nonzero(low <= bound[n][:, None])
                pending.append((n[i], j + at, low[i, j]))
                if sum(len(x[0]) for x in pending) > 16 * PAIRS:
                    found, pending = settled(), []
    return settled() if pending else found


class MultiIndex:
    """Two codebooks and the number of entries in each cell."""

    def __init__(self, sample: np.ndarray, bits: int, scale: int):
        self.dim, self.scale = sample.shape[1], scale
        self.cut = max(1, self.dim // 2)
        x = np.ldexp(sample, -scale)
        self.books = [codebook(x[:, : self.cut], bits), codebook(x[:, self.cut :], bits if self.dim > 1 else 0)]
        self.counts = np.zeros([len(b) for b in self.books], np.int64)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        x = np.ldexp(x, -self.scale)
        return [squares(half, book) for half, book in zip((x[:, : self.cut], x[:, self.cut :]), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (d.argmin(axis=1) for d in self.distances(x))
        return one * len(self.books[1]) + two

    def groups(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each cell its first group and the number of its groups: neighbouring cells share one of about ``size`` entries, larger cells have several."""
        counts = self.counts.ravel()
        run = (np.cumsum(counts) - counts) // size
        own = np.maximum(1, (counts + size // 2) // size)
        most = np.zeros(run.max() + 1, np.int64)
        np.maximum.at(most, run, own)
        return (np.cumsum(most) - most)[run], own

    def passed(self, one: np.ndarray, two: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Entries that a query with these distances reranks until it has passed each of ``cells``."""
        sums = (one[:, None] + two).ravel()
        order = np.argsort(sums, kind="stable")
        upto = np.cumsum(self.counts.ravel()[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return upto[place[cells]]

    def walk(self, one: np.ndarray, two: np.ndarray, enough: int) -> list[int]:
        """Cells by summed distance, from a heap, until they hold ``enough`` entries."""
        a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        near, far, got, out = one[a], two[b], 0, []
        heap = [(near[0] + far[0], 0, 0)]
        while heap and got < enough:
            _, i, j = heapq.heappop(heap)
            held = int(self.counts[a[i], b[j]])
            if held:
                out.append(int(a[i] * len(b) + b[j]))
                got += held
            if j + 1 < len(b):
                heapq.heappush(heap, (near[i] + far[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (near[i + 1] + far[0], i + 1, 0))
        return out


def fitted(entries: DataFrame, dim: int, count: int) -> MultiIndex:
    """An index without entries yet, its codebooks fitted on a sample by hash of at most about SAMPLE vectors."""
    rows = min(SAMPLE, max(64, SAMPLE_NUMBERS // dim))
    chosen = entries if count <= rows else entries.where(F.pmod(F.xxhash64(F.lit("codebook"), "e"), F.lit(1 << 40)) < (rows << 40) // count)
    sample = np.array([r[0] for r in sorted(chosen.select("e").limit(2 * rows).collect())], np.float64).reshape(-1, dim)
    top = entries.agg(F.max(F.array_max(F.transform("e", lambda x: F.abs(x).cast("double"))))).first()[0]
    cells = min(count / CELL, (len(sample) / 16) ** 2)
    bits = min(MOST_BITS, max(0, int(np.log2(max(cells, 1)) / 2)))
    return MultiIndex(sample, bits, int(np.frexp(top)[1]))


def in_cells(entries: DataFrame, index: MultiIndex) -> DataFrame:
    """``entries`` (e, ids) with their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = index.cells(matrix(batch.column("e"), index.dim))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *batch.columns], ["cell", *batch.schema.names])

    return entries.mapInArrow(run, T.StructType([T.StructField("cell", T.IntegerType()), *entries.schema.fields]))


def enough(entries: DataFrame, queries: DataFrame, index: MultiIndex, k: int, recall: float, least: int) -> int:
    """Entries to be reranked so that AUDIT queries, by hash, reach ``recall`` of their true neighbours among ``entries`` (cell, e, ids)."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDIT).collect()
    q = np.array([r["e"] for r in asked], np.float64).reshape(-1, index.dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in q]
        for batch in batches:
            e, cells = matrix(batch.column("e"), index.dim), batch.column("cell").to_numpy()
            ids = batch.column("ids").to_pylist()
            first = np.array([i[0] for i in ids], np.int64)
            for n, near, far in nearest(q, e, first, k + 1):
                found = [(d, int(first[i]), int(cells[i])) for i, d in zip(near.tolist(), far.tolist()) if ids[i] != [asked[n]["query_id"]]]
                best[n] = sorted(best[n] + found)[:k]
        rows = [(n, *x) for n, found in enumerate(best) for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["n", "far", "first", "cell"])

    found = entries.select("cell", "e", "ids").mapInArrow(run, "n int, far double, first long, cell int")
    order = Window.partitionBy("n").orderBy("far", "first")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("n", "cell").collect()
    one, two = index.distances(q)
    needed = np.sort(np.concatenate([index.passed(one[r["n"]], two[r["n"]], np.array([r["cell"]])) for r in true] or [np.zeros(1, np.int64)]))
    return max(least, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]))


def probes(queries: DataFrame, index: MultiIndex, groups: tuple[np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """(cells, reach, q, query_id, e): each query with the groups of cells that it visits; it visits all cells up to a summed distance of ``reach``."""
    group, own = groups
    width = len(index.books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = index.distances(matrix(batch.column("e"), index.dim))
            for i in range(len(batch)):
                cells = np.array(index.walk(one[i], two[i], depth))
                reach = float((one[i][cells // width] + two[i][cells % width]).max()) * (1 + 1e-9) + 1e-14 * index.dim  # other batches round otherwise
                n = own[cells]
                some = np.unique(np.repeat(group[cells] - np.cumsum(n) + n, n) + np.arange(n.sum()))
                row = batch.slice(i, 1)
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    many = row.take(pa.array([0] * len(part)))
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([reach] * len(part)), *many.columns], ["cells", "reach", *many.schema.names])

    return queries.mapInArrow(run, T.StructType([T.StructField("cells", T.IntegerType()), T.StructField("reach", T.DoubleType()), *queries.schema.fields]))


def reranked(entries: DataFrame, asked: DataFrame, index: MultiIndex, groups: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(q, query_id, far, ids): the nearest entries of each group of cells that a query visits."""
    dim, width, scale = index.dim, len(index.books[1]), index.scale
    parts = cut(asked.groupBy("cells").agg(F.ceil(F.count("*") / block_size(dim)).cast("int").alias("parts")))  # a row a group
    held = np.flatnonzero(index.counts)
    places = pa.table({"cell": pa.array(held, pa.int32()), "cells": pa.array(groups[0][held], pa.int32()), "own": pa.array(groups[1][held], pa.int32())})
    placed = entries.join(F.broadcast(entries.sparkSession.createDataFrame(places)), "cell").withColumn("cells", (F.col("cells") + F.pmod(F.xxhash64("e"), F.col("own"))).cast("int"))
    # both sides' keys have to be of one type: rows are dealt by their hashes
    left = placed.join(small(parts), "cells").select("cells", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell", "e", "ids")
    right = asked.join(small(parts), "cells").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).select("cells", "part", "reach", "q", "query_id", "e")

    def run(e: pa.Table, q: pa.Table) -> pa.Table:
        out = []
        if len(e) and len(q):
            e = e.sort_by("cell")
            cell, x = e.column("cell").to_numpy(), matrix(e.column("e"), dim)
            first = np.array([i[0] for i in e.column("ids").to_pylist()], np.int64)
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            for at in range(0, len(q), 4096):
                some = q.slice(at, 4096)
                y, reach = matrix(some.column("e"), dim), some.column("reach").to_numpy()
                one, two = index.distances(y)
                visits = ((i, j, np.flatnonzero(one[:, cell[i] // width] + two[:, cell[i] % width] <= reach)) for i, j in zip(starts, [*starts[1:], len(e)]))
                n, near, far = closest(y, x, first, visits, k + 1, scale)
                out.append(pa.table({"q": some.column("q").take(pa.array(n)), "query_id": some.column("query_id").take(pa.array(n)), "far": far, "ids": e.column("ids").take(pa.array(near))}))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))], ["q", "query_id", "far", "ids"])

    keys = ["cells", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "q long, query_id long, far double, ids array<long>")


def block_size(dim: int) -> int:
    """Entries or queries in a block at most, about."""
    return max(16, BLOCK_NUMBERS // dim)


@tidy
def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL, least: int = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest vectors found for each row for which ``is_query`` (of vec_id) is true.

    ``score`` is the Euclidean distance of the vectors as they are, in double
    precision; equal ones are ranked by vec_id. Vectors that are null, empty or
    zero, or hold null or non-finite components, and rows without an id take no part.
    Repeated rows count once; rows with the query's id are its own. An id with
    several vectors is a candidate by each of them, and asks once for each.
    Vectors of other lengths than the query's are never compared: each length
    has an index of its own. With fewer candidates than ``k``, all are returned;
    an empty table gives an empty result. Columns beside the two are ignored.
    """
    prepare(vectors.sparkSession)
    rows = stored(usable(vectors, id_col, vec_col))
    order = Window.partitionBy("e").orderBy("vec_id")
    entries = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries)
    asked = stored(rows.where(is_query).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "e"))
    found = rows.sparkSession.createDataFrame([], "q long, query_id long, far double, ids array<long>")
    for dim, count in sorted(tuple(r) for r in entries.groupBy(F.size("e")).count().collect()):  # one row a length
        own, theirs = entries.where(F.size("e") == dim), asked.where(F.size("e") == dim)
        index = fitted(own, dim, count)
        placed = stored(in_cells(own, index))
        for cell, held in placed.groupBy("cell").count().collect():  # a row a cell
            index.counts.flat[cell] = held
        depth = enough(placed, theirs, index, k, recall, least)
        groups = index.groups(min(block_size(dim), max(CELL, -(-count // PIECES))))
        found = found.unionByName(reranked(placed, stored(probes(theirs, index, groups, depth)), index, groups, k))
    found = found.select("q", "query_id", "far", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("far", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("far").alias("score"))
