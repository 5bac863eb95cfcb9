"""Near-duplicate embeddings by NN-descent.

Each vector keeps a list of its nearest neighbours known so far among vectors of
its label. Lists start from leaves of random hyperplane trees. A round joins the
neighbours of neighbours: around each pivot, those that have it in their list, or
are in its own, are compared with each other, and lists take what is nearer than
their last entry. Entries far below the threshold lead to no links and aren't
joined. Rounds end when few lists change.

Recall is audited with planted partners: vectors at just the threshold's cosine
from sampled ones, in a random direction, which no cluster helps to find. While
too few of them are found the number of trees is doubled; once that many leaves
cost as much as comparing all vectors of a label, these are compared.

A list whose last entry is still a link is saturated. It is enlarged WIDER times,
from the leaves; vectors whose lists are saturated even then are compared with each
other, block by block, for links between components, which join those. A link
that neither end lists has saturated lists at both ends, so none is lost there.
Then links are counted over whole components, and only counts leave a block; so a
cluster of thousands costs its comparisons but no table of its pairs.

Trees and rounds work on half-precision unit vectors; every link is confirmed in
double precision. Vectors of a label that are equal, or multiples of each other
by powers of two, are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, dealt_blocks, mixed, prepare, small, stored, tidy

K, TREES, LEAF, WIDER = 12, 4, 256, 3
#: Bits of a tree's path; its first ones make a leaf, the next REFINED ones split a large leaf.
PATH_BITS, REFINED = 40, 8
#: Entries of a list that lie further than this below the threshold aren't joined; what half precision may take off a cosine.
REACH, MARGIN = 0.18, 2e-3
#: Vectors that get a planted partner, about this many at any size, and the share of partners that must be found.
AUDIT_ROWS, AUDIT_RECALL = 2000, 0.97
#: Share of joined entries below which another round isn't worth while.
SETTLED = 0.05
#: Members of a part of a pivot's neighbours.
AROUND = 512
#: Members of a block of a component: 64, or more if that makes over 24 blocks, but 1024 at most.
BLOCK, BLOCKS, MOST = 64, 24, 1024

EDGE, EDGE_NAMES, EDGE_KINDS = "src long, dst long, sim float", ["src", "dst", "sim"], [pa.int64(), pa.int64(), pa.float32()]


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec): vec is null unless the row can link.

    Components are scaled by a power of two, so that the largest lies in 0.5 to 1
    and no square over- or underflows. vec holds floats if they are exact, which
    they are for a table of floats, else doubles; little-endian.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            for label, x in zip(batch.column(1), batch.column(2)):
                x = np.array(x.as_py(), np.float64) if label.is_valid and x.is_valid else np.empty(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if top > 0:
                    x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0
                    short = x.astype(np.float32)
                    out.append((short if (short == x).all() else x).tobytes())
                else:
                    out.append(None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "vec"])

    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return narrow.mapInArrow(run, "vec_id long, label string, dim int, vec binary")


def unit(vecs: list[bytes], dim: int) -> np.ndarray:
    """Rows of length one, in double precision, from ``vec`` values."""
    if all(len(v) == 4 * dim for v in vecs):
        x = np.frombuffer(b"".join(vecs), np.float32).reshape(len(vecs), dim).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in vecs]).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _halves(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.float16).reshape(len(sketches), -1).astype(np.float32)


def sketched(nodes: DataFrame, threshold: float, audit_rows: int) -> DataFrame:
    """(g, node, sketch): unit vectors as halves; g stands for label and dimension. Planted partners of node n are -n - 1."""
    every = max(1, nodes.count() // audit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for g, node, dim, vec, chosen in zip(*(c.to_pylist() for c in batch.columns)):
                x = unit([vec], dim)[0]
                rows = [(node, x)]
                if chosen and dim > 1:
                    u = np.random.Generator(np.random.PCG64(node)).normal(size=dim)
                    u -= (u @ x) * x
                    cosine = min(threshold + MARGIN, 1)
                    rows.append((-node - 1, cosine * x + np.sqrt(1 - cosine**2) * u / np.sqrt(u @ u)))
                for n, v in rows:
                    for column, value in zip(out, (g, n, v.astype(np.float16).tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["g", "node", "sketch"])

    chosen = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(every)) == 0
    return nodes.select("g", "node", "dim", "vec", chosen.alias("chosen")).mapInArrow(run, "g long, node long, sketch binary")


def grouped(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one value in the first column, which sorted rows have; in parts of ``most`` rows at most."""
    held: list[pa.RecordBatch] = []
    n, key = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        edges = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *edges], [*edges, len(keys)]):
            if held and (keys[a] != key):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            key = keys[a]
            while most and n + (b - a) > most:
                held.append(batch.slice(a, most - n))
                a += most - n
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            if b > a:
                held.append(batch.slice(a, b - a))
                n += b - a
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _gathered(make: Iterator[tuple], kinds: list[pa.DataType], names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows from tuples of arrays."""
    held, n = [], 0
    for x in make:
        held.append(x)
        n += len(x[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(zip(*held), kinds)], names)


def nearest_within(s: np.ndarray, ids: np.ndarray, floor: np.ndarray, k: int) -> tuple | None:
    """For each row of similarities ``s``, the k largest above its floor, as (src, dst, sim)."""
    if s.shape[1] > k:
        cols = np.argpartition(-s, k - 1, axis=1)[:, :k]
    else:
        cols = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    sims = np.take_along_axis(s, cols, 1)
    r, c = np.nonzero(sims > floor[:, None])
    return (ids[r], ids[cols[r, c]], sims[r, c]) if len(r) else None


@lru_cache(maxsize=16)
def _planes(dim: int, tree: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([5, tree])).normal(size=(PATH_BITS, dim)).astype(np.float32)


def leaf_lists(sketches: DataFrame, k: int, first: int, many: int, leaf: int) -> DataFrame:
    """Lists from ``many`` trees, the ``first`` one's number on: the nearest within a leaf of about ``leaf`` vectors of one label."""
    size = sketches.groupBy("g").agg(F.count("*").alias("of_label"))
    bits = F.least(F.greatest(F.lit(0), F.ceil(F.log2(F.col("of_label") / leaf))), F.lit(PATH_BITS - REFINED)).cast("int")
    sized = sketches.join(small(cut(size)), "g").select("g", "node", "sketch", bits.alias("bits"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(2).to_pylist()])
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                x, n = _halves(part.column(2)), np.asarray(part.column(3)).astype(np.uint64)
                group = np.asarray(part.column(0)).astype(np.uint64)
                for tree in range(first, first + many):
                    code = (x @ _planes(x.shape[1], tree).T > 0).astype(np.uint64) @ (np.uint64(1) << np.arange(PATH_BITS, dtype=np.uint64))
                    leaves = mixed(mixed(group + np.uint64(tree)) + (code & ((np.uint64(1) << n) - np.uint64(1)))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array((code >> n).astype(np.int64) & ((1 << REFINED) - 1), pa.int64()), part.column(1), part.column(2)], ["leaf", "rest", "node", "sketch"])

    rows = cut(sized.mapInArrow(placed, "leaf long, rest long, node long, sketch binary"))
    # leaves that many share go further down; what then still shares one is mostly near copies, and dealt out
    for split in (lambda n: F.pmod("rest", F.pow(F.lit(2), F.least(F.ceil(F.log2(n / leaf)), F.lit(REFINED))).cast("long")), lambda n: F.pmod(F.xxhash64("node"), F.ceil(n / leaf))):
        large = cut(rows.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf))
        rows = rows.join(small(large), "leaf", "left").withColumn("leaf", F.when(F.col("n").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", split(F.col("n"))))).drop("n")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Iterator[tuple]:
            for g in grouped(batches, 4 * leaf):
                if g.num_rows > 1:
                    x, ids = _halves(g.column(2)), np.asarray(g.column(1))
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    found = nearest_within(s, ids, np.full(len(ids), -1.5, np.float32), k)
                    if found:
                        yield found

        yield from _gathered(make(), EDGE_KINDS, EDGE_NAMES)

    return rows.select("leaf", "node", "sketch").repartition("leaf").sortWithinPartitions("leaf", "node").mapInArrow(nearest, EDGE)


def best_lists(edges: DataFrame, k: int, wide: DataFrame | None = None, most: int = 0) -> DataFrame:
    """(src, dst, sim, old, floor): the k nearest of each src, ``most`` for each of ``wide`` (src); each dst once.

    ``floor`` is what a new entry has to exceed: the last entry of a full list.
    """
    # one shuffle, by src, does for all that follows
    once = edges.repartition("src").groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    room = F.lit(k)
    if wide is not None:
        once = once.join(small(wide.withColumn("most", F.lit(most))), "src", "left")
        room = F.coalesce("most", room)
    own = Window.partitionBy("src")
    ranked = once.withColumn("r", F.row_number().over(own.orderBy(F.desc("sim"), "dst"))).where(F.col("r") <= room)
    floor = F.when(F.count("*").over(own) >= room, F.min("sim").over(own))
    return ranked.withColumn("floor", floor).select("src", "dst", "sim", "old", "floor")


def joined_neighbours(lists: DataFrame, sketches: DataFrame, k: int, from_sim: float, to_sim: float) -> DataFrame:
    """Candidates from one round: pairs around a pivot of which one is new to it, above a list's last entry.

    Only entries of ``from_sim`` or more are joined, and those of saturated lists
    (all of ``to_sim`` or more) not any further, since these vectors are compared
    with each other later. The neighbours of a hub are dealt into parts of about
    AROUND.
    """
    near = lists.where((F.col("sim") >= from_sim) & (F.coalesce("floor", F.lit(-1.0)) < to_sim))
    none = F.lit(None).cast("float").alias("floor")
    around = near.select(F.col("src").alias("pivot"), F.col("dst").alias("node"), "old", none).unionByName(near.select(F.col("dst").alias("pivot"), F.col("src").alias("node"), "old", "floor"))
    hubs = cut(around.groupBy("pivot").agg(F.ceil(F.count("*") / AROUND).alias("parts")).where("parts > 1"))
    part = F.lit(0)
    if not hubs.isEmpty():
        around, part = around.join(small(hubs), "pivot", "left"), F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    members = around.withColumn("task", F.xxhash64("pivot", part)).join(sketches.select("node", "sketch"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Iterator[tuple]:
            for g in grouped(batches, 4 * AROUND):
                # a node that is in the pivot's list and has it in its own comes twice, rows with a floor first
                ids, at = np.unique(np.asarray(g.column(1)), return_index=True)
                old = np.zeros(len(ids), bool)
                np.logical_or.at(old, np.searchsorted(ids, np.asarray(g.column(1))), np.asarray(g.column(3).to_numpy(zero_copy_only=False), bool))
                if len(ids) > 1 and not old.all():
                    x, floor = _halves(g.column(2).take(pa.array(at))), np.asarray(g.column(4))[at]
                    s = x @ x.T
                    np.fill_diagonal(s, -2)
                    s[np.ix_(old, old)] = -2
                    found = nearest_within(s, ids, floor, min(k, len(ids)))
                    if found:
                        yield found

        yield from _gathered(make(), EDGE_KINDS, EDGE_NAMES)

    dealt = members.select("task", "node", "sketch", "old", F.coalesce("floor", F.lit(-1.5)).cast("float").alias("floor"))
    return dealt.repartition("task").sortWithinPartitions("task", "node", F.desc("floor")).mapInArrow(run, EDGE)


def descended(lists: DataFrame, sketches: DataFrame, k: int, from_sim: float, to_sim: float) -> DataFrame:
    """``lists`` after rounds, until few of the entries that are joined are new."""
    while True:
        new, near = lists.where((F.col("sim") >= from_sim) & (F.coalesce("floor", F.lit(-1.0)) < to_sim)).agg(F.count_if(~F.col("old")), F.count("*")).first()
        if new <= SETTLED * near:
            return lists
        made = joined_neighbours(lists, sketches, k, from_sim, to_sim).withColumn("old", F.lit(False))
        lists = stored(best_lists(lists.drop("floor").withColumn("old", F.lit(True)).unionByName(made), k))


def saturated(lists: DataFrame, threshold: float) -> DataFrame:
    """(src) of lists whose entries all may be links, so that more may lie beyond, or elsewhere if the list is short."""
    return lists.groupBy("src").agg(F.min("sim").alias("low")).where(F.col("low") >= threshold - MARGIN).select("src")


def planted_recall(sketches: DataFrame, lists: DataFrame, threshold: float) -> float:
    """The share of planted partners that are found: a list of either end has the other; 1 without any.

    Pairs with a saturated list are left out: in a cluster others are nearer, and
    such vectors are compared with each other later.
    """
    partner = F.greatest("node", -F.col("node") - 1).alias("node")
    full = saturated(lists, threshold).select(F.col("src").alias("node")).select(partner).distinct()
    planted = sketches.where("node < 0").select(partner).join(full, "node", "left_anti")
    found = lists.where("src = - dst - 1").select(F.greatest("src", "dst").alias("node")).distinct().withColumn("found", F.lit(1))
    return planted.join(found, "node", "left").agg(F.avg(F.coalesce("found", F.lit(0)))).first()[0] or (1.0 if planted.isEmpty() else 0.0)


def neighbour_lists(nodes: DataFrame, threshold: float, k: int, trees: int, leaf: int) -> tuple[DataFrame, DataFrame, float]:
    """(lists, wanting, recall): entries (src, dst, sim), nodes whose lists may miss links, recall of planted partners."""
    sketches = stored(sketched(nodes, threshold, AUDIT_ROWS))
    largest = sketches.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    from_sim, done, new, lists = threshold - REACH, 0, trees, None
    while True:
        made = leaf_lists(sketches, k, done, new, leaf).withColumn("old", F.lit(False))
        lists = stored(best_lists(made if lists is None else lists.drop("floor").unionByName(made), k))
        lists = descended(lists, sketches, k, from_sim, threshold - MARGIN)
        done += new
        recall = planted_recall(sketches, lists, threshold)
        if recall >= AUDIT_RECALL or done * leaf >= largest:
            break
        new = done
    real = lists.where("src >= 0 and dst >= 0").drop("floor")
    if recall < AUDIT_RECALL:
        return real, nodes.select(F.col("node").alias("src")), recall
    sketches = sketches.where("node >= 0")
    wide = cut(saturated(real, threshold))
    if not wide.isEmpty():
        # longer lists come from the leaves: what a full list left out there no neighbour need know
        made = leaf_lists(sketches, WIDER * k, 0, done, leaf).join(small(wide), "src", "left_semi").withColumn("old", F.lit(False))
        real = stored(best_lists(real.unionByName(made), k, wide, WIDER * k))
        wide = cut(saturated(real, threshold))
    return real, wide, recall


def links_across(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): components of which members link, from all pairs of ``members`` (g, node, dim, vec, component) of a label."""
    dealt = dealt_blocks(members.select(F.col("g").alias("unit"), F.col("node").alias("rep"), F.col("component").alias("label"), F.lit(1).alias("n")))
    dealt = dealt.join(members.select(F.col("node").alias("rep"), "dim", "vec"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Iterator[tuple]:
            for g in grouped(batches):
                x, c, side = unit(g.column(4).to_pylist(), g.column(3)[0].as_py()), np.asarray(g.column(2)), np.asarray(g.column(1))
                low, high = side == side.min(), side == side.max()
                i, j = np.nonzero((x[low] @ x[high].T >= threshold) & (c[low][:, None] != c[high]))
                if len(i):
                    ends = np.unique(np.sort(np.stack([c[low][i], c[high][j]], axis=1), axis=1), axis=0)
                    root = {int(e): int(e) for e in np.unique(ends)}
                    keep = []
                    for n, (a, b) in enumerate(ends.tolist()):
                        while root[a] != a:
                            a = root[a]
                        while root[b] != b:
                            b = root[b]
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            keep.append(n)
                    yield ends[keep, 0], ends[keep, 1]

        yield from _gathered(make(), [pa.int64(), pa.int64()], ["a", "b"])

    dealt = dealt.select("task", "side", "label", "dim", "vec").repartition("task").sortWithinPartitions("task", "side")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def component_links(nodes: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """(node, links): how many vectors each node of a component links with, by blocks of its members."""
    members = nodes.join(component.select(F.col("id").alias("node"), "component"), "node").select("component", "node", "dim", "vec", "many")
    n = F.count("*")
    size = members.groupBy("component").agg(F.greatest(F.least(F.ceil(n / BLOCK), F.lit(BLOCKS)), F.ceil(n / MOST)).cast("int").alias("blocks"))
    placed = members.join(size, "component").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the task (i, j), i <= j, compares block i with block j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("o", other).withColumn("task", F.xxhash64("component", F.least("b", "o"), F.greatest("b", "o")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Iterator[tuple]:
            for g in grouped(batches):
                x, ids, many, b = unit(g.column(3).to_pylist(), g.column(2)[0].as_py()), np.asarray(g.column(1)), np.asarray(g.column(4)), np.asarray(g.column(5))
                low, high = b == b.min(), b == b.max()
                hit = x[low] @ x[high].T >= threshold
                if b.min() == b.max():
                    np.fill_diagonal(hit, False)
                    yield ids, hit @ many
                else:
                    yield ids[low], hit @ many[high]
                    yield ids[high], hit.T @ many[low]

        yield from _gathered(make(), [pa.int64(), pa.int64()], ["node", "links"])

    dealt = dealt.select("task", "node", "dim", "vec", "many", "b").repartition("task").sortWithinPartitions("task", "b", "node")
    return dealt.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


@tidy
def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = K, trees: int = TREES, leaf: int = LEAF, report: Callable[[float], None] | None = None) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``threshold``.

    Returns one row per row of ``vectors`` (vec_id, embedding, label): vec_id,
    n_links (other rows linked directly), component_id (the smallest vec_id
    reachable over links, itself included), kept (vec_id is that one). A null
    label, and a null, empty, zero or not wholly finite vector, link with
    nothing; vectors of different lengths don't link. Repeated rows are equal
    vectors and link. A null vec_id links, but is no component's id unless all
    are null. An empty table gives an empty result; other columns are ignored.
    ``report`` is called with the recall of planted partners.
    """
    prepare(vectors.sparkSession)
    rows = cut(usable_vectors(vectors))
    nodes = rows.where("vec is not null").groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("many"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("g", F.xxhash64("label", "dim")))

    lists, wanting, recall = neighbour_lists(nodes, threshold, k, trees, leaf)
    if report:
        report(recall)
    near = lists.where(F.col("sim") >= threshold - MARGIN).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    component = cut(connected_components(_confirmed(near, nodes, threshold)))
    component = cut(merged(nodes, wanting.withColumnRenamed("src", "node"), component, threshold))
    counts = component_links(nodes, component, threshold)
    first = nodes.join(component.withColumnRenamed("id", "node"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = nodes.join(component.withColumnRenamed("id", "node"), "node", "left").join(first, "component", "left").join(counts, "node", "left")
    placed = placed.select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = rows.join(placed, ["label", "dim", "vec"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


def merged(nodes: DataFrame, compared: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """``component`` (id, component) with those joined that links between ``compared`` (node) connect."""
    if compared.isEmpty():
        return component
    own = F.coalesce("component", "node")
    members = cut(nodes.join(compared, "node").join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("component", own).select("g", "node", "dim", "vec", "component"))
    joined = connected_components(links_across(members, threshold)).select(F.col("id").alias("own"), F.col("component").alias("into"))
    every = nodes.select("node").join(component.withColumnRenamed("id", "node"), "node", "left").withColumn("own", own).join(joined, "own", "left")
    return every.where("component is not null or into is not null").select(F.col("node").alias("id"), F.coalesce("into", "own").alias("component"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = [float(np.dot(*unit([x, y], dim))) >= threshold for dim, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
                yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))

    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = ends.join(nodes.select(F.col("node").alias("a"), "dim", F.col("vec").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b")
    return both.select("a", "b", "dim", "x", "y").mapInArrow(run, "a long, b long")
