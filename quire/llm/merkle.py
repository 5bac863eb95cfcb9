"""Merkle dataset manifest with an external-memory node store.

Each row is a leaf, the hash of its columns. Leaves are sorted by source and key in
ranges, so that a large source takes many tasks; a leaf's coordinate is its source's
number and its place there, from the counts of the ranges before. At most FANOUT
consecutive nodes are a run, whose hash is a node of the next level. The store is
Parquet by level, HEIGHT levels a folder, each folder made by one pass over the one before: a
row, or block, has BLOCK consecutive nodes and the hashes above them. The subroots
of the sources are the leaves of a last tree of that kind.

Proofs are read out from the root down: each folder's blocks meet the paths of their
nodes by coordinate, in a merge join, and hand them on to their nodes with the
steps between. A step is what lies left and right of a node in its run, so a path
folds a leaf up to the root without any other node.

No group of rows is collected but a block; the driver knows the height of the trees
and the root.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _written, prepare, small, stored, tidy

FANOUT = 3
#: Levels in a folder of the store, and nodes of the lowest one in a row of it.
HEIGHT = 3
BLOCK = FANOUT**HEIGHT
#: Columns of a leaf, in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Paths of levels up to this many nodes are broadcast: about 2 kB each, 4 MB in all.
BROADCAST_PATHS = 2_000

NO_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The hash of values: each `-` if null, else its bytes' count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def path_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


@dataclass(frozen=True)
class Manifest:
    """``sources``: (g, source, n, digest), the subroots; ``blocks`` and ``top``: blocks of the sources' trees and of the tree above them, from the leaves up; ``single``: the leaves of sources of one row; ``root`` is null for no rows."""

    sources: DataFrame
    blocks: list[DataFrame]
    single: DataFrame
    top: list[DataFrame]
    root: str | None


def placed(rows: DataFrame, keys: list[Column], group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted by ``keys`` in ranges, with ``at`` and ``part``; and (part, low, before, n): where a range starts, how many rows of its group lie before, and all of them.

    With ``group``, the first of ``keys``, there is one such row for each group in each range.
    """
    runs = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    by = [group] if group else []
    ranges = runs.groupBy("part", *by).agg(F.min("at").alias("low"), F.count("*").alias("n_part"))
    before = Window.partitionBy(*by).orderBy("part")  # one row a range
    return runs, ranges.withColumn("before", F.sum("n_part").over(before) - F.col("n_part")).withColumn("n", F.sum("n_part").over(Window.partitionBy(*by))).drop("n_part")


def heights(n: Column, wide: int) -> Column:
    """Levels that the blocks of a tree of ``n`` leaves have, whose lowest nodes stand for ``wide`` leaves each."""
    found = F.lit(HEIGHT)
    for h in reversed(range(1, HEIGHT)):
        found = F.when(n <= wide * FANOUT**h, h).otherwise(found)
    return found


def above(level: str) -> Column:
    """The hashes of the runs of a level of a block."""
    return F.expr(f"transform(sequence(0, (size({level}) - 1) div {FANOUT}), j -> sha2(array_join(slice({level}, {FANOUT} * j + 1, {FANOUT}), ''), 256))")


def climb(nodes: DataFrame, most: int, place: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all levels, and (g, digest) of what remains, from ``nodes`` (g, n, pos, digest, row): tree g has n leaves, at most ``most``.

    A block is (g, n, up, kids, level1, …, digest): consecutive nodes in order, their
    runs' hashes level by level, and the node ``up`` that they give. Trees of one
    node have none.
    """
    found, roots, wide = [], [nodes.where("n = 1").select("g", "digest")], 1
    while wide < most:
        kid = F.struct("pos", "digest", *[c for c in nodes.columns if c == "row"])
        blocks = nodes.where(F.col("n") > wide).groupBy("g", "n", F.floor(F.col("pos") / BLOCK).alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        blocks = blocks.withColumn("level0", F.col("kids.digest"))
        for h in range(HEIGHT):
            blocks = blocks.withColumn(f"level{h + 1}", above(f"level{h}"))
        # trees that end within the block have their root in a lower level, alone
        root = F.element_at(F.array(*[F.element_at(f"level{h + 1}", 1) for h in range(HEIGHT)]), heights(F.col("n"), wide))
        at = f"{place}/level={HEIGHT * len(found)}"
        blocks = blocks.withColumn("digest", root).drop("level0", f"level{HEIGHT}")
        blocks.write.option("compression", "zstd").parquet(at)
        blocks = _written(nodes.sparkSession.read.schema(blocks.schema).parquet(at))
        found.append(blocks)
        wide *= BLOCK
        nodes = blocks.select("g", "n", F.col("up").alias("pos"), "digest")
        roots.append(nodes.where(F.col("n") <= wide).select("g", "digest"))
    return found, reduce(DataFrame.unionByName, roots)


def descend(blocks: list[DataFrame], start: DataFrame) -> DataFrame:
    """(g, pos, digest, row, path and the columns of ``start``) for all leaves that lie in blocks, from ``start`` (g, n, path, …) of each tree's root."""
    carry = [c for c in start.columns if c not in ("g", "n", "path")]
    sizes = [F.sum(F.ceil(F.col("n") / BLOCK ** (k + 1))) for k in range(len(blocks))]
    sizes = start.agg(F.count("*"), *sizes).first()[1:]
    paths = None
    for k in reversed(range(len(blocks))):
        wide = BLOCK**k
        own = start.where((F.col("n") <= wide * BLOCK) & (F.col("n") > wide)).select("g", F.lit(0).cast("long").alias("up"), "path", *carry)
        paths = own if paths is None else paths.select("g", F.col("pos").alias("up"), "path", *carry).unionByName(own)
        met = blocks[k].join(F.broadcast(paths) if (sizes[k] or 0) <= BROADCAST_PATHS else stored(paths), ["g", "up"])
        inner = [f"level{h}" for h in range(1, HEIGHT)]
        met = met.withColumn("level0", F.col("kids.digest")).select("g", "n", "path", *carry, "level0", *inner, F.posexplode("kids").alias("i", "kid"))
        steps = []
        for h in range(HEIGHT):
            place = f"(i div {FANOUT**h})"
            first = f"({place} - {place} % {FANOUT})"
            left = F.expr(f"array_join(slice(level{h}, cast({first} + 1 as int), cast({place} - {first} as int)), '')")
            right = F.expr(f"array_join(slice(level{h}, cast({place} + 2 as int), cast({first} + {FANOUT - 1} - {place} as int)), '')")
            steps.append(F.struct(left.alias("left"), right.alias("right")))
        path = F.concat(F.slice(F.array(*steps), 1, heights(F.col("n"), wide)), "path")
        paths = met.select("g", "kid.*", path.alias("path"), *carry)
    return paths


def build(leaves: DataFrame, group: str = "source", key: str = "doc_id") -> Manifest:
    """The manifest of ``leaves``, which have ``group``, ``key`` and ``leaf``; all their columns stay in ``row``.

    Per group leaves ascend by key, nulls first, and by leaf where keys are equal;
    groups ascend by code point, null first.
    """
    spark = leaves.sparkSession
    prepare(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/manifest-{uuid.uuid4().hex}"
    first = lambda c: F.col(c).asc_nulls_first()
    runs, ranges = placed(leaves, [first(group), first(key), first("leaf")], group)
    ranges = stored(ranges)
    ranked, parts = placed(ranges.groupBy(group).agg(F.first("n").alias("n")), [first(group)])
    number = F.col("at") - F.col("low") + F.col("before")
    groups = stored(ranked.join(F.broadcast(parts.drop("n")), "part").select(number.alias("g"), group, "n"))  # parts has a row a range
    count, most = groups.agg(F.count("*"), F.max("n")).first()
    known = ranges.alias("r").join(small(groups).alias("s"), F.col(f"r.{group}").eqNullSafe(F.col(f"s.{group}"))).select("part", F.col(f"r.{group}").alias(group), "g", "s.n", "low", "before")
    row = F.struct(*[F.col(f"x.{c}") for c in leaves.columns]).alias("row")
    met = runs.alias("x").join(small(known).alias("k"), (F.col("x.part") == F.col("k.part")) & F.col(f"x.{group}").eqNullSafe(F.col(f"k.{group}")))
    nodes = met.select("k.g", "k.n", number.alias("pos"), F.col("x.leaf").alias("digest"), row)
    blocks, roots = climb(nodes, most or 0, f"{place}/sources")
    sources = stored(groups.join(small(roots), "g").select("g", group, "n", "digest"))
    over = sources.select(F.lit(0).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.col("g").alias("pos"), "digest", F.struct(F.col("g").alias("of"), F.col("n").alias("n"), "digest").alias("row"))
    top, roots = climb(over, count, f"{place}/top")
    last = roots.select("digest").first()
    return Manifest(sources, blocks, nodes.where("n = 1").select("g", "digest", "row"), top, last and last[0])


def proofs(manifest: Manifest) -> DataFrame:
    """(row, leaf, subroot, root, path) of every leaf; ``path`` leads via the subroot to the root."""
    nothing = F.array().cast(NO_STEPS).alias("path")
    if manifest.top:
        start = manifest.sources.groupBy(F.lit(0).cast("long").alias("g")).agg(F.count("*").alias("n")).withColumn("path", nothing)
        of = descend(manifest.top, start).select(F.col("row.of").alias("g"), F.col("row.n").alias("n"), F.col("row.digest").alias("subroot"), "path")
    else:
        of = manifest.sources.select("g", "n", F.col("digest").alias("subroot"), nothing)
    of = stored(of)
    found = manifest.single.join(small(of.where("n = 1")), "g").select("row", F.col("digest").alias("leaf"), "subroot", "path")
    if manifest.blocks:
        found = found.unionByName(descend(manifest.blocks, of).select("row", F.col("digest").alias("leaf"), "subroot", "path"))
    return found.select("row", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), "path")


@tidy
def merkle_manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "source", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) for each row of ``docs``.

    Leaves are the hashes of ``columns``. ``tampered`` is what ``text_col`` holds
    when proofs are checked, the text itself if none is given; ``folded_root`` is
    folded from that row's hash and the stored siblings, and ``verified`` says if
    it is the root. Nulls in any column are hashed as such, and differ from empty
    texts; a null key comes first, a null group is a group and comes first. Rows
    with one key are ordered by their hashes, so that repeated rows, which are
    leaves of their own, give the same result in any order. Texts are hashed whole.
    A single leaf is its subroot, and a single subroot the root. An empty table
    gives an empty result. Columns that aren't named are ignored.
    """
    leaf = leaf_digest(*map(F.col, columns))
    found = leaf if tampered is None else F.when(tampered.eqNullSafe(F.col(text_col)), F.lit(None)).otherwise(leaf_digest(*[tampered if c == text_col else F.col(c) for c in columns]))
    leaves = docs.select(F.col(key).alias("doc_id"), F.col(group).alias("source"), leaf.alias("leaf"), found.alias("found"))
    rows = proofs(build(stored(leaves)))
    folded = fold(F.coalesce("row.found", "leaf"), F.col("path"))
    # a generator's output is computed once
    rows = rows.select("*", F.explode(F.array(folded)).alias("folded_root"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
