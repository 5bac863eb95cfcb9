"""What the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache, wraps

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Arrow batches of whole texts hold this many rows at most, which bounds a Python worker's memory.
TEXTS_PER_BATCH = 1000
#: Tables of ids and a few numbers up to this many rows are broadcast, about 64 MB at most; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Make checkpoint() usable and keep Arrow batches of texts small.

    The folder is the one that ``spark.checkpoint.dir`` names; only where the
    session names none (tests) does one below the warehouse stand in.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))


#: For each running operator, the places in the checkpoint folder that it has written to.
_WRITTEN: list[list[str]] = []


def _places(df: DataFrame) -> list[str]:
    """Checkpoints and tables that the plan of ``df`` reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRDD":
            file = leaf.rdd().getCheckpointFile()
            found += [file.get()] if file.isDefined() else []
        elif kind == "LogicalRelation" and hasattr(leaf.relation(), "location"):
            paths = leaf.relation().location().rootPaths()
            found += [paths.apply(k).toString() for k in range(paths.size())]
    return found


def _written(df: DataFrame) -> DataFrame:
    if _WRITTEN:
        _WRITTEN[-1].extend(_places(df))
    return df


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``operator``, whose checkpoints and tables are deleted when it returns, but for those that its result reads.

    These stay until the operator around it returns, or for good if there is
    none. Shuffles that nothing refers to any longer are let go of as well.
    """

    @wraps(operator)
    def run(*args, **named):
        _WRITTEN.append([])
        try:
            out = operator(*args, **named)
        finally:
            own = _WRITTEN.pop()
        kept, spark = set(_places(out)), out.sparkSession
        for place in set(own) - kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if _WRITTEN:
            _WRITTEN[-1].extend(kept & set(own))
        else:
            spark._jvm.System.gc()  # the cleaner follows the garbage collector
        return out

    return run


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder."""
    prepare(df.sparkSession)
    return _written(df.checkpoint())


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a table to the shared checkpoint folder and read again.

    For loops: a checkpoint hands on what is known of its plan's partitioning and
    order, which each round of joins and renamed columns multiplies until planning
    takes minutes; a table starts anew. Its size is known as well, so that joins
    broadcast it if it is small. The codec needs no memory outside the heap.
    """
    spark = df.sparkSession
    prepare(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return _written(spark.read.schema(df.schema).parquet(place))


def small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has BROADCAST_ROWS rows at most; ``df`` should be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has."""
    longest = max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0)
    return ["_" * (longest + 1) + n for n in names]


#: Longer keys aren't remembered.
LONGEST_KEY = 100


class Remembered(dict):
    """Values that ``make`` gives for keys, remembered in two generations of ``most`` keys.

    When the present generation is full it becomes the old one; keys that are
    asked for again come back from there, so what recurs stays.
    """

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordHashes(Remembered):
    """64-bit hashes of words."""

    def __init__(self, most: int = 100_000):
        super().__init__(most)

    def make(self, key: bytes) -> int:
        return xxhash.xxh64_intdigest(key)


@cache
def word_hashes() -> WordHashes:
    """One per worker process."""
    return WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@tidy
def connected_components(edges: DataFrame) -> DataFrame:
    """Label each vertex of ``edges`` (a, b longs) with its component's smallest vertex.

    Alternates the large-star and small-star steps until the edges no longer
    change; each step is a map-side combined minimum and an equi join with it. Returns (id, component) for every vertex
    that has an edge to another one; null ends and self loops are ignored.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def with_low(x: DataFrame, low: DataFrame) -> DataFrame:
        # a table's size is known: few minima are broadcast; many are shuffled by themselves, so that adaptive joins can split a hub
        return x.join(stored(low), "u")

    def fingerprint(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = fingerprint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_low(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = with_low(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = stored(lower)
        now = fingerprint(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: A member weighs 1, or more if its n, the length of a set, is over SHINGLES. Blocks weigh LEAST or more; MOST, about, if there are over BLOCKS of a unit.
SHINGLES, LEAST, BLOCKS, MOST = 256, 64, 16, 1024


def dealt_blocks(members: DataFrame) -> DataFrame:
    """(task, side, rep, label): ``members`` (unit, rep, label, n) dealt into tasks of two blocks each, or of one with itself.

    A label with the weight of a block has blocks of its own; the rest of a unit
    shares blocks. Two blocks of one label make no task.
    """
    weight = F.greatest(F.lit(1.0), F.col("n") / SHINGLES)
    of_label = cut(members.groupBy("unit", "label").agg(F.sum(weight).alias("w")))
    of_unit = of_label.groupBy("unit").agg(F.sum("w").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    blocks = F.greatest(F.least(F.ceil(F.col("all") / LEAST), F.lit(BLOCKS)), F.ceil(F.col("all") / MOST))
    of_unit = cut(of_unit.select("unit", (F.col("all") / blocks).alias("per")))
    of_label = of_label.join(small(of_unit), "unit").withColumn("own", F.col("w") >= F.col("per"))
    pooled = of_label.where("not own").groupBy("unit").agg(F.sum("w").alias("pool"))
    of_label = of_label.join(small(cut(pooled)), "unit", "left").withColumn("parts", F.ceil(F.when(F.col("own"), F.col("w")).otherwise(F.col("pool")) / F.col("per")))
    of_label = cut(of_label.select("unit", "label", F.when(F.col("own"), F.col("label")).alias("owner"), "parts"))
    placed = members.join(small(of_label), ["unit", "label"]).withColumn("block", F.xxhash64(F.coalesce("owner", F.lit(-1)), F.col("owner").isNull(), F.pmod(F.xxhash64("rep"), F.col("parts"))))
    placed = cut(placed.select("unit", "block", "owner", "rep", "label"))
    one = placed.select("unit", "block", "owner").distinct()
    tasks = one.join(one.select("unit", F.col("block").alias("other"), F.col("owner").alias("of_other")), "unit").where("block <= other and not coalesce(owner = of_other, false)")
    sides = tasks.withColumn("task", F.xxhash64("unit", "block", "other")).select("unit", "task", F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return placed.join(sides, ["unit", "block"]).select("task", F.col("block").alias("side"), "rep", "label")
