"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each document has a fixed hash. A source's budget is met by whole copies of all
its documents and one more copy of those below a hash threshold. Sums of sizes
by source and hash bucket show the bucket in which the budget ends; only that
bucket is split further, until one hash value is left. Thresholds are nested: a
larger budget takes a superset. No document is sorted against others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, small, tidy, unused

WEIGHTS = (3, 1, 2)
#: The mix has SHARE_HALVES / 2 times all sizes; a source is taken MOST times at most.
SHARE_HALVES, MOST = 3, 2
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    """Stretches without ASCII white space; 0 for null."""
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    return F.when(text.isNull(), 0).otherwise(words).cast("long")


def mix_hash(doc_id: Column) -> Column:
    """60 bits of an MD5 of the id, equal in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":mix"))), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), by the weights in code-point order, null last.

    Sources whose weighted share is above MOST times their size stop there, and
    the rest is shared again, until none is above; each round is one aggregate.
    """
    # ranks by ranges of sources: in a range by a window, before it by the ranges' counts
    dealt = cut(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id()))
    counts = sorted(dealt.groupBy("_part").agg(F.count("*")).collect())  # one row a range
    before = dealt.sparkSession.createDataFrame([(p, sum(n for q, n in counts if q < p)) for p, _ in counts], "_part int, _before long")
    order = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    turn = (F.col("_before") + F.row_number().over(order) - 1) % len(WEIGHTS)
    ranked = dealt.join(F.broadcast(before), "_part").withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn + 1).cast("int")).cast("long"))
    ranked = cut(ranked.drop("_part", "_before"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full, num, weight = F.lit(False), 0, 1
    seen = None
    while True:
        stopped, left = ranked.agg(F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first()
        if left is None or (stopped, left) == seen:
            break
        seen = stopped, left
        num, weight = SHARE_HALVES * total - 2 * MOST * (stopped or 0), left
        full = full | (F.lit(2 * MOST * weight) * F.col("source_size") <= F.lit(num) * F.col("w"))
    share = F.lit(num).cast("double") * F.col("w") / F.lit(2 * weight)
    return ranked.select("source", "source_size", F.when(full, F.col("source_size").cast("double") * MOST).otherwise(share).alias("target"))


def _with_source(df: DataFrame, state: DataFrame) -> DataFrame:
    """``df`` with the columns of ``state`` for its source; null sources meet."""
    (name,) = unused(df, "key")
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    side = state.withColumn(name, key).drop("source")
    return df.withColumn(name, key).join(small(side), name).drop(name)


@tidy
def thresholds(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, budget, star, below) from rows (doc_id, source, size).

    ``whole`` copies of each document, one more below hash ``star``: these sum to
    ``below``, and the documents at ``star`` reach over ``budget``. Costs one
    histogram a level, over the rows of the boundary buckets alone. A null source
    is a source, a null id hashes as such, a null size counts as 0; an empty
    table has no sources; repeated rows count each.
    """
    prepare(sized.sparkSession)
    rows = cut(sized.select("source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), mix_hash(F.col("doc_id")).alias("h")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    return thresholds_of(rows, state, hashed=True)


def thresholds_of(sized: DataFrame, state: DataFrame, hashed: bool = False) -> DataFrame:
    """``state`` (source, source_size, target, whole, budget) with star and below, by histograms over ``sized``; see ``thresholds``."""
    rows = sized if hashed else cut(sized.select("source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), mix_hash(F.col("doc_id")).alias("h")))
    state = cut(state.withColumn("star", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    fixed = ["source_size", "target", "whole", "budget"]
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift, above = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level - 1)
        inside = _with_source(rows, state).where(F.shiftright("h", above) == F.col("star"))
        histogram = inside.groupBy("source", *fixed, F.shiftright("h", shift).alias("bucket"), "below").agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        histogram = histogram.withColumn("below", F.col("below") + F.coalesce(F.sum("size").over(upto), F.lit(0)))
        # the last bucket that starts within the budget holds its end
        edge = histogram.where(F.col("below") <= F.col("budget")).groupBy("source", *fixed).agg(F.max_by(F.struct("bucket", "below", "low", "high"), "bucket").alias("x"))
        state = cut(edge.select("source", *fixed, F.col("x.bucket").alias("star"), F.col("x.below").alias("below"), F.col("x.low").alias("low"), F.col("x.high").alias("high")))
        if not state.where("low <> high").limit(1).count():
            state = state.withColumn("star", F.col("low"))
            break
        state = state.drop("low", "high")
    return state.select("source", *fixed, "star", "below")


def mix(docs: DataFrame, state: DataFrame, size: Column) -> DataFrame:
    """``docs`` with source_size, target and copies, given their ``thresholds``.

    Documents below their source's threshold get one copy more. Of those at the
    threshold, mostly one, as many get it as bring the sum nearest to the budget,
    smaller sizes first. Nulls: a null source is a source, a null id hashes as
    such. Repeated rows have one hash, and share it if it is the threshold. Texts
    count whole, however long; an empty table stays empty.
    Columns of ``docs`` that have a result's name are replaced; others pass through.
    """
    docs = docs.drop("source_size", "target", "copies", "whole", "budget", "star", "below")
    h, own = unused(docs, "hash", "size")
    rows = _with_source(docs.withColumn(h, mix_hash(F.col("doc_id"))), state)
    clear = rows.where(F.col(h) != F.col("star")).withColumn("copies", F.col("whole") + (F.col(h) < F.col("star")).cast("long"))
    edge = rows.where(F.col(h) == F.col("star")).withColumn(own, F.coalesce(size, F.lit(0)))
    ahead = Window.partitionBy("source").orderBy(own, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("below") - F.coalesce(F.sum(own).over(ahead), F.lit(0))
    edge = edge.withColumn("copies", F.col("whole") + (2 * left > F.col(own)).cast("long")).drop(own)
    return clear.unionByName(edge).drop(h, "star", "below", "whole", "budget")
