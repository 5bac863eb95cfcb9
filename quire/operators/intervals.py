"""Tags as intervals: numbers that turn the tree of tag prefixes into ranges.

Tags and their prefixes are numbered in pre-order, a tag before all that lies below
it, so that what lies below is the range after its number. Stored by number, a table
answers ``a.b.**`` and the children of a tag by a range that the scan is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_tags(tags: DataFrame) -> DataFrame:
    """(tag, pre, last, depth): each tag of ``tags`` and each of its prefixes; ``last`` is the last number below it, its own if there is nothing.

    Numbers come from ranges of tags and the counts of the ranges before. Write the
    table in their order to have ranges pruned.
    """
    parts = F.split("tag", r"\.")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    nodes = tags.select("tag").where("tag <> ''").distinct().select(F.explode(upto).alias("tag")).distinct()
    key = F.replace("tag", F.lit("."), F.lit("\1"))  # below any character that tags have
    placed = nodes.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).checkpoint()
    ranges = placed.groupBy("_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))  # one row a range
    ranges = ranges.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    below = nodes.select(F.explode(upto).alias("tag")).groupBy("tag").agg(F.count("*").alias("_below"))
    rows = placed.join(F.broadcast(ranges), "_part").join(below, "tag")
    pre = F.col("_at") - F.col("_low") + F.col("_before")
    return rows.select("tag", pre.alias("pre"), (pre + F.col("_below") - 1).alias("last"), F.size(parts).alias("depth"))


def interval(numbered: DataFrame, tag: str) -> tuple[int, int, int] | None:
    """(pre, last, depth) of a tag; None if it isn't there."""
    row = numbered.where(F.col("tag") == tag).first()
    return row and (row["pre"], row["last"], row["depth"])


def tags_below(numbered: DataFrame, tag: str) -> DataFrame:
    """Rows of what ``tag.**`` matches."""
    at = interval(numbered, tag)
    return numbered.where(F.col("pre").between(at[0] + 1, at[1])) if at else numbered.limit(0)


def children(numbered: DataFrame, tag: str | None = None) -> DataFrame:
    """(segment): next segments below ``tag`` that have segments below them in turn."""
    depth = F.lit(0)
    rows = numbered
    if tag:
        at = interval(numbered, tag)
        if not at:
            return numbered.limit(0).select(F.col("tag").alias("segment"))
        rows, depth = numbered.where(F.col("pre").between(at[0] + 1, at[1])), F.lit(at[2])
    found = rows.where((F.col("depth") == depth + 1) & (F.col("last") > F.col("pre")))
    return found.select(F.substring_index("tag", ".", -1).alias("segment"))


def equal_classes(equivalences: DataFrame) -> DataFrame:
    """(tag, class): tags that equal one another, over any number of steps, have one class, the least of them."""
    pairs = equivalences.select("tag", F.col("equal").alias("other"))
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("tag"), F.col("tag").alias("other"))).where("tag <> other").distinct().checkpoint()
    known = pairs.groupBy("tag").agg(F.least("tag", F.min("other")).alias("class")).checkpoint()
    while True:
        # the least class of a neighbour, and that class's own class: chains halve
        near = pairs.join(known.select(F.col("tag").alias("other"), F.col("class").alias("near")), "other").groupBy("tag").agg(F.min("near").alias("near"))
        jump = known.select(F.col("tag").alias("class"), F.col("class").alias("jump"))
        now = known.join(near, "tag").join(jump, "class", "left").select("tag", F.least("class", "near", F.coalesce("jump", "class")).alias("new"), F.col("class").alias("old")).checkpoint()
        if now.where("new <> old").isEmpty():
            return known
        known = now.select("tag", F.col("new").alias("class"))
