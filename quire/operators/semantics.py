"""Tags: inverted index, children, the graph of prefixes and equivalences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prefix_edges


def sorted_names(column: str) -> Column:
    """An aggregate: the group's names as a sorted array, for groups that fit a row."""
    return F.array_sort(F.collect_list(column))


def tag_postings(tags: DataFrame) -> DataFrame:
    """(tag, position, doc): documents of each tag in order of name, by ranges, so that a tag of any size is spread over tasks.

    ``position`` counts from 0 within the tag. Rows are sorted by tag and name
    in range partitions; a position is the rank within the partition, and what
    earlier partitions hold of the tag.
    """
    rows = tags.select("tag", "doc").repartitionByRange("tag", "doc").withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("tag").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("tag", "_part").agg(F.count("*").alias("_n")).select("tag", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("tag", "_part").orderBy("doc")
    return rows.withColumn("_own", F.row_number().over(own) - 1).join(base, ["tag", "_part"]).select("tag", (F.col("_base") + F.col("_own")).alias("position"), "doc")


def tag_index(tags: DataFrame) -> DataFrame:
    """(tag, docs): sorted names of documents, one for each (store, model, doc).

    A tag's names meet in one row here; ``tag_postings`` has a row for each.
    """
    return tags.groupBy("tag").agg(sorted_names("doc").alias("docs"))


def tag_children(tags: DataFrame, prefix: str | None = None) -> DataFrame:
    """Next segments below ``prefix`` that have segments below them in turn; a last segment isn't listed."""
    parts = F.split("tag", r"\.")
    if not prefix:
        return tags.where(F.size(parts) > 1).select(parts[0].alias("segment")).distinct().orderBy("segment")
    n = len(prefix.split("."))
    below = tags.where(F.col("tag").startswith(prefix + ".") & (F.size(parts) > n + 1))
    return below.select(parts[n].alias("segment")).distinct().orderBy("segment")


def tag_edges(tags: DataFrame, equivalences: DataFrame | None = None) -> DataFrame:
    """(parent, child, kind): prefix edges of all tags, and equal tags both ways."""
    edges = tags.select("tag").distinct().select(F.inline(prefix_edges(F.col("tag")))).distinct().withColumn("kind", F.lit("prefix"))
    if equivalences is None:
        return edges
    equal = equivalences.select(F.col("tag").alias("parent"), F.col("equal").alias("child"), F.lit("equivalent").alias("kind"))
    return edges.unionByName(equal).distinct()


def tag_parents(edges: DataFrame) -> DataFrame:
    """(tag, parents): every tag of the graph with its sorted parents, none for roots."""
    nodes = edges.select(F.col("parent").alias("tag")).unionByName(edges.select(F.col("child").alias("tag"))).distinct()
    parents = edges.groupBy(F.col("child").alias("tag")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return nodes.join(parents, "tag", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def map_equal(equivalences: DataFrame, store: str, tag: str, equal: str) -> DataFrame:
    """``equivalences`` with the pair in both directions, each pair once."""
    both = equivalences.sparkSession.createDataFrame([(store, tag, equal), (store, equal, tag)], "store string, tag string, equal string")
    return equivalences.unionByName(both).dropDuplicates(["store", "tag", "equal"])


def descendants(edges: DataFrame, tag: str) -> DataFrame:
    """Tags reachable from ``tag``, itself included; equal tags make cycles, so only new tags go on."""
    found = edges.sparkSession.createDataFrame([(tag,)], "tag string")
    front = found
    while True:
        front = front.join(edges, front.tag == edges.parent).select(F.col("child").alias("tag")).distinct().join(found, "tag", "left_anti").checkpoint()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found
