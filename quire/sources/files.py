"""Documents as files."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_documents(spark: SparkSession, path: str, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(path, text, hash) of Markdown files below ``path`` that no rule (pattern, reason) ignores; hidden files are never read."""
    from ..operators.ingest import ignored

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    below = F.substring_index("path", path.split(":", 1)[-1].rstrip("/") + "/", -1)
    rows = files.select(below.alias("path"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("hash"))
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith("."))
    return rows.where(~hidden & ignored(F.col("path"), list(rules)).isNull())


MANIFEST = "path string, content_hash string, status string, created string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from CSV with a header; a missing one is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.csv(path, header=True, schema=MANIFEST)


def read_documents(spark: SparkSession, path: str, model: str, store: str = "local") -> DataFrame:
    """(store, model, doc, path, text) from Markdown files below ``path``, one row per file; a document's name is its file's."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    place = F.col("_metadata.file_path")
    return files.select(F.lit(store).alias("store"), F.lit(model).alias("model"), F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc"), place.alias("path"), F.col("value").alias("text"))


def tracked_files(tracked: DataFrame) -> DataFrame:
    """(store, model, doc, path, text) of tracked documents as they are in their files now; documents whose file is gone have no row.

    Files are read below the folder that all paths share. A document with a
    relative path has no file but its row in the catalog, and comes from there.
    """
    spark, columns = tracked.sparkSession, ["store", "model", "doc", "path", "text"]
    in_files = F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*:/|^/")
    own = tracked.where(~in_files).select(columns)
    low, high = tracked.where(in_files).agg(F.min("path"), F.max("path")).first()
    if low is None:
        return own
    # what the least and the greatest path share, all between share
    root = os.path.commonprefix([low, high]).rpartition("/")[0]
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return own
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    found = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return tracked.where(in_files).select(columns[:4]).join(found, "path").select(columns).unionByName(own)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row (text): a whole file, or standard input for ``-``."""
    if path == "-":
        return spark.createDataFrame([(sys.stdin.read(),)], "text string")
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_documents(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Each document (store, model, doc, …) as the file ``path/store/model/doc.md``, ended by a line feed."""
    from .folders import register

    register(docs.sparkSession)
    rows = docs.select(F.concat_ws("/", "store", "model").alias("model"), "doc", F.col(text_col).alias("text"))
    rows.write.format("documents").mode("append").save(path)


def write_document(spark: SparkSession, path: str, text: str) -> str:
    """One document as the file ``path``; returns the path as readers name it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(place, True)
    stream.write(bytearray((text + "\n").encode()))
    stream.close()
    return fs.makeQualified(place).toString()


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for results at the edge."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
