"""Document files as a stream, and events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract_docs
from ..plans.models import Model


def document_stream(spark: SparkSession, path: str, model: Model, store: str = "local") -> DataFrame:
    """Extracted documents from Markdown files as they come in below ``path``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    docs = files.select(F.lit(store).alias("store"), F.lit(model.name).alias("model"), F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return extract_docs(docs, model)


def ingest_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now as Parquet; a later call goes on where this one ended."""
    flat = stream.select("store", "model", "doc", "path", "text", "payload_json", "error")
    return flat.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time_col: str = "ts") -> DataFrame:
    """(start, event_type, n, total): events by window; of a stream, those later than ``late`` are left out."""
    timed = events.withColumn("_at", F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
