"""A corpus pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept,
and returns a DataFrame, which is written and read again for the next one. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, prepare, stored, tidy
from quire.llm.line_dedup import drop_recurring_lines
from quire.llm.mixing import mix, thresholds, word_count
from quire.llm.near_dup import near_duplicates
from quire.llm.packing import pack_documents
from quire.llm.quality import RULES, few_words, quality_filter


#: Rules of the first stage: those of the operator, but that short documents stay if they have a shingle's words.
QUALITY = (few_words(5), *RULES[1:])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text has too few words; of repeated rows all stay or all go."""
    return quality_filter(docs, QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their recurring lines; n_chars follows the text. Nulls stay; repeated rows count as one text."""
    return drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8. Rows that repeat a doc_id stay together."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is one, a null text has size 0; repeated rows are taken alike, but for those at the threshold."""
    prepare(spark)
    size = word_count(F.col("text"))
    sized = cut(docs.select("doc_id", "source", size.alias("size")))
    mixed = mix(docs, thresholds(sized), size).where("copies > 0")
    return mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its place in a training sequence. A null text is the end id alone; repeated rows are documents of their own."""
    carry = ["doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32")]
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carry=carry)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no such tokenizer.
ORACLE_SQL = None


@tidy
def kept(stage: Callable[[SparkSession, DataFrame, str], DataFrame], spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What ``stage`` makes of ``docs``, as a table."""
    return stored(stage(spark, docs, sf_dir))


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each one's result written to the shared folder and read again. An empty table gives an empty result."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage, spark, docs, sf_dir)
    return STAGES[-1][1](spark, docs, sf_dir)
