"""The hash cascade of a store, and what it tells about changes.

hash_c is a document's text, hash_d its payload; hash_b folds both over a model's
documents, hash_a the models' hash_b in order of name. Documents are folded by the
first LEAF_DIGITS hexadecimal digits of a hash of their name, then folds that share
all digits but the last, and so on to the model's: a tree, in which a large model's hashes
meet in no single row, and which can be kept at any number of digits and folded
on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import bucket_of


def document_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` (text, payload_json) with hash_c and hash_d."""
    return docs.withColumn("hash_c", F.sha2("text", 256)).withColumn("hash_d", F.sha2("payload_json", 256))


#: Hexadecimal digits at which documents are folded.
LEAF_DIGITS = 3


def _fold(rows: DataFrame, digits: int, entry: Column) -> DataFrame:
    entries = F.array_sort(F.collect_list(entry))
    return rows.groupBy("store", "model", F.substring("prefix", 1, digits).alias("prefix")).agg(F.sha2(F.to_json(entries), 256).alias("fold"))


def fold_up(folds: DataFrame, at: int, digits: int) -> DataFrame:
    """(store, model, prefix, fold) at ``digits`` digits, from those ``at`` more digits."""
    for n in reversed(range(digits, at)):
        folds = _fold(folds, n, F.struct("prefix", "fold"))
    return folds


def document_folds(hashed: DataFrame, digits: int) -> DataFrame:
    """(store, model, prefix, fold) of documents (store, model, doc, path, hash_c, hash_d): only hashes meet in a group, never texts."""
    rows = hashed.withColumn("prefix", bucket_of(LEAF_DIGITS))
    return fold_up(_fold(rows, LEAF_DIGITS, F.struct("path", "hash_c", "hash_d")), LEAF_DIGITS, digits)


def model_hashes(hashed: DataFrame) -> DataFrame:
    """(store, model, hash_b) of all documents."""
    return document_folds(hashed, 0).select("store", "model", F.col("fold").alias("hash_b"))


def folded_hashes(folds: DataFrame, digits: int) -> DataFrame:
    """(store, model, hash_b) from kept folds of ``digits`` digits, equal to ``model_hashes`` of the documents."""
    return fold_up(folds, digits, 0).select("store", "model", F.col("fold").alias("hash_b"))


def store_hashes(models: DataFrame) -> DataFrame:
    """(store, hash_a)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("model").alias("name"), "hash_b")))
    return models.groupBy("store").agg(F.sha2(F.to_json(rows), 256).alias("hash_a"))


def diagnose(tracked: DataFrame, found: DataFrame) -> DataFrame:
    """``tracked`` (store, model, doc, hash_c, hash_d) against ``found`` (store, model, doc, text, payload_json).

    note: missing, ok, benign_mutation (only the text changed), data_mutation. A
    payload that can't be had counts as unchanged. Both sides are dealt by name: they
    may come from files much smaller than the hashes, so no estimate is to broadcast one.
    """
    now = document_hashes(found).select("store", "model", "doc", F.col("hash_c").alias("now_c"), F.col("hash_d").alias("now_d"), F.lit(True).alias("there"))
    both = tracked.join(now.hint("merge"), ["store", "model", "doc"], "left")
    same_c, same_d = F.col("hash_c") == F.col("now_c"), F.coalesce(F.col("hash_d") == F.col("now_d"), F.lit(True))
    note = F.when(F.col("there").isNull(), "missing").when(same_c & same_d, "ok").when(same_d, "benign_mutation").otherwise("data_mutation")
    return both.select("store", "model", "doc", F.coalesce(same_c, F.lit(False)).alias("hash_c_ok"), (F.col("there").isNotNull() & same_d).alias("hash_d_ok"), note.alias("note"))


def diagnosis_rollup(notes: DataFrame) -> DataFrame:
    """(store, model, docs, ok, benign, changed, missing, valid). Benign mutations leave a model valid."""
    count = lambda n: F.count_if(F.col("note") == n)
    return notes.groupBy("store", "model").agg(
        F.count("*").alias("docs"), count("ok").alias("ok"), count("benign_mutation").alias("benign"), count("data_mutation").alias("changed"), count("missing").alias("missing"),
        F.bool_and(F.col("note").isin("ok", "benign_mutation")).alias("valid"),
    )


def diagnose_models(notes: DataFrame, tracked: DataFrame, models: DataFrame) -> DataFrame:
    """``diagnosis_rollup`` of ``notes`` with hash_b_ok: whether ``models`` (store, model, hash_b) holds what the tracked documents' hashes fold to.

    A model of ``models`` without documents has counts of 0, is valid, and is
    right if its hash_b is empty.
    """
    now = model_hashes(tracked).withColumnRenamed("hash_b", "now_b")
    stored = models.select("store", "model", "hash_b")
    rows = stored.join(now, ["store", "model"], "full").join(diagnosis_rollup(notes), ["store", "model"], "left")
    none = {"docs": 0, "ok": 0, "benign": 0, "changed": 0, "missing": 0, "valid": True}
    return rows.select("store", "model", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in none.items()], (F.coalesce("hash_b", F.lit("")) == F.coalesce("now_b", F.lit(""))).alias("hash_b_ok"))


def diagnose_store(diagnosed: DataFrame, models: DataFrame, stores: DataFrame) -> DataFrame:
    """(store, models, docs, hash_a_ok, valid) from ``diagnose_models``, and what is stored: ``models`` (store, model, hash_b), ``stores`` (store, hash_a).

    A store is valid if its models are and every stored hash is right.
    """
    roll = diagnosed.groupBy("store").agg(F.count("*").alias("models"), F.sum("docs").alias("docs"), F.bool_and(F.col("valid") & F.col("hash_b_ok")).alias("_valid"))
    now = store_hashes(models.where("hash_b <> ''")).withColumnRenamed("hash_a", "_now_a")
    rows = stores.select("store", "hash_a").join(now, "store", "left").join(roll, "store", "left")
    right = F.coalesce("hash_a", F.lit("")) == F.coalesce("_now_a", F.lit(""))
    return rows.select("store", F.coalesce("models", F.lit(0)).alias("models"), F.coalesce("docs", F.lit(0)).alias("docs"), right.alias("hash_a_ok"), (right & F.coalesce("_valid", F.lit(True))).alias("valid"))


def rebuild_report(tracked: DataFrame, headings: DataFrame) -> DataFrame:
    """One row of counters: tracked, processed, missing, without sections."""
    both = tracked.join(headings.select("store", "model", "doc", F.size("headings").alias("n")), ["store", "model", "doc"], "left")
    return both.agg(F.count("*").alias("docs"), F.count("n").alias("processed"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") == 0).alias("empty"))


def changed_docs(found: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose text is new or changed since ``known`` (store, model, doc, hash_c): all that a refresh has to parse."""
    return found.withColumn("hash_c", F.sha2("text", 256)).join(known, ["store", "model", "doc", "hash_c"], "left_anti")


def equal_texts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(hash_c, n, first): texts that several documents have, with the least ``key``; combined where the rows lie."""
    return docs.groupBy(F.sha2(text_col, 256).alias("hash_c")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
