"""Search by trigrams: postings of records, and candidates that a term or a pattern leaves.

A text that holds a term holds all the term's trigrams, and one that fits a pattern
those of the pattern's literals. Postings are stored sorted by gram, so that a search
reads few row groups; what they leave is searched as records are without them. A
pattern without three literal characters in a row has no grams, and scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import COLUMNS, hay_of, search

GRAM = 3
#: Characters of a pattern after which what precedes them may be missing or repeated.
_LOOSE, _ENDS = "?*{", ".^$+"


def literals(pattern: str) -> list[str]:
    """Texts that every match of ``pattern`` holds: runs of literal characters outside of groups and classes; none if it has alternatives or flags."""
    runs, now, i, depth = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            escaped = pattern[i + 1 : i + 2]
            if escaped == "Q":
                return []
            literal = escaped if escaped and not escaped.isalnum() and ord(escaped) < 128 else None
            i += 2
        elif c == "[":
            # up to the bracket that closes it; classes nest
            open_, i, literal = 1, i + 1, None
            first = i + (pattern[i : i + 1] == "^")
            while i < len(pattern) and open_:
                open_ += (pattern[i] == "[") - (pattern[i] == "]" and i != first)
                i += 2 if pattern[i] == "\\" else 1
        elif c == "(":
            if pattern[i + 1 : i + 2] == "?":
                return []
            depth, i, literal = depth + 1, i + 1, None
        elif c == ")":
            depth, i, literal = depth - 1, i + 1, None
        elif c == "|":
            if not depth:
                return []
            i, literal = i + 1, None
        elif c in _LOOSE:
            now = now[:-1]
            end = pattern.find("}", i) if c == "{" else i
            i, literal = (len(pattern) if end < 0 else end) + 1, None
        elif c in _ENDS:
            i, literal = i + 1, None
        else:
            i, literal = i + 1, c
        if literal is None or depth:
            runs.append(now)
            now = ""
        else:
            now += literal
    return [r for r in [*runs, now] if r]


def grams(term: str, regex: bool = False) -> list[str]:
    """Trigrams that each match holds, sorted, each once."""
    parts = literals(term) if regex else [term]
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def with_record(records: DataFrame) -> DataFrame:
    """``records`` with a number that their content gives."""
    return records.withColumn("record", F.xxhash64(*[c for c in COLUMNS]))


def gram_postings(records: DataFrame) -> DataFrame:
    """(gram, record): each trigram of the texts that a search looks in, case and all, sorted by gram in ranges.

    A gram that many records have is many rows, and may lie in several ranges.
    """
    texts = F.filter(hay_of("both"), lambda x: F.length(x) >= GRAM)
    cut = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - GRAM + 1), lambda i: F.substring(x, i, GRAM))
    found = with_record(records).select("record", F.explode(F.array_distinct(F.flatten(F.transform(texts, cut)))).alias("gram"))
    return found.select("gram", "record").distinct().repartitionByRange("gram", "record").sortWithinPartitions("gram", "record")


def candidates(postings: DataFrame, term: str, regex: bool = False) -> DataFrame | None:
    """(record) of all records that can match, maybe more; None if any can."""
    asked = grams(term, regex)
    if not asked:
        return None
    found = postings.where(F.col("gram").isin(asked)).groupBy("record").agg(F.count_distinct("gram").alias("n"))
    return found.where(F.col("n") == len(asked)).select("record")


def indexed_search(records: DataFrame, postings: DataFrame, term: str, within: str = "both", kinds: tuple[str, ...] = (), regex: bool = False) -> DataFrame:
    """What ``search`` gives for ``records``, which have ``record``; only candidates are looked at."""
    found = candidates(postings, term, regex)
    rows = records if found is None else records.join(found, "record", "left_semi")
    return search(rows, term, within, kinds, regex)
