"""URL filter rules by a sort-merge range join.

A host's labels in reverse, each ended by a dot, form its canonical key; a rule
for a host and its subdomains is then the interval of keys that start with the
rule's key. Such intervals are nested or disjoint. Pages and rules are dealt
into key ranges (a rule to every range that its interval meets) and sorted by
key; one sweep over a range keeps a stack of the rules whose intervals are open,
outer ones below. Rows of one key can fill several ranges.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Keys from which range bounds are chosen, about this many; only the balance depends on them.
SAMPLE_KEYS = 20_000
ROWS_PER_RANGE = 200_000


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the filters see them; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.encode().lower().decode(), rest[:end]


def host_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


class OpenRules:
    """The rules whose intervals hold the present key, as a stack by host."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, paths, lengths = self.stack[-1]
        if path not in paths or verdict == "block":
            paths[path] = (host + path, verdict)
        if len(path) not in lengths:
            lengths.append(len(path))
            lengths.sort(reverse=True)

    def longest(self, key: str, path: str) -> tuple[str, str] | None:
        self.close(key)
        best = None
        for _, paths, lengths in reversed(self.stack):
            hit = next((paths[path[:n]] for n in lengths if n <= len(path) and path[:n] in paths), None)
            if hit and (best is None or len(hit[0]) > len(best[0])):
                best = hit
        return best


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each row of ``pages`` by ``rules`` (host, path, verdict).

    Returns page_id, host, path, rule (host and path of the longest rule that
    fits; of equal length, that of the longer host), verdict (the rule's, else
    ``default``). Of rules with one host and path, ``block`` wins. Rules with a
    null host, path or verdict are left out. A null url, or one without ``://``,
    has empty host and path and meets no rule. Repeated pages and null ids are
    judged like others; empty tables give empty results or defaults.
    """
    spark = pages.sparkSession
    prepare(spark)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    total = urls.count()
    ranges = max(1, -(-total // ROWS_PER_RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = urls.select("url").sample(min(1.0, SAMPLE_KEYS / total), seed=7).collect() if total else []
    keys = sorted(host_key(split_url(r[0])[0]) for r in sample)
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    kinds = "part int, key string, kind int, page_id long, host string, path string, verdict string"
    names = [x.split()[0] for x in kinds.split(", ")]
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for page, url in zip(*(c.to_pylist() for c in batch.columns)):
                host, path = split_url(url)
                key = host_key(host)
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                part = low + xxhash.xxh64_intdigest(f"{page}") % (high - low + 1)
                for column, value in zip(out, (part, key, 1, page, host, path, None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    def of_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                key = host_key(host.encode().lower().decode())
                for part in range(bisect_left(bounds, key), bisect_right(bounds, key[:-1] + "/") + 1):
                    for column, value in zip(out, (part, key, 0, None, host, path, verdict)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rules = None, OpenRules()
        for batch in batches:
            out = [[] for _ in range(5)]
            for part, key, kind, page, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    at, rules = part, OpenRules()
                if kind == 0:
                    rules.open(key, host, path, verdict)
                else:
                    rule, judged = rules.longest(key, path) or (None, default)
                    for column, value in zip(out, (page, host, path, rule, judged)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] + [pa.string()] * 4)], ["page_id", "host", "path", "rule", "verdict"])

    usable = rules.select("host", "path", "verdict").dropna()
    rows = urls.mapInArrow(of_pages, kinds).unionByName(usable.mapInArrow(of_rules, kinds))
    dealt = rows.repartition(ranges, "part").sortWithinPartitions("part", "key", "kind")
    return dealt.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
