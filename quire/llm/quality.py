"""Quality rules as a short-circuit cascade.

Each rule rejects a text on a few measures. On a sample, every rule is timed and
its rejections are counted where the rows lie; rules then run by rejections per
cost, and a text's first rejection ends its run. Measures are taken when a rule
first asks for them. The order changes what a run costs, never what it decides.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, prepare, word_hashes

#: Rows on which rules are timed, about this many at any size of the input. Only the order depends on them.
SAMPLE_ROWS = 2_000


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at a time.
PART = 1 << 20


class Measures:
    """Measures of one text, each taken on demand. Words end at ASCII white space.

    Words of a text beyond PART bytes are kept as 64-bit hashes, 8 bytes each, so
    that it costs little beside itself; shorter ones are quicker as they are.
    """

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes] | np.ndarray:
        raw, hashes, parts, at = self.text.encode(), word_hashes(), [], 0
        if len(raw) <= PART:
            return raw.split()
        while at < len(raw):
            space = _SPACE.search(raw, at + PART)
            end = space.start() if space else len(raw)
            own = raw[at:end].split()
            parts.append(np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own)))
            at = end
        return np.concatenate(parts)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, "#*$%&|<>"))

    @cached_property
    def n_shouts(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if isinstance(w, list):
            windows = list(zip(w, w[1:], w[2:]))
            if len(set(windows)) == len(windows):
                return 0
            count, total, covered = Counter(windows), 0, 0
            for i, x in enumerate(windows):
                if count[x] > 1:
                    total += i + 3 - max(i, covered)
                    covered = i + 3
            return total
        if len(w) < 4:
            return 0
        windows = mixed(mixed(mixed(w[:-2]) + w[1:-1]) + w[2:])
        order = np.argsort(windows)
        equal = windows[order[1:]] == windows[order[:-1]]
        if not equal.any():
            return 0
        again = np.zeros(len(w) + 1, np.int8)
        again[order[1:][equal]] = again[order[:-1][equal]] = 1
        return int(np.count_nonzero(again[:-1] | np.roll(again, 1)[:-1] | np.roll(again, 2)[:-1]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


def few_words(least: int) -> Rule:
    return Rule("few_words", lambda m: m.n_words < least)


BASE_RULES = (
    few_words(50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 100 * m.n_symbols > 20 * m.n_words),
    Rule("shouting", lambda m: 100 * m.n_shouts > 40 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * len(m.lines)),
    Rule("word_length", lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 20 * m.n_words),
)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of ``rules`` by rejections per nanosecond on a sample; a tie keeps the given order."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                for rule in rules:
                    began = time.perf_counter_ns()
                    rejected[rule.name] += rule.rejects(Measures(text))
                    spent[rule.name] += time.perf_counter_ns() - began
        names = [r.name for r in rules]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([spent[n] for n in names], pa.int64()), pa.array([rejected[n] for n in names], pa.int64())], ["name", "ns", "rejected"])

    total = docs.count()
    if not total:
        return [r.name for r in rules]
    some = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, sample_rows / total), seed=7)
    figures = {r[0]: (r[1], r[2]) for r in some.mapInArrow(run, "name string, ns long, rejected long").groupBy("name").agg(F.sum("ns"), F.sum("rejected")).collect()}
    return sorted((r.name for r in rules), key=lambda n: -figures[n][1] / max(1, figures[n][0]))


def first_rejection(text: str | None, rules: tuple[Rule, ...]) -> str | None:
    m = Measures(text)
    return next((r.name for r in rules if r.rejects(m)), None)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null text counts as empty, and so has too few words. Texts are judged
    whole, however long; of equal ones all rows stay or all go. An empty table
    stays empty; columns of any name pass through.
    """
    prepare(docs.sparkSession)
    order = rule_order(docs, rules, text_col, sample_rows)
    cascade = tuple(sorted(rules, key=lambda r: order.index(r.name)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(x.as_py(), cascade) is None for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: its id, the measures, base_failed, kept and rejected_by.

    rejected_by is the rule of the cascade that rejected first (null if kept);
    which of several it is depends on the order. A null text has no words; texts
    are measured whole. Repeated rows have a row each; an empty table gives an
    empty result; other columns are ignored. All measures are taken, so the
    order of rules saves little here.
    """
    prepare(docs.sparkSession)
    order = rule_order(docs, rules, text_col, sample_rows)
    cascade = tuple(sorted(rules, key=lambda r: order.index(r.name)))
    whole = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = ["doc_id", *whole, "base_failed", "kept", "rejected_by"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names[1:]}
            for text in batch.column(1):
                m = Measures(text.as_py())
                for n in whole:
                    out[n].append(getattr(m, n))
                why = next((r.name for r in cascade if r.rejects(m)), None)
                out["base_failed"].append(any(r.rejects(m) for r in BASE_RULES))
                out["kept"].append(why is None and not out["base_failed"][-1])
                out["rejected_by"].append(why)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], t) for n, t in zip(names[1:], kinds))], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
