"""Chat formatting by incremental black-box rendering.

A template is a function from turns to text; nothing else is asked of it. Turns
are located by rendering successive prefixes: what a prefix adds to the one
before is its last turn's span. Where an earlier output is no prefix of the
next, the template rewrites history, which is reported. A turn's text within its
span is found by rendering the prefix once more with a mark in its place.

Every prefix is rendered, at any number of turns: a template that rewrites
history at some lengths only is found out. That takes two renderings a turn, and
so time by the square of a conversation's length; the template below remembers
turns, so that a rendering mostly costs a join of strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

Turns = list[tuple[str, str]]
MARK = "\ue000"
#: Characters of rendered turns that a worker process remembers.
REMEMBERED_CHARS = 1 << 24

_CONTROL = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\]|\|)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\]|\|)")


def escape(text: str) -> str:
    """Put a backslash, or one more, into each control string."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class RenderedTurns(dict):
    """What the template makes of single turns; forgotten whenever they hold ``most`` characters."""

    def __init__(self, most: int = REMEMBERED_CHARS):
        self.most, self.held = most, 0

    def __missing__(self, turn: tuple[str, str]) -> str:
        role, text = turn
        made = "<|" + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n" + escape(text) + "</s>"
        if self.held + len(made) > self.most:
            self.clear()
            self.held = 0
        if len(made) <= self.most:
            self[turn] = made
            self.held += len(made)
        return made


@cache
def rendered_turns() -> RenderedTurns:
    """One per worker process."""
    return RenderedTurns()


def render(turns: Turns) -> str:
    """The template: ``<s>``, then ``<|role``, a line end, the text and ``</s>`` for each turn."""
    return "<s>" + "".join(map(rendered_turns().__getitem__, turns))


def parse(formatted: str) -> Turns:
    """The turns that ``render`` was given."""
    turns = []
    for part in formatted.removeprefix("<s>").split("</s>")[:-1]:
        role, _, text = part.removeprefix("<|").partition("\n")
        turns.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)))
    return turns


def locate(template: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The rendering of ``turns`` and each turn's (start, end, start of text, end of text), or None if history is rewritten."""
    spans, before = [], ""
    for i, (role, _) in enumerate(turns):
        after = template(turns[: i + 1])
        marked = template([*turns[:i], (role, MARK)])
        if not (after.startswith(before) and marked.startswith(before)):
            return template(turns), None
        start, end = len(before), len(after)
        # the role comes before the text and may hold the mark as well
        at = marked.rfind(MARK, start)
        found = at >= 0 and marked.count(MARK, start) > role.count(MARK)
        spans.append((start, end, at, end - (len(marked) - at - 1)) if found else (start, end, end, end))
        before = after
    return before if turns else template(turns), spans


def format_conversations(turns: DataFrame, template: Callable[[Turns], str] = render, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format each conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, formatted, spans (one struct for each turn: start, end,
    text_start, text_end, in_loss; code points; null if the template rewrites
    history). Turns are in order of turn, then role and text, nulls first; a
    null role or text counts as empty, a null conv_id is a conversation. Texts
    are kept whole, however long. Repeated rows are turns of their own; an empty
    table gives an empty result; other columns are ignored. A conversation, which
    becomes one string, is formatted in one task.
    """
    prepare(turns.sparkSession)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = ([], [], []), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.list_(span))], ["conv_id", "formatted", "spans"])

        def close() -> None:
            whole, spans = locate(template, own)
            out[0].append(at)
            out[1].append(whole)
            out[2].append(spans and [(*s, role in loss_roles) for s, (role, _) in zip(spans, own)])

        at, own = None, []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if own and conv != at:
                    close()
                    own = []
                    size += len(out[1][-1])
                    if size > 1 << 21:
                        yield flush()
                        out, size = ([], [], []), 0
                at = conv
                own.append((role or "", text or ""))
        if own:
            close()
        yield flush()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long, text_start: long, text_end: long, in_loss: boolean>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of ``format_conversations``, all read from its texts and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = [unescape(text[s["text_start"] : s["text_end"]]) for s in spans or () if s["in_loss"]]
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
