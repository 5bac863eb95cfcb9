"""A block parser for Markdown, line by line, without dependencies.

Knows front matter, ATX and setext headings, fences, indented code, thematic
breaks, block quotes, nested bullet and ordered lists, pipe tables, HTML blocks
and paragraphs. Inline markup stays source text. Line spans are 0-based and
half-open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")


@dataclass
class Block:
    """A block: type and tag, own text (leaves only), span of lines, parts."""

    type: str
    tag: str = ""
    text: str = ""
    start: int = 0
    end: int = 0
    children: list[Block] = field(default_factory=list)

    def leaf(self) -> Block | None:
        """The first part, in order, that has text of its own."""
        if self.text:
            return self
        return next((x for x in (c.leaf() for c in self.children) if x), None)

    def all_text(self) -> str:
        return self.text or "".join(c.all_text() for c in self.children)


def split_cells(line: str) -> list[str]:
    """Cells of a table row; ``\\|`` and pipes in code spans separate nothing."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    if "\\" not in line and "`" not in line:
        parts = [c.strip() for c in line.split("|")]
        return parts[:-1] if line.endswith("|") else parts
    cells, now, code, skip = [], "", False, False
    for ch in line:
        if skip:
            now += ch if ch == "|" else "\\" + ch
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == "|" and not code:
            cells.append(now.strip())
            now = ""
        else:
            code ^= ch == "`"
            now += ch
    now += "\\" * skip
    return cells + [now.strip()] if now.strip() or not line.endswith("|") else cells


def parse_blocks(text: str) -> list[Block]:
    """Top-level blocks of ``text``."""
    lines = re.split(r"\r\n|\n|\r", text)
    if lines and lines[0].rstrip() == "---":
        for i in range(1, len(lines)):
            if lines[i].rstrip() == "---":
                front = Block("front_matter", "", "\n".join(lines[1:i]), 0, i + 1)
                return [front, *_parse([(k, x) for k, x in enumerate(lines)][i + 1 :])]
    return _parse(list(enumerate(lines)))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _starts_block(line: str) -> bool:
    item = _ITEM.match(line)
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith(">") and _indent(line) < 4 or item and item[3] and (not item[2][0].isdigit() or item[2][:-1] == "1"))


#: Quotes and lists that lie deeper in one another are text of a paragraph.
MAX_NESTING = 100


def _parse(lines: list[tuple[int, str]], depth: int = 0) -> list[Block]:
    """Blocks of numbered lines; nested containers call it with their own lines, unindented."""
    out: list[Block] = []
    i = 0
    while i < len(lines):
        at, line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            i = _code(lines, i, out)
        elif m := _ATX.match(line):
            level = len(m[1])
            out.append(Block("heading", f"h{level}", (m[2] or "").strip(), at, at + 1))
            i += 1
        elif m := _FENCE.match(line):
            i = _fence(lines, i, m, out)
        elif _RULE.match(line):
            out.append(Block("hr", "hr", "", at, at + 1))
            i += 1
        elif depth < MAX_NESTING and line.lstrip().startswith(">"):
            i = _quote(lines, i, out, depth)
        elif depth < MAX_NESTING and _ITEM.match(line):
            i = _list(lines, i, out, depth)
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1][1] and _TABLE_RULE.match(lines[i + 1][1]) and len(split_cells(line)) == len(split_cells(lines[i + 1][1])):
            i = _table(lines, i, out)
        elif _HTML.match(line):
            j = i
            while j < len(lines) and lines[j][1].strip():
                j += 1
            out.append(Block("html_block", "", "\n".join(x for _, x in lines[i:j]), at, lines[j - 1][0] + 1))
            i = j
        else:
            i = _paragraph(lines, i, out)
    return out


def _code(lines: list[tuple[int, str]], i: int, out: list[Block]) -> int:
    j = last = i
    while j < len(lines) and (not lines[j][1].strip() or _indent(lines[j][1]) >= 4):
        last = j if lines[j][1].strip() else last
        j += 1
    out.append(Block("code_block", "code", "\n".join(x[4:] for _, x in lines[i : last + 1]), lines[i][0], lines[last][0] + 1))
    return last + 1


def _fence(lines: list[tuple[int, str]], i: int, m: re.Match, out: list[Block]) -> int:
    close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
    j = i + 1
    while j < len(lines) and not close.match(lines[j][1]):
        j += 1
    shift = _indent(lines[i][1])
    body = [x[min(shift, _indent(x)) :] for _, x in lines[i + 1 : j]]
    out.append(Block("fence", "code", "".join(x + "\n" for x in body), lines[i][0], lines[min(j, len(lines) - 1)][0] + 1))
    return j + 1


def _quote(lines: list[tuple[int, str]], i: int, out: list[Block], depth: int) -> int:
    j, inner = i, []
    while j < len(lines) and lines[j][1].strip():
        x = lines[j][1].lstrip()
        if not x.startswith(">") and (_starts_block(lines[j][1]) or not inner[-1][1].strip()):
            break
        inner.append((lines[j][0], re.sub(r"^> ?", "", x)))
        j += 1
    out.append(Block("blockquote", "blockquote", "", lines[i][0], lines[j - 1][0] + 1, _parse(inner, depth + 1)))
    return j


def _list(lines: list[tuple[int, str]], i: int, out: list[Block], depth: int) -> int:
    kind = _ITEM.match(lines[i][1])[2][-1]
    items: list[Block] = []
    start = lines[i][0]
    while i < len(lines):
        m = _ITEM.match(lines[i][1])
        if not m or m[2][-1] != kind or _RULE.match(lines[i][1]):
            break
        pad = len(m[3]) if 0 < len(m[3]) <= 4 else 1
        width = len(m[1]) + len(m[2]) + pad
        own, j, blank = [(lines[i][0], lines[i][1][width:])], i + 1, not lines[i][1][width:].strip()
        last = i
        while j < len(lines):
            x = lines[j][1]
            if not x.strip():
                blank = True
            elif _indent(x) >= width:
                blank, last = False, j
            elif blank or _starts_block(x):
                break
            else:
                last = j  # the paragraph goes on without its indent
            own.append((lines[j][0], x[min(width, _indent(x)) :]))
            j += 1
        items.append(Block("list_item", "li", "", lines[i][0], lines[last][0] + 1, _parse(own[: last - i + 1], depth + 1)))
        i = last + 1
        k = i
        while k < len(lines) and not lines[k][1].strip():
            k += 1
        if k < len(lines) and (m := _ITEM.match(lines[k][1])) and m[2][-1] == kind:
            i = k
    bullet = kind in "-+*"
    out.append(Block("bullet_list" if bullet else "ordered_list", "ul" if bullet else "ol", "", start, items[-1].end, items))
    return i


def _table(lines: list[tuple[int, str]], i: int, out: list[Block]) -> int:
    def row(at: int, line: str, cell: str, n: int) -> Block:
        cells = (split_cells(line) + [""] * n)[:n]
        return Block("tr", "tr", "", at, at + 1, [Block(cell, cell, c, at, at + 1) for c in cells])

    n, j = len(split_cells(lines[i][1])), i + 2
    head = row(*lines[i], "th", n)
    rows = []
    while j < len(lines) and lines[j][1].strip() and not _starts_block(lines[j][1]):
        rows.append(row(*lines[j], "td", n))
        j += 1
    out.append(Block("table", "table", "", lines[i][0], lines[j - 1][0] + 1, [head, *rows]))
    return j


def _paragraph(lines: list[tuple[int, str]], i: int, out: list[Block]) -> int:
    j = i
    while j < len(lines) and lines[j][1].strip():
        x = lines[j][1]
        if j > i:
            under = _SETEXT.match(x)
            if under:
                level = 1 if under[1][0] == "=" else 2
                text = "\n".join(y.strip() for _, y in lines[i:j])
                out.append(Block("heading", f"h{level}", text, lines[i][0], lines[j][0] + 1))
                return j + 1
            if _starts_block(x):
                break
        j += 1
    text = "\n".join(y.strip() for _, y in lines[i:j])
    out.append(Block("paragraph", "p", text, lines[i][0], lines[j - 1][0] + 1))
    return j


def flat(blocks: list[Block], parent: int = -1, depth: int = 0, base: int = 0) -> list[tuple]:
    """(index, parent, depth, type, tag, text, start, end) in document order."""
    out: list[tuple] = []
    for b in blocks:
        index = base + len(out)
        out.append((index, parent, depth, b.type, b.tag, b.text, b.start, b.end))
        out += flat(b.children, index, depth + 1, index + 1)
    return out


BLOCK = "struct<block: int, parent: int, depth: int, type: string, tag: string, content: string, line_start: int, line_end: int>"


def with_blocks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and ``blocks``: each document's blocks, flattened; lines are 1-based here. Null texts have none."""
    at, names = docs.columns.index(text_col), [*docs.columns, "blocks"]
    kinds = [("block", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("type", pa.string()), ("tag", pa.string()), ("content", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]
    item = pa.list_(pa.struct(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[(*b[:6], b[6] + 1, b[7]) for b in flat(parse_blocks(x.as_py() or ""))] for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[dict(zip([k for k, _ in kinds], b)) for b in r] for r in rows], item)], names)

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast(f"array<{BLOCK}>").alias("blocks")).schema)
