"""Templates compiled into steps for extraction and parts for rendering."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from typing import Any

import yaml

from ..errors import CompileError
from ..sources.blocks import Block, parse_blocks, split_cells
from .markers import MARKER, Marker, capture_pattern, markers_in, parse_marker


@dataclass(frozen=True)
class BlockHandler:
    """How blocks of ``type`` capture: ``compile`` gives the names that a template's block captures, none if it isn't for this handler;
    ``read`` the values by name that a document's block (second) has for a template's (first), None if it doesn't fit."""

    type: str
    compile: Callable[[Block], tuple[str, ...]]
    read: Callable[[Block, Block], dict[str, Any] | None]


@dataclass(frozen=True)
class Grammar:
    """What templates and documents are read with: a parser of blocks, and handlers that go before the built-in ones."""

    parse: Callable[[str], list[Block]] = parse_blocks
    handlers: tuple[BlockHandler, ...] = ()

    def handler(self, kind: str) -> BlockHandler | None:
        return next((h for h in self.handlers if h.type == kind), None)


MARKDOWN = Grammar()


@dataclass(frozen=True)
class Step:
    """One thing to look for, in the order of the template's blocks.

    ``mode``: text and yaml fill fields from a block, list and rows a field with
    many values, body takes whole source lines up to the next step's block, own
    is read by a handler from ``source``, and anchor only marks a block of its type.
    """

    outer: int
    type: str
    tag: str
    mode: str
    names: tuple[str, ...] = ()
    pattern: str = ""
    columns: tuple[tuple[int, str, str], ...] = ()
    markers: tuple[Marker, ...] = ()
    source: Block | None = field(default=None, compare=False)

    @property
    def is_anchor(self) -> bool:
        return self.mode == "anchor"


@lru_cache(maxsize=256)
def compile_steps(template: str, grammar: Grammar = MARKDOWN) -> tuple[Step, ...]:
    """The steps of a template; wrong markers are errors."""
    steps: list[Step] = []
    for outer, block in enumerate(grammar.parse(template)):
        own = _steps_of(block, outer, block, grammar)
        steps += own or [Step(outer, block.type, block.tag, "anchor", pattern=re.escape(block.all_text().strip()))]
    captured = [m for s in steps if s.mode != "rows" for m in s.markers]
    sources = [m.name for m in captured if m.kind == "rev"]
    if twice := sorted({n for n in sources if sources.count(n) > 1}):
        raise CompileError(f"several rev markers for {', '.join(twice)}")
    if orphans := sorted({m.name for m in captured if m.kind == "optrev"} - set(sources)):
        raise CompileError(f"optrev markers without a rev marker: {', '.join(orphans)}")
    return tuple(steps)


def _steps_of(block: Block, outer: int, node: Block, grammar: Grammar) -> list[Step]:
    base = {"outer": outer, "type": block.type, "tag": block.tag}
    handler = grammar.handler(node.type) if node is block else None
    if handler and (names := handler.compile(node)):
        return [Step(**base, mode="own", names=tuple(names), markers=tuple(markers_in(node.all_text())), source=node)]
    if node.type in ("bullet_list", "ordered_list"):
        found = [(item, m[0]) for item in node.children if (m := markers_in(item.all_text())) and m[0].captures]
        if found:
            # the literals about an item's marker belong to the template, not to the values
            return [Step(**base, mode="list", names=(m.name,), pattern=capture_pattern(item.leaf().text)[0], markers=(m,)) for item, m in found]
    elif node.type == "table":
        cells = [(i, c.text) for i, c in enumerate(node.children[-1].children)] if len(node.children) > 1 else []
        columns = [(i, m[0], text) for i, text in cells if (m := markers_in(text)) and m[0].captures]
        if columns:
            return [Step(**base, mode="rows", names=(columns[0][1].name,), columns=tuple((i, m.name, capture_pattern(text)[0]) for i, m, text in columns), markers=tuple(m for _, m, _ in columns))]
    elif node.type in ("fence", "front_matter"):
        m = next((m for m in markers_in(node.text) if m.captures and "dict" in m.traits), None)
        if m:
            return [Step(**base, mode="yaml", names=(m.name,), markers=(m,))]
    text = node.text.strip()
    if text and (MARKER.search(text) or "{{" in text):
        pattern, names = capture_pattern(text)
        captures = tuple(m for m in markers_in(text) if m.captures)
        if not names:
            return [Step(**base, mode="anchor", pattern=pattern)]
        alone = block.type == "paragraph" and node is block and pattern == "(.*?)"
        return [Step(**base, mode="body" if alone else "text", names=tuple(names), pattern=pattern, markers=captures)]
    return [s for c in node.children for s in _steps_of(block, outer, c, grammar)]


#: YAML may nest so deep, and hold so many values for each character, with what its aliases repeat.
MAX_NESTING, MAX_VALUES = 100, 10


def _plain(value: Any, left: list[int], depth: int = 0) -> Any:
    """YAML values as JSON has them: dates as ISO text, keys as text. ``left`` counts down the values that may still come."""
    left[0] -= 1
    if depth > MAX_NESTING or left[0] < 0:
        raise CompileError("YAML nests too deep" if depth > MAX_NESTING else "YAML repeats too much by aliases")
    if isinstance(value, dict):
        return {str(k): _plain(v, left, depth + 1) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v, left, depth + 1) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


#: The C parser where PyYAML has it.
_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def load_yaml(text: str) -> Any:
    depth = 0
    try:
        if text.count("[") + text.count("{") + text.count("- ") > MAX_NESTING or " " * MAX_NESTING in text:
            # loading recurses, reading events doesn't
            for event in yaml.parse(text, Loader=_LOADER):
                depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
                if depth > MAX_NESTING:
                    raise CompileError("YAML nests too deep")
        return _plain(yaml.load(text, Loader=_LOADER), [MAX_NESTING + MAX_VALUES * len(text)])
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise CompileError(f"YAML can't be read: {e}") from e


def dump_yaml(value: Any) -> str:
    return yaml.dump(value, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), allow_unicode=True, sort_keys=False).strip()


def _reading(step: Step, block: Block, grammar: Grammar) -> dict[str, Any] | None:
    """What ``step`` reads from a block; None if it doesn't fit there."""
    if block.type != step.type:
        return None
    if step.is_anchor or step.mode == "body":
        return {}
    if step.mode == "own":
        return grammar.handler(step.type).read(step.source, block)
    if block.tag != step.tag:
        return None
    name = step.names[0]
    if step.mode == "rows":
        rows = [{n: m[1] for i, n, pattern in step.columns if i < len(r.children) and (m := re.fullmatch(pattern, r.children[i].text.strip())) and m.groups()} for r in block.children[1:]]
        return {name: kept} if (kept := [r for r in rows if r]) else None
    if step.mode == "list":
        texts = [x.strip() for item in block.children if (leaf := item.leaf()) and (x := leaf.text).strip()]
        return {name: [m[1] if (m := re.fullmatch(step.pattern, x)) and m.groups() else x for x in texts]} if texts else None
    leaf = block.leaf()
    if leaf is None:
        return None
    if step.mode == "yaml":
        value = load_yaml(leaf.text)
        return None if value is None else {name: value}
    m = re.fullmatch(step.pattern, leaf.text.strip())
    return dict(zip(step.names, m.groups())) if m else None


class _Placing:
    """Where the steps of a template find their blocks; each pair of step and block is read once at most."""

    def __init__(self, steps: tuple[Step, ...], blocks: list[Block], grammar: Grammar):
        self.steps, self.blocks, self.grammar = steps, blocks, grammar
        self.read: dict[tuple[int, int], dict[str, Any] | None] = {}

    def reading(self, k: int, i: int) -> dict[str, Any] | None:
        if (k, i) not in self.read:
            self.read[k, i] = _reading(self.steps[k], self.blocks[i], self.grammar)
        return self.read[k, i]

    def first_fit(self, k: int, begin: int) -> int | None:
        return next((i for i in range(begin, len(self.blocks)) if self.reading(k, i) is not None), None)

    def places(self) -> Iterator[tuple[int, range]]:
        """(step, blocks) in order. Steps of one template block are a group: they share a block of the document.

        A group looks from the block after its predecessor's. A body goes up to
        the block of the first later step that finds any. Once a group has its
        block, its other steps try that one alone, and only if no block was
        passed over for it; this is how documents have always been read.
        """
        begin = 0
        for _, group in groupby(range(len(self.steps)), lambda k: self.steps[k].outer):
            own = None
            for k in group:
                if self.steps[k].mode == "body":
                    ends = (self.first_fit(later, begin) for later in range(k + 1, len(self.steps)))
                    end = next((i for i in ends if i is not None), len(self.blocks))
                    yield k, range(begin, end)
                    own = max(begin, end - 1)
                elif own is None:
                    own = self.first_fit(k, begin)
                    if own is not None:
                        yield k, range(own, own + 1)
                elif own == begin < len(self.blocks) and self.reading(k, own) is not None:
                    yield k, range(own, own + 1)
            begin = begin if own is None else max(begin, own + 1)


def extract(steps: tuple[Step, ...], text: str, grammar: Grammar = MARKDOWN) -> dict[str, Any]:
    """Untyped values of a document: steps are placed on its blocks, then read; steps without a place give none."""
    blocks = grammar.parse(text)
    placing = _Placing(steps, blocks, grammar)
    lines = re.split(r"\r\n|\n|\r", text)
    out: dict[str, Any] = {}
    for k, where in placing.places():
        if steps[k].mode == "body":
            out[steps[k].names[0]] = "\n".join(lines[blocks[where[0]].start : blocks[where[-1]].end]).strip() if where else ""
        else:
            out |= placing.reading(k, where[0]) or {}
    return out


@dataclass(frozen=True)
class Part:
    """A template block to render: ``text`` with markers; lists and tables repeat it for each value of ``name``."""

    mode: str
    text: str
    name: str = ""
    head: str = ""


@lru_cache(maxsize=256)
def compile_parts(template: str) -> tuple[Part, ...]:
    lines = re.split(r"\r\n|\n|\r", template)
    parts = []
    for block in parse_blocks(template):
        source = lines[block.start : block.end]
        while source and not source[-1].strip():
            source.pop()
        if block.type in ("bullet_list", "ordered_list"):
            first = block.children[0]
            item = "\n".join(lines[first.start : first.end]).rstrip()
            if m := MARKER.search(item):
                parts.append(Part("list", item, parse_marker(m[1] if "•" in m[1] else "•" + m[1]).name))
                continue
        elif block.type == "table" and len(source) >= 3 and (m := MARKER.search(source[2])):
            parts.append(Part("table", source[2], parse_marker(m[1] if "•" in m[1] else "•" + m[1]).name, "\n".join(source[:2])))
            continue
        elif block.type == "front_matter":
            parts.append(Part("text", "---\n" + "\n".join(source[1:-1]).strip("\n") + "\n---"))
            continue
        parts.append(Part("text", "\n".join(source)))
    return tuple(parts)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
