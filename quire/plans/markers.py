"""Markers in templates: ``⸢kind,trait•name⸥``."""

from __future__ import annotations

import re
from dataclasses import dataclass

MARKER = re.compile(r"⸢([^⸥]+)⸥")
#: Markers and single-field expressions ``{{ name }}``.
DYNAMIC = re.compile(r"⸢([^⸥]+)⸥|\{\{\s*(.*?)\s*\}\}")


@dataclass(frozen=True)
class Marker:
    kind: str
    traits: tuple[str, ...]
    name: str

    @property
    def captures(self) -> bool:
        return self.kind in ("rev", "optrev")


def parse_marker(inner: str) -> Marker:
    """The head before the first ``•`` lists the kind (``rev`` if none) and traits; the rest is the name."""
    head, _, name = inner.partition("•")
    kind, *traits = [x.strip() for x in head.split(",") if x.strip()] or ["rev"]
    return Marker(kind, tuple(traits), name.strip())


def markers_in(text: str) -> list[Marker]:
    return [parse_marker(m[1]) for m in MARKER.finditer(text)]


def pieces(text: str) -> list[str | Marker]:
    """Literals and markers in order; an expression is a marker of kind ``expr``."""
    out: list[str | Marker] = []
    at = 0
    for m in DYNAMIC.finditer(text):
        out += [text[at : m.start()], parse_marker(m[1]) if m[1] else Marker("expr", (), m[2])]
        at = m.end()
    return [x for x in [*out, text[at:]] if x != ""]


def capture_pattern(text: str, java: bool = False) -> tuple[str, list[str]]:
    """An anchored pattern for what ``text`` renders to, and the names of its groups.

    ``java`` quotes literals and lets a dot stop at line feeds alone, as here.
    """
    def quote(x: str) -> str:
        return "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E" if java else re.escape(x)

    found = pieces(text)
    names = [x.name for x in found if isinstance(x, Marker) and x.captures]
    body = "".join(quote(x) if isinstance(x, str) else "(.*?)" if x.captures else ".*?" for x in found)
    return (f"(?d)\\A{body}\\z" if java else body), names


def field_lines(template: str) -> dict[str, int]:
    """1-based line of each field's last capturing marker in the template."""
    return {m.name: n for n, line in enumerate(template.split("\n"), 1) for m in markers_in(line) if m.captures and m.name}
