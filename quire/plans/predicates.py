"""Predicates of searches, compiled to columns.

A test is one of ``has(f)``, ``"text" in f``, ``f ~ "regex"``, ``model <= Base``
and ``f = v`` (also ``!=``, ``>=``, ``<=``; ``v`` is quoted or an unsigned
number). Tests join by ``and``, ``or``, ``not`` and parentheses. Regular
expressions are Java's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QuireError
from .models import Registry

COMPARISONS = ("!=", ">=", "<=", "=")


class PredicateError(QuireError, ValueError):
    """A predicate that has none of the forms."""


@dataclass(frozen=True)
class Token:
    """``kind``: name, text, number, mark or end."""

    kind: str
    value: str


@dataclass(frozen=True)
class Test:
    """``op``: has, in, ~, isa or a comparison, of ``name`` with ``value``, a text or a number."""

    op: str
    name: str
    value: str | float | None = None


@dataclass(frozen=True)
class Joined:
    """``op``: and, or, not."""

    op: str
    parts: tuple[Test | Joined, ...]


def tokens(where: str) -> list[Token]:
    out, at = [], 0
    while at < len(where):
        c, begin = where[at], at
        if c.isspace():
            at += 1
            continue
        if c == '"':
            close = where.find('"', at + 1)
            if close <= at + 1:
                raise PredicateError(f"a text doesn't end or is empty: {where}")
            out.append(Token("text", where[at + 1 : close]))
            at = close + 1
        elif c == "_" or c.isascii() and c.isalpha():
            while at < len(where) and (where[at] == "_" or where[at].isalnum()):
                at += 1
            out.append(Token("name", where[begin:at]))
        elif c.isdigit():
            while at < len(where) and where[at].isdigit():
                at += 1
            if at + 1 < len(where) and where[at] == "." and where[at + 1].isdigit():
                at += 1
                while at < len(where) and where[at].isdigit():
                    at += 1
            out.append(Token("number", where[begin:at]))
        else:
            mark = next((m for m in (*COMPARISONS, "~", "(", ")") if where.startswith(m, at)), None)
            if mark is None:
                raise PredicateError(f"no such predicate: {where}")
            out.append(Token("mark", mark))
            at += len(mark)
    return [*out, Token("end", "")]


class _Parser:
    def __init__(self, where: str):
        self.where, self.left = where, tokens(where)

    def take(self, kind: str, *values: str) -> str | None:
        """The next token's value if it is of ``kind`` and, if any are given, one of ``values``."""
        head = self.left[0]
        if head.kind != kind or values and head.value not in values:
            return None
        self.left.pop(0)
        return head.value

    def need(self, kind: str, *values: str) -> str:
        found = self.take(kind, *values)
        if found is None:
            raise PredicateError(f"no such predicate: {self.where}")
        return found

    def whole(self) -> Test | Joined:
        found = self.joined("or", lambda: self.joined("and", self.one))
        self.need("end")
        return found

    def joined(self, word: str, part: Callable[[], Test | Joined]) -> Test | Joined:
        parts = [part()]
        while self.take("name", word):
            parts.append(part())
        return Joined(word, tuple(parts)) if len(parts) > 1 else parts[0]

    def one(self) -> Test | Joined:
        if self.take("mark", "("):
            found = self.joined("or", lambda: self.joined("and", self.one))
            self.need("mark", ")")
            return found
        if (text := self.take("text")) is not None:
            self.need("name", "in")
            return Test("in", self.need("name"), text)
        name = self.need("name")
        if name == "not" and self.left[0].value not in (*COMPARISONS, "~"):
            return Joined("not", (self.one(),))
        if name == "has" and self.take("mark", "("):
            found = Test("has", self.need("name"))
            self.need("mark", ")")
            return found
        op = self.need("mark", "~", *COMPARISONS)
        if op == "~":
            return Test("~", name, self.need("text"))
        if (text := self.take("text")) is not None:
            return Test(op, name, text)
        if (number := self.take("number")) is not None:
            return Test(op, name, float(number))
        if name == "model" and op == "<=":
            return Test("isa", name, self.need("name"))
        raise PredicateError(f"no such predicate: {self.where}")


def parse_predicate(where: str) -> Test | Joined:
    return _Parser(where).whole()


def _compiled(tree: Test | Joined, leaf: Callable[[Test], Column]) -> Column:
    if isinstance(tree, Test):
        return leaf(tree)
    parts = [_compiled(x, leaf) for x in tree.parts]
    return ~parts[0] if tree.op == "not" else reduce((lambda a, b: a & b) if tree.op == "and" else (lambda a, b: a | b), parts)


def compile_predicate(where: str, schema: T.StructType, payload: Callable[[str], Column], doc: Column, model: Column, registry: Registry | None = None, strict: bool = True) -> Column:
    """``where`` over a typed payload; every form is an expression that Catalyst can push down.

    With ``strict`` off, what has none of the forms is false everywhere. Null,
    missing and values of the other type never compare; they only differ.
    """
    kinds = {f.name: f.dataType for f in schema.fields}
    false = F.lit(False)

    def column(name: str) -> tuple[Column, T.DataType | None]:
        if name in kinds:
            return payload(name), kinds[name]
        return (doc, T.StringType()) if name == "doc" else (F.lit(None).cast("string"), None)

    def leaf(test: Test) -> Column:
        if test.op == "isa":
            if registry is None:
                raise PredicateError("model <= needs the registered models")
            below = registry.descendants(test.value)
            return model.isin(below) if below else false
        value, kind = column(test.name)
        if test.op == "has":
            if test.name not in kinds:
                return false
            return value.isNotNull() & (value != "") if isinstance(kind, T.StringType) else value.isNotNull()
        if test.op == "in":
            if test.name not in kinds:
                return false
            if isinstance(kind, T.StringType):
                return F.coalesce(value.contains(test.value), false)
            return F.coalesce(F.array_contains(value, test.value), false) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType) else false
        if test.op == "~":
            # ``doc`` is the document's name here, whatever the payload has
            shown = doc if test.name == "doc" else F.to_json(value) if isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)) else value.cast("string")
            return F.coalesce(shown.rlike(test.value), false)
        fits = isinstance(kind, T.StringType if isinstance(test.value, str) else T.NumericType)
        if not fits:
            return F.lit(test.op == "!=")
        literal = F.lit(test.value)
        made = {"=": value == literal, "!=": value != literal, ">=": value >= literal, "<=": value <= literal}[test.op]
        return F.coalesce(made, F.lit(test.op == "!="))

    try:
        tree = parse_predicate(where.strip())
    except PredicateError:
        if strict:
            raise
        return false
    return _compiled(tree, leaf)


#: Names in predicates on field records, and the columns that they mean.
FIELD_NAMES = {"value": "value", "doc": "doc", "model": "model", "field": "field_path", "path": "path", "owning_section": "owning_section"}


def field_predicate(where: str, strict: bool = True) -> Column:
    """Predicates on field records: comparisons of text over value, doc, model, field, path, owning_section; has(x)."""
    where = where.strip()
    name, _, value = where.partition("=")
    differs, name = name.rstrip().endswith("!"), name.rstrip().removesuffix("!").strip()
    if where.startswith("has(") and where.endswith(")") and where[4:-1].strip() in FIELD_NAMES:
        return F.coalesce(~F.col(FIELD_NAMES[where[4:-1].strip()]).isin("", "[]", "{}"), F.lit(False))
    # a value may stand without quotes
    bare = value.strip().removeprefix('"').removesuffix('"')
    if name in FIELD_NAMES and "=" in where and '"' not in bare:
        same = F.coalesce(F.col(FIELD_NAMES[name]).cast("string") == bare, F.lit(False))
        return ~same if differs else same
    if strict:
        raise PredicateError(f"no such predicate on fields: {where}")
    return F.lit(False)


def section_predicate(where: str, strict: bool = True) -> Column:
    """Predicates on section records: title ~, "x" in about, breadcrumbs or semantic_tags, path =."""
    lists = {"about": "about", "breadcrumbs": "breadcrumbs", "semantic_tags": "semantic"}
    try:
        test = parse_predicate(where.strip())
        if isinstance(test, Test):
            if (test.op, test.name) == ("~", "title"):
                return F.coalesce(F.col("title").rlike(test.value), F.lit(False))
            if test.op == "in" and test.name in lists:
                return F.coalesce(F.array_contains(lists[test.name], test.value), F.lit(False))
            if (test.op, test.name) == ("=", "path") and isinstance(test.value, str):
                return F.coalesce(F.col("section_path") == test.value, F.lit(False))
        raise PredicateError(f"no such predicate on sections: {where}")
    except PredicateError:
        if strict:
            raise
        return F.lit(True)
