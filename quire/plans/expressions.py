"""Expressions of ``py`` markers, compiled to columns from a small safe part of Python.

Nothing is ever evaluated as Python: an expression is parsed, and what consists
of allowed nodes alone becomes a column over the payload. Whether expressions
are rendered at all is up to ``Expressions``; without one, or where an
expression isn't allowed, markers stay as written.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.LongType, T.DoubleType)


class NotAllowed(ValueError):
    """An expression outside of the safe part."""


@dataclass(frozen=True)
class Expressions:
    """``accept`` sees each expression's source and may refuse it."""

    accept: Callable[[str], bool] = lambda source: True

    def column(self, source: str, payload: Column, schema: T.StructType) -> Column | None:
        """The expression's value as text, or None if it isn't allowed."""
        try:
            if not self.accept(source):
                return None
            value, kind = _Compiler(payload, schema).visit(ast.parse(source.strip(), mode="eval").body)
        except (NotAllowed, SyntaxError, RecursionError):
            return None
        return F.initcap(value.cast("string")) if isinstance(kind, T.BooleanType) else value.cast("string")


class _Compiler(ast.NodeVisitor):
    """Nodes to (column, type). Types are text, long, double, boolean and arrays of text."""

    def __init__(self, payload: Column, schema: T.StructType):
        self.payload, self.kinds = payload, {f.name: f.dataType for f in schema.fields}

    def generic_visit(self, node: ast.AST) -> tuple[Column, T.DataType]:
        raise NotAllowed(type(node).__name__)

    def numbers(self, *nodes: ast.AST) -> tuple[list[Column], T.DataType]:
        made = [self.visit(n) for n in nodes]
        if not all(isinstance(k, _NUMBERS) for _, k in made):
            raise NotAllowed("a number is asked for")
        return [c for c, _ in made], T.DoubleType() if any(isinstance(k, T.DoubleType) for _, k in made) else T.LongType()

    def visit_Constant(self, node: ast.Constant) -> tuple[Column, T.DataType]:
        for python, kind in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
            if type(node.value) is python:
                return F.lit(node.value).cast(kind), kind
        raise NotAllowed(repr(node.value))

    def visit_Name(self, node: ast.Name) -> tuple[Column, T.DataType]:
        kind = self.kinds.get(node.id)
        if not isinstance(kind, (T.StringType, T.BooleanType, *_NUMBERS)) and kind != T.ArrayType(T.StringType()):
            raise NotAllowed(node.id)
        return self.payload[node.id], kind

    def visit_BinOp(self, node: ast.BinOp) -> tuple[Column, T.DataType]:
        if isinstance(node.op, ast.Add):
            (a, x), (b, y) = self.visit(node.left), self.visit(node.right)
            if isinstance(x, T.StringType) and isinstance(y, T.StringType):
                return F.concat(a, b), x
        (a, b), kind = self.numbers(node.left, node.right)
        if isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}[type(node.op)], kind
        divisor = F.nullif(b, F.lit(0))  # a division by zero has no value
        if isinstance(node.op, ast.Div):
            return a / divisor, T.DoubleType()
        if isinstance(node.op, ast.FloorDiv):
            return F.floor(a / divisor).cast(kind), kind
        if isinstance(node.op, ast.Mod):
            return a - divisor * F.floor(a / divisor), kind  # the divisor's sign, as in Python
        raise NotAllowed(type(node.op).__name__)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> tuple[Column, T.DataType]:
        if isinstance(node.op, ast.USub):
            (a,), kind = self.numbers(node.operand)
            return -a, kind
        a, kind = self.visit(node.operand)
        if isinstance(node.op, ast.Not) and isinstance(kind, T.BooleanType):
            return ~a, kind
        raise NotAllowed(type(node.op).__name__)

    def visit_Compare(self, node: ast.Compare) -> tuple[Column, T.DataType]:
        if len(node.ops) != 1:
            raise NotAllowed("a chain of comparisons")
        (a, x), (b, y) = self.visit(node.left), self.visit(node.comparators[0])
        op = type(node.ops[0])
        if op in (ast.In, ast.NotIn) and isinstance(x, T.StringType):
            found = F.array_contains(b, a) if isinstance(y, T.ArrayType) else F.contains(b, a) if isinstance(y, T.StringType) else None
            if found is not None:
                return (found if op is ast.In else ~found), T.BooleanType()
        if type(x) is not type(y) and not (isinstance(x, _NUMBERS) and isinstance(y, _NUMBERS)):
            raise NotAllowed("values of different types")
        tests = {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}
        if op not in tests:
            raise NotAllowed(op.__name__)
        return tests[op](), T.BooleanType()

    def visit_BoolOp(self, node: ast.BoolOp) -> tuple[Column, T.DataType]:
        made = [self.visit(v) for v in node.values]
        if not all(isinstance(k, T.BooleanType) for _, k in made):
            raise NotAllowed("a truth value is asked for")
        out = made[0][0]
        for c, _ in made[1:]:
            out = out & c if isinstance(node.op, ast.And) else out | c
        return out, T.BooleanType()

    def visit_IfExp(self, node: ast.IfExp) -> tuple[Column, T.DataType]:
        (test, kind), (a, x), (b, y) = self.visit(node.test), self.visit(node.body), self.visit(node.orelse)
        if not isinstance(kind, T.BooleanType) or type(x) is not type(y):
            raise NotAllowed("a condition of one type")
        return F.when(test, a).otherwise(b), x

    def visit_Call(self, node: ast.Call) -> tuple[Column, T.DataType]:
        if not isinstance(node.func, ast.Name) or node.keywords or not node.args:
            raise NotAllowed("a call")
        name, args = node.func.id, node.args
        if name in ("min", "max") and len(args) > 1:
            columns, kind = self.numbers(*args)
            return (F.least if name == "min" else F.greatest)(*columns), kind
        if len(args) != 1:
            raise NotAllowed(name)
        value, kind = self.visit(args[0])
        if name == "len" and isinstance(kind, (T.StringType, T.ArrayType)):
            return (F.length(value) if isinstance(kind, T.StringType) else F.size(value)).cast("long"), T.LongType()
        if name == "str" and not isinstance(kind, (T.ArrayType, T.BooleanType)):
            return value.cast("string"), T.StringType()
        if name in ("int", "float") and not isinstance(kind, T.ArrayType):
            made = T.LongType() if name == "int" else T.DoubleType()
            return value.try_cast(made), made
        if name in ("abs", "round") and isinstance(kind, _NUMBERS):
            return (F.abs(value), kind) if name == "abs" else (F.bround(value).cast("long"), T.LongType())
        if name == "sorted" and isinstance(kind, T.ArrayType):
            return F.array_sort(value), kind
        raise NotAllowed(name)
