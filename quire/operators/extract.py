"""Typed rows from Markdown, and back: extraction, rendering, validation.

A template of headings and paragraphs that each fit one line extracts by one
regular expression in the JVM; documents that it doesn't match, and templates
with lists, tables or YAML, go through one Arrow UDF. Rendering is an expression
over columns; only YAML values pass through a UDF.
"""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.expressions import Expressions
from ..plans.markers import MARKER, Marker, capture_pattern, pieces
from ..plans.models import KINDS, Field, Model
from ..plans.templates import MARKDOWN, Grammar, Part, canonical, compile_parts, compile_steps, dump_yaml, extract

PAYLOAD, ERROR = "payload_json", "error"
#: A private character between groups; a text that has it is left to the block parser, as one that doesn't match.
SEPARATOR = "\ue0f5"


def quick_pattern(model: Model) -> tuple[str, list[str]] | None:
    """One expression for a whole document of ``model``, or None if its template has other blocks than plain lines.

    A line that starts with a marker could become any block, and a body may have
    many lines; templates with either are left to the block parser.
    """
    lines: list[str] = []
    names: list[str] = []
    for line in model.template.strip("\n").split("\n\n"):
        heading = len(line) - len(line.lstrip("#"))
        text = line[heading:].strip() if heading else line
        literal = text.split("⸢")[0].split("{{")[0]
        if not line.strip() or "\n" in line or "{{" in line or heading > 6 or not heading and (not literal[:1].isalpha() or text != text.strip()) or heading and not line[heading:].startswith(" ") or heading and text.endswith("#"):
            return None
        pattern, own = capture_pattern(text, java=True)
        # a heading's closing hashes and spaces are no text of it
        body = pattern.removeprefix("(?d)\\A").removesuffix("\\z").replace("(.*?)", "([^\\s#](?:.*?[^\\s#])?)" if heading else "(\\S(?:.*?\\S)?)")
        if body.count(".*?") != body.count("(?:.*?"):
            return None
        lines.append("#" * heading + " " * bool(heading) + body)
        names += own
    return ("(?d)\\A" + "\\n\\n+".join(lines) + "\\n?\\z", names) if names and len(names) == len(set(names)) else None


def _typed(value: Column, field: Field) -> Column:
    """``value``, JSON of a field, in the field's type; null if it can't be."""
    kind = field.kind
    text = F.when(F.is_variant_null(F.try_parse_json(value)), F.lit(None)).otherwise(value)
    if kind == "dict":
        return F.try_parse_json(text)
    if kind == "list":
        return F.from_json(text, KINDS[kind].simpleString())
    if kind == "rows":
        # rows by key come in the keys' order: numbers by size, then text
        keyed = F.map_entries(F.from_json(text, "map<string, map<string, string>>"))
        order = F.transform(keyed, lambda e: F.struct(F.coalesce(F.when(e["key"].rlike("^[0-9]+$"), e["key"].try_cast("decimal(38,0)")), F.lit("9" * 38).cast("decimal(38,0)")).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
        # a map can't be compared, so places are sorted in its stead
        at = F.array_sort(F.transform(order, lambda x, i: F.struct(x["n"].alias("n"), x["k"].alias("k"), i.alias("i"))))
        return F.when(text.startswith("{"), F.transform(at, lambda x: F.get(keyed, x["i"])["value"])).otherwise(F.from_json(text, KINDS[kind].simpleString()))
    plain = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return _cast(plain, field)


def _cast(text: Column, field: Field) -> Column:
    if field.kind == "str":
        return text
    bare = F.trim(text)
    if field.kind == "bool":
        low = F.lower(bare)
        return F.when(low.isin("true", "t", "yes", "y", "on", "1"), True).when(low.isin("false", "f", "no", "n", "off", "0"), False)
    if field.kind == "int":
        return F.when(bare.rlike(r"^[+-]?\d+(\.0*)?$"), F.split(bare, r"\.")[0].try_cast("long"))
    return bare.try_cast("double")


def _problems(model: Model, value: Any) -> Column:
    """Names of fields that are missing or of the wrong type, joined; null if none."""
    found = [F.when(value(f)[0].isNull() & (F.lit(not f.optional) | value(f)[1]), F.lit(f.name)) for f in model.fields if f.default is None and f.name not in model.compositions]
    if not found:
        return F.lit(None).cast("string")
    bad = F.array_compact(F.array(*found))
    return F.when(F.size(bad) > 0, F.concat(F.lit("missing or mistyped: "), F.array_join(bad, ", ")))


def _by_parser(text: Column, model: Model, grammar: Grammar) -> Column:
    """What the block parser finds: struct of each field's text (JSON for lists, rows and mappings), payload_json and error; null for null."""
    steps = compile_steps(model.template, grammar)
    kinds = {f.name: f.kind for f in model.fields}
    shape = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(kinds))] + [T.StructField(PAYLOAD, T.StringType()), T.StructField(ERROR, T.StringType())])

    def shown(value: Any) -> str | None:
        return value if value is None or isinstance(value, str) else canonical(value)

    @F.udf(returnType=shape, useArrow=True)
    def parse(source):
        if source is None:
            return None
        try:
            found = extract(steps, source, grammar)
            whole = canonical(found)
        except Exception as e:  # whatever is wrong with a document is that document's error
            return {ERROR: str(e) or type(e).__name__}
        own = {f"f{i}": (canonical(found[n]) if k in ("list", "rows", "dict") else shown(found[n])) for i, (n, k) in enumerate(kinds.items()) if found.get(n) is not None}
        return own | {PAYLOAD: whole}

    return parse(text)


def extract_docs(docs: DataFrame, model: Model, text_col: str = "text", quick: bool = True, grammar: Grammar = MARKDOWN) -> DataFrame:
    """``docs`` with ``payload`` (the model's fields), ``payload_json`` (untyped, canonical) and ``error``.

    A document never stops a job: what is wrong with it is in its error column,
    null if nothing is. A null text is an empty document. Columns of ``docs``
    named payload, payload_json or error are replaced. Documents are read once;
    those that the quick pattern fits reach Python as nulls. Another ``grammar``
    than Markdown has no quick pattern.
    """
    docs = docs.drop("payload", PAYLOAD, ERROR)
    plan = quick_pattern(model) if quick and grammar is MARKDOWN else None
    text, kept = F.coalesce(F.col(text_col), F.lit("")), docs.columns
    if plan:
        pattern, names = plan
        # one match for all groups; a generator's output isn't computed again for each use
        groups = F.split(F.regexp_replace(text, pattern, SEPARATOR.join(f"${i + 1}" for i in range(len(names))) + SEPARATOR), SEPARATOR)
        groups = F.when(F.contains(text, F.lit(SEPARATOR)), F.array().cast("array<string>")).otherwise(groups)
        rows = docs.select("*", F.explode(F.array(groups)).alias("_g"))
        fits = F.size("_g") == len(names) + 1
        rows = rows.select(*kept, "_g", fits.alias("_fits"), _by_parser(F.when(~fits, text), model, grammar).alias("_u"))
    else:
        names = []
        rows = docs.select("*", F.lit(False).alias("_fits"), _by_parser(text, model, grammar).alias("_u"))
    raw = {}
    for i, f in enumerate(model.fields):
        slow = F.col(f"_u.f{i}")
        raw[f.name] = F.when(F.col("_fits"), F.col("_g")[names.index(f.name)] if f.name in names else F.lit(None)).otherwise(slow) if plan else slow

    def value(f: Field) -> Column:
        v = raw[f.name]
        made = F.try_parse_json(v) if f.kind == "dict" else F.from_json(v, KINDS[f.kind].simpleString()) if f.kind in ("list", "rows") else _cast(v, f)
        return F.coalesce(made, F.lit(f.default).cast(KINDS[f.kind])) if f.default is not None else made

    whole = F.col(f"_u.{PAYLOAD}")
    if plan:
        whole = F.when(F.col("_fits"), F.to_json(F.struct(*[F.col("_g")[names.index(n)].alias(n) for n in sorted(names)]))).otherwise(whole)
    return rows.select(
        *kept,
        F.struct(*[value(f).alias(f.name) for f in model.fields]).alias("payload"),
        whole.alias(PAYLOAD),
        F.coalesce(F.col(f"_u.{ERROR}"), _problems(model, lambda f: (value(f), raw[f.name].isNotNull()))).alias(ERROR),
    )


def template_model(template: str, name: str = "Template") -> Model:
    """A model of what ``template`` alone tells: lists, rows and mappings by their blocks, all else text; every field is optional."""
    kinds = {"list": "list", "rows": "rows", "yaml": "dict"}
    found = {n: kinds.get(step.mode, "str") for step in compile_steps(template) for n in step.names}
    return Model(name, template, tuple(Field(n, kind, f"captured by the template as {kind}", optional=True) for n, kind in found.items() if n))


def extract_with_template(docs: DataFrame, template: str, text_col: str = "text") -> DataFrame:
    """``docs`` with payload_json and error, without any model."""
    return extract_docs(docs, template_model(template), text_col).drop("payload")


def render_with_template(payloads: DataFrame, template: str) -> DataFrame:
    """``payloads`` (payload_json, …) with ``text``, without any model; names that the template doesn't capture are read as text."""
    model = template_model(template)
    named = {m.name for part in compile_parts(template) for m in pieces(part.text) if isinstance(m, Marker)} - {f.name for f in model.fields} - {""}
    inner = {n for step in compile_steps(template) if step.mode == "rows" for _, n, _ in step.columns}
    model = replace(model, fields=(*model.fields, *(Field(n, "str", "named by the template", optional=True) for n in sorted(named - inner))))
    return typed_payloads(payloads, model).withColumn("text", render_column(model, F.col("payload"))).drop("payload", ERROR)


def typed_payloads(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (payload_json, …) with the model's ``payload`` and ``error``; values come in as text, as from a document."""
    return _finished(docs.drop("payload", ERROR).withColumn(ERROR, F.lit(None).cast("string")), model)


def _finished(made: DataFrame, model: Model) -> DataFrame:
    raw = made.withColumn("_v", F.try_parse_json(PAYLOAD))

    def one(f: Field) -> tuple[Column, Column]:
        part = F.to_json(F.try_variant_get("_v", f"$['{f.name}']", "variant"))
        value = _typed(part, f)
        return (F.coalesce(value, F.lit(f.default).cast(KINDS[f.kind])) if f.default is not None else value), part.isNotNull() & (part != "null")

    values = {f.name: one(f) for f in model.fields}
    return raw.select(
        *[c for c in made.columns if c != ERROR],
        F.struct(*[values[f.name][0].alias(f.name) for f in model.fields]).alias("payload"),
        F.coalesce(ERROR, _problems(model, lambda f: values[f.name])).alias(ERROR),
    ).select(*[c for c in made.columns if c not in (PAYLOAD, ERROR)], "payload", PAYLOAD, ERROR)


def _yaml_text(value: Column) -> Column:
    """JSON as YAML, keys in their order."""

    @F.udf(returnType="string", useArrow=True)
    def dump(text):
        try:
            return None if text is None else dump_yaml(json.loads(text))
        except (ValueError, RecursionError):
            return text  # JSON is YAML as well

    return dump(value)


def _shown(field: Field | None, value: Column) -> Column:
    """A field's value as text in a document."""
    if field is None or field.kind in ("str", "int"):
        return value.cast("string")
    if field.kind == "bool":
        return F.initcap(value.cast("string"))
    if field.kind == "float":
        return value.cast("string")
    return _yaml_text(F.to_json(value))


def _marker_text(marker: Marker, of: Any, expression: Any = None) -> Column:
    """What a marker renders to: ``of`` gives a name's text column, ``expression`` an expression's, or None."""
    literal = "⸢" + ",".join([marker.kind, *marker.traits]) + "•" + marker.name + "⸥"
    value = of(marker.name)
    if marker.kind == "py":
        made = expression(marker.name) if expression else None
        return F.lit(literal) if made is None else F.coalesce(made, F.lit(literal))
    empty = F.lit("" if marker.kind in ("optrev", "render", "expr") else literal)
    return empty if value is None else F.coalesce(value, empty)


def _filled(text: str, of: Any, expression: Any = None) -> Column:
    found = [F.lit(x) if isinstance(x, str) else _marker_text(x, of, expression) for x in pieces(text)]
    return F.concat(*found) if found else F.lit("")


def render_column(model: Model, payload: Column, computed: dict[str, Column] | None = None, expressions: Expressions | None = None) -> Column:
    """The document of ``payload``, a struct of the model's fields; ``computed`` adds text by name.

    ``py`` markers stay as written, unless ``expressions`` are given and allow them.
    """
    computed = computed or {}

    def expression(source: str) -> Column | None:
        return expressions.column(source, payload, model.schema) if expressions else None

    def of(name: str) -> Column | None:
        if name in computed:
            return computed[name]
        field = model.named(name)
        return _shown(field, payload[name]) if field else None

    def items(part: Part) -> Column:
        return F.transform(payload[part.name], lambda x: _filled(part.text, lambda n: x if n == part.name else None))

    def rows(part: Part) -> Column:
        made = F.transform(payload[part.name], lambda x: _filled(part.text, lambda n: F.element_at(x, F.lit(n))))
        return F.concat(F.array(F.lit(part.head)), made) if part.head else made

    blocks = []
    for part in compile_parts(model.template):
        field = model.named(part.name) if part.name else None
        whole = (part.head + "\n" if part.head else "") + part.text
        if part.mode == "list" and field and field.kind == "list":
            empty = part.text.replace(MARKER.search(part.text)[0], "")
            blocks.append(F.when(payload[part.name].isNull(), "").when(F.size(payload[part.name]) == 0, _filled(empty, of)).otherwise(F.array_join(items(part), "\n")))
        elif part.mode in ("list", "table") and field and field.kind == "rows":
            some = F.coalesce(F.size(payload[part.name]), F.lit(0)) > 0
            none = F.when(payload[part.name].isNotNull(), "[]")
            blocks.append(F.when(some, F.array_join(rows(part), "\n")).otherwise(_filled(whole, lambda n, part=part, none=none: none if n == part.name else of(n))))
        else:
            blocks.append(_filled(whole, of, expression))
    joined = F.array_join(F.array(*blocks), "\n\n") if blocks else F.lit("")
    return F.regexp_replace(joined, r"\A\s+|\s+\z", "")


def validate_docs(docs: DataFrame, model: Model, text_col: str = "text", strict: bool = False) -> DataFrame:
    """``docs`` with payload, error, rendered, valid and mismatches.

    A document is valid if what its rendering gives equals what it gave: for
    rev fields, or with ``strict`` for all. ``mismatches`` lists others.
    """
    first = extract_docs(docs, model, text_col).withColumn("rendered", render_column(model, F.col("payload"))).withColumnRenamed(text_col, "_source").withColumnRenamed("payload", "_payload").withColumnRenamed(PAYLOAD, "_json").withColumnRenamed(ERROR, "_error")
    again = extract_docs(first, model, "rendered")
    sources = {m.name for s in compile_steps(model.template) for m in s.markers if strict or m.kind == "rev"}
    names = [f.name for f in model.fields if f.name in sources]

    def part(json_col: str, name: str) -> Column:
        return F.to_json(F.try_variant_get(F.try_parse_json(json_col), f"$['{name}']", "variant"))

    bad = F.array_compact(F.array(*[F.when(~part("_json", n).eqNullSafe(part(PAYLOAD, n)), n) for n in names])) if names else F.array().cast("array<string>")
    out = again.withColumn("mismatches", bad).withColumn("valid", F.col("_error").isNull() & (F.size("mismatches") == 0))
    kept = [c for c in docs.columns if c not in ("payload", PAYLOAD, ERROR)]
    return out.select(*[F.col("_source").alias(c) if c == text_col else F.col(c) for c in kept], F.col("_payload").alias("payload"), F.col("_json").alias(PAYLOAD), F.col("_error").alias(ERROR), "rendered", "valid", "mismatches")

