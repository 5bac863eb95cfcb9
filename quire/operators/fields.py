"""Fields of payloads as rows, and changes of single fields.

Payloads of several models meet as JSON text. ``payload_json`` is canonical:
keys sorted, no spaces.
"""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FieldEditError
from ..plans.models import Model
from ..plans.templates import canonical


def _path(parts: list[str]) -> str:
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) and i else f"['{p}']" for i, p in enumerate(parts))


def split_path(path: str) -> list[str]:
    parts = [p for p in re.split(r"[./]", path) if p]
    if not parts:
        raise FieldEditError("an empty field path")
    return parts


def deep_get(payload_json: Column, path: str) -> Column:
    """The value at a dotted path as JSON; a number after the first part also counts into a list. Null if missing."""
    value = F.try_parse_json(payload_json)
    parts = split_path(path)
    whole = F.try_variant_get(value, _path(parts), "variant")
    named = F.try_variant_get(value, "$" + "".join(f"['{p}']" for p in parts), "variant")
    return F.to_json(F.coalesce(whole, named))


def flatten_payloads(docs: DataFrame, keys: list[str], payload_col: str = "payload_json") -> DataFrame:
    """(keys, field_path, value_json): mappings are gone into, lists stay whole, empty mappings give no row.

    The payload is parsed once; its mappings are opened in their row, a level a
    step, as variants. When none is open any longer a step only looks. A null
    payload, and one that is no mapping, give no rows.
    """
    entry = "struct<field_path: string, open: map<string, variant>, value_json: string>"

    def entry_of(path: Column, value: Column) -> Column:
        inner = F.try_variant_get(value, "$", "map<string, variant>")
        return F.struct(path.alias("field_path"), inner.alias("open"), F.when(inner.isNull(), F.to_json(value)).alias("value_json")).cast(entry)

    def step(state: Column, _: Column) -> Column:
        inside = lambda x: F.transform(F.map_entries(x["open"]), lambda e: entry_of(F.concat_ws(".", x["field_path"], e["key"]), F.coalesce(e["value"], F.parse_json(F.lit("null")))))
        opened = F.flatten(F.transform(state, lambda x: F.when(x["open"].isNull(), F.array(x)).otherwise(inside(x))))
        return F.when(F.exists(state, lambda x: x["open"].isNotNull()), opened).otherwise(state)

    payload = F.col(payload_col)
    braces = F.length(payload) - F.length(F.replace(payload, F.lit("{"), F.lit("")))
    start = F.array(entry_of(F.lit(None).cast("string"), F.try_parse_json(payload))).cast(f"array<{entry}>")
    rows = docs.select(*keys, F.explode(F.aggregate(F.sequence(F.lit(1), F.greatest(braces, F.lit(1))), start, step)).alias("f"))
    return rows.select(*keys, "f.field_path", "f.value_json").where("field_path is not null")


def flatten_typed(docs: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """(keys, field_path, value_json) of a typed payload without mappings: one explode, no JSON to read."""
    plain = [f for f in model.fields if f.kind != "dict"]
    value = lambda f: F.to_json(F.struct(F.col("payload")[f.name].alias("v")), {"ignoreNullFields": "false"})
    pairs = [F.struct(F.lit(f.name).alias("field_path"), F.regexp_replace(value(f), r'\A\{"v":|\}\z', "").alias("value_json")) for f in plain]
    return docs.select(*keys, F.explode(F.array(*pairs)).alias("f")).select(*keys, "f.*")


def query_fields(fields: DataFrame, name: str) -> DataFrame:
    """Rows of flattened fields whose path is ``name`` or ends with it."""
    return fields.where((F.col("field_path") == name) | F.col("field_path").endswith(f".{name}"))


def _edit(payload: dict, op: str, parts: list[str], value: Any) -> dict:
    at: Any = payload
    for p in parts[:-1]:
        if isinstance(at, list) and p.isdigit() and int(p) < len(at):
            at = at[int(p)]
        elif isinstance(at, dict) and (p in at or op == "create"):
            at = at.setdefault(p, {})
        else:
            raise FieldEditError(f"no field {'.'.join(parts)}")
    last: Any = parts[-1]
    if isinstance(at, list) and last.isdigit():
        last = int(last)
        known = last < len(at)
    elif isinstance(at, dict):
        known = last in at
    else:
        raise FieldEditError(f"no field {'.'.join(parts)}")
    if op != "create" and not known:
        raise FieldEditError(f"no field {'.'.join(parts)}")
    if op in ("create", "update"):
        if isinstance(at, list) and not known:
            raise FieldEditError(f"no field {'.'.join(parts)}")
        at[last] = value
    elif op == "remove":
        del at[last]
    elif op == "append":
        if not isinstance(at[last], list):
            raise FieldEditError(f"{'.'.join(parts)} is no list")
        at[last].append(value)
    else:
        if not isinstance(at[last], list):
            raise FieldEditError(f"{'.'.join(parts)} is no list")
        kept, seen = [], set()
        for x in at[last]:
            if not (value["drop_empty"] and x in (None, "", [], {}) or value["dedupe"] and canonical(x) in seen):
                kept.append(x)
                seen.add(canonical(x))
        at[last] = kept
    return payload


def edit_field(payload_json: Column, op: str, path: str, value: Any = None) -> Column:
    """Payloads with one field changed: struct<payload_json, error>.

    ``op``: create sets a field and the mappings above it; update, remove,
    append and clean ask for a field that exists. clean takes {dedupe, drop_empty}.
    """
    parts = split_path(path)

    @F.udf(returnType="struct<payload_json: string, error: string>", useArrow=True)
    def run(text):
        try:
            return {"payload_json": canonical(_edit(json.loads(text or "{}"), op, parts, value)), "error": None}
        except Exception as e:  # a payload's own error stops no other
            return {"payload_json": text, "error": str(e) or type(e).__name__}

    return run(payload_json)


def clean_list(items: Column, dedupe: bool = True, drop_empty: bool = True) -> Column:
    """``clean`` for a typed list of texts, in the JVM: keeps the first of equal items."""
    items = F.filter(items, lambda x: x.isNotNull() & (x != "")) if drop_empty else items
    return F.array_distinct(items) if dedupe else items


def parse_value(text: str) -> Any:
    """A value as typed by hand: JSON, else YAML."""
    from ..plans.templates import load_yaml

    try:
        return json.loads(text)
    except ValueError:
        return load_yaml(text)
