"""Computed fields: texts that a document makes of its children, models in the order in which they need one another."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RegistryError
from ..plans.models import Model, Registry
from .extract import render_column
from .links import composed_field


def rendering_order(registry: Registry) -> list[str]:
    """Models, each after those that its compositions hold; a cycle is an error that names it."""
    done: list[str] = []

    def place(name: str, trail: tuple[str, ...]) -> None:
        if name in trail:
            raise RegistryError(f"compositions need each other: {' > '.join((*trail[trail.index(name) :], name))}")
        if name not in done:
            for c in registry[name].compositions.values():
                if c.model:
                    place(c.model, (*trail, name))
            done.append(name)

    for name in registry.models:
        place(name, ())
    return done


def line_column(line: str, of: dict[str, Column]) -> Column:
    """``line`` with each ``{name}`` filled in; null if a name is unknown or its value null."""
    parts = re.split(r"\{(\w*)\}", line)
    return F.concat(*[(F.lit(p) if i % 2 == 0 else of.get(p, F.lit(None)).cast("string")) for i, p in enumerate(parts)])


def _children(docs: DataFrame, model: Model, line: str) -> DataFrame:
    """(doc, line) by name and by path, each once; of several documents the least line stays."""
    of = {f.name: F.col("payload")[f.name] for f in model.fields} | {n: F.col("computed")[n] for n in model.compositions}
    rows = docs.select(F.explode(F.array_distinct(F.array("doc", "path"))).alias("doc"), line_column(line, of).alias("line"))
    return rows.groupBy("doc").agg(F.min("line").alias("line"))


def render_compositions(registry: Registry, payloads: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``payloads`` (store, doc, path, payload) by model, each with ``computed``, a struct of the model's compositions, and ``text``.

    References are names or paths, in backticks or not; those without a document
    are left out, as are children whose line names an unknown field. A list that is
    null or isn't a list gives an empty text. All is one plan: a model's children
    are rendered before it, whatever they are composed of.
    """
    out: dict[str, DataFrame] = {}
    for name in rendering_order(registry):
        if name not in payloads:
            continue
        model = registry[name]
        rows = payloads[name]
        keys = ["store", "doc", "path"]
        for at, (field, spec) in enumerate(model.compositions.items()):
            child = spec.model and out.get(spec.model)
            source = model.named(spec.field)
            if not child or not source or source.kind != "list":
                rows = rows.withColumn(f"_c{at}", F.lit(""))
                continue
            refs = F.transform(F.coalesce(F.col("payload")[spec.field], F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.trim(x), "^`+|`+$", "")))
            lines = _children(child, registry[spec.model], spec.line)
            made = composed_field(rows.select(*keys, refs.alias("_refs")), keys, "_refs", lines, F.col("line"), spec.separator).withColumnRenamed("composed", f"_c{at}")
            rows = rows.join(made, keys, "left").withColumn(f"_c{at}", F.coalesce(f"_c{at}", F.lit("")))
        texts = [F.col(f"_c{i}").alias(n) for i, n in enumerate(model.compositions)]
        rows = rows.withColumn("computed", F.struct(*texts) if texts else F.struct(F.lit(None).cast("string").alias("_")))
        text = render_column(model, F.col("payload"), {n: F.col("computed")[n] for n in model.compositions})
        out[name] = rows.withColumn("text", text).select(*keys, "payload", "computed", "text")
    return out
