"""Unified search over stores, models, documents, sections and fields."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.markers import field_lines
from ..plans.models import Registry
from ..plans.predicates import compile_predicate, field_predicate, section_predicate
from .fields import flatten_payloads
from .library import KEYS, Library, union
from .sections import owning_section, placed, sections, with_headings

KINDS = ("store", "model", "doc", "section", "field")
FUZZY = 0.7
COLUMNS = ["kind", "store", "model", "doc", "name", "path", "physical", "semantic", "about", "title", "field_path", "section_path", "breadcrumbs", "value", "payload_json", "owning_section", "ord"]


def search_records(library: Library, stores: DataFrame | None = None, kinds: tuple[str, ...] = KINDS, persisted: DataFrame | None = None) -> DataFrame:
    """One row per record, of the asked kinds only; what a kind lacks is null.

    ``stores``: (store, name, path, linked). Texts are parsed for sections and
    owners, and not at all unless one of these is asked for. ``persisted``, a
    catalog's sections, saves parsing for sections; both give the same records.
    """
    frames = []
    arr = lambda *x: F.array(*[F.lit(c) if not isinstance(c, Column) else c for c in x]).cast("array<string>")
    nothing = F.array().cast("array<string>")
    if "store" in kinds and stores is not None:
        rows = stores.withColumn("model_count", F.lit(len(library.registry.models)).cast("long"))
        payload = F.when(F.col("linked"), F.to_json(F.struct(F.lit(True).alias("linked")))).otherwise(F.to_json(F.struct("model_count")))
        frames.append(rows.select(F.lit("store").alias("kind"), "store", "name", "path", arr(F.col("name"), F.col("path")).alias("physical"), nothing.alias("semantic"), payload.alias("payload_json"), F.lit(0).alias("ord")))
    if "model" in kinds:
        used = library.documents.select("store", "model").distinct()
        models = used.join(F.broadcast(library.registry.table(library.spark).drop("store")), "model")
        frames.append(models.select(F.lit("model").alias("kind"), "store", "model", F.col("model").alias("name"), arr(F.col("model")).alias("physical"), F.col("semantics").alias("semantic"), F.to_json(F.struct("field_count")).alias("payload_json"), F.lit(1).alias("ord")))
    if {"doc", "section", "field"} & set(kinds):
        docs = library.payloads()
        if "doc" in kinds:
            frames.append(docs.select(F.lit("doc").alias("kind"), "store", "model", "doc", F.col("doc").alias("name"), "path", arr(F.col("doc"), F.col("path"), F.concat_ws("/", "model", "doc")).alias("physical"), F.col("semantic_tags").alias("semantic"), "payload_json", F.lit(2).alias("ord")))
        if "section" in kinds:
            named = docs.withColumnRenamed("path", "doc_path")
            if persisted is None:
                found = sections(named, ["store", "model", "doc", "doc_path", "semantic_tags"], F.col("semantic_tags"))
            else:
                found = persisted.join(named.select("store", "model", "doc", "doc_path", "semantic_tags"), ["store", "model", "doc"])
            frames.append(
                found.select(
                    F.lit("section").alias("kind"), "store", "model", "doc", F.col("slug").alias("name"), F.concat_ws("#", "doc_path", "path").alias("path"),
                    arr(F.col("title"), F.col("slug"), F.col("path"), F.col("doc_path")).alias("physical"), F.col("semantic_tags").alias("semantic"), "about", "title", F.col("path").alias("section_path"), "breadcrumbs",
                    F.to_json(F.struct("level", "line_start", "line_end", "breadcrumbs")).alias("payload_json"), F.lit(3).alias("ord"),
                )
            )
        if "field" in kinds:
            frames.append(field_records(library, docs).select(F.lit("field").alias("kind"), "store", "model", "doc", F.col("field_path").alias("name"), F.concat(F.col("path"), F.lit(":"), F.col("field_path")).alias("path"), arr(F.col("field_path"), F.col("doc"), F.col("path"), F.col("model")).alias("physical"), F.col("semantic_tags").alias("semantic"), "field_path", "value", "payload_json", "owning_section", F.lit(4).alias("ord")))
    out = union(frames)
    missing = {"model": "string", "doc": "string", "path": "string", "about": "array<string>", "title": "string", "field_path": "string", "section_path": "string", "breadcrumbs": "array<string>", "value": "string", "owning_section": "string"}
    for c, kind in missing.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out.select(*COLUMNS)


def field_records(library: Library, docs: DataFrame | None = None) -> DataFrame:
    """(store, model, doc, path, semantic_tags, payload_json, field_path, value, owning_section)."""
    docs = docs if docs is not None else library.payloads()
    lines = [F.struct(F.lit(m.name).alias("model"), F.lit(f).alias("field"), F.lit(n).alias("line")) for m in library.registry.models.values() for f, n in field_lines(m.template).items()]
    own = with_headings(docs).withColumn("_p", placed(F.col("headings")))
    # owners of a model's fields, as a map that travels with the document's row
    mine = F.filter(F.array(*lines), lambda x: x["model"] == F.col("model")) if lines else F.array().cast("array<struct<model: string, field: string, line: int>>")
    owners = F.map_from_entries(F.transform(mine, lambda x: F.struct(x["field"], owning_section(F.col("_p"), x["line"]))))
    rows = own.withColumn("_owners", owners)
    flat = flatten_payloads(rows, [*KEYS, "semantic_tags", "payload_json", "_owners"])
    text = F.try_variant_get(F.try_parse_json("value_json"), "$", "string")
    value = F.when(F.col("value_json").startswith("[") | F.col("value_json").startswith("{"), F.col("value_json")).otherwise(text)
    return flat.select(*KEYS, "semantic_tags", "payload_json", "field_path", value.alias("value"), F.try_element_at("_owners", "field_path").alias("owning_section"))


def _reach(hay: Column, term: str) -> Column:
    """The texts of ``hay`` whose ratio to ``term`` can reach FUZZY, both in lower case.

    The ratio is twice the number of matched characters by both lengths, and no more
    of a character can be matched than the rarer side has. That bound is exact for
    what it is, so nothing is lost; lengths alone rule out most texts.
    """
    low = term.lower()
    letters, n = Counter(low), len(low)

    def can(x: Column) -> Column:
        m = F.length(x)
        shared = sum((F.least(F.lit(c), m - F.length(F.replace(x, F.lit(ch), F.lit("")))) for ch, c in letters.items()), F.lit(0))
        return (2 * F.least(m, F.lit(n)) >= FUZZY * (m + n)) & (2 * shared >= FUZZY * (m + n))

    return F.filter(F.transform(hay, F.lower), can)


def _near(hay: Column, term: str) -> Column:
    """Any text within FUZZY of ``term``, both in lower case.

    Texts that contain it, and those that can't come near, are settled in the JVM;
    Python sees the rest in one Arrow call, and nulls in the place of settled rows.
    """

    @F.udf(returnType="boolean", useArrow=True)
    def near(values):
        from difflib import SequenceMatcher

        m = SequenceMatcher(a=term.lower())
        for v in values if values is not None else ():
            m.set_seq2(v)
            if m.real_quick_ratio() >= FUZZY and m.quick_ratio() >= FUZZY and m.ratio() >= FUZZY:
                return True
        return False

    within = F.exists(hay, lambda x: F.contains(F.lower(x), F.lit(term.lower())))
    close = _reach(hay, term)
    return F.when(within, True).otherwise(near(F.when(~within & (F.size(close) > 0), close)))


def hay_of(within: str) -> Column:
    """The texts of a record that a search looks in."""
    empty = F.array().cast("array<string>")
    parts = [F.col("physical")] * (within in ("physical", "both")) + [F.col("semantic"), F.col("about")] * (within in ("semantic", "both"))
    return F.filter(F.concat(*[F.coalesce(p, empty) for p in parts]), lambda x: x.isNotNull() & (x != ""))


def search(records: DataFrame, term: str = "", within: str = "both", kinds: tuple[str, ...] = (), regex: bool = False, fuzzy: bool = False) -> DataFrame:
    """Records that match ``term`` in their physical names, semantic terms or both.

    A plural of a kind (``docs``) gives all records of it, whatever ``kinds``
    says. No term gives all. Plain terms are parts of names, case and all.
    """
    if term in {k + "s" for k in KINDS}:
        return records.where(F.col("kind") == term[:-1])
    if kinds:
        records = records.where(F.col("kind").isin(*kinds))
    if not term:
        return records
    hay = hay_of(within)
    if regex:
        return records.where(F.exists(hay, lambda x: x.rlike(term)))
    if fuzzy:
        return records.where(_near(hay, term))
    return records.where(F.exists(hay, lambda x: F.contains(x, F.lit(term))))


def where_records(records: DataFrame, where: str, registry: Registry, strict: bool = True) -> DataFrame:
    """``where`` by kind: field and section records have predicates of their own, documents those of payloads; stores and models always pass."""
    field = section = F.lit(False)
    errors = []
    for make in ("field", "section"):
        try:
            if make == "field":
                field = field_predicate(where, strict)
            else:
                section = section_predicate(where, strict)
        except ValueError as e:
            errors.append(e)
    doc = F.lit(False)
    try:
        for m in registry.models.values():
            value = lambda f, m=m: F.try_variant_get(F.try_parse_json("payload_json"), f"$['{f}']", m.schema[f].dataType.simpleString() if m.schema[f].dataType.simpleString() != "variant" else "variant")
            doc = F.when(F.col("model") == m.name, compile_predicate(where, m.schema, value, F.col("doc"), F.col("model"), registry, strict)).otherwise(doc)
    except ValueError as e:
        errors.append(e)
    if len(errors) == 3:
        raise errors[0]
    kind = F.col("kind")
    return records.where(F.when(kind == "field", field).when(kind == "section", section).when(kind == "doc", doc).otherwise(True))
