"""Trees of stores, models, documents and fields, and the schema of their graph.

Nested results are structs and arrays; ``as_json`` makes text of them at the edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogError
from .fields import deep_get
from .library import Library
from .sections import sections
from .semantics import sorted_names

#: Kinds of nodes and edges, fixed values.
NODES = ("store", "model", "doc", "section", "field")
EDGES = ("has_model", "has_doc", "has_section", "has_field")


def model_tree(library: Library) -> DataFrame:
    """(store, model, fields, docs): described fields and sorted names of documents of each model that a store uses."""
    docs = library.documents.groupBy("store", "model").agg(sorted_names("doc").alias("docs"))
    described = library.registry.fields_table(library.spark).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("position", "field", "kind", "description"))).alias("f"))
    fields = F.transform("f", lambda x: F.struct(x["field"].alias("name"), x["kind"].alias("kind"), x["description"].alias("description")))
    return docs.join(F.broadcast(described.select("model", fields.alias("fields"))), "model", "left").select("store", "model", "fields", "docs")  # models are few


def store_tree(library: Library) -> DataFrame:
    """(store, models): a store's models in order of name, each with its fields and documents."""
    return model_tree(library).groupBy("store").agg(F.array_sort(F.collect_list(F.struct("model", "docs", "fields"))).alias("models"))


def doc_tree(library: Library) -> DataFrame:
    """(store, model, doc, sections, fields): paths of each document's sections in order, names of its payload's fields."""
    docs = library.payloads()
    key = ["store", "model", "doc"]
    placed = sections(docs.select(*key, "text"), key).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]).alias("sections"))
    names = F.array_sort(F.map_keys(F.from_json("payload_json", "map<string, variant>")))
    return docs.select(*key, names.alias("fields")).join(placed, key, "left").select(*key, F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), "fields")


def tree_of(library: Library, target: str | None = None) -> DataFrame:
    """The tree at ``target``: none or ``stores``, ``models/name``, ``docs/name``, ``fields/doc/path``, or a document's name."""
    kind, _, rest = (target or "stores").partition("/")
    if kind == "stores":
        tree = store_tree(library)
        return tree.where(F.col("store") == rest) if rest else tree.orderBy("store")
    if kind == "models":
        tree = model_tree(library)
        return tree.where(F.col("model") == rest) if rest else tree.orderBy("store", "model")
    if kind == "fields":
        doc, _, path = rest.partition("/")
        if not doc or not path:
            raise CatalogError(f"no document and field in {target}")
        hit = library.target(doc).select("store", "model", "doc")
        found = library.payloads().join(hit, ["store", "model", "doc"], "left_semi")
        return found.select("store", "model", "doc", F.lit(path.replace("/", ".")).alias("field"), deep_get(F.col("payload_json"), path).alias("value"))
    hit = library.target(rest if kind == "docs" and rest else target).select("store", "model", "doc")
    return doc_tree(library).join(hit, ["store", "model", "doc"], "left_semi")


def graph_edges(library: Library) -> DataFrame:
    """(source, target, relation): a store's models, a model's documents, a document's sections and fields."""
    docs = library.payloads()
    own = docs.select("store", "model", "doc")
    models = own.select("store", "model").distinct().select(F.col("store").alias("source"), F.col("model").alias("target"), F.lit("has_model").alias("relation"))
    members = own.select(F.col("model").alias("source"), F.col("doc").alias("target"), F.lit("has_doc").alias("relation"))
    parts = sections(docs.select("doc", "text"), ["doc"]).select(F.col("doc").alias("source"), F.col("path").alias("target"), F.lit("has_section").alias("relation"))
    fields = docs.select(F.col("doc").alias("source"), F.explode(F.map_keys(F.from_json("payload_json", "map<string, variant>"))).alias("target"), F.lit("has_field").alias("relation"))
    return models.unionByName(members).unionByName(parts).unionByName(fields)


def graph_schema(library: Library) -> DataFrame:
    """(kind, name): the kinds of nodes and edges of ``graph_edges``."""
    return library.spark.createDataFrame([("node", x) for x in NODES] + [("edge", x) for x in EDGES], "kind string, name string")
