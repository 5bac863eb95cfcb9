"""A document's parts as tables: context, structure, nodes, surface, graph, context index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.blocks import with_blocks
from .library import KEYS, Library
from .search import field_records
from .sections import sections


def document_parts(library: Library, docs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Six DataFrames, keyed by (store, model, doc).

    ``context``: path and tags; ``structure``: sections with their parents;
    ``nodes``: sections and fields; ``surface``: blocks; ``graph``: edges
    has_section and has_field; ``context_index``: breadcrumbs and about terms.
    """
    docs = docs if docs is not None else library.payloads()
    key = KEYS[:3]
    found = sections(docs, [*key, "semantic_tags"], F.col("semantic_tags"))
    own = field_records(library, docs)
    section_nodes = found.select(*key, F.lit("section").alias("kind"), F.col("path").alias("name"), F.col("parent").alias("owner"), F.lit(None).cast("string").alias("value"))
    field_nodes = own.select(*key, F.lit("field").alias("kind"), F.col("field_path").alias("name"), F.col("owning_section").alias("owner"), "value")
    nodes = section_nodes.unionByName(field_nodes)
    edge = F.when(F.col("kind") == "section", "has_section").otherwise("has_field")
    return {
        "context": docs.select(*key, F.col("path").alias("physical"), F.col("semantic_tags").alias("semantic")),
        "structure": found.select(*key, "position", "title", "slug", "level", "path", "parent", "line_start", "line_end", "body_end"),
        "nodes": nodes,
        "surface": with_blocks(docs.select(*key, "text")).select(*key, F.explode("blocks").alias("b")).select(*key, "b.*"),
        "graph": nodes.select(*key, F.col("doc").alias("source"), F.col("name").alias("target"), edge.alias("relation")),
        "context_index": found.select(*key, "path", "breadcrumbs", "about"),
    }
