"""Documents of registered models, addressed and filtered.

``documents`` has store, model, doc, path and text. Every method is a lazy
DataFrame; a query over one model extracts that model alone, with the scope
filter below the parser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogError
from ..functions.text import address, glob_pattern, tag_pattern
from ..plans.addresses import Address, parse_address
from ..plans.models import Model, Registry, model_tags
from ..plans.predicates import compile_predicate
from .extract import extract_docs
from .fields import deep_get, flatten_payloads
from .semantics import tag_children

KEYS = ["store", "model", "doc", "path"]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def document_tags(model: Model, payload_json: Column) -> Column:
    """The model's tags and the payload's ``semantic_tags`` and ``tags``, sorted, each once."""
    value = F.try_parse_json(payload_json)
    lists = [F.coalesce(F.try_variant_get(value, f"$.{k}", "array<string>"), F.array().cast("array<string>")) for k in ("semantic_tags", "tags")]
    own = F.filter(F.transform(F.concat(*lists), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    fixed = F.array(*[F.lit(t) for t in model_tags(model.semantics)]).cast("array<string>")
    return F.array_sort(F.array_union(fixed, own))


class Library:
    def __init__(self, registry: Registry, documents: DataFrame, equivalences: DataFrame | None = None):
        """``equivalences``: (store, tag, equal) pairs, both directions."""
        self.registry, self.documents = registry, documents
        self.spark = documents.sparkSession
        self.equivalences = equivalences if equivalences is not None else self.spark.createDataFrame([], "store string, tag string, equal string")

    def typed(self, model: str, store: str | None = "local") -> DataFrame:
        """Documents of one model with payload, payload_json, error and semantic_tags."""
        m = self.registry[model]
        own = self.documents.where(F.col("model") == model)
        own = own if store is None else own.where(F.col("store") == store)
        return extract_docs(own, m).withColumn("semantic_tags", document_tags(m, F.col("payload_json")))

    def payloads(self, models: list[str] | None = None, store: str | None = None) -> DataFrame:
        """Documents of several models; payloads as JSON."""
        names = list(self.registry.models) if models is None else models
        if not names:
            raise CatalogError("no models")
        return union([self.typed(n, store).drop("payload") for n in names])

    def scope(self, a: Address) -> list[str]:
        if a.model == "*":
            return list(self.registry.models)
        if a.model not in self.registry.models:
            return []
        return self.registry.descendants(a.model) if a.descendants else [a.model]

    def _none(self, column: str) -> DataFrame:
        return self.spark.createDataFrame([], f"{column} string")

    def ls(self, text: str) -> DataFrame:
        """What an address holds: models, documents, fields with descriptions, tags; one sorted column ``name``."""
        a = parse_address(text)
        if a.root == "st" and a.model is None:
            return self.registry.table(self.spark).select(F.col("model").alias("name")).orderBy("name")
        if a.root == "st" and a.doc is None:
            scope = self.scope(a)
            return self.documents.where((F.col("store") == "local") & F.col("model").isin(scope)).select(F.col("doc").alias("name")).orderBy("name") if scope else self._none("name")
        if a.root == "st":
            docs = self.documents.where((F.col("store") == "local") & F.col("model").isin(self.scope(a)) & (F.col("doc") == a.doc)).select("model")
            fields = self.registry.fields_table(self.spark)
            return docs.join(F.broadcast(fields), "model").select(F.concat_ws(": ", "field", "description").alias("name")).orderBy("name")
        if a.root == "se":
            tags = self.tags()
            return tag_children(tags.select("tag").distinct(), a.tag).select(F.col("segment").alias("name")).unionByName(tags.where(F.col("tag") == a.tag).select(F.col("doc").alias("name")) if a.tag else self._none("name")).orderBy("name")
        return self.get(text).select(F.col("address").alias("name")).orderBy("name")

    def tags(self, store: str | None = "local") -> DataFrame:
        """(store, model, doc, tag)."""
        return self.payloads(store=store).select("store", "model", "doc", F.explode("semantic_tags").alias("tag"))

    def get(self, text: str) -> DataFrame:
        """One value (``value``, JSON) of st addresses; addresses of documents for tags."""
        a = parse_address(text)
        if a.root == "st":
            if a.doc is None:
                raise CatalogError(f"no document in {text}")
            scope = self.scope(a)
            docs = self.payloads(scope, "local").where(F.col("doc") == a.doc) if scope else self.payloads([*self.registry.models][:1], "local").limit(0)
            return docs.select((deep_named(F.col("payload_json"), a.field) if a.field else F.col("payload_json")).alias("value"))
        if a.root == "se":
            return self.tags().where(F.col("tag") == a.tag).select(address(F.col("model"), F.col("doc")).alias("address")).distinct().orderBy("address")
        if a.root == "gse":
            tags = self.tags(None)
            equal = self.equivalences.where(F.col("equal") == a.tag).select("store", "tag")
            # the side with the sought tag's equals is one tag's neighbours
            mapped = tags.join(equal, ["store", "tag"], "left_semi").unionByName(tags.where((F.col("store") == "local") & (F.col("tag") == a.tag)))
            return mapped.select(F.concat(F.col("store"), F.lit(":"), address(F.col("model"), F.col("doc"))).alias("address")).distinct().orderBy("address")
        return self.bridge(a.tag, a.store).select(F.col("tag").alias("address"))

    def bridge(self, tag: str, store: str) -> DataFrame:
        """Tags of ``store`` that equal a global tag, as ``se.`` addresses."""
        own = self.equivalences.where((F.col("store") == store) & (F.col("equal") == tag))
        return own.select(F.concat(F.lit("se."), "tag").alias("tag")).distinct().orderBy("tag")

    def glob(self, text: str) -> DataFrame:
        """Addresses that match: shell patterns in documents and fields, ``*`` and ``**`` in tags."""
        a = parse_address(text)
        if a.root == "st" and a.doc:
            scope = self.scope(a)
            if not scope:
                return self._none("address")
            hit = F.col("doc").rlike(glob_pattern(a.doc))
            if not a.field:
                return self.documents.where((F.col("store") == "local") & F.col("model").isin(scope) & hit).select(address(F.col("model"), F.col("doc")).alias("address")).orderBy("address")
            # the names of a payload's fields are those that its document gave
            keys = F.explode(F.map_keys(F.from_json("payload_json", "map<string, variant>"))).alias("field")
            own = self.payloads(scope, "local").where(hit).select("model", "doc", keys).where(F.col("field").rlike(glob_pattern(a.field)))
            return own.select(F.concat(address(F.col("model"), F.col("doc")), F.lit("."), "field").alias("address")).orderBy("address")
        if a.root == "se" and a.tag:
            return self.tags().select("tag").distinct().where(F.col("tag").rlike(tag_pattern(a.tag))).select(F.concat(F.lit("se."), "tag").alias("address")).orderBy("address")
        raise CatalogError(f"no pattern in {text}")

    def find(self, text: str, where: str | None = None, strict: bool = True) -> DataFrame:
        """Documents in scope for which ``where`` holds, with their address and payload."""
        a = parse_address(text)
        if a.root == "st" and a.model:
            scope, test = self.scope(a), None
        elif a.root == "se" and a.tag:
            scope, test = list(self.registry.models), F.exists("semantic_tags", lambda t: t.rlike(tag_pattern(a.tag)))
        else:
            raise CatalogError(f"no scope in {text}")
        found = []
        for name in scope:
            docs = self.typed(name)
            docs = docs if test is None else docs.where(test)
            if where:
                docs = docs.where(compile_predicate(where, self.registry[name].schema, lambda f: F.col(f"payload.{f}"), F.col("doc"), F.col("model"), self.registry, strict))
            found.append(docs.drop("payload") if len(scope) > 1 else docs)
        if not found:
            return self._none("address")
        return union(found).withColumn("address", address(F.col("model"), F.col("doc")))

    def fields(self, store: str | None = None) -> DataFrame:
        return flatten_payloads(self.payloads(store=store), [*KEYS, "semantic_tags", "payload_json"])

    def target(self, text: str) -> DataFrame:
        """The one document that a name, a path or ``Model/name`` means."""
        hit = self.documents.where((F.col("doc") == text) | (F.col("path") == text) | (F.concat_ws("/", "model", "doc") == text))
        n = hit.limit(2).count()
        if n != 1:
            raise CatalogError(f"{text!r} is {'ambiguous' if n else 'unknown'}")
        return hit


def deep_named(payload_json: Column, path: str) -> Column:
    """A value under mappings only; a number is a key, not a place in a list."""
    return F.to_json(F.try_variant_get(F.try_parse_json(payload_json), "$" + "".join(f"['{p}']" for p in path.split(".")), "variant"))


def select_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The named columns; unknown ones are null."""
    return df.select(*[F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys])


__all__ = ["KEYS", "Library", "deep_get", "deep_named", "document_tags", "select_keys", "union"]
