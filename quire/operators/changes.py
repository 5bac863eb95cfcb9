"""Changes of a catalog: each returns after its generation is in place."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RegistryError, CatalogError, RoundTripError
from ..plans.models import Model, Registry
from ..sources.catalog import Catalog, bucket_of
from ..sources.files import tracked_files
from .extract import PAYLOAD, extract_docs, render_column, typed_payloads, validate_docs
from .fields import edit_field
from .integrity import document_folds, document_hashes, folded_hashes, store_hashes
from .library import document_tags, union
from .sections import sections
from .semantics import map_equal
from .trigrams import gram_postings, with_record

DOC = ["store", "model", "doc"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of rows of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def prepared(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of the documents table from (store, doc, path, text)."""
    own = extract_docs(docs.withColumn("model", F.lit(model.name)), model).withColumn("semantic_tags", document_tags(model, F.col(PAYLOAD)))
    return document_hashes(own).select(*DOC, "path", "text", PAYLOAD, "semantic_tags", "hash_c", "hash_d", "error")


class Changes:
    def __init__(self, catalog: Catalog, registry: Registry):
        self.catalog, self.registry, self.spark = catalog, registry, catalog.spark

    def _commit(self, new: DataFrame | None = None, gone: DataFrame | None = None, mark: tuple[str, int] | None = None, **tables: DataFrame) -> None:
        """Put documents ``new`` in place of those of the same names, forget ``gone`` (store, model, doc), and write ``tables``, in one generation.

        Only the buckets of these documents are read and written, with their sections
        and folds. Each model's hash_b follows from the folds, the store's hash_a from
        these. Models whose first document comes with it are registered. Hold the lock.
        """
        models, digits = tables.pop("models", None), self.catalog.digits
        keys = [x.select(*DOC) for x in (new, gone) if x is not None]
        if not keys:
            self._finish(models, tables, None, mark)
            return
        keys = union(keys)
        if new is not None:
            new = new.persist()  # its buckets, documents and sections come from one extraction
        try:
            buckets = sorted(r[0] for r in keys.select(bucket_of(digits)).distinct().collect())  # at most 16 ** digits

            def changed(name: str, more: DataFrame | None) -> DataFrame:
                rows = self.catalog.read(name, buckets).join(keys, DOC, "left_anti")
                return (rows if more is None else rows.unionByName(more.select(rows.columns))).withColumn("bucket", bucket_of(digits))

            found = None if new is None else sections(new, [*DOC, "semantic_tags"], F.col("semantic_tags"))
            written = {
                "documents": changed("documents", new),
                "sections": changed("sections", found),
                "folds": lambda read: document_folds(read("documents", buckets), digits).withColumn("bucket", F.col("prefix")),
            }
            self._finish(models, written | tables, buckets, mark)
        finally:
            if new is not None:
                new.unpersist()

    def _finish(self, models: DataFrame | None, tables: dict, buckets: list[str] | None, mark: tuple[str, int] | None) -> None:
        digits = self.catalog.digits

        def with_hashes(read: Callable[[str], DataFrame]) -> DataFrame:
            folded = folded_hashes(read("folds").where("store = 'local'"), digits)
            known = (self.catalog.read("models") if models is None else models).drop("hash_b")
            used = folded.select("model").distinct().join(known.select("model"), "model", "left_anti")
            known = known.unionByName(self.registry.table(self.spark).join(used, "model", "left_semi").select(known.columns))
            return known.join(folded, ["store", "model"], "left").withColumn("hash_b", F.coalesce("hash_b", F.lit("")))

        def with_root(read: Callable[[str], DataFrame]) -> DataFrame:
            root = store_hashes(read("models").where("hash_b <> ''")).select(F.col("store").alias("name"), F.col("hash_a").alias("_root"))
            stores = tables.get("stores", self.catalog.read("stores")).drop("hash_a").join(root, "name", "left")
            return stores.withColumn("hash_a", F.when(F.col("linked"), F.lit(None)).otherwise(F.coalesce("_root", F.lit(""))))

        own = {n: df for n, df in tables.items() if n != "stores"}
        self.catalog.write(buckets, mark, **own, models=with_hashes, stores=with_root)

    def add_model(self, name: str) -> None:
        with self.catalog.lock():
            old, new = self.catalog.read("models"), self.registry.table(self.spark).where(F.col("model") == name)
            if not old.where(F.col("model") == name).isEmpty():
                raise RegistryError(f"model {name!r} is registered")
            self._commit(models=old.unionByName(new, allowMissingColumns=True))

    def update_model(self, name: str, bump: bool = False) -> None:
        """Hash a registered model's documents anew, from their texts; with ``bump`` its version goes up by one."""
        with self.catalog.lock():
            models, docs = self.catalog.read("models"), self.catalog.read("documents")
            if models.where(F.col("model") == name).isEmpty():
                raise RegistryError(f"model {name!r} isn't registered")
            own = prepared(docs.where(F.col("model") == name).select("store", "doc", "path", "text"), self.registry[name]).drop("error")
            version = F.when((F.col("model") == name) & F.lit(bump), F.col("version") + 1).otherwise(F.col("version"))
            self._commit(own, models=models.withColumn("version", version))

    def draft(self, name: str) -> Model:
        """The draft of a model that is kept in the catalog, else the registered model."""
        spec = self.catalog.read("drafts").where(F.col("model") == name).select("spec").first()
        return replace(Model.from_spec(json.loads(spec[0])), **{k: getattr(self.registry[name], k) for k in ("parents", "compositions", "version")}) if spec else self.registry[name]

    def keep_draft(self, draft: Model) -> None:
        """Keep ``draft`` beside the registered model, in place of an earlier one."""
        with self.catalog.lock():
            new = self.spark.createDataFrame([(draft.name, json.dumps(draft.to_spec()))], "model string, spec string")
            self.catalog.write(drafts=upsert(self.catalog.read("drafts"), new, ["model"]))

    def promote_model(self, draft: Model) -> None:
        """Replace a model by ``draft`` if every tracked document still survives its round trip."""
        docs = self.catalog.read("documents").where(F.col("model") == draft.name)
        bad = validate_docs(docs.select(*DOC, "path", "text"), draft).where("not valid").count()
        if bad:
            raise RoundTripError(f"{bad} documents of {draft.name} don't fit the draft")
        self.registry.models[draft.name] = draft.promoted()
        with self.catalog.lock():
            new = self.registry.table(self.spark).where(F.col("model") == draft.name)
            models = self.catalog.read("models")
            self._commit(
                prepared(docs.select("store", "doc", "path", "text"), self.registry[draft.name]).drop("error"),
                models=upsert(models, new.withColumn("hash_b", F.lit("")).select(models.columns), ["store", "model"]),
                drafts=self.catalog.read("drafts").where(F.col("model") != draft.name),
            )

    def track(self, docs: DataFrame, model: str, force: bool = False) -> None:
        """Add documents (store, doc, path, text); names are new within their model, and texts valid unless forced."""
        m = self.registry[model]
        if docs.groupBy("store", "doc").count().where("count > 1").limit(1).count():
            raise CatalogError("a name comes twice")
        if not force:
            bad = validate_docs(docs, m).where("not valid").select("doc").limit(5).collect()
            if bad:
                raise RoundTripError("invalid: " + ", ".join(r.doc for r in bad))
        new = prepared(docs, m).drop("error")
        with self.catalog.lock():
            names = docs.select("store", F.lit(model).alias("model"), "doc")
            if not self._known(names).join(names, DOC, "left_semi").isEmpty():
                raise CatalogError("a document of that name is tracked")
            self._commit(new)

    def create(self, rows: DataFrame, model: str) -> None:
        """Render documents from (store, doc, path, payload), then track them."""
        m = self.registry[model]
        self.track(rows.select("store", "doc", "path", render_column(m, F.col("payload")).alias("text")), model)

    def _known(self, names: DataFrame) -> DataFrame:
        """Tracked documents of the buckets in which ``names`` (store, model, doc) would be."""
        buckets = names.select(bucket_of(self.catalog.digits)).distinct().collect()  # at most 16 ** digits
        return self.catalog.read("documents", [r[0] for r in buckets])

    def _replace(self, new: DataFrame) -> None:
        with self.catalog.lock():
            self._commit(new)

    def update(self, rows: DataFrame, model: str) -> None:
        """Whole new payloads (store, doc, payload) for tracked documents."""
        m = self.registry[model]
        known = self._known(rows.withColumn("model", F.lit(model))).where(F.col("model") == model).select("store", "doc", "path")
        texts = rows.join(known, ["store", "doc"]).select("store", "doc", "path", render_column(m, F.col("payload")).alias("text"))
        if texts.count() < rows.count():
            raise CatalogError("a document isn't tracked")
        if not validate_docs(texts, m).where("not valid").isEmpty():
            raise RoundTripError("a payload doesn't fit its model")
        self._replace(prepared(texts, m).drop("error"))

    def take(self, docs: DataFrame, mark: tuple[str, int] | None = None) -> bool:
        """Put documents (store, model, doc, path, text) in, tracked before or not; wrong ones too, with their error as an empty payload.

        ``mark``, a stream's name and the number of its batch, is kept with the
        generation; a batch that is there already, or an earlier one, changes nothing.
        """
        with self.catalog.lock(wait_s=10):
            if mark and mark[1] <= self.catalog.mark(mark[0]):
                return False
            names = [r[0] for r in docs.select("model").distinct().collect()]  # one row per model
            for name in names:
                self.registry[name]
            new = [prepared(docs.where(F.col("model") == n).drop("model"), self.registry[n]).drop("error") for n in names]
            self._commit(union(new) if new else None, mark=mark)
            return True

    def untrack(self, docs: DataFrame) -> None:
        """Forget documents (store, model, doc); files stay."""
        with self.catalog.lock():
            self._commit(gone=docs)

    def edit(self, docs: DataFrame, model: str, op: str, path: str, value: Any = None) -> None:
        """Change one field of documents (store, doc), render and check them again; see ``edit_field``."""
        m = self.registry[model]
        own = self._known(docs.withColumn("model", F.lit(model))).where(F.col("model") == model).join(docs.select("store", "doc"), ["store", "doc"], "left_semi")
        edited = own.withColumn("_e", edit_field(F.col(PAYLOAD), op, path, value))
        errors = edited.where("_e.error is not null").select("_e.error").limit(1).collect()
        if errors:
            raise RoundTripError(errors[0][0])
        typed = typed_payloads(edited.select("store", "doc", "path", F.col("_e.payload_json").alias(PAYLOAD)), m)
        texts = typed.select("store", "doc", "path", render_column(m, F.col("payload")).alias("text"))
        if not validate_docs(texts, m).where("not valid").isEmpty():
            raise RoundTripError(f"{path} doesn't survive the round trip")
        self._replace(prepared(texts, m).drop("error"))

    def link_store(self, name: str, path: str) -> None:
        with self.catalog.lock():
            old = self.catalog.read("stores")
            if not old.where(F.col("name") == name).isEmpty():
                raise CatalogError(f"store {name!r} is linked")
            if not Catalog(self.spark, path).exists():
                raise CatalogError(f"no catalog in {path}")
            self.catalog.write(stores=old.unionByName(self.spark.createDataFrame([("local", name, path, True, None)], old.schema)))

    def map_tags(self, tag: str, equal: str, store: str = "local") -> None:
        with self.catalog.lock():
            self.catalog.write(equivalences=map_equal(self.catalog.read("equivalences"), store, tag, equal))

    def index(self, records: DataFrame) -> None:
        """Keep search records and their trigrams, for the documents as they are now; ``root`` tells whether they still are."""
        with self.catalog.lock():
            root = F.lit(self.catalog.root_hash())
            kept = with_record(records).withColumn("root", root)
            self.catalog.write(records=kept, postings=lambda read: gram_postings(read("records")).withColumn("root", root))

    def refresh(self, found: DataFrame | None = None) -> dict[str, int]:
        """Take in texts (store, model, doc, path, text) that changed since they were tracked; by default all tracked documents' own files.

        Only changed documents are parsed, and only their buckets written. Documents
        of the models in ``found`` without a text are counted as missing. Documents of
        models that aren't registered stay as they are, and these models are counted as skipped.
        """
        with self.catalog.lock(wait_s=10):
            old = self.catalog.read("documents").where("store = 'local'")
            asked = old if found is None else old.join(found.select("model").distinct(), "model", "left_semi")
            found = (tracked_files(old) if found is None else found).select(*DOC, "path", "text")
            changed = found.join(old.select(*DOC, "hash_c"), DOC).where(F.sha2("text", 256) != F.col("hash_c"))
            names = [r[0] for r in asked.select("model").distinct().collect()]  # one row per model
            new = [prepared(changed.where(F.col("model") == n).select("store", "doc", "path", "text"), self.registry[n]).drop("error") for n in names if n in self.registry.models]
            missing = asked.join(found.select(*DOC), DOC, "left_anti").count()
            self._commit(union(new) if new else None)
            skipped = sum(n not in self.registry.models for n in names)
            return {"docs": self.catalog.read("documents").count(), "missing": missing, "skipped": skipped, "sections": self.catalog.read("sections").count()}
