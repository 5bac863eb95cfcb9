"""A thin command line over a catalog: python -m quire.cli --help."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QuireError, CatalogError
from .operators import extract, fields, integrity, library, links, search, sections, tree, trigrams
from .operators.changes import Changes
from .operators.semantics import tag_edges
from .plans.models import Field, Model, Registry
from .plans.templates import dump_yaml, load_yaml
from .sources.catalog import KEEP_S, Catalog
from .sources.files import as_json, read_documents, read_text, tracked_files, write_document


def registry_of(ref: str) -> Registry:
    """``module:NAME`` of a Registry or a Model, or a YAML file that lists model specs."""
    if ref.endswith((".yaml", ".yml")):
        with open(ref, encoding="utf-8") as f:
            specs = load_yaml(f.read())
        return Registry(*(Model.from_spec(s) for s in (specs if isinstance(specs, list) else [specs])))
    module, _, name = ref.partition(":")
    found = getattr(importlib.import_module(module), name)
    return found if isinstance(found, Registry) else Registry(found)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("--catalog", help="folder of the catalog; else the one in the nearest folder above that has any, else ./catalog")
    p.add_argument("--models", help="module:REGISTRY or a YAML file of models")
    p.add_argument("--format", choices=("text", "json", "yaml"), default="text")
    groups = p.add_subparsers(dest="group", required=True)

    def group(name: str) -> argparse._SubParsersAction:
        return groups.add_parser(name).add_subparsers(dest="action", required=True)

    def command(where: argparse._SubParsersAction, name: str, /, *names: str, **options: dict) -> None:
        c = where.add_parser(name)
        for n in names:
            c.add_argument(n.removesuffix("?"), **({"nargs": "?"} if n.endswith("?") else {}))
        for n, kind in options.items():
            c.add_argument("--" + n.replace("_", "-"), **kind)

    flag = {"action": "store_true"}
    for name in ("extract", "validate"):
        command(groups, name, "model", "file", **({"strict": flag} if name == "validate" else {}))
    command(groups, "render", "model", "data")
    command(groups, "extract-template", "template", "file")
    command(groups, "render-template", "template", "data")
    command(groups, "help", "topic?")
    stores = group("stores")
    command(stores, "init", force=flag)
    command(stores, "add", "path", "name")
    command(stores, "check")
    command(stores, "update", "folder?", "model?")
    command(stores, "vacuum")
    command(stores, "index")
    command(stores, "map", "tag", "equal")
    models = group("models")
    command(models, "add", "name")
    command(models, "show", "name?")
    command(models, "update", "name", bump=flag)
    command(models, "edit", "name", template={"default": None}, add={"default": None}, remove={"default": None}, promote=flag)
    command(models, "drafts")
    docs = group("docs")
    command(docs, "track", "model", "folder", force=flag)
    command(docs, "create", "model", "name", "payload", out={"default": None})
    command(docs, "update", "model", "name", "payload")
    command(docs, "untrack", "name")
    command(docs, "show", "name")
    command(docs, "recover", "name", depth={"type": int, "default": 1}, links_only=flag, no_transclusions=flag)
    command(docs, "compose", "name")
    f = group("fields")
    command(f, "show", "name")
    command(f, "query", "field")
    for op in ("create", "update", "append"):
        command(f, op, "model", "name", "field", "value")
    command(f, "remove", "model", "name", "field")
    command(f, "clean", "model", "name", "field", dedupe=flag, drop_empty=flag)
    s = group("sections")
    command(s, "show", "name?")
    command(s, "find", "term", rebuild=flag, regex=flag)
    command(s, "fields", "name", "section?")
    command(groups, "find", "term?", within={"choices": ("physical", "semantic", "both"), "default": "both"}, regex=flag, fuzzy=flag, type={"action": "append", "default": []}, select={"default": None}, where={"default": None}, rebuild=flag, **{"global": flag})
    ast = group("ast")
    command(ast, "show", "name?")
    command(ast, "schema")
    for name in ("ls", "get", "glob"):
        command(groups, name, "address")
    command(groups, "raw-find", "address", where={"default": None})
    legacy = group("legacy")
    for name in ("ls", "get", "glob"):
        command(legacy, name, "address")
    command(legacy, "find", "address", where={"default": None})
    command(legacy, "recover", "name", depth={"type": int, "default": 1}, links_only=flag, no_transclusions=flag)
    command(legacy, "compose", "name")
    return p


def find_catalog(start: str = ".") -> str:
    """The folder ``catalog`` that is one, in ``start`` or the nearest folder above it; ``catalog`` if there is none."""
    here = os.path.abspath(start)
    while True:
        if os.path.isfile(os.path.join(here, "catalog", "CURRENT")):
            return os.path.join(here, "catalog")
        if os.path.dirname(here) == here:
            return "catalog"
        here = os.path.dirname(here)


TOPICS = {
    "addresses": "st.{Model+}.doc.field   se.a.b   gse.a.b   gse.a.b.se.{store}",
    "predicates": 'has(f)   "text" in f   f ~ "regex"   model <= Base   f = v, !=, >=, <=   and, or, not, ( )',
    "targets": "stores   models/NAME   docs/NAME   fields/DOC/PATH",
    "exit": "0: all well and something found; 1: nothing found, or an error; 2: no such command",
}


class Commands:
    """Each command gives a DataFrame to print, or None; ``code`` is the exit code."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.code = spark, args, 0
        self.catalog = Catalog(spark, args.catalog or find_catalog())
        self.registry = registry_of(args.models) if args.models else Registry()
        self.changes = Changes(self.catalog, self.registry)

    def library(self) -> library.Library:
        own = self.catalog.read("documents").select("store", "model", "doc", "path", "text")
        linked = self.catalog.read("stores").where("linked").select("name", "path").collect()  # one row per linked store
        frames = [own] + [Catalog(self.spark, r.path).read("documents").where("store = 'local'").select(F.lit(r.name).alias("store"), "model", "doc", "path", "text") for r in linked]
        return library.Library(self.registry, library.union(frames), self.catalog.read("equivalences"))

    def model(self) -> Model:
        return self.registry[self.args.model]

    def extract(self) -> DataFrame:
        docs = read_text(self.spark, self.args.file)
        out = extract.extract_docs(docs, self.model()).select("payload_json", "error")
        self.code = 0 if out.where("error is not null").isEmpty() else 1
        return out

    def validate(self) -> DataFrame:
        docs = read_text(self.spark, self.args.file)
        out = extract.validate_docs(docs, self.model(), strict=self.args.strict).select("valid", "mismatches", "error")
        self.code = 0 if out.where("not valid").isEmpty() else 1
        return out

    def _template(self) -> str:
        with open(self.args.template, encoding="utf-8") as f:
            return f.read()

    def extract_template(self) -> DataFrame:
        out = extract.extract_with_template(read_text(self.spark, self.args.file), self._template()).select("payload_json", "error")
        self.code = 0 if out.where("error is not null").isEmpty() else 1
        return out

    def render_template(self) -> DataFrame:
        payload = self.spark.createDataFrame([(json.dumps(self._mapping(self.args.data)),)], "payload_json string")
        return extract.render_with_template(payload, self._template()).select("text")

    def help(self) -> DataFrame:
        if self.args.topic and self.args.topic not in TOPICS:
            raise QuireError(f"no topic {self.args.topic!r}; there are {', '.join(TOPICS)}")
        rows = [(k, v) for k, v in TOPICS.items() if self.args.topic in (None, k)]
        return self.spark.createDataFrame(rows, "topic string, text string")

    def _payload(self, text: str) -> DataFrame:
        value = self._mapping(text)
        return extract.typed_payloads(self.spark.createDataFrame([(json.dumps(value),)], "payload_json string"), self.model()).select("payload")

    def _mapping(self, text: str) -> dict:
        if text == "-":
            text = sys.stdin.read()
        elif os.path.isfile(text):
            with open(text, encoding="utf-8") as f:
                text = f.read()
        value = load_yaml(text)
        if not isinstance(value, dict):
            raise QuireError("a payload is a mapping")
        return value

    def render(self) -> DataFrame:
        return self._payload(self.args.data).select(extract.render_column(self.model(), F.col("payload")).alias("text"))

    def stores_init(self) -> None:
        self.catalog.init(self.args.force)

    def stores_add(self) -> None:
        self.changes.link_store(self.args.name, self.args.path)

    def stores_map(self) -> None:
        self.changes.map_tags(self.args.tag, self.args.equal)

    def stores_update(self) -> DataFrame:
        """Take in changed files: those of a folder as a model's documents, or else every tracked document's own."""
        if self.args.folder and not self.args.model:
            raise QuireError("a folder needs the model of its documents")
        report = self.changes.refresh(read_documents(self.spark, self.args.folder, self.args.model) if self.args.folder else None)
        self.code = 1 if report["missing"] or report["skipped"] else 0
        return self.spark.createDataFrame([report])

    def stores_index(self) -> None:
        """Keep search records and trigrams of the documents as they are now, which ``find`` reads while they are."""
        stores = self.catalog.read("stores").where("not linked")
        self.changes.index(search.search_records(self._local(), stores, persisted=self._persisted()))

    def stores_vacuum(self) -> DataFrame:
        """Delete files that nothing names and that readers have had an hour to end with."""
        with self.catalog.lock():
            return self.spark.createDataFrame([(self.catalog.vacuum(KEEP_S),)], "places int")

    def stores_check(self) -> DataFrame:
        """Tracked documents against their files, stored hashes against the documents'; text shows PASS or FAIL."""
        tracked = self.catalog.read("documents").where("store = 'local'")
        now = library.Library(self.registry, tracked_files(tracked)).payloads()
        models = integrity.diagnose_models(integrity.diagnose(tracked, now), tracked, self.catalog.read("models"))
        store = integrity.diagnose_store(models, self.catalog.read("models"), self.catalog.read("stores").where("not linked").select(F.col("name").alias("store"), "hash_a"))
        self.code = 0 if store.where("not valid").isEmpty() else 1
        if self.args.format == "text":
            shown = lambda name, ok: F.concat(F.when(F.col(ok), "PASS ").otherwise("FAIL "), name)
            counts = F.concat(F.lit(" ("), F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.col(c)) for c in ("docs", "ok", "benign", "changed", "missing")]), F.lit(")"))
            lines = models.withColumn("fine", F.col("valid") & F.col("hash_b_ok")).orderBy("store", "model").select(F.concat(shown(F.concat_ws("/", "store", "model"), "fine"), counts).alias("report"))
            return store.select(shown(F.col("store"), "valid").alias("report")).unionByName(lines)
        return store.join(models.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("model", "valid", "hash_b_ok", "docs", "ok", "benign", "changed", "missing"))).alias("model_reports")), "store", "left")

    def models_add(self) -> None:
        self.changes.add_model(self.args.name)

    def models_show(self) -> DataFrame:
        t = self.registry.fields_table(self.spark)
        return t.where(F.col("model") == self.args.name) if self.args.name else self.catalog.read("models").drop("template")

    def models_update(self) -> None:
        self.changes.update_model(self.args.name, self.args.bump)

    def models_drafts(self) -> DataFrame:
        return self.catalog.read("drafts").orderBy("model")

    def models_edit(self) -> DataFrame:
        """Edit the draft that is kept of a model; ``--promote`` puts it in the model's place."""
        draft = self.changes.draft(self.args.name)
        if self.args.add:
            spec = load_yaml(self.args.add)
            draft = draft.with_field(Field(spec["name"], spec.get("type", "str"), spec.get("description", ""), bool(spec.get("optional"))))
        if self.args.remove:
            draft = draft.without_field(self.args.remove)
        if self.args.template:
            with open(self.args.template, encoding="utf-8") as f:
                draft = draft.with_template(f.read())
        if self.args.promote:
            self.changes.promote_model(draft)
        else:
            self.changes.keep_draft(draft)
        return Registry(draft).fields_table(self.spark)

    def docs_track(self) -> None:
        self.changes.track(read_documents(self.spark, self.args.folder, self.args.model), self.args.model, self.args.force)

    def _row(self) -> DataFrame:
        return self._payload(self.args.payload).select(F.lit("local").alias("store"), F.lit(self.args.name).alias("doc"), F.lit(f"{self.args.name}.md").alias("path"), "payload")

    def docs_create(self) -> None:
        row = self._row()
        if self.args.out:
            m = self.model()
            text = row.select(extract.render_column(m, F.col("payload")).alias("text"), "store", "doc")
            if not extract.validate_docs(text, m).where("not valid").isEmpty():
                raise QuireError("the payload doesn't survive the round trip")
            made = text.first().text
            path = write_document(self.spark, f"{self.args.out.rstrip('/')}/{self.args.name}.md", made)
            file = self.spark.createDataFrame([("local", self.args.name, path, made + "\n")], "store string, doc string, path string, text string")
            self.changes.track(file, self.args.model)
        else:
            self.changes.create(row, self.args.model)

    def docs_update(self) -> None:
        self.changes.update(self._row().drop("path"), self.args.model)

    def docs_untrack(self) -> None:
        self.changes.untrack(self.library().target(self.args.name))

    def docs_show(self) -> DataFrame:
        doc = self.library().target(self.args.name)
        return self.catalog.read("documents").join(doc.select("store", "model", "doc"), ["store", "model", "doc"], "left_semi").drop("text")

    def _resolved(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Documents, their links, and the one that is meant: a file, tracked or not, else a tracked name."""
        docs = self.library().documents
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.args.name)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(place) and files.getFileStatus(place).isFile():
            path = files.makeQualified(place).toString()
            start = docs.where(F.col("path") == path)
            if start.isEmpty():
                row = read_text(self.spark, self.args.name).select(F.lit("file").alias("store"), F.lit("").alias("model"), F.lit(path).alias("path"), "text")
                docs = docs.unionByName(row.withColumn("doc", F.lit("\0" + path)))  # no link means it by name
                start = docs.where(F.col("path") == path)
        else:
            start = self.library().target(self.args.name)
        return docs, self._links(docs), start.select("path")

    def _links(self, docs: DataFrame) -> DataFrame:
        return links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs, "file:" + os.getcwd())

    def docs_recover(self) -> DataFrame:
        _, found, start = self._resolved()
        out = links.recover_links(found, start, self.args.depth, not self.args.no_transclusions)
        self.code = 0 if out.where("not resolved").isEmpty() else 1
        return out.select("target").distinct().orderBy("target") if self.args.links_only else out

    def docs_compose(self) -> DataFrame:
        docs, found, path = self._resolved()
        self.code = 0 if found.join(path, "path", "left_semi").where("kind = 'transclusion' and not resolved").isEmpty() else 1
        return links.compose(docs, found).join(path, "path", "left_semi").select("composed")

    def fields_show(self) -> DataFrame:
        parts = self.args.name.split("/")
        if parts[0] == "models":
            t = self.registry.fields_table(self.spark).where(F.col("model") == parts[1])
            return t.where(F.col("field") == parts[2]) if len(parts) > 2 else t
        doc = self.library().payloads().where(F.col("doc") == parts[1])
        return doc.select(fields.deep_get(F.col("payload_json"), ".".join(parts[2:])).alias("value"))

    def fields_query(self) -> DataFrame:
        return self._rows(search.field_records(self.library()).where((F.col("field_path") == self.args.field) | F.col("field_path").endswith("." + self.args.field)).drop("payload_json"))

    def _edit(self, op: str, value: object = None) -> None:
        docs = self.spark.createDataFrame([("local", self.args.name)], "store string, doc string")
        self.changes.edit(docs, self.args.model, op, self.args.field, value)

    def fields_create(self) -> None:
        self._edit("create", fields.parse_value(self.args.value))

    def fields_update(self) -> None:
        self._edit("update", fields.parse_value(self.args.value))

    def fields_append(self) -> None:
        self._edit("append", fields.parse_value(self.args.value))

    def fields_remove(self) -> None:
        self._edit("remove")

    def fields_clean(self) -> None:
        self._edit("clean", {"dedupe": self.args.dedupe, "drop_empty": self.args.drop_empty})

    def _sections(self) -> DataFrame:
        return sections.sections(self.library().payloads(), ["store", "model", "doc", "semantic_tags"], F.col("semantic_tags"))

    def sections_show(self) -> DataFrame:
        s = self._shortened(self._sections())
        return self._rows(s.where(F.col("doc") == self.args.name) if self.args.name else s)

    def _shortened(self, df: DataFrame) -> DataFrame:
        """``df`` with the first five about terms, as text shows them."""
        return df.withColumn("about", F.slice("about", 1, 5)) if self.args.format == "text" and "about" in df.columns else df

    def _persisted(self) -> DataFrame | None:
        """Stored sections, unless they are to be rebuilt or there are none yet."""
        stored = self.catalog.read("sections")
        return None if getattr(self.args, "rebuild", False) or stored.isEmpty() else stored

    def _local(self) -> library.Library:
        lib = self.library()
        return library.Library(self.registry, lib.documents.where("store = 'local'"), lib.equivalences)

    def sections_find(self) -> DataFrame:
        found = search.search_records(self._local(), kinds=("section",), persisted=self._persisted())
        return self._rows(self._shortened(search.search(found, self.args.term, regex=self.args.regex)))

    def sections_fields(self) -> DataFrame:
        r = search.field_records(self.library()).where(F.col("doc") == self.args.name)
        return self._rows((r.where(F.col("owning_section") == self.args.section) if self.args.section else r).drop("payload_json"))

    def _rows(self, df: DataFrame) -> DataFrame:
        self.code = 1 if df.isEmpty() else 0
        return df

    def find(self) -> DataFrame:
        a = self.args
        everywhere = getattr(a, "global")
        stores = self.catalog.read("stores").where(F.lit(everywhere) | ~F.col("linked"))
        # stored sections are the local store's
        lib, stored = (self.library(), None) if everywhere else (self._local(), self._persisted())
        kept = None if everywhere or a.fuzzy or a.rebuild or not a.term else self.catalog.indexed()
        if kept:
            found = trigrams.indexed_search(*kept, a.term, a.within, tuple(a.type), a.regex)
        else:
            found = search.search(search.search_records(lib, stores, persisted=stored), a.term or "", a.within, tuple(a.type), a.regex, a.fuzzy)
        if a.where:
            found = search.where_records(found, a.where, self.registry)
        return self._rows(library.select_keys(found, a.select.split(",")) if a.select else found)

    def ast_show(self) -> DataFrame:
        return self._rows(tree.tree_of(self.library(), self.args.name))

    def ast_schema(self) -> DataFrame:
        return tree.graph_schema(self.library())

    def ls(self) -> DataFrame:
        return self.library().ls(self.args.address)

    def get(self) -> DataFrame:
        return self._rows(self.library().get(self.args.address))

    def glob(self) -> DataFrame:
        return self.library().glob(self.args.address)

    def raw_find(self) -> DataFrame:
        return self.library().find(self.args.address, self.args.where).select("address").orderBy("address")

    legacy_ls, legacy_get, legacy_glob, legacy_find, legacy_recover, legacy_compose = ls, get, glob, raw_find, docs_recover, docs_compose

    def edges(self) -> DataFrame:
        return tag_edges(self.library().tags(), self.catalog.read("equivalences"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well and a search found something, else 1; 2 for unknown commands."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    name = args.group.replace("-", "_") + (f"_{args.action}" if getattr(args, "action", None) else "")
    try:
        commands = Commands(spark, args)
        out = getattr(commands, name)()
        if out is not None:
            for r in (out if args.format == "text" else as_json(out)).toLocalIterator():
                if args.format == "yaml":
                    print(dump_yaml([json.loads(r[0])]))
                    continue
                print(r[0] if len(r) == 1 else "\t".join("" if x is None else str(x) for x in r))
        return commands.code
    except (QuireError, CatalogError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
