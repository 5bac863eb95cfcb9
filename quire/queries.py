"""Queries over the driver's tables, each with SQL that computes its result from the source columns.

The tables hold no Markdown, so documents are rendered from rows by our own
templates, then extracted, searched and linked as documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import file_slug, slug, tag_pattern
from .operators import changes, compositions, extract, fields, ingest, integrity, intervals, ir, library, links, search, sections, semantics, tree, trigrams
from .plans.models import Composition, Field, Model, Registry
from .sources import folders
from .sources.blocks import with_blocks
from .sources.catalog import Catalog, bucket_of
from .streaming.files import tumbling_counts

PART = Model(
    "Part",
    "# ⸢rev•p_name⸥\n\nKey: ⸢rev•p_partkey⸥\n\nBrand: ⸢rev•p_brand⸥\n\nType: ⸢rev•p_type⸥\n\n## Size\n\nValue: ⸢rev•p_size⸥\n",
    (
        Field("p_name", "str", "Name of the part"),
        Field("p_partkey", "int", "Key of the part"),
        Field("p_brand", "str", "Brand of the part"),
        Field("p_type", "str", "Type of the part"),
        Field("p_size", "int", "Size of the part"),
    ),
    {"catalog": "parts"},
)
SIZED = Model("SizedPart", PART.template, PART.fields, {"catalog": ["parts", "sized"]}, parents=(PART,))
REGION = Model(
    "Region",
    "# ⸢rev•r_name⸥\n\n## Nations\n\n- ⸢rev,list•nations⸥\n\n## Notes\n\n⸢rev•notes⸥\n",
    (Field("r_name", "str", "Name of the region"), Field("nations", "list", "Nations of the region"), Field("notes", "str", "Remarks", optional=True)),
)
ORDER = Model(
    "Order",
    "# Order ⸢rev•o_orderkey⸥\n\nStatus: ⸢rev•status⸥\n\n| Line | Part | Quantity |\n| --- | --- | --- |\n| ⸢rev•lines⸥ | part ⸢rev•part⸥ | ⸢rev•quantity⸥ |\n",
    (Field("o_orderkey", "int", "Key of the order"), Field("status", "str", "Status of the order"), Field("lines", "rows", "Line items")),
)
CUSTOMER = Model(
    "Customer",
    "---\n⸢rev,dict•meta⸥\n---\n\n# ⸢rev•c_name⸥\n\nNation [[nation-⸢rev•nation⸥]].\n",
    (Field("meta", "dict", "Segment and balance"), Field("c_name", "str", "Name of the customer"), Field("nation", "int", "Key of the nation")),
)
NOTE = Model("Note", "# ⸢rev•title⸥\n\n⸢rev•body⸥\n", (Field("title", "str", "Title"), Field("body", "str", "Text", optional=True)))
REGISTRY = Registry(PART, SIZED)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rendered(rows: DataFrame, model: Model, doc: Column, store: Column | str = "local", name: Column | None = None) -> DataFrame:
    """Documents of ``model`` from rows that have its fields."""
    payload = rows.select("*", F.struct(*[F.col(f.name) for f in model.fields]).alias("_payload"))
    return payload.select(
        (F.lit(store) if isinstance(store, str) else store).alias("store"),
        (name if name is not None else F.lit(model.name)).alias("model"),
        doc.alias("doc"),
        F.concat(F.lit("docs/"), doc, F.lit(".md")).alias("path"),
        extract.render_column(model, F.col("_payload")).alias("text"),
    )


def part_docs(spark: SparkSession, sf_dir: str, sized_from: int = 25) -> DataFrame:
    """Parts as documents; larger ones are of the specialised model."""
    rows = read(spark, sf_dir, "part").select("p_name", F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"))
    kind = F.when(F.col("p_size") >= sized_from, SIZED.name).otherwise(PART.name)
    return _rendered(rows, PART, F.concat(F.lit("part-"), F.col("p_partkey")), name=kind)


def parts(spark: SparkSession, sf_dir: str) -> library.Library:
    return library.Library(REGISTRY, part_docs(spark, sf_dir))


def _part_columns(found: DataFrame) -> DataFrame:
    p = F.try_parse_json("payload_json")
    return found.select("address", F.try_variant_get(p, "$.p_size", "long").alias("p_size"), F.try_variant_get(p, "$.p_brand", "string").alias("p_brand"))


def region_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    rows = read(spark, sf_dir, "region").join(nations, "r_regionkey").withColumn("notes", F.concat(F.lit("See [["), F.col("r_name"), F.lit("]] for more.\n\nSecond paragraph.")))
    return _rendered(rows, REGION, F.concat(F.lit("region-"), F.col("r_regionkey")))


def chain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that link customers to nations and nations to regions, with a dangling link in each nation."""
    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    note = lambda doc, title, body: [F.concat(*doc).alias("doc"), title.alias("title"), F.concat(*body).alias("body")]
    rows = region.select(*note([F.lit("region-"), F.col("r_regionkey")], F.col("r_name"), [F.lit("A region.")]))
    rows = rows.unionByName(nation.select(*note([F.lit("nation-"), F.col("n_nationkey")], F.col("n_name"), [F.lit("Part of ![[region-"), F.col("n_regionkey"), F.lit("]] and of [[nowhere]].")])))
    rows = rows.unionByName(customer.select(*note([F.lit("customer-"), F.col("c_custkey")], F.col("c_name"), [F.lit("Lives in [[nation-"), F.col("c_nationkey"), F.lit("]], see [[docs/nation-"), F.col("c_nationkey"), F.lit(".md]].")])))
    return _rendered(rows, NOTE, F.col("doc"))


def part_roundtrip(spark, sf_dir):
    v = extract.validate_docs(part_docs(spark, sf_dir), PART)
    return v.where("valid and error is null").select("payload.*")


def where_query(where: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _part_columns(parts(spark, sf_dir).find("st.{Part+}", where))


def select_projection(spark, sf_dir):
    found = parts(spark, sf_dir).find("st.{SizedPart}").select("*", "payload.p_size")
    return library.select_keys(found, ["doc", "p_size", "nothing"])


def scope_inheritance(spark, sf_dir):
    lib = parts(spark, sf_dir)
    both = [lib.ls(a).groupBy().agg(F.count("*").alias("n")).select(F.lit(a).alias("scope"), "n") for a in ("st.{Part}", "st.{Part+}", "st.{SizedPart}", "st.{*}", "st.{Nothing}")]
    return library.union(both)


def where_model(spark, sf_dir):
    return parts(spark, sf_dir).find("st.{*}", "model <= SizedPart").select("address")


def glob_docs_fields(spark, sf_dir):
    return parts(spark, sf_dir).glob("st.{Part+}.part-1*.p_[bs]*")


def get_value(spark, sf_dir):
    return parts(spark, sf_dir).get("st.{Part+}.part-7.p_brand").select(F.try_variant_get(F.try_parse_json("value"), "$", "string").alias("value"))


def ls_models_fields(spark, sf_dir):
    lib = parts(spark, sf_dir)
    return lib.ls("st").unionByName(lib.ls("st.{Part+}.part-7"))


def list_extract(spark, sf_dir):
    got = extract.extract_docs(region_docs(spark, sf_dir), REGION)
    return got.select("payload.r_name", F.array_join("payload.nations", "|").alias("nations"), "payload.notes")


def table_extract(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_orderstatus").alias("status"))
    item = F.struct(F.col("l_linenumber").cast("string").alias("n"), F.col("l_partkey").cast("string").alias("p"), F.col("l_quantity").cast("long").cast("string").alias("q"))
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    row = lambda x: F.create_map(F.lit("lines"), x["n"], F.lit("part"), x["p"], F.lit("quantity"), x["q"])
    rows = orders.join(items, "o_orderkey").withColumn("lines", F.transform("x", row))
    got = extract.extract_docs(_rendered(rows, ORDER, F.concat(F.lit("order-"), F.col("o_orderkey"))), ORDER)
    line = got.select("payload.o_orderkey", "payload.status", F.explode("payload.lines").alias("l"))
    return line.select("o_orderkey", "status", F.col("l.lines").cast("long").alias("line"), F.col("l.part").cast("long").alias("part"), F.col("l.quantity").cast("long").alias("quantity"))


def customer_docs(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    meta = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.floor("c_acctbal").cast("long").alias("whole"), (F.col("c_acctbal") < 0).alias("negative")).alias("balance")))
    return _rendered(c.select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("nation"), F.parse_json(meta).alias("meta")), CUSTOMER, F.concat(F.lit("customer-"), F.col("c_custkey")))


def yaml_extract(spark, sf_dir):
    got = extract.extract_docs(customer_docs(spark, sf_dir), CUSTOMER)
    return got.select("payload.c_name", "payload.nation", F.variant_get("payload.meta", "$.segment", "string").alias("segment"), F.variant_get("payload.meta", "$.balance.whole", "long").alias("whole"), F.variant_get("payload.meta", "$.balance.negative", "boolean").alias("negative"))


def payload_flatten(spark, sf_dir):
    got = extract.extract_docs(customer_docs(spark, sf_dir), CUSTOMER)
    flat = fields.flatten_payloads(got, ["doc"])
    return flat.select("doc", "field_path", F.try_variant_get(F.try_parse_json("value_json"), "$", "string").alias("value"))


def fields_query(spark, sf_dir):
    got = extract.extract_docs(customer_docs(spark, sf_dir), CUSTOMER)
    return fields.query_fields(fields.flatten_payloads(got, ["doc"]), "whole").select("doc", "field_path", F.col("value_json").cast("long").alias("value"))


def events_props_flatten(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload_json"))
    flat = fields.flatten_payloads(e, ["event_id"])
    return flat.select("event_id", "field_path", F.col("value_json").cast("long").alias("value"))


def deep_get_query(spark, sf_dir):
    got = extract.extract_docs(region_docs(spark, sf_dir), REGION)
    return got.select("doc", F.try_variant_get(F.try_parse_json(fields.deep_get(F.col("payload_json"), "nations.1")), "$", "string").alias("second"))


def hierarchy_docs(spark, sf_dir):
    """Regions with a heading for each nation and one for each of its customers' segments."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    per = c.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("### Segment "), F.initcap("c_mktsegment"), F.lit("\n\nText.")))), "\n\n").alias("s"))
    n = read(spark, sf_dir, "nation").join(per, "n_nationkey", "left").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", F.concat_ws("\n\n", F.concat(F.lit("## "), F.initcap("n_name")), "s").alias("t")))).alias("x"))
    r = read(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.concat(F.lit("region-"), F.col("r_regionkey")).alias("doc"), F.concat(F.lit("# "), F.initcap("r_name"), F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n\n")).alias("text"))


def section_paths(spark, sf_dir):
    s = sections.sections(hierarchy_docs(spark, sf_dir), ["doc"])
    return s.select("doc", "path", "level", F.array_join("breadcrumbs", " > ").alias("breadcrumbs"), F.coalesce("parent", F.lit("")).alias("parent"))


def about_terms(spark, sf_dir):
    s = sections.sections(hierarchy_docs(spark, sf_dir).withColumn("tags", F.array(F.lit("geo.world"), F.lit("text"))), ["doc"], F.col("tags"))
    return s.where("level = 3").select("doc", "path", F.array_join("about", "|").alias("about"))


def section_lines(spark, sf_dir):
    s = sections.sections(part_docs(spark, sf_dir), ["doc"])
    return s.select("doc", "title", "line_start", "line_end", "body_end")


def field_ownership(spark, sf_dir):
    return sections.field_owners(part_docs(spark, sf_dir), ["doc"], PART.template).select("doc", "field", "line", F.coalesce("owning_section", F.lit("")).alias("owner"))


def section_fields(spark, sf_dir):
    own = search.field_records(parts(spark, sf_dir))
    return own.where(F.col("owning_section").endswith("/size")).select("doc", "field_path", F.col("value").cast("long").alias("value"))


def _records(spark, sf_dir, kinds):
    stores = spark.createDataFrame([("local", "local", "root", False), ("local", "other", "elsewhere", True)], "store string, name string, path string, linked boolean")
    return search.search_records(parts(spark, sf_dir), stores, kinds)


def search_kinds(spark, sf_dir):
    return _records(spark, sf_dir, search.KINDS).groupBy("kind").agg(F.count("*").alias("n"))


def search_term(spark, sf_dir):
    return search.search(_records(spark, sf_dir, ("doc", "section")), "part-11", "physical").select("kind", "doc", "name")


def search_semantic(spark, sf_dir):
    return search.search(_records(spark, sf_dir, ("model", "doc")), "parts.sized", "semantic").select("kind", "name")


def search_regex(spark, sf_dir):
    return search.search(_records(spark, sf_dir, ("doc",)), r"^part-\d*9$", regex=True).select("name")


def search_fuzzy(spark, sf_dir):
    return search.search(_records(spark, sf_dir, ("model", "doc")), "PART-1234x", "physical", fuzzy=True).select("kind", "name")


def search_where_fields(spark, sf_dir):
    found = search.where_records(_records(spark, sf_dir, ("field",)), 'field = "p_size"', REGISTRY)
    return found.select("doc", F.col("value").cast("long").alias("value"), "owning_section")


def search_where_sections(spark, sf_dir):
    return search.where_records(_records(spark, sf_dir, ("section",)), 'title ~ "^S"', REGISTRY).select("doc", "section_path")


def _tagged(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    tag = F.concat(F.lit("type."), F.replace(F.lower("p_type"), F.lit(" "), F.lit(".")), F.lit("."), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")))
    return p.select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("doc"), tag.alias("tag"), F.when(F.col("p_partkey") % 2 == 0, "local").otherwise("child").alias("store"))


def tag_index(spark, sf_dir):
    return semantics.tag_index(_tagged(spark, sf_dir)).select("tag", F.size("docs").cast("long").alias("n"), F.array_join("docs", ",").alias("docs"))


def tag_children(spark, sf_dir):
    return semantics.tag_children(_tagged(spark, sf_dir).select("tag").distinct(), "type")


def tag_edges(spark, sf_dir):
    return semantics.tag_edges(_tagged(spark, sf_dir)).select("parent", "child")


def tag_parents(spark, sf_dir):
    return semantics.tag_parents(semantics.tag_edges(_tagged(spark, sf_dir))).select("tag", F.array_join("parents", ",").alias("parents"))


def tag_glob(spark, sf_dir):
    return _tagged(spark, sf_dir).select("tag").distinct().where(F.col("tag").rlike(tag_pattern("type.*.brand-1*")) | F.col("tag").rlike(tag_pattern("type.**.brand-2*")))


def tag_intervals(spark, sf_dir):
    """Numbers of all tags and prefixes, in pre-order."""
    return intervals.numbered_tags(_tagged(spark, sf_dir))


def tags_below(spark, sf_dir):
    """What ``type.**`` matches, by a range of a stored table; tags that have something below them are marked as children."""

    def work(catalog: Catalog) -> DataFrame:
        intervals.numbered_tags(_tagged(spark, sf_dir)).orderBy("pre").write.parquet(f"{catalog.root}/tags")
        numbered = spark.read.parquet(f"{catalog.root}/tags")
        open_ = intervals.children(numbered, "type").withColumn("child", F.lit(True))
        found = intervals.tags_below(numbered, "type")
        return found.select("tag", F.substring_index("tag", ".", -1).alias("segment")).join(open_, "segment", "left").select("tag", F.coalesce("child", F.lit(False)).alias("child"))

    return _with_catalog(spark, work)


def global_library(spark, sf_dir):
    docs = part_docs(spark, sf_dir)
    half = F.when(F.regexp_extract("doc", r"\d+", 0).cast("long") % 2 == 0, "local").otherwise("child")
    equal = semantics.map_equal(spark.createDataFrame([], "store string, tag string, equal string"), "child", "catalog.parts.sized", "catalog.large")
    return library.Library(REGISTRY, docs.withColumn("store", half), semantics.map_equal(equal, "local", "catalog.parts", "catalog.large"))


def global_tags(spark, sf_dir):
    return global_library(spark, sf_dir).get("gse.catalog.large")


def local_tags(spark, sf_dir):
    return global_library(spark, sf_dir).get("se.catalog.parts.sized")


def bridge_tags(spark, sf_dir):
    return global_library(spark, sf_dir).get("gse.catalog.large.se.{child}")


def links_resolve(spark, sf_dir):
    docs = chain_docs(spark, sf_dir)
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs)
    return found.select("doc", "ord", "target", "kind", "resolved", F.coalesce("target_path", F.lit("")).alias("target_path"), F.coalesce("source", F.lit("")).alias("source"))


def recover_depth(spark, sf_dir):
    docs = chain_docs(spark, sf_dir)
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs)
    start = docs.where(F.col("doc").startswith("customer-")).select("path")
    return links.recover_links(found, start, depth=2).select("root", "depth", "target", "kind", "resolved")


def compose_docs(spark, sf_dir):
    docs = chain_docs(spark, sf_dir)
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs)
    return links.compose(docs, found)


def composition_refs(spark, sf_dir):
    """Children that exist, in the parents' order; names without a child are left out."""
    one = Composition("nations", "- {title}")
    nation = read(spark, sf_dir, "nation").select(F.col("n_name").alias("doc"), F.col("n_nationkey").alias("key"))
    regions = extract.extract_docs(region_docs(spark, sf_dir), REGION).select("doc", F.concat(F.array(F.lit("nowhere")), "payload.nations").alias("nations"))
    line = F.concat(F.lit(one.line.split("{")[0]), F.col("doc"), F.lit(" ("), F.col("key"), F.lit(")"))
    return links.composed_field(regions, ["doc"], "nations", nation, line, one.separator)


def compositions_nested(spark, sf_dir):
    """Regions made of nations, which are made of suppliers: texts of texts, in one plan."""
    title = Field("title", "str", "Title")
    one = Model("One", "# ⸢rev•title⸥\n", (title,))
    some = lambda name, child, line, sep: Model(name, "# ⸢rev•title⸥\n\n⸢render•listing⸥\n", (title, Field("parts", "list", "Names of parts")), compositions={"listing": Composition("parts", line, sep, child)})
    models = Registry(some("Top", "Middle", "- {title}: {listing}", "\n"), some("Middle", "One", "{title}", "; "), one)
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    docs = lambda rows, doc, fields: rows.select(F.lit("local").alias("store"), doc.alias("doc"), F.concat(F.lit("docs/"), doc, F.lit(".md")).alias("path"), F.struct(*fields).alias("payload"))
    at = lambda prefix, key: F.concat(F.lit(prefix), F.col(key))
    names = lambda column: F.concat(F.array(F.lit("nowhere")), F.array_sort(column))
    of_nation = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(names(F.collect_list("s_name")).alias("parts"))
    of_region = nation.groupBy("n_regionkey").agg(names(F.collect_list(F.concat(F.lit("docs/n"), "n_nationkey", F.lit(".md")))).alias("parts"))
    payloads = {
        "One": docs(supplier, F.col("s_name"), [F.col("s_name").alias("title")]),
        "Middle": docs(nation.join(of_nation, "n_nationkey", "left"), at("n", "n_nationkey"), [F.col("n_name").alias("title"), "parts"]),
        "Top": docs(of_region, at("r", "n_regionkey"), [at("Region ", "n_regionkey").alias("title"), "parts"]),
    }
    return compositions.render_compositions(models, payloads)["Top"].select("doc", "text")


def hash_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("payload_json", F.concat(F.lit('{"n":'), F.col("n_chars"), F.lit("}")))
    return integrity.document_hashes(docs).select("doc_id", "hash_c", "hash_d")


def dup_docs(spark, sf_dir):
    return integrity.equal_texts(read(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("first", "first_doc")


def _mutated(spark, sf_dir):
    docs = part_docs(spark, sf_dir).withColumn("key", F.regexp_extract("doc", r"\d+", 0).cast("long"))
    tracked = changes.prepared(docs.select("store", "doc", "path", "text"), PART)
    text = F.when(F.col("key") % 10 == 2, F.replace("text", F.lit("\n\n"), F.lit("\n\n\n"))).when(F.col("key") % 10 == 3, F.replace("text", F.lit("Brand: "), F.lit("Brand: New "))).otherwise(F.col("text"))
    found = changes.prepared(docs.where("key % 10 <> 1").select("store", "doc", "path", text.alias("text")), PART)
    return integrity.diagnose(tracked, found)


def diagnose(spark, sf_dir):
    return _mutated(spark, sf_dir).select("doc", "note")


def diagnose_rollup(spark, sf_dir):
    return integrity.diagnosis_rollup(_mutated(spark, sf_dir)).drop("store")


def diagnose_benign(spark, sf_dir):
    """Changes that leave all payloads as they were: every model stays valid."""
    docs = part_docs(spark, sf_dir).select("store", "doc", "path", "text")
    tracked = changes.prepared(docs, PART)
    return integrity.diagnosis_rollup(integrity.diagnose(tracked, changes.prepared(docs.withColumn("text", F.replace("text", F.lit("\n\n"), F.lit("\n\n\n"))), PART))).drop("store")


def store_check(spark, sf_dir):
    """Stores whose documents are unchanged; in one a model's stored hash is wrong, in another the root's."""
    docs = changes.prepared(part_docs(spark, sf_dir).select("store", "doc", "path", "text"), PART)
    tracked = library.union([docs.withColumn("store", F.lit(s)) for s in ("right", "wrong model", "wrong root")])
    models = integrity.model_hashes(tracked)
    models = models.withColumn("hash_b", F.when(F.col("store") == "wrong model", "x").otherwise(F.col("hash_b")))
    stores = integrity.store_hashes(models).withColumn("hash_a", F.when(F.col("store") == "wrong root", "x").otherwise(F.col("hash_a")))
    by_model = integrity.diagnose_models(integrity.diagnose(tracked, tracked), tracked, models)
    return integrity.diagnose_store(by_model, models, stores)


def _with_catalog(spark: SparkSession, work: Callable[[Catalog], DataFrame]) -> DataFrame:
    """What ``work`` reads from a catalog of its own in the shared folder, which is deleted then."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    catalog = Catalog(spark, f"{spark.sparkContext.getCheckpointDir()}/catalog-{uuid.uuid4().hex}")
    catalog.init()
    try:
        return work(catalog).checkpoint()
    finally:
        catalog.drop()


def _tracked_parts(spark: SparkSession, sf_dir: str, catalog: Catalog) -> changes.Changes:
    """Parts of both models, tracked."""
    c = changes.Changes(catalog, REGISTRY)
    for name in (PART.name, SIZED.name):
        c.track(part_docs(spark, sf_dir).where(F.col("model") == name).select("store", "doc", "path", "text"), name)
    return c


PART_1 = [("local", "part-1")]


def catalog_changes(spark, sf_dir):
    """All parts tracked in a catalog, one edited, those of brand 11 updated, sold ones in large lots untracked."""

    def work(catalog: Catalog) -> DataFrame:
        c = changes.Changes(catalog, REGISTRY)
        docs = part_docs(spark, sf_dir).withColumn("model", F.lit("Part"))
        c.track(docs.select("store", "doc", "path", "text"), "Part")
        c.edit(spark.createDataFrame(PART_1, "store string, doc string"), "Part", "update", "p_type", "EDITED")
        part = read(spark, sf_dir, "part").where("p_brand = 'Brand#11'")
        payload = F.struct("p_name", F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.lit("UPDATED").alias("p_type"), F.col("p_size").cast("long").alias("p_size"))
        c.update(part.select(F.lit("local").alias("store"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("doc"), payload.alias("payload")), "Part")
        sold = read(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.concat(F.lit("part-"), F.col("l_partkey")).alias("doc")).distinct()
        c.untrack(sold.withColumn("store", F.lit("local")).withColumn("model", F.lit("Part")))
        kept, models = catalog.read("documents"), catalog.read("models")
        by_model = integrity.diagnose_models(integrity.diagnose(kept, kept), kept, models)
        right = integrity.diagnose_store(by_model, models, catalog.read("stores").select(F.col("name").alias("store"), "hash_a")).select("store", "valid")
        return kept.join(F.broadcast(right), "store").select("doc", F.try_variant_get(F.try_parse_json("payload_json"), "$.p_type", "string").alias("p_type"), "valid")  # one row per store

    return _with_catalog(spark, work)


def catalog_buckets(spark, sf_dir):
    """Which buckets of the tracked parts an edit of one of them writes anew, and what lies in each."""

    def work(catalog: Catalog) -> DataFrame:
        c = _tracked_parts(spark, sf_dir, catalog)
        files = lambda: catalog.read("documents").select(bucket_of(1).alias("bucket"), F.regexp_extract("_metadata.file_path", "slot=([^/]*)", 1).alias("slot"))
        counts = lambda out: files().groupBy("bucket").agg(F.first("slot").alias(out), F.count("*").alias("docs"))
        before = counts("before").drop("docs").checkpoint()
        name = read(spark, sf_dir, "part").where("p_partkey = 1").select(F.when(F.col("p_size") >= 25, SIZED.name).otherwise(PART.name)).first()[0]
        c.edit(spark.createDataFrame(PART_1, "store string, doc string"), name, "update", "p_type", "EDITED")
        return counts("after").join(before, "bucket").select("bucket", "docs", (F.col("after") != F.col("before")).alias("written"))

    return _with_catalog(spark, work)


def stored_hash_tree(spark, sf_dir):
    """hash_b of the models and hash_a of a catalog after tracking, an edit and an untracking, each of which folded its buckets only."""

    def work(catalog: Catalog) -> DataFrame:
        c = _tracked_parts(spark, sf_dir, catalog)
        sold = read(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.concat(F.lit("part-"), F.col("l_partkey")).alias("doc")).distinct()
        for name in (PART.name, SIZED.name):
            c.untrack(sold.withColumn("store", F.lit("local")).withColumn("model", F.lit(name)))
        again = part_docs(spark, sf_dir).where("doc = 'part-1'").withColumn("text", F.concat("text", F.lit("\n")))
        c.refresh(again)
        root = catalog.read("stores").select("hash_a")
        return catalog.read("models").select("model", "hash_b").join(F.broadcast(root))  # one row

    return _with_catalog(spark, work)


def catalog_sections(spark, sf_dir):
    """Sections that a catalog keeps, after an edit and an untracking."""

    def work(catalog: Catalog) -> DataFrame:
        c = _tracked_parts(spark, sf_dir, catalog)
        small = read(spark, sf_dir, "part").where("p_size < 25")
        payload = F.struct(F.lit("Renamed").alias("p_name"), F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", "p_type", F.col("p_size").cast("long").alias("p_size"))
        c.update(small.where("p_brand = 'Brand#11'").select(F.lit("local").alias("store"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("doc"), payload.alias("payload")), PART.name)
        c.untrack(part_docs(spark, sf_dir).where(F.col("model") == SIZED.name))
        return catalog.read("sections").select("doc", F.col("path").alias("section_path"), "line_start", "body_end")

    return _with_catalog(spark, work)


def _indexed(spark, sf_dir, *search_for, **options):
    def work(catalog: Catalog) -> DataFrame:
        c = _tracked_parts(spark, sf_dir, catalog)
        c.index(search.search_records(library.Library(REGISTRY, catalog.read("documents")), kinds=("doc", "section"), persisted=catalog.read("sections")))
        return trigrams.indexed_search(*catalog.indexed(), *search_for, **options).select("kind", "doc", "name")

    return _with_catalog(spark, work)


def indexed_term(spark, sf_dir):
    """``search_term`` by trigrams kept in a catalog."""
    return _indexed(spark, sf_dir, "part-11", "physical")


def indexed_regex(spark, sf_dir):
    return _indexed(spark, sf_dir, r"part-\d*7$", regex=True)


def folder_files(spark, sf_dir):
    """Parts written as files, a folder for each model, and those of one model and some names read again."""
    folders.register(spark)

    def work(catalog: Catalog) -> DataFrame:
        place = f"{catalog.root}/files"
        part_docs(spark, sf_dir).select("model", "doc", "text").write.format("documents").mode("append").save(place)
        found = spark.read.format("documents").load(place).where((F.col("model") == PART.name) & F.col("doc").startswith("part-1"))
        return extract.extract_docs(found, PART).select("doc", "payload.p_size", "error")

    return _with_catalog(spark, work)


def hash_cascade(spark, sf_dir):
    """Whether equal stores have equal root hashes, and changed ones others."""
    docs = changes.prepared(part_docs(spark, sf_dir).select("store", "doc", "path", "text"), PART)
    twice = docs.withColumn("store", F.lit("again")).unionByName(docs).unionByName(docs.withColumn("store", F.lit("changed")).withColumn("hash_c", F.when(F.col("doc") == "part-1", "x").otherwise(F.col("hash_c"))))
    roots = integrity.store_hashes(integrity.model_hashes(twice))
    return roots.groupBy("hash_a").agg(F.count("*").alias("stores"), F.array_join(F.array_sort(F.collect_list("store")), ",").alias("names")).drop("hash_a")


def field_clean(spark, sf_dir):
    w = read(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("t"))
    return w.select("p_partkey", F.array_join(fields.clean_list(F.concat("t", F.array(F.lit("")), "t")), "|").alias("cleaned"))


def field_edit(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", fields.edit_field(F.col("props"), "create", "a.b", 1).alias("e"))
    return e.select("event_id", F.try_variant_get(F.try_parse_json("e.payload_json"), "$.a.b", "long").alias("b"), F.try_variant_get(F.try_parse_json("e.payload_json"), "$.k", "long").alias("k"))


def rebuild_report(spark, sf_dir):
    docs = part_docs(spark, sf_dir)
    return integrity.rebuild_report(docs.select("store", "model", "doc"), sections.with_headings(docs.where(~F.col("doc").endswith("7"))))


def decompose_sources(spark, sf_dir):
    docs = hierarchy_docs(spark, sf_dir)
    return ingest.decompose(docs, ["doc"]).select("doc", "part", "title", F.length("content").cast("long").alias("n"), "node_type", ingest.summary(F.col("content")).alias("summary"))


def slugs(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", slug(F.col("p_name")).alias("slug"), file_slug(F.col("p_type")).alias("file_slug"))


def ignore_rules(spark, sf_dir):
    rules = [("part-1*", "ones"), ("docs/", "all"), ("**/part-2.md", "two"), ("docs/part-3?.md", "thirties")]
    docs = part_docs(spark, sf_dir)
    return docs.select("doc", ingest.ignored(F.col("path"), rules[2:]).alias("by_path"), ingest.ignored(F.col("doc"), rules[:1]).alias("by_name"))


def drafts_index(spark, sf_dir):
    d = read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey"), F.lit("/"), F.lower("n_name"), F.lit(".md")).alias("path"), F.col("n_name").alias("title"))
    return ingest.drafts_index(d)


def manifest_upsert(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    old = c.where("c_acctbal >= 0").select(F.col("c_name").alias("path"), F.col("c_mktsegment").alias("content_hash"), F.lit("done").alias("status"), F.lit("t0").alias("created"))
    new = c.where("c_acctbal < 2000").select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(F.col("c_mktsegment")).alias("content_hash"), F.lit("t1").alias("created"))
    return ingest.upsert_manifest(old, new)


def store_union(spark, sf_dir):
    lib = global_library(spark, sf_dir)
    return lib.payloads().groupBy("store", "model").agg(F.count("*").alias("n"))


def store_tree(spark, sf_dir):
    return tree.tree_of(parts(spark, sf_dir)).select("store", F.to_json("models").alias("models"))


def doc_tree(spark, sf_dir):
    return tree.doc_tree(parts(spark, sf_dir)).select("doc", F.array_join("sections", "|").alias("sections"), F.array_join("fields", "|").alias("fields"))


def graph_edges(spark, sf_dir):
    return tree.graph_edges(parts(spark, sf_dir))


def links_relative(spark, sf_dir):
    """Links by paths with ``.`` and ``..``, from folders two deep, and from the working directory."""
    n = read(spark, sf_dir, "nation")
    place = F.concat(F.lit("file:/w/r"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.lit(".md"))
    text = F.concat(F.lit("[[../r0/./n0.md]] [[r"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.lit(".md]] [[../../up.md]] [[sub/../n"), F.col("n_nationkey"), F.lit(".md]]"))
    docs = n.select(F.col("n_name").alias("doc"), place.alias("path"), text.alias("text"))
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs, "file:/w")
    return found.select("doc", "ord", "resolved", F.coalesce("target_path", F.lit("")).alias("target_path"))


def compose_chain(spark, sf_dir):
    """Each nation includes the next one, the last one includes the first: a chain of all that ends in a cycle."""
    n = read(spark, sf_dir, "nation")
    nth = F.concat(F.lit("n"), F.col("n_nationkey"))
    after = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_nationkey").alias("next"))
    rows = n.join(after, "n_nationkey", "left").withColumn("next", F.coalesce("next", F.lit(0)))
    docs = rows.select(nth.alias("doc"), F.concat(nth, F.lit(".md")).alias("path"), F.concat(F.col("n_nationkey"), F.lit(" ![[n"), F.col("next"), F.lit("]]")).alias("text"))
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs)
    lists = links.transclusion_lists(found).select("path", F.size("transclusions").cast("long").alias("n"))
    return links.compose(docs, found).join(lists, "path")


def _composed(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("path", F.concat("doc", F.lit(".md")))
    return links.compose(docs, links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs))


def compose_dense(spark, sf_dir):
    """Each nation includes all other ones: a dense cycle, in which each is gone into once."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    every = n.agg(F.array_sort(F.collect_list("k")).alias("all"))  # one row of all nations
    others = F.array_join(F.transform(F.filter("all", lambda x: x != F.col("k")), lambda x: F.concat(F.lit(" ![[n"), x, F.lit("]]"))), "")
    return _composed(n.join(F.broadcast(every)).select(F.concat(F.lit("n"), "k").alias("doc"), F.concat("k", F.lit(":"), others, F.lit("\n")).alias("text")))


def compose_diamond(spark, sf_dir):
    """Regions include their nations, and these the world, twice; it is gone into where it is met first. Files end with line feeds."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    of = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda x: F.concat(F.lit(" ![[n"), x, F.lit("]]"))), "").alias("n"))
    docs = region.join(of, "r_regionkey").select(F.concat(F.lit("r"), "r_regionkey").alias("doc"), F.concat(F.lit("R"), "r_regionkey", "n", F.lit("\n")).alias("text"))
    docs = docs.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("doc"), F.concat(F.lit("N"), "n_nationkey", F.lit(" ![[w]] ![[w]]\n\n")).alias("text")))
    world = region.where("r_regionkey = 0").select(F.explode(F.array(F.struct(F.lit("w").alias("doc"), F.lit("W ![[leaf]]\n").alias("text")), F.struct(F.lit("leaf").alias("doc"), F.lit("L \t\n").alias("text")))).alias("d")).select("d.*")
    return _composed(docs.unionByName(world))


def tag_postings(spark, sf_dir):
    return semantics.tag_postings(_tagged(spark, sf_dir).withColumn("tag", F.substring_index("tag", ".", 3))).withColumn("position", F.col("position").cast("long"))


def extract_template(spark, sf_dir):
    got = extract.extract_with_template(part_docs(spark, sf_dir), PART.template)
    p = F.try_parse_json("payload_json")
    return got.select("doc", *[F.try_variant_get(p, f"$.{n}", "string").alias(n) for n in ("p_name", "p_size")], F.col("error").isNull().alias("fine"))


def render_template(spark, sf_dir):
    rows = read(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_name").alias("title"), F.array("r_regionkey", F.lit(7)).alias("items"))).alias("payload_json"))
    return extract.render_with_template(rows, "# ⸢rev•title⸥\n\n- ⸢rev,list•items⸥").select("text")


def flatten_deep(spark, sf_dir):
    """Payloads of mappings 14 deep."""
    inner = F.concat(F.lit('{"price":'), F.floor("o_totalprice").cast("string"), F.lit("}"))
    for i in range(13):
        inner = F.concat(F.lit(f'{{"k{i}":'), inner, F.lit("}"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", inner.alias("payload_json"))
    return fields.flatten_payloads(rows, ["o_orderkey"]).select("o_orderkey", "field_path", F.col("value_json").cast("long").alias("value"))


def document_parts(spark, sf_dir):
    """How many rows each part of the documents' representation has."""
    found = ir.document_parts(parts(spark, sf_dir))
    return library.union([df.groupBy().agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in found.items()])


def persisted_sections(spark, sf_dir):
    """Section records from stored sections, which are those that parsing gives."""
    lib = parts(spark, sf_dir)
    stored = sections.sections(lib.documents, ["store", "model", "doc"])
    return search.search(search.search_records(lib, kinds=("section",), persisted=stored), "size", "physical").select("doc", "section_path")


def pages_headings(spark, sf_dir):
    found = sections.html_headings(read(spark, sf_dir, "pages"), ["page_id"])
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.max("heading").alias("last_heading"))


def blocks_count(spark, sf_dir):
    b = with_blocks(part_docs(spark, sf_dir)).select(F.explode("blocks").alias("b")).select("b.*")
    return b.groupBy("type", "tag").agg(F.count("*").alias("n"), F.sum("line_start").alias("lines"))


def events_tumbling(spark, sf_dir):
    t = tumbling_counts(read(spark, sf_dir, "events"))
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def last_purchase(spark, sf_dir):
    """Each event with its user's last purchase so far."""
    events = read(spark, sf_dir, "events")
    return sections.owner_before(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_id").select("user_id", "event_id", "owner")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "part_roundtrip": part_roundtrip,
    "where_ge": where_query("p_size >= 25"),
    "where_le": where_query("p_size <= 10"),
    "where_eq": where_query("p_size = 10"),
    "where_ne": where_query('p_brand != "Brand#11"'),
    "where_contains": where_query('"A" in p_type'),
    "where_regex": where_query('p_brand ~ "#1[1-3]$"'),
    "where_has": where_query("has(p_name)"),
    "where_doc": where_query('doc ~ "-1.$"'),
    "where_mistyped": where_query('p_size = "25" or p_size != "25" and p_size = 7'),
    "where_joined": where_query('not (p_size >= 10 or has(nothing)) and "A" in p_type or p_size = 44'),
    "where_model": where_model,
    **{f.__name__: f for f in (
        select_projection, scope_inheritance, glob_docs_fields, get_value, ls_models_fields, list_extract, table_extract, yaml_extract, payload_flatten, fields_query,
        events_props_flatten, section_paths, about_terms, section_lines, field_ownership, section_fields, search_kinds, search_term, search_semantic, search_regex, search_fuzzy,
        search_where_fields, search_where_sections, tag_index, tag_children, tag_edges, tag_parents, tag_glob, tag_intervals, tags_below, global_tags, local_tags, bridge_tags, links_resolve, recover_depth,
        compose_docs, composition_refs, compositions_nested, hash_text, dup_docs, diagnose, diagnose_rollup, diagnose_benign, store_check, catalog_changes, catalog_buckets, stored_hash_tree, catalog_sections, indexed_term, indexed_regex, folder_files, hash_cascade, field_clean, field_edit, rebuild_report,
        decompose_sources, slugs, ignore_rules, drafts_index, manifest_upsert, store_union, store_tree, doc_tree, graph_edges, links_relative, compose_chain, compose_dense, compose_diamond, tag_postings, extract_template, render_template, flatten_deep, document_parts, persisted_sections, pages_headings, blocks_count, events_tumbling, last_purchase,
    )},
    "deep_get": deep_get_query,
}

_MODEL = "CASE WHEN p_size >= 25 THEN 'SizedPart' ELSE 'Part' END"
_DOC = "'part-' || p_partkey"
_ADDRESS = f"'st.{{' || {_MODEL} || '}}.' || {_DOC}"
_PART = f"SELECT {_ADDRESS} AS address, p_size::BIGINT AS p_size, p_brand FROM part"
_TAGS = "SELECT 'part-' || p_partkey AS doc, 'type.' || replace(lower(p_type), ' ', '.') || '.' || replace(lower(p_brand), '#', '-') AS tag FROM part"

SQL: dict[str, str] = {
    "part_roundtrip": "SELECT p_name, p_partkey, p_brand, p_type, p_size::BIGINT AS p_size FROM part",
    "where_ge": f"{_PART} WHERE p_size >= 25",
    "where_le": f"{_PART} WHERE p_size <= 10",
    "where_eq": f"{_PART} WHERE p_size = 10",
    "where_ne": f"{_PART} WHERE p_brand <> 'Brand#11'",
    "where_contains": f"{_PART} WHERE contains(p_type, 'A')",
    "where_regex": f"{_PART} WHERE regexp_matches(p_brand, '#1[1-3]$')",
    "where_has": f"{_PART} WHERE p_name IS NOT NULL AND p_name <> ''",
    "where_doc": f"{_PART} WHERE regexp_matches({_DOC}, '-1.$')",
    "where_mistyped": f"{_PART} WHERE p_size = 7",
    "where_joined": f"{_PART} WHERE (p_size < 10 AND contains(p_type, 'A')) OR p_size = 44",
    "where_model": f"SELECT {_ADDRESS} AS address FROM part WHERE p_size >= 25",
    "select_projection": f"SELECT {_DOC} AS doc, p_size::BIGINT AS p_size, NULL::VARCHAR AS nothing FROM part WHERE p_size >= 25",
    "scope_inheritance": """
        SELECT scope, n::BIGINT AS n FROM (
          SELECT 'st.{Part}' AS scope, count(*) FILTER (p_size < 25) AS n FROM part UNION ALL SELECT 'st.{Part+}', count(*) FROM part
          UNION ALL SELECT 'st.{SizedPart}', count(*) FILTER (p_size >= 25) FROM part UNION ALL SELECT 'st.{*}', count(*) FROM part UNION ALL SELECT 'st.{Nothing}', 0)""",
    "glob_docs_fields": f"SELECT {_ADDRESS} || '.' || f AS address FROM part, (VALUES ('p_brand'), ('p_size')) t(f) WHERE p_partkey::VARCHAR LIKE '1%'",
    "get_value": "SELECT p_brand AS value FROM part WHERE p_partkey = 7",
    "ls_models_fields": """
        SELECT unnest(['Part', 'SizedPart', 'p_name: Name of the part', 'p_partkey: Key of the part', 'p_brand: Brand of the part', 'p_type: Type of the part', 'p_size: Size of the part']) AS name""",
    "list_extract": """
        SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS nations, 'See [[' || r_name || ']] for more.' || chr(10) || chr(10) || 'Second paragraph.' AS notes
        FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""",
    "table_extract": """
        SELECT o_orderkey, o_orderstatus AS status, l_linenumber::BIGINT AS line, l_partkey AS part, trunc(l_quantity)::BIGINT AS quantity
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "yaml_extract": "SELECT c_name, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, floor(c_acctbal)::BIGINT AS whole, c_acctbal < 0 AS negative FROM customer",
    "payload_flatten": """
        SELECT 'customer-' || c_custkey AS doc, unnest(['c_name', 'nation', 'meta.segment', 'meta.balance.whole', 'meta.balance.negative']) AS field_path,
               unnest([c_name, c_nationkey::VARCHAR, c_mktsegment, floor(c_acctbal)::BIGINT::VARCHAR, (c_acctbal < 0)::VARCHAR]) AS value FROM customer""",
    "fields_query": "SELECT 'customer-' || c_custkey AS doc, 'meta.balance.whole' AS field_path, floor(c_acctbal)::BIGINT AS value FROM customer",
    "events_props_flatten": "SELECT event_id, unnest(json_keys(props)) AS field_path, (props->>unnest(json_keys(props)))::BIGINT AS value FROM events",
    "deep_get": "SELECT 'region-' || r_regionkey AS doc, list(n_name ORDER BY n_name)[2] AS second FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey",
    "field_ownership": f"""
        SELECT {_DOC} AS doc, f AS field, l::INT AS line, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || o AS owner
        FROM part, (VALUES ('p_name', 1, ''), ('p_partkey', 3, ''), ('p_brand', 5, ''), ('p_type', 7, ''), ('p_size', 11, '/size')) t(f, l, o)""",
    "section_fields": f"SELECT {_DOC} AS doc, 'p_size' AS field_path, p_size::BIGINT AS value FROM part",
    "section_lines": f"""
        SELECT {_DOC} AS doc, unnest([p_name, 'Size']) AS title, unnest([1, 9]::INT[]) AS line_start, unnest([2, 10]::INT[]) AS line_end, unnest([11, 11]::INT[]) AS body_end FROM part""",
    "search_kinds": """
        SELECT kind, n::BIGINT AS n FROM (
          SELECT 'store' AS kind, 2 AS n UNION ALL SELECT 'model', count(DISTINCT p_size >= 25) FROM part UNION ALL SELECT 'doc', count(*) FROM part
          UNION ALL SELECT 'section', 2 * count(*) FROM part UNION ALL SELECT 'field', 5 * count(*) FROM part)""",
    "search_term": f"""
        SELECT unnest(['doc', 'section', 'section']) AS kind, {_DOC} AS doc,
               unnest([{_DOC}, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 'size']) AS name
        FROM part WHERE p_partkey::VARCHAR LIKE '11%'""",
    "search_semantic": f"SELECT 'doc' AS kind, {_DOC} AS name FROM part WHERE p_size >= 25 UNION ALL SELECT 'model', 'SizedPart'",
    "search_regex": f"SELECT {_DOC} AS name FROM part WHERE p_partkey % 10 = 9",
    "search_where_fields": f"SELECT {_DOC} AS doc, p_size::BIGINT AS value, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '/size' AS owning_section FROM part",
    "search_where_sections": f"""
        WITH s AS (SELECT {_DOC} AS doc, p_name, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part)
        SELECT doc, slug || '/size' AS section_path FROM s UNION ALL SELECT doc, slug FROM s WHERE p_name LIKE 'S%'""",
    "hash_text": "SELECT doc_id, sha256(text) AS hash_c, sha256('{\"n\":' || n_chars || '}') AS hash_d FROM documents",
    "dup_docs": "SELECT sha256(text) AS hash_c, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1",
    "diagnose": f"SELECT {_DOC} AS doc, CASE p_partkey % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'benign_mutation' WHEN 3 THEN 'data_mutation' ELSE 'ok' END AS note FROM part",
    "diagnose_rollup": """
        SELECT 'Part' AS model, count(*)::BIGINT AS docs, (count(*) FILTER (p_partkey % 10 NOT IN (1, 2, 3)))::BIGINT AS ok, (count(*) FILTER (p_partkey % 10 = 2))::BIGINT AS benign,
               (count(*) FILTER (p_partkey % 10 = 3))::BIGINT AS changed, (count(*) FILTER (p_partkey % 10 = 1))::BIGINT AS missing, false AS valid FROM part""",
    "diagnose_benign": "SELECT 'Part' AS model, count(*)::BIGINT AS docs, 0::BIGINT AS ok, count(*)::BIGINT AS benign, 0::BIGINT AS changed, 0::BIGINT AS missing, true AS valid FROM part",
    "store_check": """
        SELECT unnest(['right', 'wrong model', 'wrong root']) AS store, 1::BIGINT AS models, count(*)::BIGINT AS docs, unnest([true, true, false]) AS hash_a_ok, unnest([true, false, false]) AS valid FROM part""",
    "catalog_changes": f"""
        SELECT {_DOC} AS doc, CASE WHEN p_brand = 'Brand#11' THEN 'UPDATED' WHEN p_partkey = 1 THEN 'EDITED' ELSE p_type END AS p_type, true AS valid
        FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""",
    "catalog_buckets": f"""
        WITH d AS (SELECT substr(sha256({_MODEL} || chr(0) || {_DOC}), 1, 1) AS bucket, p_partkey FROM part)
        SELECT bucket, count(*)::BIGINT AS docs, bool_or(p_partkey = 1) AS written FROM d GROUP BY bucket""",
    "stored_hash_tree": f"""
        WITH d AS (SELECT {_MODEL} AS model, substr(sha256({_MODEL} || chr(0) || {_DOC}), 1, 3) AS p3, 'docs/' || {_DOC} || '.md' AS path,
            sha256('# ' || p_name || repeat(chr(10), 2) || 'Key: ' || p_partkey || repeat(chr(10), 2) || 'Brand: ' || p_brand || repeat(chr(10), 2) || 'Type: ' || p_type || repeat(chr(10), 2) || '## Size' || repeat(chr(10), 2) || 'Value: ' || p_size || CASE WHEN p_partkey = 1 THEN chr(10) ELSE '' END) AS c,
            sha256('{{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_partkey":"' || p_partkey || '","p_size":"' || p_size || '","p_type":"' || p_type || '"}}') AS d
          FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)),
        f3 AS (SELECT model, p3 AS p, sha256('[' || string_agg('{{"path":"' || path || '","hash_c":"' || c || '","hash_d":"' || d || '"}}', ',' ORDER BY path) || ']') AS f FROM d GROUP BY ALL),
        f2 AS (SELECT model, p[:2] AS p, sha256('[' || string_agg('{{"prefix":"' || p || '","fold":"' || f || '"}}', ',' ORDER BY p) || ']') AS f FROM f3 GROUP BY model, p[:2]),
        f1 AS (SELECT model, p[:1] AS p, sha256('[' || string_agg('{{"prefix":"' || p || '","fold":"' || f || '"}}', ',' ORDER BY p) || ']') AS f FROM f2 GROUP BY model, p[:1]),
        f0 AS (SELECT model, sha256('[' || string_agg('{{"prefix":"' || p || '","fold":"' || f || '"}}', ',' ORDER BY p) || ']') AS hash_b FROM f1 GROUP BY model)
        SELECT model, hash_b, sha256('[' || (SELECT string_agg('{{"name":"' || model || '","hash_b":"' || hash_b || '"}}', ',' ORDER BY model) FROM f0) || ']') AS hash_a FROM f0""",
    "catalog_sections": f"""
        WITH d AS (SELECT {_DOC} AS doc, CASE WHEN p_brand = 'Brand#11' THEN 'renamed' ELSE regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS slug FROM part WHERE p_size < 25)
        SELECT doc, slug AS section_path, 1::INT AS line_start, 11::INT AS body_end FROM d UNION ALL SELECT doc, slug || '/size', 9, 11 FROM d""",
    "indexed_term": f"""
        WITH s AS (SELECT {_DOC} AS doc, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part WHERE contains({_DOC}, 'part-11'))
        SELECT unnest(['doc', 'section', 'section']) AS kind, doc, unnest([doc, slug, 'size']) AS name FROM s""",
    "indexed_regex": f"SELECT 'doc' AS kind, {_DOC} AS doc, {_DOC} AS name FROM part WHERE p_partkey % 10 = 7",
    "folder_files": f"SELECT {_DOC} AS doc, p_size::BIGINT AS p_size, NULL::VARCHAR AS error FROM part WHERE p_size < 25 AND starts_with(p_partkey::VARCHAR, '1')",
    "tag_intervals": f"""
        WITH n AS (SELECT DISTINCT array_to_string(string_split(tag, '.')[1 : i], '.') AS tag FROM ({_TAGS}), unnest(range(1, len(string_split(tag, '.')) + 1)) AS u(i)),
        p AS (SELECT tag, row_number() OVER (ORDER BY replace(tag, '.', chr(1))) - 1 AS pre FROM n)
        SELECT tag, pre::BIGINT AS pre, (pre + (SELECT count(*) FROM n m WHERE starts_with(m.tag, p.tag || '.')))::BIGINT AS last, len(string_split(tag, '.'))::INT AS depth FROM p""",
    "tags_below": f"""
        WITH n AS (SELECT DISTINCT array_to_string(string_split(tag, '.')[1 : i], '.') AS tag FROM ({_TAGS}), unnest(range(1, len(string_split(tag, '.')) + 1)) AS u(i))
        SELECT tag, EXISTS (SELECT 1 FROM n m WHERE starts_with(m.tag, 'type.' || split_part(n.tag, '.', -1) || '.')) AS child FROM n WHERE regexp_matches(tag, '^type\\.')""",
    "compositions_nested": """
        WITH n AS (SELECT n_nationkey, n_regionkey, n_name, coalesce(string_agg(s_name, '; ' ORDER BY s_name), '') AS listing FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
        SELECT 'r' || n_regionkey AS doc, '# Region ' || n_regionkey || repeat(chr(10), 2) || rtrim(string_agg('- ' || n_name || ': ' || listing, chr(10) ORDER BY 'docs/n' || n_nationkey || '.md')) AS text FROM n GROUP BY n_regionkey""",
    "hash_cascade": "SELECT 2::BIGINT AS stores, 'again,local' AS names UNION ALL SELECT 1, 'changed'",
    "field_clean": """
        SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS cleaned FROM (
          SELECT p_partkey, x, min(i) AS i FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS x, generate_subscripts(string_split(p_type, ' '), 1) AS i FROM part) GROUP BY ALL)
        WHERE x <> '' GROUP BY p_partkey""",
    "field_edit": "SELECT event_id, 1::BIGINT AS b, (props->>'k')::BIGINT AS k FROM events",
    "rebuild_report": "SELECT count(*)::BIGINT AS docs, (count(*) FILTER (p_partkey % 10 <> 7))::BIGINT AS processed, (count(*) FILTER (p_partkey % 10 = 7))::BIGINT AS missing, 0::BIGINT AS empty FROM part",
    "slugs": """
        SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
               regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS file_slug FROM part""",
    "ignore_rules": f"""
        SELECT {_DOC} AS doc, CASE WHEN p_partkey BETWEEN 30 AND 39 THEN 'thirties' WHEN p_partkey = 2 THEN 'two' END AS by_path,
               CASE WHEN p_partkey::VARCHAR LIKE '1%' THEN 'ones' END AS by_name FROM part""",
    "drafts_index": """
        SELECT 'r' || n_regionkey AS folder, string_agg('- [' || n_name || '](r' || n_regionkey || '/' || lower(n_name) || '.md)', chr(10) ORDER BY n_name) AS index
        FROM nation GROUP BY n_regionkey""",
    "manifest_upsert": """
        WITH o AS (SELECT c_name AS path, c_mktsegment AS h FROM customer WHERE c_acctbal >= 0),
        n AS (SELECT c_name AS path, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS h FROM customer WHERE c_acctbal < 2000)
        SELECT coalesce(o.path, n.path) AS path, coalesce(n.h, o.h) AS content_hash, CASE WHEN o.path IS NULL THEN 'new' ELSE 'done' END AS status,
               CASE WHEN n.path IS NOT NULL AND n.h IS DISTINCT FROM o.h THEN 't1' ELSE 't0' END AS created
        FROM o FULL JOIN n ON o.path = n.path""",
    "store_union": f"SELECT CASE WHEN p_partkey % 2 = 0 THEN 'local' ELSE 'child' END AS store, {_MODEL} AS model, count(*)::BIGINT AS n FROM part GROUP BY ALL",
    "store_tree": f"""
        SELECT 'local' AS store, '[' || string_agg('{{"model":"' || model || '","docs":["' || docs || '"],"fields":[' || fields || ']}}', ',' ORDER BY model) || ']' AS models
        FROM (SELECT {_MODEL} AS model, string_agg({_DOC}, '","' ORDER BY {_DOC}) AS docs FROM part GROUP BY 1),
             (SELECT string_agg('{{"name":"' || n || '","kind":"' || k || '","description":"' || d || '"}}', ',' ORDER BY i) AS fields
              FROM (VALUES (1, 'p_name', 'str', 'Name of the part'), (2, 'p_partkey', 'int', 'Key of the part'), (3, 'p_brand', 'str', 'Brand of the part'), (4, 'p_type', 'str', 'Type of the part'), (5, 'p_size', 'int', 'Size of the part')) t(i, n, k, d))""",
    "doc_tree": f"""
        SELECT {_DOC} AS doc, slug || '|' || slug || '/size' AS sections, 'p_brand|p_name|p_partkey|p_size|p_type' AS fields
        FROM (SELECT *, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part)""",
    "links_relative": """
        WITH l AS (SELECT n_name AS doc, n_regionkey AS r, n_nationkey AS n, unnest([0, 1, 2, 3]) AS ord FROM nation),
        t AS (SELECT doc, ord, CASE ord WHEN 0 THEN 'file:/w/r0/n0.md' WHEN 2 THEN '' ELSE 'file:/w/r' || r || '/n' || n || '.md' END AS target_path FROM l)
        SELECT doc, ord::INT AS ord, target_path <> '' AS resolved, target_path FROM t""",
    "compose_chain": """
        SELECT 'n' || a.n_nationkey || '.md' AS path, count(*)::BIGINT AS n,
               string_agg(b.n_nationkey || ' ', '' ORDER BY (b.n_nationkey - a.n_nationkey + c) % c) || a.n_nationkey || ' ![[n' || ((a.n_nationkey + 1) % any_value(c)) || ']]' AS composed
        FROM nation a, nation b, (SELECT count(*) AS c FROM nation) GROUP BY a.n_nationkey""",
    "compose_dense": """
        WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation),
        raw AS (SELECT a.k, a.k || ':' || string_agg(' ![[n' || b.k || ']]', '' ORDER BY b.k) AS raw FROM n a JOIN n b ON a.k <> b.k GROUP BY a.k),
        seq AS (SELECT r.k AS r, v.k AS v, row_number() OVER (PARTITION BY r.k ORDER BY v.k <> r.k, v.k) - 1 AS i FROM n r, n v),
        -- in the i-th document of a root's walk all are met before, but for the next one
        made AS (
          SELECT r, i, NULL::BIGINT AS next, NULL::VARCHAR AS text FROM (SELECT r, max(i) + 1 AS i FROM seq GROUP BY r)
          UNION ALL
          SELECT m.r, m.i - 1, s.v, s.v || ':' || string_agg(' ' || CASE WHEN w.k = m.next THEN m.text ELSE w.raw END, '' ORDER BY w.k)
          FROM made m JOIN seq s ON s.r = m.r AND s.i = m.i - 1 JOIN raw w ON w.k <> s.v GROUP BY m.r, m.i, s.v)
        SELECT 'n' || r || '.md' AS path, text || chr(10) AS composed FROM made WHERE i = 0""",
    "compose_diamond": """
        WITH f AS (SELECT n_regionkey AS r, n_nationkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS first FROM nation)
        SELECT 'r' || r || '.md' AS path, 'R' || r || string_agg(' N' || k || CASE WHEN first THEN ' W L' ELSE ' W ![[leaf]]' END || ' W ![[leaf]]', '' ORDER BY k) || chr(10) AS composed FROM f GROUP BY r
        UNION ALL SELECT 'n' || n_nationkey || '.md', 'N' || n_nationkey || ' W L W ![[leaf]]' || repeat(chr(10), 2) FROM nation
        UNION ALL SELECT * FROM (VALUES ('w.md', 'W L' || chr(10)), ('leaf.md', 'L ' || chr(9) || chr(10)))""",
    "extract_template": f"SELECT {_DOC} AS doc, p_name, p_size::VARCHAR AS p_size, true AS fine FROM part",
    "render_template": "SELECT '# ' || r_name || chr(10) || chr(10) || '- ' || r_regionkey || chr(10) || '- 7' AS text FROM region",
    "flatten_deep": "SELECT o_orderkey, 'k12.k11.k10.k9.k8.k7.k6.k5.k4.k3.k2.k1.k0.price' AS field_path, floor(o_totalprice)::BIGINT AS value FROM orders",
    "graph_edges": f"""
        WITH s AS (SELECT {_DOC} AS source, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part)
        SELECT source, unnest([slug, slug || '/size', 'p_name', 'p_partkey', 'p_brand', 'p_type', 'p_size']) AS target,
               unnest(['has_section', 'has_section', 'has_field', 'has_field', 'has_field', 'has_field', 'has_field']) AS relation FROM s
        UNION ALL SELECT {_MODEL}, {_DOC}, 'has_doc' FROM part UNION ALL SELECT DISTINCT 'local', {_MODEL}, 'has_model' FROM part""",
    "document_parts": """
        SELECT unnest(['context', 'structure', 'nodes', 'surface', 'graph', 'context_index']) AS part, unnest([n, 2 * n, 7 * n, 6 * n, 7 * n, 2 * n])::BIGINT AS n FROM (SELECT count(*) AS n FROM part)""",
    "persisted_sections": f"SELECT {_DOC} AS doc, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '/size' AS section_path FROM part",
    "pages_headings": """
        SELECT page_id, len(h)::BIGINT AS n, list_max(h) AS last_heading
        FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1) AS h FROM pages) WHERE len(h) > 0""",
    "blocks_count": """
        SELECT type, tag, n::BIGINT AS n, lines::BIGINT AS lines FROM (
          SELECT 'heading' AS type, 'h1' AS tag, count(*) AS n, count(*) AS lines FROM part UNION ALL SELECT 'heading', 'h2', count(*), 9 * count(*) FROM part
          UNION ALL SELECT 'paragraph', 'p', 4 * count(*), (3 + 5 + 7 + 11) * count(*) FROM part)""",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "last_purchase": """
        SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM events""",
}

_TREE = """h AS (
  SELECT 'region-' || r_regionkey AS doc, r_name AS r, NULL AS n, NULL AS s FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
  UNION ALL SELECT 'region-' || n_regionkey, r_name, n_name, NULL FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT DISTINCT 'region-' || n_regionkey, r_name, n_name, c_mktsegment FROM nation JOIN region ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey),
cap AS (SELECT doc, array_to_string(list_transform(string_split(lower(r), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS r,
  array_to_string(list_transform(string_split(lower(n), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS n,
  'Segment ' || array_to_string(list_transform(string_split(lower(s), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS s FROM h),
t AS (SELECT *, regexp_replace(lower(r), '[^a-z0-9]+', '-', 'g') AS rs, regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g') AS ns, regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g') AS ss FROM cap)"""
_CHAIN = """docs AS (
  SELECT 'region-' || r_regionkey AS doc, [] AS l FROM region
  UNION ALL SELECT 'nation-' || n_nationkey, ['transclusion|region-' || n_regionkey, 'link|nowhere'] FROM nation
  UNION ALL SELECT 'customer-' || c_custkey, ['link|nation-' || c_nationkey, 'link|docs/nation-' || c_nationkey || '.md'] FROM customer),
links AS (SELECT doc, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS x FROM docs)"""

SQL |= {
    "section_paths": f"""WITH {_TREE}
        SELECT doc, concat_ws('/', rs, ns, ss) AS path, (1 + (n IS NOT NULL)::INT + (s IS NOT NULL)::INT)::INT AS level, concat_ws(' > ', r, n, s) AS breadcrumbs,
               CASE WHEN n IS NULL THEN '' WHEN s IS NULL THEN rs ELSE rs || '/' || ns END AS parent FROM t""",
    "about_terms": f"""WITH {_TREE}
        SELECT doc, concat_ws('/', rs, ns, ss) AS path, concat_ws('|', r, replace(rs, '-', ' '), n, replace(ns, '-', ' '), s, replace(ss, '-', ' '), 'geo.world', 'text') AS about FROM t WHERE s IS NOT NULL""",
    "decompose_sources": f"""WITH {_TREE},
        p AS (SELECT doc, r, n, s, string_agg(CASE WHEN s IS NOT NULL THEN '### ' || s || chr(10) || chr(10) || 'Text.' WHEN n IS NOT NULL THEN '## ' || n ELSE '# ' || r END, chr(10) || chr(10) ORDER BY s NULLS FIRST) OVER (PARTITION BY doc, n) AS body FROM t),
        d AS (SELECT DISTINCT doc, coalesce(n, r) AS title, n, body FROM p),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n NULLS FIRST) - 1 AS part, count(*) OVER (PARTITION BY doc) AS parts FROM d)
        SELECT doc, part::INT AS part, title, (length(body) + CASE WHEN part < parts - 1 THEN 1 ELSE 0 END)::BIGINT AS n, 'doc' AS node_type, title AS summary FROM k""",
    "tag_index": f"SELECT tag, count(*)::BIGINT AS n, string_agg(doc, ',' ORDER BY doc) AS docs FROM ({_TAGS}) GROUP BY tag",
    "tag_postings": f"""
        SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY doc) - 1 AS position, doc FROM (SELECT array_to_string(string_split(tag, '.')[1:3], '.') AS tag, doc FROM ({_TAGS}))""",
    "tag_children": f"SELECT DISTINCT string_split(tag, '.')[2] AS segment FROM ({_TAGS}) WHERE len(string_split(tag, '.')) > 2",
    "tag_edges": f"""
        SELECT DISTINCT array_to_string(p[1:i], '.') AS parent, array_to_string(p[1:i + 1], '.') AS child
        FROM (SELECT string_split(tag, '.') AS p FROM ({_TAGS})), unnest(range(1, len(p))) AS t(i)""",
    "tag_parents": f"""
        SELECT DISTINCT array_to_string(p[1:i], '.') AS tag, CASE WHEN i = 1 THEN '' ELSE array_to_string(p[1:i - 1], '.') END AS parents
        FROM (SELECT string_split(tag, '.') AS p FROM ({_TAGS})), unnest(range(1, len(p) + 1)) AS t(i)""",
    "tag_glob": f"SELECT DISTINCT tag FROM ({_TAGS}) WHERE regexp_matches(tag, '^type\\.[^.]+\\.brand-1[^.]+$') OR regexp_matches(tag, '^type\\..*\\.brand-2[^.]+$')",
    "global_tags": f"SELECT CASE WHEN p_partkey % 2 = 0 THEN 'local:' ELSE 'child:' END || {_ADDRESS} AS address FROM part WHERE (p_partkey % 2 = 1 AND p_size >= 25) OR (p_partkey % 2 = 0 AND p_size < 25)",
    "local_tags": f"SELECT {_ADDRESS} AS address FROM part WHERE p_partkey % 2 = 0 AND p_size >= 25",
    "bridge_tags": "SELECT 'se.catalog.parts.sized' AS address",
    "links_resolve": f"""WITH {_CHAIN},
        k AS (SELECT doc, ord, split_part(x, '|', 1) AS kind, split_part(x, '|', 2) AS target FROM links)
        SELECT doc, ord::INT AS ord, target, kind, target <> 'nowhere' AS resolved, CASE WHEN target = 'nowhere' THEN '' WHEN target LIKE 'docs/%' THEN target ELSE 'docs/' || target || '.md' END AS target_path,
               CASE WHEN target = 'nowhere' THEN '' WHEN target LIKE 'docs/%' THEN 'path' ELSE 'store' END AS source FROM k""",
    "recover_depth": """
        WITH c AS (SELECT 'docs/customer-' || c_custkey || '.md' AS root, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT root, unnest([1, 1, 2, 2]::INT[]) AS depth, unnest(['nation-' || n, 'docs/nation-' || n || '.md', 'region-' || r, 'nowhere']) AS target,
               unnest(['link', 'link', 'transclusion', 'link']) AS kind, unnest([true, true, true, false]) AS resolved FROM c""",
    "compose_docs": """
        WITH r AS (SELECT r_regionkey, '# ' || r_name || chr(10) || chr(10) || 'A region.' AS text FROM region)
        SELECT 'docs/region-' || r_regionkey || '.md' AS path, text AS composed FROM r
        UNION ALL SELECT 'docs/nation-' || n_nationkey || '.md', '# ' || n_name || chr(10) || chr(10) || 'Part of ' || text || ' and of [[nowhere]].' FROM nation JOIN r ON r_regionkey = n_regionkey
        UNION ALL SELECT 'docs/customer-' || c_custkey || '.md', '# ' || c_name || chr(10) || chr(10) || 'Lives in [[nation-' || c_nationkey || ']], see [[docs/nation-' || c_nationkey || '.md]].' FROM customer""",
    "composition_refs": """
        SELECT 'region-' || r_regionkey AS doc, string_agg('- ' || n_name || ' (' || n_nationkey || ')', chr(10) ORDER BY n_name) AS composed
        FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
}
