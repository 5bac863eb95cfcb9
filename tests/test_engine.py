import dataclasses
import difflib
import hashlib
import json
import os
import random
import re
import socket
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import cli
from quire.errors import FieldEditError, RegistryError, CatalogError, CompileError, RoundTripError
from quire.functions import text
from quire.operators import compositions, extract, fields, ingest, integrity, intervals, library, links, search, sections, semantics, tree, trigrams
from quire.operators.changes import Changes
from quire.plans import expressions, templates
from quire.plans.addresses import parse_address
from quire.plans.markers import Marker, capture_pattern, field_lines, parse_marker
from quire.plans.models import Composition, Field, Model, Registry, model_tags
from quire.plans.predicates import PredicateError
from quire.sources import blocks, folders
from quire.sources import catalog as catalog_module
from quire.sources.blocks import parse_blocks, split_cells, with_blocks
from quire.sources.catalog import Catalog
from quire.sources.files import raw_documents, read_documents, read_manifest, write_documents
from quire.streaming import versions as streamed
from quire.streaming.files import document_stream, ingest_available, tumbling_counts

GUIDE = Model(
    "Guide",
    "# ⸢rev•title⸥\n\nStatus: ⸢rev•status⸥\n\nCoverage: ⸢rev•coverage⸥\n\n## Abstract\n\n⸢rev•abstract⸥\n\n## Tags\n\n- ⸢rev,list•semantic_tags⸥\n",
    (Field("title", "str", "Title"), Field("status", "str", "Status"), Field("coverage", "int", "Coverage"), Field("abstract", "str", "Abstract", optional=True), Field("semantic_tags", "list", "Tags")),
    {"type": {"documentation": "Guide"}},
    "guides",
)
SPECIAL = Model("SpecialGuide", GUIDE.template, GUIDE.fields, {"type": {"documentation": "Guide"}, "ecosystem": "special"}, parents=(GUIDE,))
NOTE = Model("Note", "# ⸢rev•title⸥\n\n⸢rev•body⸥\n", (Field("title", "str", "Title"), Field("body", "str", "Body", optional=True)))
REGISTRY = Registry(GUIDE, SPECIAL, NOTE)


def guide(title, status, coverage, abstract, tags):
    return f"# {title}\n\nStatus: {status}\n\nCoverage: {coverage}\n\n## Abstract\n\n{abstract}\n\n## Tags\n\n" + "\n".join(f"- {t}" for t in tags)


def docs_of(spark, *rows):
    return spark.createDataFrame([(s, m, d, f"docs/{d}.md", t) for s, m, d, t in rows], "store string, model string, doc string, path string, text string")


@pytest.fixture(scope="module")
def lib(spark):
    docs = docs_of(
        spark,
        ("local", "Guide", "readme", guide("Project Guide", "accepted", 90, "Project overview.", ["project.core.database"])),
        ("local", "SpecialGuide", "local-special", guide("Local Special Guide", "draft", 88, "Local specialization.", ["project.core.database"])),
        ("child", "SpecialGuide", "special", guide("Special Guide", "accepted", 95, "Special overview.\n\n- a list\n\nmore", ["project.core.database"])),
        ("local", "Note", "note", "# A note\n\nSee [[readme]] and ![[readme]], [[gone]].\n"),
    )
    equal = semantics.map_equal(spark.createDataFrame([], "store string, tag string, equal string"), "local", "type.documentation.Guide", "type.manual")
    return library.Library(REGISTRY, docs, semantics.map_equal(equal, "child", "type.documentation.Guide", "type.manual"))


def names(df, column="address"):
    return sorted(r[column] for r in df.collect())


# templates


def test_markers():
    assert parse_marker("rev,list•tags") == Marker("rev", ("list",), "tags")
    assert parse_marker(" optrev , dict •a•b") == Marker("optrev", ("dict",), "a•b")
    assert parse_marker("name") == Marker("name", (), "")
    assert parse_marker("•x") == Marker("rev", (), "x")
    assert capture_pattern("a.⸢rev•x⸥ {{ y }}")[1] == ["x"]
    assert field_lines(GUIDE.template) == {"title": 1, "status": 3, "coverage": 5, "abstract": 9, "semantic_tags": 13}
    for bad in ("# ⸢rev•a⸥\n\nx ⸢rev•a⸥", "# ⸢optrev•a⸥"):
        with pytest.raises(CompileError):
            templates.compile_steps(bad)


def test_blocks():
    kinds = lambda t: [(b.type, b.tag, b.start, b.end) for b in parse_blocks(t)]
    assert kinds("# A #\ntext\nmore\n\nB\n===\n---\n***\n") == [("heading", "h1", 0, 1), ("paragraph", "p", 1, 3), ("heading", "h1", 4, 6), ("hr", "hr", 6, 7), ("hr", "hr", 7, 8)]
    assert kinds("---\na: 1\n---\n\nx") == [("front_matter", "", 0, 3), ("paragraph", "p", 4, 5)]
    assert kinds("```py\n# no heading\n```\n    code\n> q\nlazy\n") == [("fence", "code", 0, 3), ("code_block", "code", 3, 4), ("blockquote", "blockquote", 4, 6)]
    assert kinds("- a\n  b\n\n  c\n- d\n\n1. e\n2. f\n") == [("bullet_list", "ul", 0, 5), ("ordered_list", "ol", 6, 8)]
    nested = parse_blocks("- a\n  - b\n  - c\n- d")[0]
    assert [len(x.children) for x in nested.children] == [2, 1] and [x.all_text() for x in nested.children[0].children[1].children] == ["b", "c"]
    table = parse_blocks("| a | b |\n|---|:-:|\n| 1 | x \\| y |\n| 2 |\n")[0]
    assert [[c.text for c in r.children] for r in table.children] == [["a", "b"], ["1", "x | y"], ["2", ""]]
    assert split_cells("a | `b|c` |") == ["a", "`b|c`"]
    assert parse_blocks("") == [] and kinds("\n\n") == []
    assert [b.type for b in parse_blocks("<div>\nx\n</div>\n\ny")] == ["html_block", "paragraph"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#-*>|`~ \n1.ab=:<\t\\", max_size=60))
def test_blocks_never_fail_and_go_forward(t):
    at = 0
    for b in parse_blocks(t):
        assert at <= b.start < b.end
        at = b.end


def test_extraction_goes_forward():
    t = "# ⸢rev•title⸥\n\n## First\n\n⸢rev•first⸥\n\n## Second\n\n⸢rev•second⸥\n"
    got = templates.extract(templates.compile_steps(t), "# T\n\n## First\n\none\n\n- two\n\n## Second\n\nthree\n\n```\ncode\n```\n")
    assert got == {"title": "T", "first": "one\n\n- two", "second": "three\n\n```\ncode\n```"}
    assert templates.extract(templates.compile_steps(t), "") == {"first": "", "second": ""}
    assert templates.extract(templates.compile_steps("- Task: ⸢rev,list•t⸥"), "- Task: a\n- Task: b\n- c") == {"t": ["a", "b", "c"]}
    with pytest.raises(CompileError):
        templates.extract(templates.compile_steps("---\n⸢rev,dict•m⸥\n---\n"), "---\n{: [\n---\n")


# models


def test_models():
    with pytest.raises(TypeError):
        Field("x")
    with pytest.raises(FieldEditError):
        GUIDE.with_field(Field("title", "str", "again"))
    with pytest.raises(FieldEditError):
        GUIDE.without_field("nothing")
    with pytest.raises(FieldEditError):
        GUIDE.with_template("# ⸢rev•unknown⸥")
    assert GUIDE.with_field(Field("more", "str", "more")).named("more") and GUIDE.promoted().version == 2
    assert REGISTRY.descendants("Guide") == ["Guide", "SpecialGuide"]
    with pytest.raises(RegistryError):
        Registry(GUIDE, GUIDE)
    assert model_tags({"a": "b", "c": ["d", "e"], "f": {"g": "h", "i": ["j", "k"]}}) == ["a.b", "c.d.e", "f.g.h", "f.i.j.k"]
    made = Model.from_spec({"name": "X", "template": "# ⸢rev•t⸥", "fields": {"t": {"type": "str", "description": "T"}, "l": {"type": "list[str]", "description": "L"}}})
    assert [f.kind for f in made.fields] == ["str", "list"]


# extraction and rendering


def test_round_trip(spark, lib):
    v = extract.validate_docs(lib.documents.where("model <> 'Note'"), GUIDE, strict=True)
    assert v.where("valid and error is null").count() == 3
    broken = docs_of(spark, ("local", "Guide", "x", "# X\n\nStatus: y\n\nCoverage: many\n"), ("local", "Guide", "n", None))
    got = {r.doc: r for r in extract.validate_docs(broken, GUIDE).collect()}
    assert "coverage" in got["x"].error and not got["x"].valid and not got["n"].valid
    assert extract.extract_docs(broken.limit(0), GUIDE).count() == 0


def test_quick_and_general_paths_agree(spark):
    m = Model("M", "# ⸢rev•a⸥\n\nB: ⸢rev•b⸥, ⸢rev•c⸥\n\n## End\n\nN: ⸢rev•n⸥", (Field("a", "str", "a"), Field("b", "str", "b"), Field("c", "float", "c"), Field("n", "bool", "n", optional=True)))
    assert extract.quick_pattern(m) and not extract.quick_pattern(GUIDE)
    rows = ["# x\n\nB: y, 1.5\n\n## End\n\nN: yes", "# x #\n\nB: y, 2\n\n## End\n\nN: no\n", "# \n\nB: , \n\n## End\n\nN: maybe", "text\n\n# x\n\nB: y, z, 3\nmore\n\n## End", None, "", "# a\n\n\n\nB: 1, 2\n\n## End\n\nN: true\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, text string")
    read = lambda q: {r.i: (r.payload, json.loads(r.payload_json), r.error) for r in extract.extract_docs(df, m, quick=q).collect()}
    assert read(True) == read(False)


def test_lists_tables_and_yaml(spark):
    m = Model(
        "T",
        "---\n⸢rev,dict•meta⸥\n---\n\n# ⸢rev•title⸥\n\n| A | B |\n| - | - |\n| ⸢rev•rows⸥ | x ⸢rev•b⸥ |\n\n* ⸢rev,list•items⸥\n\nBye ⸢optrev•title⸥ ⸢render•nothing⸥ ⸢py•1+1⸥",
        (Field("meta", "dict", "m"), Field("title", "str", "t"), Field("rows", "rows", "r"), Field("items", "list", "i", optional=True)),
    )
    text = "---\nb: {c: [1, 2]}\nday: 2020-01-31\n---\n\n# T\n\n| A | B |\n| - | - |\n| 1 | x 2 |\n| 3 | x 4 |\n\n* p\n* q"
    docs = spark.createDataFrame([(text,)], "text string")
    r = extract.extract_docs(docs, m).first()
    assert json.loads(r.payload_json) == {"meta": {"b": {"c": [1, 2]}, "day": "2020-01-31"}, "title": "T", "rows": [{"rows": "1", "b": "2"}, {"rows": "3", "b": "4"}], "items": ["p", "q"]}
    out = extract.extract_docs(docs, m).select(extract.render_column(m, F.col("payload"))).first()[0]
    assert "| 3 | x 4 |" in out and "* q" in out and out.endswith("Bye T  ⸢py•1+1⸥")
    assert extract.validate_docs(docs, m).first().valid


# addresses and predicates


def test_addresses(lib):
    assert parse_address("st.{A+}.d.f.g").field == "f.g" and parse_address("gse.a.b.se.{x}").store == "x"
    with pytest.raises(CatalogError):
        parse_address("nothing")
    assert names(lib.ls("st.{Guide+}"), "name") == ["local-special", "readme"]
    assert names(lib.ls("st.{Guide}"), "name") == ["readme"]
    assert names(lib.ls("st"), "name") == ["Guide", "Note", "SpecialGuide"]
    assert "title: Title" in names(lib.ls("st.{Guide}.readme"), "name")
    assert lib.get("st.{Guide}.readme.title").first().value == '"Project Guide"'
    assert lib.get("st.{Guide}.readme.no.such").first().value is None
    assert names(lib.glob("st.{Guide}.*.title")) == ["st.{Guide}.readme.title"]
    assert names(lib.glob("st.{*}.[lr]*")) == ["st.{Guide}.readme", "st.{SpecialGuide}.local-special"]
    assert names(lib.get("se.type.documentation.Guide")) == ["st.{Guide}.readme", "st.{SpecialGuide}.local-special"]
    assert names(lib.glob("se.project.**.database")) == ["se.project.core.database"]
    assert names(lib.ls("se.type"), "name") == ["documentation"]
    assert names(lib.get("gse.type.manual")) == ["child:st.{SpecialGuide}.special", "local:st.{Guide}.readme", "local:st.{SpecialGuide}.local-special"]
    assert names(lib.get("gse.type.manual.se.{child}")) == ["se.type.documentation.Guide"]
    assert names(lib.find("se.ecosystem.*", 'status = "draft"')) == ["st.{SpecialGuide}.local-special"]
    with pytest.raises(CatalogError):
        lib.target("nobody")


@pytest.mark.parametrize(
    ("where", "found"),
    [
        ('status = "accepted"', ["readme"]), ('status != "accepted"', ["local-special"]), ("coverage >= 89", ["readme"]), ("coverage <= 88.5", ["local-special"]), ("coverage = 90", ["readme"]),
        ('coverage = "90"', []), ("has(abstract)", ["local-special", "readme"]), ("has(nothing)", []), ('"overview" in abstract', ["readme"]), ('"project.core.database" in semantic_tags', ["local-special", "readme"]),
        ('"project" in semantic_tags', []), ('title ~ "^Local"', ["local-special"]), ('doc ~ "^r"', ["readme"]), ("model <= SpecialGuide", ["local-special"]), ("model <= Guide", ["local-special", "readme"]), ("coverage >= 1000", []),
    ],
)
def test_predicates(lib, where, found):
    assert names(lib.find("st.{Guide+}", where), "doc") == found


def test_wrong_predicates(lib):
    with pytest.raises(PredicateError):
        lib.find("st.{Guide}", "coverage > 3")
    assert lib.find("st.{Guide}", "coverage > 3", strict=False).count() == 0


# sections


def test_sections(spark):
    t = "# A\n\n## B b!\n\n### C\n\ntext\n\n# D\n\n### É\n\n## \n"
    s = sections.sections(spark.createDataFrame([("d", t), ("e", None)], "doc string, text string"), ["doc"]).orderBy("position").collect()
    assert [r.path for r in s] == ["a", "a/b-b", "a/b-b/c", "d", "d/section"]
    assert s[2].breadcrumbs == ["A", "B b!", "C"] and s[2].about == ["A", "a", "B b!", "b b", "C", "c"] and s[2].parent == "a/b-b"
    assert [(r.line_start, r.line_end, r.body_end) for r in s][:4] == [(1, 2, 8), (3, 4, 8), (5, 6, 8), (9, 10, 13)]
    own = sections.field_owners(spark.createDataFrame([("d", t)], "doc string, text string"), ["doc"], "x\n\n⸢rev•f⸥\n\n\n\n\n⸢rev•g⸥").collect()
    assert {r.field: r.owning_section for r in own} == {"f": "a/b-b", "g": "a/b-b/c"}
    assert with_blocks(spark.createDataFrame([(t,)], "text string")).select(F.size("blocks")).first()[0] == 7


# fields


def test_fields(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":1},"l":[1,{"x":2}]},"e":{},"n":null,"s":"t"}'), (2, None)], "i int, payload_json string")
    flat = fields.flatten_payloads(df, ["i"])
    assert {(r.field_path, r.value_json) for r in flat.collect()} == {("a.b.c", "1"), ("a.l", '[1,{"x":2}]'), ("n", "null"), ("s", '"t"')}
    got = df.select(fields.deep_get(F.col("payload_json"), "a.l.1.x").alias("v"), fields.deep_get(F.col("payload_json"), "a/b/c").alias("w"), fields.deep_get(F.col("payload_json"), "a.q").alias("q")).first()
    assert tuple(got) == ("2", "1", None)
    edit = lambda op, path, value=None: df.where("i = 1").select(fields.edit_field(F.col("payload_json"), op, path, value).alias("e")).first().e
    assert json.loads(edit("create", "p.q", [1]).payload_json)["p"] == {"q": [1]}
    assert json.loads(edit("append", "a.l", 3).payload_json)["a"]["l"] == [1, {"x": 2}, 3]
    assert "s" not in json.loads(edit("remove", "s").payload_json)
    assert edit("update", "zz", 1).error and edit("append", "s", 1).error
    many = spark.createDataFrame([('{"l":["a","","a",null,"b"]}',)], "payload_json string")
    assert json.loads(many.select(fields.edit_field(F.col("payload_json"), "clean", "l", {"dedupe": True, "drop_empty": True}).alias("e")).first().e.payload_json) == {"l": ["a", "b"]}
    with pytest.raises(FieldEditError):
        fields.split_path("..")
    assert fields.parse_value("[1, 2]") == [1, 2] and fields.parse_value("a: b") == {"a": "b"} and fields.parse_value("x") == "x"


# search


def test_search(spark, lib):
    stores = spark.createDataFrame([("local", "local", "root", False), ("local", "child", "child", True)], "store string, name string, path string, linked boolean")
    r = search.search_records(lib, stores).persist()
    assert Counter(x.kind for x in r.collect()) == {"store": 2, "model": 4, "doc": 4, "section": 3 * 3 + 1, "field": 3 * 5 + 2}
    assert search.search(r, "docs", kinds=("field",)).count() == 4
    assert names(search.search(r, "local-special", "physical", ("doc",)), "name") == ["local-special"]
    assert names(search.search(r, "ecosystem.special", "semantic", ("doc",)), "name") == ["local-special", "special"]
    assert names(search.search(r, "^local-.*l$", kinds=("doc",), regex=True), "name") == ["local-special"]
    assert names(search.search(r, "REDME", kinds=("doc",), fuzzy=True), "name") == ["readme"]
    assert search.search(r, "abstract", "semantic", ("section",)).count() == 3
    assert names(search.where_records(r.where("kind = 'field'"), 'field = "status"', REGISTRY), "value") == ["accepted", "accepted", "draft"]
    assert names(search.where_records(r.where("kind = 'field'"), 'value != "draft"', REGISTRY), "kind").count("field") == 16
    assert search.where_records(r.where("kind = 'section'"), '"Abstract" in breadcrumbs', REGISTRY).count() == 3
    assert names(search.where_records(r.where("kind = 'doc'"), "coverage >= 90", REGISTRY), "name") == ["readme", "special"]
    assert r.where("kind = 'field' and field_path = 'semantic_tags' and doc = 'readme'").first().owning_section == "project-guide/tags"
    assert library.select_keys(r, ["name", "zz"]).columns == ["name", "zz"]


# tags


def test_tags(spark):
    tags = spark.createDataFrame([("d1", "a.b.c"), ("d2", "a.b.c"), ("d2", "a.x"), ("d2", "solo")], "doc string, tag string")
    assert {(r.tag, tuple(r.docs)) for r in semantics.tag_index(tags).collect()} == {("a.b.c", ("d1", "d2")), ("a.x", ("d2",)), ("solo", ("d2",))}
    assert names(semantics.tag_children(tags, "a"), "segment") == ["b"] and names(semantics.tag_children(tags), "segment") == ["a"]
    equal = semantics.map_equal(spark.createDataFrame([], "store string, tag string, equal string"), "local", "a.x", "a.b")
    edges = semantics.tag_edges(tags, equal)
    assert edges.count() == 5
    assert names(semantics.descendants(edges, "a.x"), "tag") == ["a.b", "a.b.c", "a.x"]
    loop = semantics.map_equal(equal, "local", "a.x", "a.x")
    assert loop.where("tag = equal").count() == 1


# links


def test_links(spark, lib):
    notes = {"a": "[[b]] ![[c]] [[b]] [[ b ]]", "b": "[[c]] [[gone]] [[docs/a.md]]", "c": "end ![[b]] $1 \\x", "sub/d": "[[a.md]] ![[nope]]"}
    docs = docs_of(spark, *[("local", "Note", d, t) for d, t in notes.items()])
    parsed = links.parsed_links(docs, ["doc", "path"])
    assert [(r.raw, r.target, r.kind) for r in parsed.where("doc = 'a'").orderBy("ord").collect()] == [("[[b]]", "b", "link"), ("![[c]]", "c", "transclusion"), ("[[b]]", "b", "link"), ("[[ b ]]", "b", "link")]
    found = links.resolve_links(parsed, docs)
    assert {(r.doc, r.target): (r.resolved, r.source) for r in found.collect()}[("b", "docs/a.md")] == (True, "path")
    assert not found.where("target = 'gone'").first().resolved
    start = docs.where("doc = 'a'")
    assert [r.target for r in links.recover_links(found, start, 1).orderBy("ord").collect()] == ["b", "c"]
    deep = links.recover_links(found, start, 3)
    assert Counter((r.target, r.kind, r.depth) for r in deep.collect()) == Counter([("b", "link", 1), ("c", "transclusion", 1), ("c", "link", 2), ("gone", "link", 2), ("docs/a.md", "link", 2), ("b", "transclusion", 2)])
    assert links.recover_links(found, start, 1, transclusions=False).count() == 1
    simple = docs.where("doc <> 'c'").unionByName(docs_of(spark, ("local", "Note", "c", "end $1 \\x")))
    found = links.resolve_links(links.parsed_links(simple, ["doc", "path"]), simple)
    made = {r.path: r.composed for r in links.compose(simple, found).collect()}
    assert made["docs/a.md"] == "[[b]] end $1 \\x [[b]] [[ b ]]" and made["docs/sub/d.md"] == "[[a.md]] ![[nope]]"
    kids = spark.createDataFrame([("x", 1), ("z", 3)], "doc string, n int")
    parents = spark.createDataFrame([("p", ["z", "y", "x"]), ("q", [])], "doc string, refs array<string>")
    composed = {r.doc: r.composed for r in links.composed_field(parents, ["doc"], "refs", kids, F.concat(F.col("doc"), F.lit("="), F.col("n")), ", ").collect()}
    assert composed == {"p": "z=3, x=1", "q": ""}


# integrity and changes


def test_integrity(spark):
    rows = [("local", "M", f"d{i}", f"p{i}", "text", "{}") for i in range(4)]
    df = spark.createDataFrame(rows, "store string, model string, doc string, path string, text string, payload_json string")
    tracked = integrity.document_hashes(df)
    now = df.where("doc <> 'd0'").withColumn("text", F.when(F.col("doc") == "d1", "other").when(F.col("doc") == "d2", "third").otherwise(F.col("text"))).withColumn("payload_json", F.when(F.col("doc") == "d2", '{"a":1}').otherwise(F.col("payload_json")))
    notes = integrity.diagnose(tracked, now)
    assert {r.doc: r.note for r in notes.collect()} == {"d0": "missing", "d1": "benign_mutation", "d2": "data_mutation", "d3": "ok"}
    roll = integrity.diagnosis_rollup(notes).first()
    assert (roll.docs, roll.ok, roll.benign, roll.changed, roll.missing, roll.valid) == (4, 1, 1, 1, 1, False)
    models = integrity.model_hashes(tracked)
    stores = integrity.store_hashes(models)

    def report(now, models=models, stores=stores):
        by_model = integrity.diagnose_models(integrity.diagnose(tracked, now), tracked, models)
        m, s = by_model.first(), integrity.diagnose_store(by_model, models, stores).first()
        return m.valid, m.hash_b_ok, s.hash_a_ok, s.valid

    benign = df.withColumn("text", F.when(F.col("doc") == "d1", "other").otherwise(F.col("text")))
    assert report(df) == report(benign) == (True, True, True, True)
    assert report(df.where("doc <> 'd0'")) == (False, True, True, False) and report(now) == (False, True, True, False)
    tampered = models.withColumn("hash_b", F.lit("x"))
    assert report(df, tampered) == (True, False, False, False)
    assert report(df, tampered, integrity.store_hashes(tampered)) == (True, False, True, False)
    assert report(df, models, stores.withColumn("hash_a", F.lit("x"))) == (True, True, False, False)
    nothing = models.limit(0).unionByName(spark.createDataFrame([("local", "Empty", "")], models.schema))
    assert integrity.diagnose_models(integrity.diagnose(tracked.limit(0), df), tracked.limit(0), nothing).first().asDict() == {"store": "local", "model": "Empty", "docs": 0, "ok": 0, "benign": 0, "changed": 0, "missing": 0, "valid": True, "hash_b_ok": True}
    moved = tracked.withColumn("hash_c", F.when(F.col("doc") == "d1", "x").otherwise(F.col("hash_c")))
    assert integrity.model_hashes(moved).first().hash_b != models.first().hash_b == integrity.model_hashes(tracked.repartition(3)).first().hash_b
    assert integrity.changed_docs(now, tracked.select("store", "model", "doc", "hash_c")).count() == 2


def test_diagnosis_broadcasts_no_documents(spark):
    """Few bytes are expected of documents made by expressions, however many they are."""
    docs = spark.range(5).select(F.lit("local").alias("store"), F.lit("M").alias("model"), F.concat(F.lit("d"), "id").alias("doc"), F.repeat(F.lit("text"), 1000).alias("text"), F.lit("{}").alias("payload_json"))
    notes = integrity.diagnose(integrity.document_hashes(docs), docs.where("id <> 3"))
    assert {r.doc: r.note for r in notes.collect()} == {f"d{i}": "missing" if i == 3 else "ok" for i in range(5)}
    assert "Broadcast" not in notes._jdf.queryExecution().executedPlan().toString()


def _slots(catalog, name="documents"):
    return catalog._pointer()[name]


def test_a_change_writes_its_bucket_only(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "buckets"))
    catalog.init()
    c = Changes(catalog, Registry(NOTE))
    rows = [("local", f"n{i}", f"n{i}.md", f"# T{i}\n\ntext {i}\n") for i in range(60)]
    c.track(spark.createDataFrame(rows, "store string, doc string, path string, text string"), "Note")
    whole = lambda: integrity.model_hashes(catalog.read("documents")).first().hash_b
    kept = lambda: catalog.read("models").where("model = 'Note'").first().hash_b
    first = kept()
    assert whole() == first and len(_slots(catalog)) > 8
    before = {n: _slots(catalog, n) for n in ("documents", "sections", "folds")}
    c.edit(spark.createDataFrame([("local", "n7")], "store string, doc string"), "Note", "update", "body", "other")
    own = hashlib.sha256(b"Note\0n7").hexdigest()[:1]
    for n, old in before.items():
        assert {b for b, x in _slots(catalog, n).items() if old[b] != x} == {own}
    assert whole() == kept() != first
    # the files of before stay for readers, and go when their time is over
    assert len(os.listdir(tmp_path / "buckets" / "documents")) - 1 > len(_slots(catalog))
    assert catalog.vacuum(3600) == 0 and catalog.vacuum() > 0
    assert sum(x.startswith("slot=") for x in os.listdir(tmp_path / "buckets" / "documents")) == len(_slots(catalog))
    assert catalog.read("documents").count() == 60
    c.untrack(catalog.read("documents"))
    assert catalog.read("documents").count() == catalog.read("sections").count() == 0 and kept() == "" and _slots(catalog) == {}


def test_old_files_go_after_their_time(spark, tmp_path, monkeypatch):
    catalog = Catalog(spark, str(tmp_path / "kept"))
    catalog.init()
    c = Changes(catalog, Registry(NOTE))
    places = lambda: {x for x in os.listdir(tmp_path / "kept" / "models") if x.isdigit()}
    c.add_model("Note")
    assert len(places()) == 2
    monkeypatch.setattr(catalog_module, "KEEP_S", -1)
    c.map_tags("a", "b")
    assert len(places()) == 1 and catalog.read("models").count() == 1


def test_maintained_tables_equal_rebuilt_ones(spark, tmp_path):
    rng = random.Random(4)
    catalog = Catalog(spark, str(tmp_path / "maintained"))
    catalog.init()
    c = Changes(catalog, Registry(NOTE, GUIDE))
    known, schema = {}, "store string, doc string, path string, text string"
    for step in range(7):
        op = rng.choice(["track", "update", "untrack", "refresh"]) if known else "track"
        some = rng.sample(sorted(known), min(len(known), 3))
        if op == "track":
            new = {f"d{step}-{i}": f"# A{i}\n\nbody {rng.random()}\n\n## B\n" for i in range(4)}
            c.track(spark.createDataFrame([("local", d, f"{d}.md", t) for d, t in new.items()], schema), "Note", force=True)
            known |= new
        elif op == "update":
            c.update(spark.createDataFrame([("local", d, (f"New {step}", "b")) for d in some], "store string, doc string, payload struct<title: string, body: string>"), "Note")
            known |= {d: f"# New {step}\n\nb" for d in some}
        elif op == "untrack":
            c.untrack(spark.createDataFrame([("local", "Note", d) for d in some], "store string, model string, doc string"))
            known = {d: t for d, t in known.items() if d not in some}
        else:
            known |= {d: known[d] + "\n## More\n" for d in some}
            c.refresh(spark.createDataFrame([("local", "Note", d, f"{d}.md", t) for d, t in known.items()], "store string, model string, doc string, path string, text string"))
        docs = catalog.read("documents")
        assert {r.doc: r.text for r in docs.collect()} == known
        rebuilt = sections.sections(docs, ["store", "model", "doc", "semantic_tags"], F.col("semantic_tags"))
        columns = ["doc", "position", "path", "line_start", "body_end", "about"]
        assert sorted(map(repr, catalog.read("sections").select(columns).collect())) == sorted(map(repr, rebuilt.select(columns).collect()))
        hashes = {r.model: r.hash_b for r in integrity.model_hashes(docs).collect()}
        assert {r.model: r.hash_b for r in catalog.read("models").where("hash_b <> ''").collect()} == hashes


def test_update_takes_all_models_files(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "all"))
    catalog.init()
    c = Changes(catalog, Registry(NOTE, GUIDE))
    for name, text in (("Note", "# A\n\nb\n"), ("Guide", guide("One", "draft", 1, "a", ["x.y"]))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc.md").write_text(text)
        c.track(read_documents(spark, str(tmp_path / name), name).drop("model"), name)
    assert c.refresh() == {"docs": 2, "missing": 0, "skipped": 0, "sections": 4}
    assert c.refresh(read_documents(spark, str(tmp_path / "Note"), "Note"))["missing"] == 0
    (tmp_path / "Note" / "doc.md").write_text("# B\n\nc\n")
    (tmp_path / "Guide" / "doc.md").unlink()
    assert c.refresh()["missing"] == 1
    assert catalog.read("documents").where("model = 'Note'").first().text.startswith("# B")


HOSTILE = {
    "yaml": "---\n" + "[" * 3000 + "\n---\n\n# T\n", "quotes": ">" * 3000 + " # T\n", "lists": "- " * 3000 + "x\n", "flow": "---\na: " + "{b: " * 500 + "}" * 500 + "\n---\n",
    "aliases": "---\na: &a [x, x, x, x, x, x, x, x, x, x]\n" + "\n".join(f"{c}: &{c} [{', '.join(['*' + chr(ord(c) - 1)] * 10)}]" for c in "bcdefgh") + "\n---\n\n# T\n",
    "heading": "# " + "x" * 1_000_000 + "\n", "headings": "# a\n\n" * 3000, "fence": "```" * 50_000, "fine": "---\nk: v\n---\n\n# Fine\n\ntext\n",
}


def test_no_document_stops_a_job(spark, tmp_path):
    model = Model("Meta", "---\n⸢rev,dict•meta⸥\n---\n\n# ⸢rev•title⸥\n\n⸢rev•body⸥\n", (Field("meta", "dict", "Front matter", optional=True), Field("title", "str", "Title", optional=True), Field("body", "str", "Text", optional=True)))
    docs = spark.createDataFrame([("local", "Meta", d, f"{d}.md", t) for d, t in HOSTILE.items()], "store string, model string, doc string, path string, text string")
    got = {r.doc: r for r in extract.extract_docs(docs, model).collect()}
    assert set(got) == set(HOSTILE) and got["fine"].error is None and got["fine"].payload.title == "Fine"
    assert "deep" in got["yaml"].error and "deep" in got["flow"].error and "aliases" in got["aliases"].error
    for quick in (True, False):
        heads = {r.doc: r.headings for r in sections.with_headings(docs, quick=quick).select("doc", "headings").collect()}
        assert len(heads["headings"]) == 3000 and [h.title for h in heads["fine"]] == ["Fine"] and len(heads) == len(HOSTILE)
    assert blocks.with_blocks(docs).select(F.explode("blocks")).count() > 3000
    deep = spark.createDataFrame([('{"a":' * 200_000 + "1" + "}" * 200_000,), ('{"a":1}',), ("[" * 5000,)], "p string")
    assert [r.e.error is None for r in deep.select(fields.edit_field(F.col("p"), "create", "b", 1).alias("e")).collect()] == [False, True, False]
    catalog = Catalog(spark, str(tmp_path / "hostile"))
    catalog.init()
    c = Changes(catalog, Registry(model))
    c.track(docs.drop("model"), "Meta", force=True)
    assert c.refresh(docs.withColumn("text", F.concat("text", F.lit("\n"))))["docs"] == len(HOSTILE)
    tracked = catalog.read("documents")
    assert integrity.diagnose(tracked, library.Library(Registry(model), tracked).payloads()).where("note = 'ok'").count() == len(HOSTILE)


def test_indexed_search_gives_what_a_scan_gives(spark, lib, tmp_path):
    records = trigrams.with_record(search.search_records(lib)).checkpoint()
    postings = trigrams.gram_postings(records).checkpoint()
    key = ["kind", "store", "model", "doc", "name", "path"]
    rows = lambda df: sorted(map(repr, df.select(key).collect()))
    for term, regex in (("readme", False), ("Guide", False), ("re", False), ("core.data", False), ("nothing here", False), (r"^read\w+$", True), (r"(special|note)", True), (r"doc[sx]/.*\.md", True), (r"loc?al-spec{1,2}ial", True), (r"\.d.tab", True), ("Abs|Tag", True)):
        for within in ("both", "physical", "semantic"):
            assert rows(trigrams.indexed_search(records, postings, term, within, regex=regex)) == rows(search.search(records, term, within, regex=regex)), term
    postings.write.parquet(str(tmp_path / "postings"))
    plan = trigrams.candidates(spark.read.parquet(str(tmp_path / "postings")), "readme")._jdf.queryExecution().toString()
    assert "In(gram, [adm,dme,ead,rea])" in plan
    assert trigrams.candidates(postings, r"a.b|readme", regex=True) is None and trigrams.candidates(postings, "readme").count() < records.count()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.*+?[](){}|^$\\d-,1", max_size=10), st.text(alphabet="ab1.-", max_size=12))
def test_every_match_holds_the_literals(pattern, value):
    try:
        found = re.search(pattern, value)
    except (re.error, OverflowError):
        return
    if found:
        assert all(x in value for x in trigrams.literals(pattern)), (pattern, value, trigrams.literals(pattern))


def test_an_index_holds_while_documents_do(spark, tmp_path, capsys):
    spec = tmp_path / "models.yaml"
    spec.write_text("- name: Memo\n  template: |\n    # ⸢rev•title⸥\n\n    By ⸢rev•author⸥\n  fields:\n    title: {type: str, description: T}\n    author: {type: str, description: A}\n")
    run = lambda *a: cli.main(["--catalog", str(tmp_path / "c"), "--models", str(spec), *a], spark)
    assert run("stores", "init") == 0 and run("docs", "create", "Memo", "first", "{title: Hello, author: Ann}") == 0
    catalog = Catalog(spark, str(tmp_path / "c"))
    assert catalog.indexed() is None and run("stores", "index") == 0 and catalog.indexed()
    capsys.readouterr()
    assert run("find", "first", "--type", "doc", "--select", "name,kind") == 0 and capsys.readouterr().out.strip() == "first\tdoc"
    assert run("docs", "create", "Memo", "first-too", "{title: Hello, author: Ann}") == 0 and catalog.indexed() is None
    assert run("find", "first-too", "--type", "doc") == 0
    assert run("stores", "vacuum") == 0 and run("stores", "update") == 0


def test_folders_as_a_source(spark, tmp_path):
    folders.register(spark)
    rows = [("local", m, d, f"# {d}\n\nä\n") for m in ("A", "B") for d in ("one", "two", "sub/three")]
    docs = spark.createDataFrame(rows, "store string, model string, doc string, text string")
    docs.select("model", "doc", "text").write.format("documents").mode("append").save(str(tmp_path / "out"))
    (tmp_path / "out" / "A" / ".hidden.md").write_text("x")
    (tmp_path / "out" / "A" / "other.txt").write_text("x")
    read = lambda: spark.read.format("documents").load(str(tmp_path / "out"))
    assert sorted((r.model, r.doc, r.text) for r in read().collect()) == sorted((m, d.rpartition("/")[2], t) for _, m, d, t in rows)
    assert [(r.doc, r.path) for r in read().where("model = 'B' and doc = 'three'").collect()] == [("three", f"{tmp_path}/out/B/sub/three.md")]
    assert read().where("doc in ('one', 'two') and text like '%two%' and model <> 'A'").count() == 1 and read().where("store = 'x'").count() == 0
    reader = folders.FolderReader({"path": str(tmp_path / "out")})
    left = list(reader.pushFilters([folders.EqualTo(("model",), "A"), folders.StringStartsWith(("doc",), "t"), folders.EqualTo(("text",), "x")]))
    assert [f.attribute for f in left] == [("text",)]
    assert [(p.model, [x.rpartition("/")[2] for x in p.paths]) for p in reader.partitions()] == [("A", ["three.md", "two.md"])]
    assert spark.read.format("documents").load(str(tmp_path / "none")).count() == 0
    write_documents(docs, str(tmp_path / "files"))
    assert (tmp_path / "files" / "local" / "A" / "one.md").read_text() == "# one\n\nä\n"


def test_a_shuffled_and_replayed_stream(spark, tmp_path):
    rng = random.Random(11)
    versions = [("local", "Note", f"d{i}", f"d{i}.md", f"# T{i}\n\nversion {v if rng.random() < 0.7 else 0}\n", v) for i in range(6) for v in range(5)]
    catalog = Catalog(spark, str(tmp_path / "stream"))
    catalog.init()
    c = Changes(catalog, Registry(NOTE))
    source = tmp_path / "in"
    stream = lambda: spark.readStream.schema(streamed.VERSION).option("maxFilesPerTrigger", 1).json(str(source))
    source.mkdir()
    keys = ["store", "model", "doc", "path", "text", "version"]
    for part in range(4):
        some = rng.sample(versions, 14) if part < 3 else rng.sample(versions, len(versions))
        (source / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(keys, v))) for v in some))
        if part in (1, 3):
            streamed.stream_into(c, stream(), "notes", str(tmp_path / "state")).awaitTermination()
    newest = {v[2]: v[4] for v in sorted(versions, key=lambda v: (v[5], hashlib.sha256(v[4].encode()).hexdigest()))}
    assert {r.doc: r.text for r in catalog.read("documents").collect()} == newest
    last, pointer = catalog.mark("notes"), catalog._pointer()["documents"]
    assert last >= 1 and not c.take(catalog.read("documents").select("store", "model", "doc", "path", F.lit("# x").alias("text")), ("notes", last))
    assert catalog._pointer()["documents"] == pointer and c.take(spark.createDataFrame([], "store string, model string, doc string, path string, text string"), ("notes", last + 1))
    assert integrity.model_hashes(catalog.read("documents")).first().hash_b == catalog.read("models").first().hash_b


def test_flatten_stops_where_payloads_do(spark):
    rows = ['{"a":{"b":{"c":1,"d":[{"e":{"f":2}}]},"g":{}},"h":null,"i":"x","j":{"k":null}}', "{}", None, "[1]", "nothing", '{"l":[' + ",".join('{"m":1}' for _ in range(800)) + "]}", '{"a.b":{"c":true}}']
    docs = spark.createDataFrame(list(enumerate(rows)), "i int, payload_json string")
    got = sorted((r.i, r.field_path, r.value_json) for r in fields.flatten_payloads(docs, ["i"]).collect())
    want = [(0, "a.b.c", "1"), (0, "a.b.d", '[{"e":{"f":2}}]'), (0, "h", "null"), (0, "i", '"x"'), (0, "j.k", "null"), (5, "l", "[" + ",".join('{"m":1}' for _ in range(800)) + "]"), (6, "a.b.c", "true")]
    assert got == want


def test_fuzzy_search_loses_nothing(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdeÄ ") for _ in range(rng.randrange(1, 12))) for _ in range(1500)] + ["Straße", "STRASSE", "dashboard", "Dashbord", "dahsboard"]
    records = spark.createDataFrame([(n, [n], [], []) for n in names], "name string, physical array<string>, semantic array<string>, about array<string>")
    for term in ("abcde", "dashboard", "ÄbÄ", "strasse", "a"):
        low = term.lower()
        want = sorted(n for n in names if low in n.lower() or difflib.SequenceMatcher(None, low, n.lower()).ratio() >= search.FUZZY)
        assert sorted(r.name for r in search.search(records, term, fuzzy=True).collect()) == want


def test_compositions_of_compositions(spark):
    title = Field("title", "str", "Title")
    leaf = Model("Leaf", "# ⸢rev•title⸥", (title,))
    mid = Model("Mid", "# ⸢rev•title⸥\n\n⸢render•all⸥", (title, Field("kids", "list", "Children", optional=True)), compositions={"all": Composition("kids", "{title}", "+", "Leaf")})
    top = Model("Top", "# ⸢rev•title⸥\n\n⸢render•sum⸥\n\n⸢render•bad⸥", (title, Field("kids", "list", "Children")), compositions={"sum": Composition("kids", "* {title} = {all}", "\n", "Mid"), "bad": Composition("kids", "{nothing}", "\n", "Mid")})
    frame = lambda rows, kids: spark.createDataFrame([("local", d, f"{d}.md", tuple(p)) for d, *p in rows], f"store string, doc string, path string, payload struct<title: string{', kids: array<string>' if kids else ''}>")
    payloads = {"Leaf": frame([("a", "A"), ("b", "B")], False), "Mid": frame([("m", "M", ["`b`", " a.md ", "none"]), ("o", "O", None)], True), "Top": frame([("t", "T", ["o", "m", "m"])], True)}
    got = compositions.render_compositions(Registry(top, mid, leaf), payloads)
    assert {r.doc: r.text for r in got["Mid"].collect()} == {"m": "# M\n\nB+A", "o": "# O"}
    assert got["Top"].first().text == "# T\n\n* O = \n* M = B+A\n* M = B+A"
    loop = dataclasses.replace(leaf, compositions={"x": Composition("title", "", "", "Top")})
    with pytest.raises(RegistryError, match="Top > Mid > Leaf > Top"):
        compositions.rendering_order(Registry(top, mid, loop))


def test_tags_as_intervals(spark, tmp_path):
    tags = ["a.b.c", "a.b", "a-x", "a.b-x.d", "a.c.d.e", "b", "b.a", "a", "c.d", "a.b.c.d"]
    numbered = intervals.numbered_tags(spark.createDataFrame([(t,) for t in [*tags, *tags, ""]], "tag string"))
    numbered.orderBy("pre").write.parquet(str(tmp_path / "tags"))
    numbered = spark.read.parquet(str(tmp_path / "tags"))
    nodes = {".".join(t.split(".")[:i]) for t in tags for i in range(1, t.count(".") + 2)}
    rows = {r.tag: r for r in numbered.collect()}
    assert set(rows) == nodes and [r.tag for r in sorted(rows.values(), key=lambda r: r.pre)] == sorted(nodes, key=lambda t: t.split("."))
    distinct = spark.createDataFrame([(t,) for t in tags], "tag string")
    for top in ("a", "a.b", "a.b.c.d", "zz"):
        below = intervals.tags_below(numbered, top)
        assert {r.tag for r in below.collect()} == {t for t in nodes if re.match(text.tag_pattern(top + ".**"), t)}
        assert sorted(r.segment for r in intervals.children(numbered, top).collect()) == [r.segment for r in semantics.tag_children(distinct, top).collect()]
    plan = intervals.tags_below(numbered, "a")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pre," in plan and "LessThanOrEqual(pre," in plan
    equal = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("z", "z"), ("e", "d"), ("f", "e"), ("g", "f")], "tag string, equal string")
    assert {r.tag: r["class"] for r in intervals.equal_classes(equal).collect()} == {**dict.fromkeys("abcdefg", "a"), "x": "x", "y": "x"}


def test_links_to_one_hot_target(spark):
    rows = [(f"d{i}", f"x/d{i}.md", "[[hub]] [[d1]] [[hub]]") for i in range(300)] + [("hub", "y/hub.md", "")]
    docs = spark.createDataFrame(rows, "doc string, path string, text string")
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs)
    assert found.count() == 900 and found.where("target_path = 'y/hub.md'").count() == 600 and found.where("not resolved or ambiguous").isEmpty()


def test_changes(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    with pytest.raises(CatalogError):
        catalog.read("documents")
    catalog.init()
    with pytest.raises(CatalogError):
        catalog.init()
    c = Changes(catalog, Registry(GUIDE, NOTE))
    c.add_model("Guide")
    with pytest.raises(RegistryError):
        c.add_model("Guide")
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "one.md").write_text(guide("One", "draft", 1, "a", ["x.y", "x.y"]))
    (folder / "two.md").write_text(guide("Two", "draft", 2, "b", ["x.z"]))
    files = read_documents(spark, str(folder), "Guide").drop("model")
    c.track(files, "Guide")
    with pytest.raises(CatalogError):
        c.track(files.where("doc = 'one'"), "Guide")
    with pytest.raises(RoundTripError):
        c.track(spark.createDataFrame([("local", "bad", "bad.md", "# only")], "store string, doc string, path string, text string"), "Guide")
    one = spark.createDataFrame([("local", "one")], "store string, doc string")
    c.edit(one, "Guide", "update", "status", "accepted")
    c.edit(one, "Guide", "clean", "semantic_tags", {"dedupe": True, "drop_empty": True})
    row = catalog.read("documents").where("doc = 'one'").first()
    assert json.loads(row.payload_json)["status"] == "accepted" and json.loads(row.payload_json)["semantic_tags"] == ["x.y"] and row.semantic_tags == ["type.documentation.Guide", "x.y"]
    with pytest.raises(RoundTripError):
        c.edit(one, "Guide", "remove", "zz")
    with pytest.raises(CatalogError), catalog.lock():
        c.untrack(catalog.read("documents"))
    c.map_tags("x.y", "g.h")
    assert catalog.read("equivalences").count() == 2
    (folder / "one.md").unlink()
    (folder / "two.md").write_text(guide("Two again", "final", 3, "b", ["x.z"]))
    assert c.refresh(read_documents(spark, str(folder), "Guide")) == {"docs": 2, "missing": 1, "skipped": 0, "sections": 6}
    assert Changes(catalog, Registry(NOTE)).refresh(read_documents(spark, str(folder), "Guide"))["skipped"] == 1
    assert json.loads(catalog.read("documents").where("doc = 'two'").first().payload_json)["title"] == "Two again"
    c.promote_model(GUIDE.with_field(Field("more", "str", "more", optional=True)))
    assert catalog.read("models").where("model = 'Guide'").first().version == 2
    with pytest.raises(RoundTripError):
        c.promote_model(GUIDE.with_template("# ⸢rev•title⸥\n\nMore: ⸢rev•status⸥"))
    c.untrack(catalog.read("documents").where("doc = 'one'"))
    assert names(catalog.read("documents"), "doc") == ["two"]
    catalog.vacuum()
    assert catalog.read("documents").count() == 1
    other = Catalog(spark, str(tmp_path / "other"))
    with pytest.raises(CatalogError):
        c.link_store("other", other.root)
    other.init()
    c.link_store("other", other.root)
    assert catalog.read("stores").count() == 2


# sources


def test_ingest(spark):
    df = spark.createDataFrame([("s", "# Intro\n\nFirst line\n## Rules\nx\n## \n")], "src string, text string")
    parts = ingest.decompose(df, ["src"]).orderBy("part").collect()
    assert [(r.title, r.node_type) for r in parts] == [("Intro", "doc"), ("Rules", "doc_standard"), ("", "doc")]
    one = df.select(ingest.abstract(F.col("text")).alias("a"), ingest.summary(F.col("text")).alias("s")).first()
    assert tuple(one) == ("First line", "Intro")
    slugs = spark.createDataFrame([("A b!",), ("É",), ("x" * 90,)], "t string").select(text.slug(F.col("t")).alias("s"), text.file_slug(F.col("t")).alias("f")).collect()
    assert [tuple(r) for r in slugs][:2] == [("a-b", "a_b"), ("section", "draft_node")] and len(slugs[2].f) == 80
    rules = ingest.parse_rules("*.tmp #temporary\n\n# comment\nbuild/ #built\n**/cache\n")
    paths = spark.createDataFrame([("a/x.tmp",), ("build/y.py",), ("a/cache/z",), ("ok.py",)], "path string")
    assert [r[0] for r in paths.select(ingest.ignored(F.col("path"), rules)).collect()] == ["temporary", "built", "ignored", None]
    code = ingest.scan_code(paths, {".py": "python"}, rules).collect()
    assert {(r.path, r.handler, r.exempt) for r in code} == {("a/x.tmp", None, "temporary"), ("build/y.py", "python", "built"), ("a/cache/z", None, "ignored"), ("ok.py", "python", None)}
    assert "node_id: doc:intro" in df.select(ingest.draft(F.lit("Intro"), F.lit("s"), F.col("text"))).first()[0]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.md").write_text(guide("One", "draft", 1, "a", ["x.y"]))
    stream = lambda: ingest_available(document_stream(spark, str(src), GUIDE), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    stream()
    (src / "two.md").write_text("# broken")
    stream()
    got = {r.doc: r.error for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["one"] is None and "coverage" in got["two"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    assert sorted((r.n, r.total) for r in tumbling_counts(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_command_line(spark, tmp_path, capsys):
    spec = tmp_path / "models.yaml"
    spec.write_text("name: Memo\ntemplate: |\n  # ⸢rev•title⸥\n\n  By ⸢rev•author⸥\nfields:\n  title: {description: Title}\n  author: {description: Author}\nsemantics: {kind: memo}\n")
    run = lambda *a: cli.main(["--catalog", str(tmp_path / "c"), "--models", str(spec), *a], spark)
    assert run("stores", "init") == 0 and run("models", "add", "Memo") == 0
    assert run("docs", "create", "Memo", "first", "{title: Hello, author: Ann}") == 0
    assert run("docs", "create", "Memo", "first", "{title: Hello, author: Ann}") == 1
    assert run("fields", "update", "Memo", "first", "author", "Bo") == 0
    capsys.readouterr()
    assert run("get", "st.{Memo}.first.author") == 0 and capsys.readouterr().out.strip() == '"Bo"'
    assert run("find", "first", "--type", "doc", "--select", "name,kind") == 0 and capsys.readouterr().out.strip() == "first\tdoc"
    assert run("find", "nobody") == 1
    assert run("raw-find", "st.{Memo}", "--where", 'author = "Bo"') == 0 and "st.{Memo}.first" in capsys.readouterr().out
    assert run("stores", "check") == 0 and run("sections", "show", "first") == 0 and run("ast", "schema") == 0
    assert run("docs", "untrack", "first") == 0 and run("ls", "st.{Memo}") == 0
    assert run("ls", "zz") == 1


def _composed_of(spark, rows):
    docs = spark.createDataFrame([(d, f"{d}.md", t) for d, t in rows], "doc string, path string, text string")
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs)
    return {r.path.removesuffix(".md"): r.composed for r in links.compose(docs, found).collect()}, docs, found


def _whole(text, root):
    """Depth first, in reading order; what was met before comes with its own text, and line ends go."""
    met = set()

    def go(doc):
        if doc in met:
            return text[doc]
        met.add(doc)
        return re.sub(r"!\[\[(.*?)\]\]", lambda m: go(m[1]).rstrip() if m[1] in text else m[0], text[doc])

    return go(root)


def test_compose_deep_chains_and_cycles(spark):
    rows = [(f"c{i}", f"{i} ![[c{i + 1}]] ![[c40]]\n" if i < 14 else f"{i}\t \n\n") for i in range(15)] + [("c40", "end \u00a0\n")]
    rows += [("x", "x(![[y]] ![[c13]])"), ("y", "y(![[z]])\n"), ("z", "z(![[x]] ![[z]] ![[none]])"), ("w", "w(![[x]])\n")]
    rows += [("a", "A ![[b]] ![[c]]\n"), ("b", "B ![[d]]\n"), ("c", "C ![[d]] ![[d]]\n"), ("d", "D ![[e]]\n"), ("e", "E\n"), ("blank", "\n \n"), ("over", "x ![[blank]] y ![[blank]]\n"), ("once", "a![[e]]b\n")]
    rows += [(f"k{i}", " ".join(f"![[k{j}]]" for j in range(12) if j != i) + f" {i}\n") for i in range(12)]
    text = dict(rows)
    got, docs, found = _composed_of(spark, rows)
    assert got == {d: _whole(text, d) for d in text}
    assert got["a"] == "A B D E C D ![[e]] D ![[e]]\n"
    assert {r.path for r in links.reach_cycles(docs, found).collect()} == {f"{d}.md" for d in ("x", "y", "z", "w", *(f"k{i}" for i in range(12)))}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([" ", "\n", "x", "", "[[1]]"]), st.integers(0, 9)), max_size=4), min_size=1, max_size=8))
def test_compose_equals_a_walk(spark, made):
    text = {str(i): f"{i}" + "".join(f"{gap}![[{j}]]" for gap, j in parts) + "\n" for i, parts in enumerate(made)}
    assert _composed_of(spark, list(text.items()))[0] == {d: _whole(text, d) for d in text}


def test_descendants_at_any_depth(spark):
    edges = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(36)] + [("t36", "t0")], "parent string, child string")
    assert semantics.descendants(edges, "t0").count() == 37


def test_flattening_goes_to_any_depth(spark):
    deep, path = "1", ".".join(f"k{i}" for i in range(30))
    for i in reversed(range(30)):
        deep = json.dumps({f"k{i}": json.loads(deep)})
    df = spark.createDataFrame([(1, deep), (2, '{"a":"{","l":[{"x":{"y":1}}]}'), (3, "{}")], "i int, payload_json string")
    got = {(r.i, r.field_path, r.value_json) for r in fields.flatten_payloads(df, ["i"]).collect()}
    assert got == {(1, path, "1"), (2, "a", '"{"'), (2, "l", '[{"x":{"y":1}}]')}


def test_predicates_join(lib):
    assert names(lib.find("st.{Guide+}", 'status = "accepted" or coverage <= 88'), "doc") == ["local-special", "readme"]
    assert names(lib.find("st.{Guide+}", 'not status = "accepted" and (coverage >= 1 or has(nothing))'), "doc") == ["local-special"]
    for bad in ("", "and", "(coverage = 1", 'status = ""', "coverage = 1.", 'status = "a', "coverage == 1", "model <= 3 x", "has()", "coverage & 1"):
        with pytest.raises(PredicateError):
            lib.find("st.{Guide}", bad or "()")


def test_odd_addresses():
    for bad in ("", "st.", "st.A", "st.{}", "st.{A", "st.{A}x", "st.{A}.", "st.{A}.d.", "st.{A++}", "st.{+}", "st.{A{B}}", "se.", "gse.", "xx.a"):
        with pytest.raises(CatalogError):
            parse_address(bad)
    assert parse_address("st.{A}.d").doc == "d" and parse_address("gse.a.se.{}").root == "gse" and parse_address("gse.a.se.b.se.{x}").tag == "a.se.b"


def test_paths_and_relative_links(spark):
    paths = {"a/./b//c.md": "a/b/c.md", "a/b/../../c.md": "c.md", "../x": "../x", "../../x/..": "../..", "/a/../../b": "/b", "file:///a/b/../c.md": "file:/a/c.md", "hdfs://h/a/../b": "hdfs://h/b", "": ""}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(text.normal_path(F.col("p"))).collect()] == list(paths.values())
    rows = [("one", "file:///w/docs/one.md", "[[../top.md]] [[./sub/../two.md]] [[docs/two.md]] [[/w/top.md]] [[../../up.md]]"), ("two", "file:///w/docs/two.md", ""), ("t", "file:///w/top.md", "![[docs/one.md]]")]
    docs = spark.createDataFrame(rows, "doc string, path string, text string")
    found = links.resolve_links(links.parsed_links(docs, ["doc", "path"]), docs, "file:///w").collect()
    assert {(r.doc, r.target): r.target_path and r.target_path.rpartition("/")[2] for r in found} == {("one", "../top.md"): "top.md", ("one", "./sub/../two.md"): "two.md", ("one", "docs/two.md"): "two.md", ("one", "/w/top.md"): None, ("one", "../../up.md"): None, ("t", "docs/one.md"): "one.md"}
    cycle = spark.createDataFrame([("a", "a.md", "![[b]] ![[b]]"), ("b", "b.md", "![[a]] ![[gone]] [[c]]"), ("c", "c.md", "![[a]]"), ("d", "d.md", "")], "doc string, path string, text string")
    lists = links.transclusion_lists(links.resolve_links(links.parsed_links(cycle, ["doc", "path"]), cycle)).collect()
    assert {r.path: (r.transclusions, r.unresolved) for r in lists} == {p: (["a", "b"], ["gone"]) for p in ("a.md", "b.md", "c.md")}


def test_templates_alone(spark):
    template = "# ⸢rev•title⸥\n\n| A | B |\n| - | - |\n| ⸢rev•rows⸥ | ⸢rev•b⸥ |\n\n- ⸢rev,list•items⸥\n\nBy ⸢render•author⸥"
    text_ = "# T\n\n| A | B |\n| - | - |\n| 1 | 2 |\n\n- p\n- q\n\nBy Ann"
    got = extract.extract_with_template(spark.createDataFrame([(text_,)], "text string"), template).first()
    assert json.loads(got.payload_json) == {"title": "T", "rows": [{"rows": "1", "b": "2"}], "items": ["p", "q"]} and got.error is None
    payload = {"title": "T", "rows": {"10": {"rows": "c", "b": "3"}, "9": {"rows": "b", "b": "2"}, "x": {"rows": "d", "b": "4"}, "1": {"rows": "a", "b": "1"}}, "items": ["p"], "author": "Ann"}
    out = extract.render_with_template(spark.createDataFrame([(json.dumps(payload),)], "payload_json string"), template).first().text
    assert [x for x in out.split("\n") if x.startswith("| ")][2:] == ["| a | 1 |", "| b | 2 |", "| c | 3 |", "| d | 4 |"] and out.endswith("By Ann")


def test_trees(spark, lib):
    stores = {r.store: [(m.model, m.docs, [f.name for f in m.fields]) for m in r.models] for r in tree.tree_of(lib).collect()}
    fields_of = ["title", "status", "coverage", "abstract", "semantic_tags"]
    assert stores == {"child": [("SpecialGuide", ["special"], fields_of)], "local": [("Guide", ["readme"], fields_of), ("Note", ["note"], ["title", "body"]), ("SpecialGuide", ["local-special"], fields_of)]}
    assert tree.tree_of(lib, "models/Note").first().docs == ["note"]
    doc = tree.tree_of(lib, "docs/readme").first()
    assert doc.sections == ["project-guide", "project-guide/abstract", "project-guide/tags"] and doc.fields == sorted(fields_of)
    assert tree.tree_of(lib, "fields/readme/title").first().value == '"Project Guide"'
    with pytest.raises(CatalogError):
        tree.tree_of(lib, "docs/nobody")
    assert Counter(r.relation for r in tree.graph_edges(lib).collect()) == {"has_model": 4, "has_doc": 4, "has_section": 10, "has_field": 17}


def test_tag_postings(spark):
    rows = [(f"d{i:03}", "all") for i in range(200)] + [(f"d{i:03}", f"t{i % 3}") for i in range(50)] + [("d001", "all")]
    tags = spark.createDataFrame(rows, "doc string, tag string").repartition(7)
    got = {}
    for r in semantics.tag_postings(tags).orderBy("tag", "position").collect():
        got.setdefault(r.tag, []).append((r.position, r.doc))
    assert got == {t: list(enumerate(sorted(d for d, x in rows if x == t))) for t in ("all", "t0", "t1", "t2")}


def test_raw_sources_and_manifests(spark, tmp_path):
    for name in ("a.md", "sub/b.md", ".hidden/c.md", "build/d.md", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.path: r.hash for r in raw_documents(spark, str(tmp_path), [("build/", "built")]).collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.md", "sub/b.md")}
    assert read_manifest(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "m.csv").write_text("path,content_hash,status,created\na.md,h,new,t0\n")
    assert read_manifest(spark, str(tmp_path / "m.csv")).first().content_hash == "h"
    docs = docs_of(spark, ("local", "A", "same", "x"), ("local", "B", "same", "y"))
    write_documents(docs, str(tmp_path / "out"))
    assert {m: (tmp_path / "out" / "local" / m / "same.md").read_text() for m in "AB"} == {"A": "x\n", "B": "y\n"}


def test_locks_left_behind(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.init()
    lock = tmp_path / "c" / "LOCK"
    lock.write_text(json.dumps({"host": socket.gethostname(), "pid": os.getpid()}))
    with pytest.raises(CatalogError), catalog.lock():
        pass
    for left in ({"host": socket.gethostname(), "pid": 2**22 + 1}, {"host": "elsewhere", "pid": 1}):
        lock.unlink(missing_ok=True)
        (tmp_path / "c" / ".LOCK.crc").unlink(missing_ok=True)
        lock.write_text(json.dumps(left))
        os.utime(lock, (1, 1))
        with catalog.lock():
            assert lock.exists()
        assert not lock.exists()


def test_checks_on_the_command_line(spark, tmp_path, capsys):
    spec = tmp_path / "models.yaml"
    spec.write_text("name: Memo\ntemplate: |\n  # ⸢rev•title⸥\n\n  By ⸢rev•author⸥\nfields:\n  title: {description: Title}\n  author: {description: Author}\n")

    def run(*a):
        code = cli.main(["--catalog", str(tmp_path / "c"), "--models", str(spec), *a], spark)
        return code, capsys.readouterr().out

    assert run("stores", "init")[0] == 0 and run("models", "add", "Memo")[0] == 0
    assert run("stores", "check") == (0, "PASS local\nPASS local/Memo (docs 0, ok 0, benign 0, changed 0, missing 0)\n")
    for name in ("one", "two", "three"):
        assert run("docs", "create", "Memo", name, f"{{title: {name}, author: Ann}}", "--out", str(tmp_path / "docs"))[0] == 0
    assert run("docs", "create", "Memo", "kept", "{title: k, author: Bo}")[0] == 0
    assert run("stores", "check") == (0, "PASS local\nPASS local/Memo (docs 4, ok 4, benign 0, changed 0, missing 0)\n")
    file = tmp_path / "docs" / "one.md"
    (tmp_path / "docs" / ".one.md.crc").unlink(missing_ok=True)
    file.write_text(file.read_text().replace("\n\n", "\n\n\n"))
    assert run("stores", "check") == (0, "PASS local\nPASS local/Memo (docs 4, ok 3, benign 1, changed 0, missing 0)\n")
    (tmp_path / "docs" / "two.md").unlink()
    (tmp_path / "docs" / ".three.md.crc").unlink(missing_ok=True)
    (tmp_path / "docs" / "three.md").write_text("# other\n\nBy Ann\n")
    assert run("stores", "check") == (1, "FAIL local\nFAIL local/Memo (docs 4, ok 1, benign 1, changed 1, missing 1)\n")
    code, out = run("--format", "json", "stores", "check")
    assert code == 1 and json.loads(out)["model_reports"][0]["missing"] == 1 and json.loads(out)["hash_a_ok"]
    catalog = Catalog(spark, str(tmp_path / "c"))
    catalog.write(models=catalog.read("models").withColumn("hash_b", F.lit("x")))
    assert not json.loads(run("--format", "json", "stores", "check")[1])["model_reports"][0]["hash_b_ok"]
    assert run("models", "update", "Memo", "--bump")[0] == 0 and catalog.read("models").first().version == 2
    assert run("models", "edit", "Memo", "--add", "{name: more, description: More, optional: true}")[0] == 0
    assert "more" in run("models", "drafts")[1] and "more" in run("models", "edit", "Memo")[1]
    assert run("models", "edit", "Memo", "--promote")[0] == 0 and run("models", "drafts")[1] == ""
    assert run("find", "kept", "--type", "doc", "--select", "name")[1] == "kept\n" == run("find", "kept", "--global", "--rebuild", "--type", "doc", "--select", "name")[1]
    assert "title: k" in run("--format", "yaml", "legacy", "get", "st.{Memo}.kept")[1] or run("legacy", "get", "st.{Memo}.kept.title")[1] == '"k"\n'
    assert run("help", "exit")[0] == 0 and run("help", "nothing")[0] == 1
    assert run("ast", "show", "docs/kept")[0] == 0 and run("ast", "show", "stores")[0] == 0
    (tmp_path / "t.md").write_text("# ⸢rev•title⸥\n")
    (tmp_path / "d.md").write_text("# Hello\n")
    assert run("extract-template", str(tmp_path / "t.md"), str(tmp_path / "d.md"))[1].startswith('{"title":"Hello"}')
    assert run("render-template", str(tmp_path / "t.md"), "{title: Bye}")[1] == "# Bye\n"
    (tmp_path / "catalog").mkdir()
    (tmp_path / "catalog" / "CURRENT").write_text("{}")
    assert cli.find_catalog(str(tmp_path / "docs")) == str(tmp_path / "catalog")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(st.sampled_from(["# A", "## B b ##", "### ", "#x", "####### n", "text", "- item", "> quote", "", "# C #", "#\tD\t", "1. e", "| a | b |", "#   F ", "```", "<div>", "---", " # G", "    # code", "# H\r"]), st.text(alphabet="# ab\t-=>`~<", max_size=6)), max_size=9), min_size=20, max_size=20))
def test_headings_in_both_engines(spark, docs):
    df = spark.createDataFrame([(i, "\n".join(x) + "\n" * (i % 3)) for i, x in enumerate(docs)], "i int, text string")
    read = lambda q: {r.i: r.headings for r in sections.with_headings(df, quick=q).collect()}
    assert read(True) == read(False)


def test_expressions(spark):
    m = Model("E", "X", (Field("n", "int", "n"), Field("f", "float", "f"), Field("s", "str", "s"), Field("l", "list", "l"), Field("b", "bool", "b"), Field("d", "dict", "d", optional=True)))
    df = spark.createDataFrame([(7, 2.5, "ab", ["y", "x"], True, None)], m.schema.simpleString().replace("variant", "string")).withColumn("d", F.parse_json(F.lit("{}"))).select(F.struct("*").alias("p"))
    e = expressions.Expressions()
    values = {"n + 1": "8", "-n // 2": "-4", "-n % 3": "2", "n / 2": "3.5", "s + 'c'": "abc", "len(s) * len(l)": "4", "n > 3 and not b": "False", "'x' in l": "True", "'z' if n == 7 else s": "z", "max(n, 9, 1)": "9", "round(f)": "2", "int('12')": "12", "str(n) + '!'": "7!", "n / 0": None, "min(f, n)": "2.5"}
    made = df.select(*[e.column(x, F.col("p"), m.schema).alias(f"c{i}") for i, x in enumerate(values)]).first()
    assert dict(zip(values, made)) == values
    for bad in ("__import__('os')", "s.upper()", "open('x')", "[1]", "lambda: 1", "n if n else s", "d", "zz", "n + s", "1 < n < 3", "n **", "len(n)", "(" * 500, "n ** 2", "f'{n}'"):
        assert e.column(bad, F.col("p"), m.schema) is None, bad
    t = Model("T", "# ⸢rev•s⸥\n\n⸢py•n * 2⸥ ⸢py•s.x⸥", (m.fields[2], m.fields[0]))
    show = lambda ex: df.select(extract.render_column(t, F.col("p"), expressions=ex)).first()[0]
    assert show(e) == "# ab\n\n14 ⸢py•s.x⸥" and show(None) == show(expressions.Expressions(lambda source: False)) == "# ab\n\n⸢py•n * 2⸥ ⸢py•s.x⸥"


def test_own_grammars(spark):
    def names_of(block):
        return tuple(m.name for m in parse_marker_names(block.text))

    def parse_marker_names(t):
        return [parse_marker(x) for x in re.findall("⸢([^⸥]+)⸥", t)]

    def read(template, block):
        pairs = dict(x.split("=", 1) for x in block.text.split("\n") if "=" in x)
        return {n: pairs[n] for n in names_of(template) if n in pairs} or None

    def shouting(t):
        return [b if b.type != "paragraph" else dataclasses.replace(b, text=b.text.replace("c", "C")) for b in parse_blocks(t)]

    m = Model("Conf", "# ⸢rev•title⸥\n\n```\n⸢rev•a⸥\n⸢rev•b⸥\n```\n", (Field("title", "str", "t"), Field("a", "int", "a"), Field("b", "str", "b", optional=True)))
    df = spark.createDataFrame([("# T\n\n```\nx\n```\n\n```\na=1\nb=two\n```",), ("# T\n\n```\nb=3\n```",)], "text string")
    got = extract.extract_docs(df, m, grammar=templates.Grammar(handlers=(templates.BlockHandler("fence", names_of, read),))).collect()
    assert [tuple(r.payload) for r in got] == [("T", 1, "two"), ("T", None, "3")] and got[1].error
    loud = extract.extract_docs(spark.createDataFrame([("# a\n\nB: c",)], "text string"), Model("L", "# ⸢rev•t⸥\n\nB: ⸢rev•x⸥", (Field("t", "str", "t"), Field("x", "str", "x"))), grammar=templates.Grammar(shouting))
    assert tuple(loud.first().payload) == ("a", "C")


def test_scanners(spark):
    def todos(t):
        return [{"line": i, "text": x} for i, x in enumerate(t.split("\n")) if "TODO" in x]

    files = spark.createDataFrame([("a.py", "x\n# TODO é"), ("b.txt", "TODO"), ("c.js", "{"), ("d.py", None), ("e", "TODO")], "path string, text string")
    got = {(r.path, r.found, r.error) for r in ingest.run_scanners(files, {".py": todos, ".js": lambda t: json.loads(t)}).collect()}
    assert {x[:2] for x in got if x[2] is None} == {("a.py", '{"line": 1, "text": "# TODO é"}')} and [x[0] for x in got if x[2]] == ["c.js"]
