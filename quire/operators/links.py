"""Links between documents: parsing, resolving, recovering, composing."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import links_in, normal_path


#: Parts in which links to one target meet what it means.
SPREAD = 16


def parsed_links(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, ord, raw, target, kind): each document's links in order."""
    return docs.select(*keys, F.posexplode(links_in(F.col(text_col))).alias("ord", "l")).select(*keys, "ord", "l.*")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def resolve_links(links: DataFrame, docs: DataFrame, base: str = "") -> DataFrame:
    """``links`` (doc, path, target, …) with resolved, target_path, source.

    A target is a tracked name, else a path beside the document, else a path
    from ``base``, the working directory. Paths are compared without ``.`` and
    ``..``; target_path is the one that the document has. Of documents that
    share a name the first by path is meant, and ambiguous is set.
    """
    names = docs.groupBy("doc").agg(F.min("path").alias("by_name"), (F.count("*") > 1).alias("several")).withColumnRenamed("doc", "target")
    paths = docs.groupBy(normal_path(F.col("path")).alias("normal")).agg(F.min("path").alias("known"))
    rooted = F.when(F.col("target").rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), F.col("target"))
    beside = normal_path(F.coalesce(rooted, F.concat("_folder", "target")))
    direct = normal_path(F.coalesce(rooted, F.concat(F.lit(base.rstrip("/") + "/" if base else ""), "target")))
    # what a target means depends on it and the folder alone; a target that many link to is looked up once a folder
    asked = links.select(_folder(F.col("path")).alias("_folder"), "target").distinct().join(names, "target", "left")
    asked = asked.withColumn("_beside", beside).join(paths.toDF("_beside", "_beside_path"), "_beside", "left")
    asked = asked.withColumn("_direct", direct).join(paths.toDF("_direct", "_direct_path"), "_direct", "left")
    asked = asked.select("_folder", "target", "by_name", "several", "_beside_path", "_direct_path")
    # links of one folder to one target may be many: they are dealt over SPREAD parts, each with its own copy of the answer
    part = F.pmod(F.xxhash64("path", "doc"), F.lit(SPREAD)).cast("int")
    found = links.withColumn("_folder", _folder(F.col("path"))).withColumn("_part", part)
    found = found.join(asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), ["_folder", "target", "_part"], "left")
    path = F.coalesce("by_name", "_beside_path", "_direct_path")
    return found.select(
        *links.columns,
        path.isNotNull().alias("resolved"),
        path.alias("target_path"),
        F.when(F.col("by_name").isNotNull(), "store").when(path.isNotNull(), "path").alias("source"),
        F.coalesce("several", F.lit(False)).alias("ambiguous"),
    )


def first_links(links: DataFrame, keys: list[str]) -> DataFrame:
    """The first of links with equal target and kind, by ``ord``."""
    order = Window.partitionBy(*keys, "target", "kind").orderBy("ord")
    return links.where("true").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def recover_links(resolved: DataFrame, start: DataFrame, depth: int = 1, transclusions: bool = True) -> DataFrame:
    """Links reachable from ``start`` (path) within ``depth`` steps: (root, depth, path, ord, target, kind, resolved, target_path).

    Goes by shortest distance, a document once for each root, so cycles end; a
    link's first appearance stays. Without ``transclusions`` those are left out.
    """
    links = resolved.where("kind = 'link'") if not transclusions else resolved
    links = links.select("path", "ord", "target", "kind", "resolved", "target_path")
    front = start.select(F.col("path").alias("root"), "path").distinct()
    seen, out = front, None
    for d in range(1, depth + 1):
        step = front.join(links, "path").withColumn("depth", F.lit(d))
        out = step if out is None else out.unionByName(step)
        if d < depth:
            front = step.where("resolved").select("root", F.col("target_path").alias("path")).distinct().join(seen, ["root", "path"], "left_anti")
            if d > 1:
                front = front.checkpoint()  # each step would otherwise repeat those before
            seen = seen.unionByName(front)
    order = Window.partitionBy("root", "target", "kind").orderBy("depth", "path", "ord")
    return out.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").select("root", "depth", "path", "ord", "target", "kind", "resolved", "target_path")


def _bare(text: Column) -> Column:
    """``text`` without white space at its end, as what is put in comes."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+\z", "")


def _occurrences(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, ord, raw, target_path): transclusions of documents that are there."""
    inner = resolved.where("kind = 'transclusion' and resolved").select("path", "ord", "raw", "target_path").distinct()
    return inner.join(docs.select(F.col("path").alias("target_path")).distinct(), "target_path", "left_semi").checkpoint()


def _trees(docs: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, composed, reach) of documents whose transclusions are a tree, composed from the leaves up; and (path) of all others.

    A document is in no tree if it reaches another one twice, or itself.
    """
    texts = docs.select("path", F.col("text").alias("composed"))
    done = texts.join(inner, "path", "left_anti").withColumn("reach", F.array("path")).checkpoint()
    left, shared = texts.join(inner, "path", "left_semi").checkpoint(), None
    while not left.isEmpty():
        # what lies above a shared document is shared as well
        blocked = inner.join(left.select(F.col("path").alias("target_path")), "target_path", "left_semi").select("path")
        ready = left.join(blocked, "path", "left_anti").checkpoint()
        if ready.isEmpty():
            break
        parts = inner.join(ready.select("path"), "path", "left_semi").join(done.select(F.col("path").alias("target_path"), _bare(F.col("composed")).alias("part"), "reach"), "target_path", "left")
        parts = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "raw", "part"))).alias("parts"), F.flatten(F.collect_list("reach")).alias("below"), F.count_if(F.col("part").isNull()).alias("unknown"))
        reach = F.concat(F.array("path"), "below")
        met = ready.join(parts, "path").withColumn("reach", reach).withColumn("tree", (F.col("unknown") == 0) & (F.size("reach") == F.size(F.array_distinct("reach"))))
        mark = lambda x: F.concat(F.lit("\0"), x["ord"].cast("string"), F.lit("\0"))
        marked = F.aggregate("parts", F.col("composed"), lambda acc, x: F.replace(acc, x["raw"], mark(x)))
        spliced = F.aggregate("parts", marked, lambda acc, x: F.replace(acc, mark(x), x["part"]))
        met = met.select("path", "tree", F.when(F.col("tree"), spliced).alias("composed"), F.when(F.col("tree"), F.col("reach")).alias("reach")).checkpoint()
        done = done.unionByName(met.where("tree").drop("tree")).checkpoint()
        more = met.where("not tree").select("path")
        shared = more if shared is None else shared.unionByName(more)
        left = left.join(ready, "path", "left_anti").checkpoint()
    shared = left.select("path") if shared is None else shared.unionByName(left.select("path"))
    return done, shared


def _reached(start: DataFrame, inner: DataFrame) -> DataFrame:
    """(root, path): all that each path of ``start`` leads to by ``inner`` (path, target_path), and itself."""
    front = start.select(F.col("path").alias("root"), "path").distinct().checkpoint()
    seen, edges = front, inner.select("path", "target_path").distinct()
    while not front.isEmpty():
        step = front.join(edges, "path").select("root", F.col("target_path").alias("path")).distinct()
        front = step.join(seen, ["root", "path"], "left_anti").checkpoint()
        seen = seen.unionByName(front)
    return seen


def _in_order(root: str, texts: dict[str, str], inner: dict[str, list[tuple[str, str]]]) -> str:
    """The text of ``root``: what is met first, in reading order, is put in composed, what was met before with its own text."""
    met, out = {root}, []
    open_: list[tuple[str, int, int, int]] = [(root, 0, 0, 0)]  # path, place in the text, in its links, and of its start in out
    while open_:
        path, at, k, start = open_.pop()
        text, links = texts[path], inner.get(path, [])
        while k < len(links):
            raw, target = links[k]
            place = text.find(raw, at)
            if place < 0:
                k += 1
                continue
            out.append(text[at:place])
            at, k = place + len(raw), k + 1
            if target not in met:
                met.add(target)
                open_ += [(path, at, k, start), (target, 0, 0, len(out))]
                break
            out.append(texts[target].rstrip())
        else:
            out.append(text[at:])
            if open_:
                # the end of what was put in goes, over as many pieces as are blank
                while len(out) > start:
                    out[-1] = out[-1].rstrip()
                    if out[-1]:
                        break
                    out.pop()
    return "".join(out)


def transclusion_lists(resolved: DataFrame) -> DataFrame:
    """(path, transclusions, unresolved): what composing each document puts in, at any depth, and what it can't find; sorted, each once.

    Documents that include nothing have no row. A document is gone through once
    for each root, so cycles end.
    """
    inner = resolved.where("kind = 'transclusion'").select("path", "target", "resolved", "target_path").distinct().checkpoint()
    front = inner.select(F.col("path").alias("root"), "path").distinct()
    seen = front
    while True:
        step = front.join(inner.where("resolved"), "path").select("root", F.col("target_path").alias("path")).distinct()
        front = step.join(seen, ["root", "path"], "left_anti").checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    rows = seen.join(inner, "path").select(F.col("root").alias("path"), "target", "resolved").distinct()
    some = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("target"))))
    return rows.groupBy("path").agg(some(F.col("resolved")).alias("transclusions"), some(~F.col("resolved")).alias("unresolved"))


def reach_cycles(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path): documents whose transclusions lead into a cycle."""
    inner = _occurrences(docs, resolved)
    edges = inner.select("path", "target_path").distinct().checkpoint()
    while True:
        # what includes nothing that is left can't reach a cycle
        some = edges.join(edges.select(F.col("path").alias("target_path")).distinct(), "target_path", "left_semi").checkpoint()
        if some.count() == edges.count():
            return edges.select("path").distinct()
        edges = some


def compose(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(path, composed): texts with resolved transclusions spliced in, however deep.

    From each root on, a document is gone into once, where it is met first in
    reading order; where it is met again, in a diamond or a cycle, its own text is
    put in. White space at the end of what is put in goes. Unresolved
    transclusions stay as written.

    Documents whose transclusions are a tree are composed from the leaves up, by
    expressions. For others the documents that each reaches are gathered by joins,
    and put in order in one task a root, which holds what the result's row holds.
    """
    inner = _occurrences(docs, resolved)
    done, shared = _trees(docs, inner)
    done = done.select("path", "composed")
    if shared.isEmpty():
        return done
    links_of = inner.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "raw", "target_path"))).alias("links"))
    parts = docs.select("path", "text").join(links_of, "path", "left")
    rows = _reached(shared, inner).join(parts, "path").select("root", "path", "text", F.to_json("links").alias("links"))

    def run(found: pa.Table) -> pa.Table:
        paths, root = found.column("path").to_pylist(), found.column("root")[0].as_py()
        links = [[(x["raw"], x["target_path"]) for x in json.loads(v or "[]")] for v in found.column("links").to_pylist()]
        made = _in_order(root, dict(zip(paths, found.column("text").to_pylist())), dict(zip(paths, links)))
        return pa.table({"path": [root], "composed": [made]})

    return done.unionByName(rows.groupBy("root").applyInArrow(run, "path string, composed string"))


def composed_field(parents: DataFrame, keys: list[str], refs: str, children: DataFrame, line: Column, separator: str = "\n") -> DataFrame:
    """(keys, composed): one line for each child that ``refs``, an array of names, lists and that exists, in order."""
    lines = children.select(F.col("doc").alias("_ref"), line.alias("_line"))
    rows = parents.select(*keys, F.posexplode_outer(refs).alias("_ord", "_ref"))
    found = rows.join(lines, "_ref", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_ord", "_line")))).alias("_l"))
    return found.select(*keys, F.array_join(F.transform("_l", lambda x: x["_line"]), separator).alias("composed"))
