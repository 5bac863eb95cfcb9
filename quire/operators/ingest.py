"""Raw sources into drafts: decomposition, summaries, manifests, ignore rules, roll-ups."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_slug, glob_pattern


def decompose(sources: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, part, title, content, node_type): sources cut before each ``## `` line; parts without text go.

    A title is the part's first line without hashes; rules and standards are ``doc_standard``, others ``doc``.
    """
    parts = sources.select(*keys, F.posexplode(F.split(F.col(text_col), r"\n(?=## )")).alias("part", "content")).where(F.trim("content") != "")
    title = F.trim(F.regexp_replace(F.split("content", "\n")[0], "^#+", ""))
    kind = F.when(F.lower(title).rlike("rule|standard"), "doc_standard").otherwise("doc")
    return parts.select(*keys, "part", title.alias("title"), "content", kind.alias("node_type"))


def abstract(text: Column) -> Column:
    """The first line with text that is no heading; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def summary(text: Column) -> Column:
    """The first heading's text, else the first line with text."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    heading = F.try_element_at(F.filter(lines, lambda x: x.rlike("^#{1,6}\\s")), F.lit(1))
    return F.coalesce(F.trim(F.regexp_replace(heading, "^#+", "")), F.try_element_at(lines, F.lit(1)), F.lit(""))


def draft(title: Column, source: Column, content: Column) -> Column:
    """A draft document with front matter, abstract and details."""
    node = F.concat(F.lit("doc:"), file_slug(title))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("node_id: "), node), F.concat(F.lit("source: "), source), F.lit("---"), F.concat(F.lit("# "), title), F.lit(""), F.lit("## Abstract"), F.lit(""), abstract(content), F.lit(""), F.lit("## Details"), F.lit(""), content)


def drafts_index(drafts: DataFrame, path: str = "path", title: str = "title") -> DataFrame:
    """(folder, index): for each first part of a path, a list of its drafts by title."""
    line = F.concat(F.lit("- ["), F.col(title), F.lit("]("), F.col(path), F.lit(")"))
    return drafts.groupBy(F.split(path, "/")[0].alias("folder")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(title).alias("t"), line.alias("l")))), lambda x: x["l"]), "\n").alias("index"))


def upsert_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``manifest`` (path, content_hash, status, created) with ``found`` (path, content_hash, created): new paths come in, changed hashes take the new time."""
    old, new = manifest.alias("o"), found.alias("n")
    both = old.join(new, F.col("o.path") == F.col("n.path"), "full")
    changed = F.col("n.path").isNotNull() & ~F.col("n.content_hash").eqNullSafe(F.col("o.content_hash"))
    return both.select(
        F.coalesce("o.path", "n.path").alias("path"),
        F.when(changed, F.col("n.content_hash")).otherwise(F.col("o.content_hash")).alias("content_hash"),
        F.coalesce("o.status", F.lit("new")).alias("status"),
        F.when(changed, F.col("n.created")).otherwise(F.col("o.created")).alias("created"),
    )


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the last rule (pattern, reason) that fits a path, null if none does.

    ``dir/`` and ``dir/**`` mean all below, ``**/name`` the name at any depth.
    """
    out = F.lit(None).cast("string")
    name = F.regexp_extract(path, "[^/]*$", 0)
    for pattern, reason in rules:
        bare = pattern.removesuffix("/**").removesuffix("/")
        test = path.rlike(glob_pattern(pattern)) | name.rlike(glob_pattern(pattern))
        if bare != pattern:
            test = test | (path == bare) | path.startswith(bare + "/")
        if pattern.startswith("**/"):
            part = pattern[3:].rstrip("/")
            test = test | F.concat(F.lit("/"), path, F.lit("/")).contains(f"/{part}/")
        out = F.when(test, reason).otherwise(out)
    return out


def parse_rules(text: str) -> list[tuple[str, str]]:
    """Lines ``pattern #reason``; blank lines and comments are skipped."""
    rules = []
    for line in text.splitlines():
        pattern, _, reason = line.partition("#")
        if pattern.strip():
            rules.append((pattern.strip(), reason.strip() or "ignored"))
    return rules


def run_scanners(files: DataFrame, scanners: dict[str, Callable[[str], list[dict]]]) -> DataFrame:
    """(path, found, error): what the scanner of a file's extension finds in its text, one JSON object a row.

    A scanner that fails stops nothing: its message comes as the file's only
    row. Files (path, text) without a scanner, or with a null text, have none.
    """

    @F.udf(returnType="array<struct<found: string, error: string>>", useArrow=True)
    def scan(path, text):
        scanner = scanners.get(re.search(r"(\.[^./]+)?$", path or "")[0])
        if scanner is None or text is None:
            return []
        try:
            return [{"found": json.dumps(x, ensure_ascii=False, sort_keys=True), "error": None} for x in scanner(text)]
        except Exception as e:
            return [{"found": None, "error": f"{type(e).__name__}: {e}"}]

    return files.select("path", F.inline(scan("path", "text")))


def scan_code(files: DataFrame, plugins: dict[str, str], rules: list[tuple[str, str]]) -> DataFrame:
    """(path, handler, exempt): which plugin reads a file by its extension, and why it is exempt if so."""
    extension = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    handler = F.lit(None).cast("string")
    for ext, name in plugins.items():
        handler = F.when(extension == ext, name).otherwise(handler)
    return files.select("path", handler.alias("handler"), ignored(F.col("path"), rules).alias("exempt")).where("handler is not null or exempt is not null")

