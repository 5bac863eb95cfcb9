"""Scalar functions of the document engine, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"(!)?\[\[([^\]]+)\]\]"


def slug(title: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of others as ``-``; ``section`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(bare == "", "section").otherwise(bare)


def file_slug(title: Column, most: int = 80) -> Column:
    """Like ``slug``, with ``_``, case folded last and at most ``most`` characters; ``draft_node`` if nothing is left."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(title, "[^a-zA-Z0-9]+", "_")), "^_|_$", "")
    cut = F.regexp_replace(F.substring(bare, 1, most), "_$", "")
    return F.when(cut == "", "draft_node").otherwise(cut)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def prefix_edges(tag: Column) -> Column:
    """Each proper prefix of a dotted tag with the next longer one, as array<struct<parent, child>>."""
    p = F.filter(F.split(tag, r"\."), lambda x: x != "")
    edge = lambda i: F.struct(F.array_join(F.slice(p, 1, i), ".").alias("parent"), F.array_join(F.slice(p, 1, i + 1), ".").alias("child"))
    # a sequence from 1 to 0 would count down
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), edge)).otherwise(F.array().cast("array<struct<parent: string, child: string>>"))


def normal_path(path: Column) -> Column:
    """``path`` without ``.``, ``..`` and empty parts; what leads above a root stays there; of a scheme's empty host one slash stays."""
    root = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*", 0)
    parts = F.split(F.substring(path, F.length(root) + 1, F.length(path)), "/")
    nothing = F.array().cast("array<string>")

    def step(open_: Column, part: Column) -> Column:
        up = (F.size(open_) > 0) & (F.try_element_at(open_, F.lit(-1)) != "..")
        back = F.when(up, F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0)))).when(root != "", open_).otherwise(F.concat(open_, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), open_).when(part == "..", back).otherwise(F.concat(open_, F.array(part)))

    return F.concat(F.regexp_replace(root, ":///+$", ":/"), F.array_join(F.aggregate(parts, nothing, step), "/"))


def links_in(text: Column) -> Column:
    """Links in order, as array<struct<raw, target, kind>>; ``![[x]]`` transcludes."""
    raw = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))
    one = lambda x: F.struct(
        x.alias("raw"),
        F.trim(F.regexp_extract(x, LINK, 2)).alias("target"),
        F.when(x.startswith("!"), "transclusion").otherwise("link").alias("kind"),
    )
    return F.transform(raw, one)


def about_terms(breadcrumbs: Column, tags: Column) -> Column:
    """Each breadcrumb, then its slug in words; then tags; the first of equal ones stays."""
    both = F.flatten(F.transform(breadcrumbs, lambda b: F.array(F.trim(b), F.replace(slug(b), F.lit("-"), F.lit(" ")))))
    return F.array_distinct(F.concat(both, tags))


def address(model: Column, doc: Column) -> Column:
    return F.concat(F.lit("st.{"), model, F.lit("}."), doc)


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression that both engines read: ``*``, ``?``, ``[…]``."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        close = pattern.find("]", i + 1) if c == "[" else -1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif close > 0:
            inner = pattern[i:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else "\\" + inner if inner.startswith("^") else inner) + "]"
            i = close + 1
        else:
            out += c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c
    return f"^{out}$"


def tag_pattern(pattern: str) -> str:
    """``**`` stands for anything, ``*`` for one or more characters that are no dot."""
    parts = ("[\\s\\S]*" if x == "**" else "[^.]+" if x == "*" else "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in x) for x in _split_stars(pattern))
    return "^" + "".join(parts) + "$"


def _split_stars(pattern: str) -> list[str]:
    out, i = [], 0
    while i < len(pattern):
        n = 2 if pattern.startswith("**", i) else 1
        if pattern[i] == "*":
            out.append(pattern[i : i + n])
            i += n
        else:
            out.append(pattern[i])
            i += 1
    return out
