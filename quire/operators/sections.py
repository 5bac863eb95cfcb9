"""Sections of documents: hierarchy, breadcrumbs, about terms, ownership of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import about_terms, slug
from ..plans.markers import field_lines
from ..sources.blocks import parse_blocks

HEADINGS = "array<struct<title: string, level: int, line_start: int, line_end: int, body_end: int>>"
#: Lines that can change what a line with a hash at its start means: fences, HTML, underlines and rules, indented hashes; and characters that engines strip differently.
_PARSER_ONLY = r"(?md)^ {0,3}(```|~~~|<|=+[ \t]*$|-+[ \t]*$)|^ {1,3}#|[\r\x0b\x0c\x1c-\x1f\x85\u2028\u2029]"
_HASHES = r"(?d)^(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$"


def _parsed_headings(text: str) -> list[dict]:
    blocks = [b for b in parse_blocks(text) if b.type == "heading" and b.text]
    last = text.rstrip("\n").count("\n") + 1
    levels = [int(b.tag[1]) for b in blocks]
    ends = [next((blocks[j].start for j in range(i + 1, len(blocks)) if levels[j] <= levels[i]), last) for i in range(len(blocks))]
    return [{"title": b.text, "level": n, "line_start": b.start + 1, "line_end": b.end + 1, "body_end": e} for b, n, e in zip(blocks, levels, ends)]


def _line_headings(text: Column) -> Column:
    """Headings of a text in which each line with hashes at its start is one."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("l"), i.alias("i")))
    lines = F.filter(numbered, lambda x: x["l"].startswith("#") & x["l"].rlike(_HASHES))
    title = lambda x: F.regexp_replace(F.regexp_extract(x["l"], _HASHES, 2), r"(?U)^\s+|\s+$", "")
    level = lambda x: F.length(F.regexp_extract(x["l"], "^#+", 0))
    found = F.filter(F.transform(lines, lambda x: F.struct(title(x).alias("title"), level(x).alias("level"), x["i"].alias("i"))), lambda x: x["title"] != "")
    bare = F.regexp_replace(text, r"(?d)\n+\z", "")
    last = F.length(bare) - F.length(F.replace(bare, F.lit("\n"), F.lit(""))) + 1
    after = lambda h: F.filter(found, lambda x: (x["i"] > h["i"]) & (x["level"] <= h["level"]))
    end = lambda h: F.coalesce(F.get(after(h), F.lit(0))["i"], last)
    return F.transform(found, lambda h: F.struct(h["title"].alias("title"), h["level"].alias("level"), (h["i"] + 1).alias("line_start"), (h["i"] + 2).alias("line_end"), end(h).alias("body_end"))).cast(HEADINGS)


def with_headings(docs: DataFrame, text_col: str = "text", quick: bool = True) -> DataFrame:
    """``docs`` and ``headings``: titled top-level headings in order.

    ``line_start`` is 1-based; ``line_end`` is the heading's own last line plus
    one; ``body_end`` is the last line before the next heading of its level or
    above, or the document's last. Texts without fences, HTML, underlined and
    indented headings are read in the JVM; others reach the block parser.
    """

    @F.udf(returnType=HEADINGS, useArrow=True)
    def parse(text):
        return None if text is None else _parsed_headings(text)

    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = ~text.rlike(_PARSER_ONLY) if quick else F.lit(False)
    rows = docs.select("*", plain.alias("_plain"), parse(F.when(~plain, text)).alias("_parsed"))
    return rows.select(*docs.columns, F.when(F.col("_plain"), _line_headings(text)).otherwise(F.col("_parsed")).alias("headings"))


def placed(headings: Column) -> Column:
    """Headings with slug, path and breadcrumbs, by one fold with a stack of the open ones."""
    entry = "struct<title: string, level: int, line_start: int, line_end: int, body_end: int, slug: string, path: string, breadcrumbs: array<string>>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("open"), F.array().cast(f"array<{entry}>").alias("done"))

    def step(state: Column, h: Column) -> Column:
        above = F.filter(state["open"], lambda x: x["level"] < h["level"])
        own = slug(h["title"])
        now = F.struct(
            h["title"].alias("title"), h["level"].alias("level"), h["line_start"].alias("line_start"), h["line_end"].alias("line_end"), h["body_end"].alias("body_end"),
            own.alias("slug"),
            F.array_join(F.concat(F.transform(above, lambda x: x["slug"]), F.array(own)), "/").alias("path"),
            F.concat(F.transform(above, lambda x: x["title"]), F.array(h["title"])).alias("breadcrumbs"),
        )
        one = F.array(now).cast(f"array<{entry}>")
        return F.struct(F.concat(above, one).alias("open"), F.concat(state["done"], one).alias("done"))

    return F.aggregate(headings, start, step, lambda s: s["done"])


def sections(docs: DataFrame, keys: list[str], tags: Column | None = None, text_col: str = "text") -> DataFrame:
    """One row per section: ``keys``, position, title, level, lines, slug, path, parent, breadcrumbs, about."""
    with_tags = docs.select(*keys, F.col(text_col), F.coalesce(tags if tags is not None else F.array().cast("array<string>"), F.array().cast("array<string>")).alias("_tags"))
    rows = with_headings(with_tags, text_col).select(*keys, "_tags", F.posexplode(placed(F.col("headings"))).alias("position", "s"))
    return rows.select(
        *keys, "position", "s.*",
        F.when(F.col("s.path").contains("/"), F.regexp_replace("s.path", "/[^/]*$", "")).alias("parent"),
        about_terms(F.col("s.breadcrumbs"), F.col("_tags")).alias("about"),
    )


def html_headings(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """(keys, position, heading): headings of raw pages that hold text alone, in order."""
    found = F.regexp_extract_all(html_col, F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))
    return pages.select(*keys, F.posexplode(found).alias("position", "heading"))


def owner_before(rows: DataFrame, groups: list[str], order: list[str], mark: Column, name: str) -> DataFrame:
    """``rows`` with ``owner``: the column ``name`` of the last marked row of its group at or before it, as a field's section is the last heading before it.

    A group that is too large for a task should be cut by time first.
    """
    upto = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("owner", F.last(F.when(mark, F.col(name)), ignorenulls=True).over(upto))


def owning_section(placed_headings: Column, line: Column) -> Column:
    """Path of the last section, by line and then path, that starts at or before ``line``; null if none does."""
    before = F.filter(placed_headings, lambda s: s["line_start"] <= line)
    last = F.array_max(F.transform(before, lambda s: F.struct(s["line_start"].alias("line"), s["path"].alias("path"))))
    return last["path"]


def field_owners(docs: DataFrame, keys: list[str], template: str, text_col: str = "text") -> DataFrame:
    """(keys, field, line, owning_section): each template field's line among each document's sections."""
    lines = field_lines(template)
    fields = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("line")) for n, k in lines.items()]) if lines else F.array().cast("array<struct<field: string, line: int>>")
    at = with_headings(docs.select(*keys, text_col), text_col).select(*keys, placed(F.col("headings")).alias("_p"), F.explode(fields).alias("f"))
    return at.select(*keys, "f.field", "f.line", owning_section(F.col("_p"), F.col("f.line")).alias("owning_section"))
