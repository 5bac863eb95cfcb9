"""Line dedup by a log-template tree, in DataFrame functions only.

A line goes down a tree of fixed depth: its number of tokens, then its leading
tokens, where a token with a digit reads as a field ``<*>``. In the leaf that it
reaches, its tokens are taken in at most SEGMENTS segments (single tokens for
short lines), each by its place. A segment that MIN_DOCS distinct texts have in
that leaf is constant, any other one generalises to a field; lines of one leaf
with the same constants are one template. Two more trees take the last tokens and those
in the middle for the leading ones, so that fields at a line's start, and at both
its ends, generalise as well. A line with fields at all three places, none of which three texts share,
makes no template.

A template must keep half of its line's tokens. One that enough distinct texts
share recurs, and its lines are dropped from every document. All counts are over
all documents.

Copies count once towards a template, so that a group of copies, which
near-duplicate removal settles, keeps its lines. To count a template's texts, the
first one and its copies are taken away, then the next; what is left after all but
one decides. What copies are is told as near-duplicate removal would, by five-word shingles and
a similarity of COPY, from lines alone:

* A line is shared with another text if that has it, or a quarter of its segments
  at its place. Each line that isn't shared takes 4 words more from what is,
  the shingles across its ends. So texts that have a passage in common, but lines
  of their own as well, are no copies, unless near-duplicate removal would say so.
* Each shared line that differs takes 5 words more, the shingles of a changed word. With
  these the similarity may be as low as EDITED, which two texts have that are at
  COPY from a third one. So forms whose lines all differ in a word are no copies.

A run of lines with LONG constant tokens or more, one long line or several short
ones, is dropped from two texts on that aren't copies. Lines of one constant
token alone make no template and go only as part of a run; lines of fields stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, small, stored, tidy, unused

#: Distinct texts that make a template recur; tokens of a tree path, at most half of a line's; segments of a line; fewest constant tokens of a template; similarity of copies, and with what changed words take.
MIN_DOCS, LEAD, SEGMENTS, MIN_CONSTANT, COPY, EDITED = 3, 3, 8, 2, 0.8, 0.63
#: Shingles that are lost at the ends of a line of one's own, and by a changed word.
BETWEEN, CHANGED = 4, 5
#: Constant tokens of a run of lines that two texts make recur.
LONG = 50


def _fingerprint(text: Column) -> Column:
    """120 bits of an MD5, equal in every engine."""
    half = lambda at: F.conv(F.substring(F.md5(text), at, 15), 16, 10).cast("long")
    return F.struct(half(1).alias("h"), half(16).alias("g"))


def line_segments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(fp, line, n, per, constant, raw, whole, leaves, segments) for each line that has a word.

    ``n`` tokens, ``constant`` of them without a digit, ``per`` tokens a segment;
    hashes of the line as it is, of the line with fields, of its leaves and of its segments.
    """
    line = F.col("l")
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(line)
    spaced = F.col("m")
    for c in "\t\r\v\f":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    rows = docs.select(_fingerprint(F.col(text_col)).alias("fp"), F.col(text_col).alias("text"))
    rows = rows.select("fp", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    # a generator's output is computed once; a projection's would be computed again for each use
    rows = rows.select("fp", "line", F.xxhash64(F.lit(5), "l").alias("raw"), F.explode(F.array(masked)).alias("m"))
    rows = rows.select("fp", "line", "raw", "m", F.explode(F.array(F.array_remove(F.split(spaced, " "), ""))).alias("t"))
    rows = rows.withColumn("n", F.size("t")).where("n > 0")
    fields = F.when(F.contains("m", F.lit("<*>")), (F.length("m") - F.length(F.replace(F.col("m"), F.lit("<*>"), F.lit("")))) / 3).otherwise(0)
    rows = rows.withColumn("constant", (F.col("n") - fields).cast("int")).withColumn("per", F.ceil(F.col("n") / SEGMENTS).cast("int"))
    lead = F.least(F.lit(LEAD), F.floor((F.col("n") + 1) / 2)).cast("int")
    segment = lambda i: F.when(i * F.col("per") < F.col("n"), F.xxhash64(F.lit(i), F.slice("t", i * F.col("per") + 1, F.col("per"))))
    # in short lines the middle is at an end
    leaves = [F.xxhash64(F.lit(1), "n", F.slice("t", 1, lead)), F.xxhash64(F.lit(2), "n", F.slice("t", F.col("n") - lead + 1, lead))]
    middle = F.xxhash64(F.lit(6), "n", F.slice("t", F.floor((F.col("n") - lead) / 2).cast("int") + 1, lead))
    return rows.select(
        "fp", "line", "n", "per", "constant", "raw",
        F.xxhash64(F.lit(0), "n", "t").alias("whole"),
        F.when(F.col("n") > LEAD + 1, F.array(*leaves, middle)).otherwise(F.array(*leaves)).alias("leaves"),
        F.array(*map(segment, range(SEGMENTS))).alias("segments"),
    )


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that two texts or more have; combined where the rows lie."""
    return rows.groupBy(key).agg(F.min("fp.h").alias("low"), F.max("fp.h").alias("high")).where("low <> high").select(key)


def line_templates(lines: DataFrame, again: DataFrame, min_docs: int) -> DataFrame:
    """(template, fp, line, n): lines with the templates that they fit; whole lines of ``again`` (whole), those that two texts have, and generalised ones."""
    lines = lines.where(F.col("constant") >= MIN_CONSTANT)
    whole = lines.join(small(again), "whole").select(F.col("whole").alias("template"), "fp", "line", "n")
    leaves = lines.select("fp", "line", "n", "per", "constant", "segments", F.explode("leaves").alias("leaf"))
    shared = cut(_several(lines.select("fp", F.explode("leaves").alias("leaf")), "leaf"))
    leaves = stored(leaves.join(small(shared), "leaf"))
    parts = leaves.select("*", F.posexplode("segments").alias("i", "segment")).where("segment is not null").withColumn("key", F.xxhash64("leaf", "segment"))
    several = small(cut(_several(parts.select("key", "fp"), "key")))
    fixed = cut(parts.select("key", "fp").join(several, "key").groupBy("key").agg(F.count_distinct("fp").alias("d")).where(F.col("d") >= min_docs).select("key"))
    # a segment's key by its place; equal texts have a line's segments several times
    keys = [F.max(F.when(F.col("i") == i, F.col("key"))).alias(f"k{i}") for i in range(SEGMENTS)]
    found = parts.join(small(fixed), "key").groupBy("fp", "line", "n", "per", "constant", "leaf").agg(*keys)
    length = lambda i: F.least(F.col("n") - i * F.col("per"), F.col("per"))
    kept = sum((F.when(F.col(f"k{i}").isNotNull(), length(i)).otherwise(0) for i in range(SEGMENTS)), F.lit(0))
    # lines without a field are templates as whole lines
    found = found.withColumn("kept", kept).where("kept < n and 2 * kept >= n").where(F.col("constant") - (F.col("n") - F.col("kept")) >= MIN_CONSTANT)
    return whole.unionByName(found.select(F.xxhash64("leaf", *[F.coalesce(f"k{i}", F.lit(0)) for i in range(SEGMENTS)]).alias("template"), "fp", "line", "n")).distinct()


def line_parts(lines: DataFrame) -> DataFrame:
    """(fp, line, n, part, same): lines as they are, and each quarter of their segments."""
    wide = SEGMENTS // 4
    quarter = lambda i: F.when(F.col("n") > i * wide * F.col("per"), F.xxhash64(F.lit(i), "n", F.slice("segments", i * wide + 1, wide)))
    rows = lines.where("constant > 0").select("fp", "line", "n", F.posexplode(F.array("raw", *map(quarter, range(4)))).alias("kind", "part"))
    return rows.where("part is not null").select("fp", "line", "n", "part", (F.col("kind") == 0).alias("same"))


def runs(lines: DataFrame) -> DataFrame:
    """(fp, template, run): from each line on, the fewest lines with LONG constant tokens: a hash and their numbers."""
    rows = lines.where("constant > 0").select("fp", "line", "constant", "whole").dropDuplicates(["fp", "line"])
    order = Window.partitionBy("fp").orderBy("line")
    rows = rows.withColumn("start", F.sum("constant").over(order) - F.col("constant"))
    ahead = Window.partitionBy("fp").orderBy("start").rangeBetween(0, LONG - 1)
    found = rows.select("fp", F.sum("constant").over(ahead).alias("tokens"), F.collect_list("whole").over(ahead).alias("hashes"), F.collect_list("line").over(ahead).alias("run"))
    return found.where(F.col("tokens") >= LONG).select("fp", F.xxhash64("hashes").alias("template"), "run")


def recurring_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(fp, drop): for each text with recurring lines, their numbers from 0."""
    prepare(docs.sparkSession)
    lines = stored(line_segments(docs.where(F.col(text_col).isNotNull()), text_col))
    again = cut(_several(lines.where("constant > 0").select("fp", "whole"), "whole"))
    made = cut(line_templates(lines, again, min_docs))
    shared = cut(made.groupBy("template").agg(F.count_distinct("fp").alias("d")).where(F.col("d") >= min_docs).select("template"))
    hits = cut(made.join(small(shared), "template"))
    # lines of a run that recurs recur themselves, so texts without such lines have none
    in_two = lines.where("constant > 0").join(small(again), "whole", "left_semi").select("fp").distinct()
    long = cut(runs(lines.join(small(cut(in_two)), "fp", "left_semi")))
    long = cut(long.join(small(cut(_several(long, "template"))), "template"))
    # only copies among the texts that share a template or a run matter
    sharing = small(cut(hits.select("fp").unionByName(long.select("fp")).distinct()))
    sizes = cut(text_sizes(lines.join(sharing, "fp", "left_semi")))
    left = hits.select("template", "fp").distinct()
    for _ in range(min_docs - 1):
        left = without_first(left, lines, sizes)
    dropped = hits.join(small(cut(left.select("template").distinct())), "template").select("fp", "line")
    left = without_first(long.select("template", "fp").distinct(), lines, sizes)
    dropped = dropped.unionByName(long.join(small(cut(left.select("template").distinct())), "template").select("fp", F.explode("run").alias("line"))).distinct()
    return dropped.groupBy("fp").agg(F.collect_list("line").alias("drop"))


def text_sizes(lines: DataFrame) -> DataFrame:
    """(fp, words, lines): of lines that have a word without a digit, each once."""
    # documents of one text have each of its lines several times
    return lines.where("constant > 0").groupBy("fp", "line").agg(F.first("n").alias("n")).groupBy("fp").agg(F.sum("n").alias("words"), F.count("*").alias("lines"))


def alike(common: Column, words: Column, of_first: Column, least: float) -> Column:
    """Whether ``common`` words are ``least`` of all words of two texts."""
    return common >= least * (words + of_first - common)


def without_first(left: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """``left`` (template, fp) without each template's first text and the copies of that one."""
    first = left.groupBy("template").agg(F.min("fp").alias("first"))
    rest = cut(left.join(small(cut(first)), "template").where("fp <> first"))
    pairs = rest.select("fp", "first").distinct().join(sizes, "fp").join(sizes.select(F.col("fp").alias("first"), F.col("words").alias("of_first")), "first")
    # copies share most words of the longer one
    pairs = cut(pairs.where(F.least("words", "of_first") >= COPY * F.greatest("words", "of_first")))
    of = lambda name: line_parts(lines.join(small(cut(pairs.select(F.col(name).alias("fp")).distinct())), "fp", "left_semi"))
    theirs = of("first").select(F.col("fp").alias("first"), "part").distinct()
    both = of("fp").join(small(pairs), "fp").join(small(cut(theirs)), ["first", "part"])
    ofs = ["fp", "first", "words", "of_first", "lines"]
    common = both.groupBy(*ofs, "line").agg(F.first("n").alias("n"), F.bool_or("same").alias("same")).groupBy(*ofs).agg(F.sum("n").alias("common"), F.count("*").alias("met"), F.count_if(~F.col("same")).alias("edited"))
    shared = F.col("common") - BETWEEN * (F.col("lines") - F.col("met"))
    copies = common.where(alike(shared, F.col("words"), F.col("of_first"), COPY) & alike(shared - CHANGED * F.col("edited"), F.col("words"), F.col("of_first"), EDITED)).select("fp", "first")
    return cut(rest.join(small(cut(copies)), ["fp", "first"], "left_anti").select("template", "fp"))


@tidy
def drop_recurring_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with recurring lines taken out of the text; all rows and columns stay.

    Documents of equal text get equal results. A null text stays null; a text
    all of whose lines recur becomes empty; lines without words stay. Texts are
    read whole, however long. Repeated rows count once, as one text. An empty
    table stays empty. Columns of any name pass through.
    """
    h, g, drop, lines = unused(docs, "h", "g", "drop", "lines")
    # a table's size is known: it is broadcast if it is small, else texts are shuffled
    drops = stored(recurring_lines(docs, text_col, min_docs).select(F.col("fp.h").alias(h), F.col("fp.g").alias(g), F.col("drop").alias(drop)))
    fp = _fingerprint(F.col(text_col))
    left = docs.withColumn(h, fp["h"]).withColumn(g, fp["g"]).join(drops, [h, g], "left")
    split = F.when(F.col(drop).isNotNull(), F.split(F.col(text_col), "\n"))
    left = left.select("*", F.explode(F.array(split)).alias(lines))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop)), lambda i: F.get(F.col(lines), i)), "\n")
    return left.select(*[F.when(F.col(drop).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
