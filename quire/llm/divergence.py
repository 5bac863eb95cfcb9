"""Source divergence audit by wide term vectors.

Terms are counted by language and source, added up where the texts lie. Each kept
term of a language becomes one row, an array of counts with one place a source.
Higher-order functions turn it into an array of smoothed shares, in whole billionths, and
emit what it adds to the distance of each pair of sources; sums by pair are
combined where the rows lie, so that what is shuffled is as large as the result.

A pair in which neither source has the term differs by a constant, the distance of
the two smallest shares. That is added once for all terms, and rows are emitted only
for pairs of which one source has the term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, small, stored, tidy

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text as terms have them: A-Z in lower case, what no term has as spaces.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms by language and source that a task adds up in memory before it sends its sums, and rows that it sends at once.
TERMS_HELD, ROWS_SENT = 400_000, 20_000
#: Documents of a language that keep a term; ranks of the part `term`.
MIN_DOCS, TOP = 30, 50
#: Added to each count.
PRIOR = 5


def share_sql(count: str, total: str) -> str:
    """1 + floor(10^9 * count / total), by long division in steps of 1000, exact for totals up to 9 * 10^15."""
    left, digits = count, []
    for unit in (1_000_000, 1_000, 1):
        digits.append(f"(({left}) * 1000L div {total}) * {unit}L")
        left = f"(({left}) * 1000L % {total})"
    return "1L + " + " + ".join(digits)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and documents that have the term.

    Separators are single bytes in UTF-8, so a text is cut in one pass over its bytes.
    A task adds up what it meets and hands on its sums once it holds TERMS_HELD.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, within) in held.items():
                terms = list(count)
                for at in range(0, len(terms), ROWS_SENT):
                    some = terms[at : at + ROWS_SENT]
                    columns = [pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([count[t] for t in some], pa.int64()), pa.array([within[t] for t in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = text.translate(BYTES).split()
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                count, within = held[lang, source]
                count.update(terms)
                within.update(set(terms))
            if sum(len(count) for count, _ in held.values()) > TERMS_HELD:
                yield from sums()
        yield from sums()

    found = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def numbered_sources(docs: DataFrame) -> DataFrame:
    """(lang, source, i, width): a language's sources from 0, and their number."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    of = Window.partitionBy("lang")
    return stored(groups.withColumn("i", F.row_number().over(of.orderBy("source")) - 1).withColumn("width", F.count("*").over(of).cast("int")))


def wide_vectors(counts: DataFrame, sources: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, counts): kept terms, with a count for each of the language's sources."""
    entries = counts.join(small(sources), ["lang", "source"]).groupBy("lang", "term", "width")
    entries = entries.agg(F.sort_array(F.collect_list(F.struct("i", "count"))).alias("e"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    # zeros fill what lies between the places that are there
    filled = "flatten(transform(e, (x, k) -> concat(array_repeat(0L, x.i - if(k = 0, 0, get(e, k - 1).i + 1)), array(x.count))))"
    return entries.select("lang", "term", F.expr(f"concat({filled}, array_repeat(0L, width - 1 - element_at(e, -1).i))").alias("counts"))


def with_shares(vectors: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vectors`` with p, q and zero, and (lang, terms, zero) for every language: shares by source and in the language, and shares of a term that a source hasn't."""
    total = vectors.select("lang", F.posexplode("counts").alias("i", "c")).groupBy("lang", "i").agg(F.sum("c").alias("n"))
    terms = vectors.groupBy("lang").agg(F.count("*").alias("terms"))
    known = sources.join(small(cut(total)), ["lang", "i"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("n"))
    known = known.join(small(cut(terms)), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    known = known.withColumn("d", F.transform("n.n", lambda n: n + PRIOR * F.col("terms"))).withColumn("all", F.aggregate("n.n", F.lit(0).cast("long"), lambda a, n: a + n) + PRIOR * F.col("terms"))
    known = cut(known.withColumn("zero", F.when(F.col("terms") > 0, F.expr(f"transform(d, x -> {share_sql(f'{PRIOR}L', 'x')})"))))
    rows = vectors.join(small(known), "lang")
    rows = rows.withColumn("p", F.expr(f"transform(counts, (c, i) -> {share_sql(f'c + {PRIOR}L', 'get(d, i)')})"))
    rows = rows.withColumn("q", F.expr(share_sql(f"aggregate(counts, 0L, (a, c) -> a + c) + {PRIOR}L", "all")))
    return rows.select("lang", "term", "counts", "zero", F.explode(F.array(F.struct("p", "q"))).alias("s")).select("lang", "term", "counts", "zero", "s.*"), known.select("lang", "terms", "zero")


def pair_sums(shares: DataFrame) -> DataFrame:
    """(lang, i, j, more): for i before j, what all terms that either has add beyond the distance of terms that neither has."""
    places = "sequence(0, size(counts) - 1)"
    other = f"filter({places}, j -> j > i and (get(counts, i) > 0 or get(counts, j) > 0))"
    more = "abs(get(p, i) - get(p, j)) - abs(get(zero, i) - get(zero, j))"
    pairs = F.expr(f"flatten(transform({places}, i -> transform({other}, j -> struct(i as i, j as j, {more} as more))))")
    return shares.select("lang", F.explode(pairs).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.more").alias("more"))


@tidy
def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and the terms that mark each one.

    Part `pair` has each other source of the language, with the sum of absolute
    differences of their shares over all kept terms; part `term` has the terms
    whose share in the source is above that in the language, ranked to ``top``.
    Null text, language and source read as ''; a group without terms gives every
    term its smallest share, and a language without kept terms has distances of 0
    and no terms. Repeated rows count each. Equal values are ranked by item.
    Texts count whole. An empty table gives an empty result; columns beside text,
    lang and source are ignored.

    A language's sources have to fit a row, since the result has a row for each
    pair of them.
    """
    prepare(docs.sparkSession)
    sources = numbered_sources(docs)
    vectors = stored(wide_vectors(term_counts(docs), sources, min_docs))
    shares, langs = with_shares(vectors, sources)
    shares = stored(shares)
    name = lambda i, out: sources.select("lang", F.col("i").alias(i), F.col("source").alias(out))
    sums = cut(pair_sums(shares))
    sums = sums.unionByName(sums.select("lang", F.col("i").alias("j"), F.col("j").alias("i"), "more"))
    # the result has these rows: all pairs of a language's sources
    every = sources.select("lang", "source", "i", F.explode(F.expr("filter(sequence(0, width - 1), j -> j <> i)")).alias("j"))
    every = every.join(small(langs), "lang").join(small(sums), ["lang", "i", "j"], "left").join(small(name("j", "item")), ["lang", "j"])
    base = F.when(F.col("terms") > 0, F.col("terms") * F.expr("abs(get(zero, i) - get(zero, j))")).otherwise(0)
    pairs = every.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("more", F.lit(0))).cast("long").alias("value"))
    marks = shares.select("lang", "term", F.explode(F.expr("filter(transform(counts, (c, i) -> struct(i as i, c as c, get(p, i) - q as value)), x -> x.c > 0 and x.value > 0)")).alias("x"))
    marks = marks.select("lang", F.col("x.i").alias("i"), F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.value").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    marks = marks.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(*order))).where(F.col("rank") <= top)
    marks = marks.join(small(name("i", "source")), ["lang", "i"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*out).unionByName(marks.select(*out))
