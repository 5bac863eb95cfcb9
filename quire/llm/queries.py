"""Queries that apply the operators of this folder to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .chat import format_conversations, read_back
from .common import cut, prepare
from .divergence import source_divergence
from .embedding_dup import embedding_duplicates
from .line_dedup import drop_recurring_lines
from .merkle import merkle_manifest, path_digest
from .mixing import mix, thresholds, word_count
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import quality_report
from .token_counts import count_tokens, vocabulary
from .toxicity import toxicity
from .url_filters import filter_urls

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A conversation whose texts hold control strings of common templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
CONTROL_TURNS = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    carry = ["doc_id", "piece", "start", F.crc32("ids").alias("ids_crc32")]
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), carry=carry)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path(PIECES)))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4, similarity=80)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(spark.createDataFrame(CONTROL_TURNS, turns.schema))))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    return drop_recurring_lines(docs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    sized = cut(read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(sized, thresholds(sized), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents")).drop("rejected_by")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(read(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filters": op7_url_filters,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

SQL: dict[str, str] = {}

SQL["op9_mixing"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM sources),
-- sources stop in the order of size per weight
steps AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER p, 0) AS size_before, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS weight_left
  FROM ranked WINDOW p AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (3 * total - 4 * size_before)::BIGINT AS num, weight_left::BIGINT AS weight FROM steps
  WHERE (3 * total - 4 * size_before) * w < 4 * weight_left * source_size
  ORDER BY source_size::DOUBLE / w, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN num * w >= 4 * weight * source_size THEN source_size::DOUBLE * 2
         ELSE num::DOUBLE * w / (2 * weight) END AS target FROM ranked, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         target - whole * source_size - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         target - whole * source_size - sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS room_after
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN room_after >= 0 OR 2 * room > size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""

SQL["op10_quality_rules"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS shouts
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * shouts > 40 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op3_minhash_near_dedup"] = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(ws[i : i + 3], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS t(i)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM linked JOIN w x ON x.r = a JOIN w y ON y.r = b),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS other FROM either UNION SELECT reach.id, either.b FROM reach JOIN either ON reach.other = either.a),
low AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(other, doc_id)) AS kept
FROM w LEFT JOIN n USING (r) LEFT JOIN low ON doc_id = id
"""

SQL["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
either AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS id, b AS other FROM either UNION SELECT reach.id, either.b FROM reach JOIN either ON reach.other = either.a),
low AS (SELECT id, min(other) AS other FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM either GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(other, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.id LEFT JOIN degree ON vec_id = degree.id
"""

SQL["op6_chat_formatting"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g') AS escaped,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g') AS escaped_role FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(escaped_role) + length(escaped) + 7))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

SQL["op7_url_filters"] = rf"""
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(x, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT r, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(v, length(h || p) * 1000 + length(h)) AS v
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hits USING (r)
"""



def _without_first(left: str, out: str) -> str:
    return f"""
{out}_first AS (SELECT k, min(fp) AS first FROM {left} GROUP BY k),
{out}_rest AS (SELECT k, fp, first FROM {left} JOIN {out}_first USING (k) WHERE fp <> first),
{out}_pairs AS (SELECT DISTINCT r.fp, r.first, x.words, x.own, y.words AS of_first FROM {out}_rest r JOIN alike x ON x.fp = r.fp JOIN alike y ON y.fp = r.first
  WHERE least(x.words, y.words) >= 0.8::DOUBLE * greatest(x.words, y.words)),
{out}_met AS (SELECT p.fp, p.first, p.words, p.of_first, p.own, a.i, a.n, bool_or(a.same) AS same
  FROM {out}_pairs p JOIN twins a ON a.fp = p.fp JOIN twins b ON b.fp = p.first AND b.k = a.k GROUP BY ALL),
{out}_sums AS (SELECT fp, first, words + of_first AS whole, sum(n) - 4 * (own - count(*)) AS common, count(*) FILTER (NOT same) AS edited FROM {out}_met GROUP BY fp, first, words, of_first, own),
{out}_copies AS (SELECT fp, first FROM {out}_sums WHERE common >= 0.8::DOUBLE * (whole - common) AND common - 5 * edited >= 0.63::DOUBLE * (whole - common + 5 * edited)),
{out} AS (SELECT k, fp FROM {out}_rest ANTI JOIN {out}_copies USING (fp, first))"""


SQL["op8_line_dedup"] = rf"""
WITH d AS (SELECT doc_id, text, substr(md5(text), 1, 30) AS fp FROM documents),
texts AS (SELECT DISTINCT fp, text FROM d WHERE text IS NOT NULL),
l AS (SELECT fp, i, string_split(text, chr(10))[i] AS l FROM texts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
m AS (SELECT fp, i, l, regexp_replace(l, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS m FROM l),
t AS (SELECT fp, i, l, m, regexp_extract_all(m, '[^\x20\x09-\x0D]+') AS t FROM m),
n AS (SELECT fp, i, l, t, len(t) AS n, (len(t) + 7) // 8 AS per, least(3, (len(t) + 1) // 2) AS lead,
             len(t) - (length(m) - length(replace(m, '<*>', ''))) // 3 AS constant, array_to_string(t, ' ') AS whole FROM t WHERE len(t) > 0),
e AS (SELECT * FROM n WHERE constant >= 2),
-- leading, last and middle tokens; in lines of up to four the middle is at an end
paths AS (SELECT *, unnest([0, n - lead, CASE WHEN n > 4 THEN (n - lead) // 2 END]) AS start, unnest(['h', 't', 'm']) AS tree FROM e),
leaf AS (SELECT fp, i, t, n, per, constant, concat_ws('|', tree, n, array_to_string(t[start + 1 : start + lead], ' ')) AS leaf FROM paths WHERE start IS NOT NULL),
part AS (SELECT fp, i, n, per, constant, leaf, s, concat_ws('|', leaf, s, array_to_string(t[s * per + 1 : least(n, (s + 1) * per)], ' ')) AS k FROM leaf, unnest(range(0, (n + per - 1) // per)) AS u(s)),
fixed AS (SELECT k FROM part GROUP BY k HAVING count(DISTINCT fp) >= 3),
found AS (SELECT fp, i, n, constant, string_agg(k, '#' ORDER BY s) AS k, sum(least(n, (s + 1) * per) - s * per) AS kept FROM part SEMI JOIN fixed USING (k) GROUP BY fp, i, n, constant, leaf),
made AS (SELECT n || ' ' || whole AS k, fp, i, n FROM e
  UNION ALL SELECT k, fp, i, n FROM found WHERE kept < n AND 2 * kept >= n AND constant - (n - kept) >= 2),
hits AS (SELECT k, fp, i, n FROM made SEMI JOIN (SELECT k FROM made GROUP BY k HAVING count(DISTINCT fp) >= 3) USING (k)),
worded AS (SELECT * FROM n WHERE constant > 0),
half AS (SELECT fp, i, n, true AS same, 'w|' || l AS k FROM worded
  UNION ALL SELECT fp, i, n, false, concat_ws('|', q, n, array_to_string(t[2 * q * per + 1 : least(n, 2 * (q + 1) * per)], ' ')) FROM worded, unnest(range(4)) AS u(q) WHERE n > 2 * q * per),
twins AS (SELECT k, fp, i, n, same FROM half SEMI JOIN (SELECT k FROM half GROUP BY k HAVING count(DISTINCT fp) >= 2) USING (k)),
alike AS (SELECT fp, words, own FROM (SELECT fp, sum(n) AS again FROM (SELECT DISTINCT fp, i, n FROM twins) GROUP BY fp)
  JOIN (SELECT fp, sum(n) AS words, count(*) AS own FROM worded GROUP BY fp) USING (fp) WHERE again >= 0.8::DOUBLE * words),
three AS (SELECT DISTINCT k, fp FROM hits),{_without_first("three", "two")},{_without_first("two", "one")},
starts AS (SELECT fp, i, constant, whole, sum(constant) OVER (PARTITION BY fp ORDER BY i) - constant AS start FROM n WHERE constant > 0),
run AS (SELECT fp, sum(constant) OVER w AS tokens, list(whole) OVER w AS k, list(i) OVER w AS run FROM starts WINDOW w AS (PARTITION BY fp ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
long AS (SELECT fp, k, run FROM run WHERE tokens >= 50),
pairwise AS (SELECT DISTINCT k, fp FROM long WHERE k IN (SELECT k FROM long GROUP BY k HAVING count(DISTINCT fp) >= 2)),{_without_first("pairwise", "beyond")},
gone AS (SELECT fp, list(DISTINCT i) AS gone FROM (
  SELECT fp, i FROM hits SEMI JOIN one USING (k) UNION ALL SELECT fp, unnest(run) FROM long SEMI JOIN beyond USING (k)) GROUP BY fp)
SELECT doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
       CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
FROM d LEFT JOIN gone USING (fp)
"""

_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text"))

SQL["op11_merkle_manifest"] = rf"""
WITH RECURSIVE
bytes AS (SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
docs AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS hit FROM documents, bytes),
kept AS (SELECT doc_id, source, sha256({_FIELDS}) AS leaf FROM docs),
changed AS (SELECT doc_id, source, sha256({_FIELDS}) AS found FROM (SELECT * REPLACE (CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS text) FROM docs)),
leaves AS (SELECT kept.doc_id, leaf, found, dense_rank() OVER (ORDER BY kept.source NULLS FIRST) - 1 AS g,
  row_number() OVER (PARTITION BY kept.source ORDER BY kept.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY kept.source) AS n FROM kept POSITIONAL JOIN changed),
trees AS (SELECT g, 0 AS lvl, pos, n, leaf AS d FROM leaves
  UNION ALL SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM trees WHERE n > 1 GROUP BY g, lvl, pos // 3, n),
subroots AS (SELECT g, d AS subroot FROM trees WHERE n = 1),
tops AS (SELECT -1::BIGINT AS g, 0 AS lvl, g AS pos, count(*) OVER () AS n, subroot AS d FROM subroots
  UNION ALL SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY g, lvl, pos // 3, n),
nodes AS (SELECT * FROM trees UNION ALL SELECT * FROM tops),
sides AS (SELECT g, lvl, pos, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY g, lvl, pos // 3 ORDER BY pos)),
low AS (SELECT row_number() OVER () AS k, doc_id, leaf, g, 0 AS lvl, pos, n, found AS h, '' AS proof FROM leaves
  UNION ALL SELECT k, doc_id, leaf, s.g, s.lvl + 1, s.pos // 3, (s.n + 2) // 3, sha256(l || h || r), proof || l || r FROM low s JOIN sides USING (g, lvl, pos) WHERE s.n > 1),
high AS (SELECT k, doc_id, leaf, g AS of, -1::BIGINT AS g, 0 AS lvl, g AS pos, (SELECT count(*) FROM subroots) AS n, h, proof FROM low WHERE n = 1
  UNION ALL SELECT k, doc_id, leaf, of, s.g, s.lvl + 1, s.pos // 3, (s.n + 2) // 3, sha256(l || h || r), proof || l || r FROM high s JOIN sides USING (g, lvl, pos) WHERE s.n > 1),
top AS (SELECT d AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM high JOIN subroots ON of = subroots.g, top WHERE n = 1
"""

SQL["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
found AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM groups JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM every JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(v) AS v FROM p GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM whole),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (FROM pairs UNION ALL FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""

SQL["op13_nearest_neighbours"] = """
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
far AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([0::DOUBLE] || list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM far QUALIFY rank <= 10
"""
