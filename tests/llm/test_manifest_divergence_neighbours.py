import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, common, divergence, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g long, path string, row int, i int, n int, digest string"
CLASHES = (5, "p", 6, 7, 8, "d")


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA)


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and for each node the (left, right) siblings up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            start = p - p % 3
            paths[k].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + 3])))
        at = [p // 3 for p in at]
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, path, folded root, verified), line feeds taken out of documents with an even id."""
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = tree([leaf_of(*r) for r in sources[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = Counter()
    for s, top in zip(order, tops):
        for r, low in zip(sources[s], trees[s][1]):
            path, text = low + top, r[1]
            h = leaf_of(r[0], text.replace("\n", "") if text is not None and r[0] is not None and r[0] % 2 == 0 else text, *r[2:])
            for left, right in path:
                h = H(left, h, right)
            out[r[0], leaf_of(*r), trees[s][0], root, tuple(path), h, h == root] += 1
    return out


def manifest_rows():
    rng = random.Random(1)
    rows = []
    for source, n in [(None, 5), ("", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 9), ("e", 10), ("f", 27), ("g", 28), ("h", 82), ("é", 55), ("\U0001f600", 244)]:
        for _ in range(n):
            text = "\n".join("".join(rng.choice("ab ü\U0001f600") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(4)))
            rows.append((rng.randrange(10_000), text, rng.choice(["en", None, ""]), source, rng.choice([None, len(text)])))
    rows += [(7, None, None, "x", None), (None, None, None, None, None), (None, "", "en", "x", 0), (8, "a\nb", "en", "x", 3), (8, "a\nb", "en", "x", 3), (8, "c\nd", "en", "x", 3), (9, "long\n" * 200_000, "en", "y", 1)]
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_manifest(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(merkle, "BROADCAST_PATHS", 0)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = manifest_rows()
    tampered = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.merkle_manifest(docs_of(spark, rows).repartition(5), tampered).collect()
    assert Counter((*r[:4], tuple(map(tuple, r.path)), *r[5:]) for r in got) == brute_manifest(rows)


def test_manifests_of_few_rows(spark):
    assert merkle.merkle_manifest(docs_of(spark, [])).count() == 0
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "b", "en", None, 1)], [(i, "a", "en", "s", 1) for i in range(1, 4)], [(2 * i, "a\nb", "en", f"s{i}", 1) for i in range(40)]):
        got = merkle.merkle_manifest(docs_of(spark, rows)).collect()
        want = {k[:5] for k in brute_manifest(rows)}
        assert {(*r[:4], tuple(map(tuple, r.path))) for r in got} == want and all(r.verified for r in got)


def test_a_manifest_sees_any_change(spark):
    rows = manifest_rows()[:60]
    root = merkle.merkle_manifest(docs_of(spark, rows)).first().root
    for i, change in ((3, (3, "x", "en", None, 1)), (40, (*rows[40][:4], 99))):
        assert merkle.merkle_manifest(docs_of(spark, [*rows[:i], change, *rows[i + 1 :]])).first().root != root
    assert merkle.merkle_manifest(docs_of(spark, rows[::-1])).first().root == root


# source divergence


def brute_divergence(rows, min_docs, top):
    found = re.compile(divergence.TERM)
    counts, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = found.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for (at, t), n in docs.items() if at == lang and n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])]
    return out


def divergence_rows():
    rng = random.Random(2)
    words = [*"the The THE of and café CAFÉ Über über naïve x1y don't \U0001f600 中文 ſet".split(), *("w" + chr(97 + i) + chr(97 + j) for i in range(8) for j in range(8))]
    rows = []
    for i in range(400):
        source = rng.choice(["hot", "hot", "hot", "b", "é", "c", None, ""])
        mine = words if source == "hot" else words[hash(source or "") % 3 :: 2]
        rows.append((i, rng.choice([" ", "\n", "-", "_1", "@["]).join(rng.choice(mine) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]), source, 1))
    rows += [(1000, None, "en", "no terms", 1), (1001, "123 !", "xx", "only", 1), (1002, "rare words", "yy", "a", 1), (1003, "rare", "yy", "b", 1), (1004, "the " * 50_000, "en", "b", 1), (None, "the of", None, None, None)]
    return rows + rows[:5]


@pytest.mark.parametrize("broadcast", [True, False])
def test_divergence(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = divergence_rows()
    for min_docs, top in ((30, 50), (8, 3)):
        got = divergence.source_divergence(docs_of(spark, rows), min_docs, top)
        assert sorted(map(tuple, got.collect())) == sorted(brute_divergence(rows, min_docs, top))
    assert divergence.source_divergence(docs_of(spark, [])).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(3)
    rows = [(d, d) for d in (1, 5, 7, 9 * 10**15)] + [(rng.randrange(1, d + 1), d) for d in (rng.randrange(1, 9 * 10**15) for _ in range(300))]
    got = spark.createDataFrame(rows, "c long, d long").select("c", "d", F.expr(divergence.share_sql("c", "d")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.c // r.d for r in got)


# nearest neighbours


def brute_neighbours(rows, k=10, every=100):
    usable = {(i, tuple(e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    out = []
    for i, q in usable:
        if i % every == 0:
            far = sorted((math.hypot(*(a - b for a, b in zip(q, e))), j) for j, e in usable if j != i and len(e) == len(q))
            out += [(i, r + 1, j, d) for r, (d, j) in enumerate(far[:k])]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], "vec_id long, embedding array<double>, cell int, q int, ids string")


def same(got, want):
    got, want = sorted(map(tuple, got)), sorted(want)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3], rel=1e-12) for g, w in zip(got, want))


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 7)))]
    rows += [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, rows[5][1]), (3100, rows[5][1]), (rows[7][0], rows[7][1])]
    rows += [(4000, None), (4100, []), (4200, [0.0] * 7), (4300, [1.0] * 6 + [None]), (4400, [math.nan] * 7), (4500, [math.inf] * 7), (None, [1.0] * 7)]
    rows += [(5000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 3)))] + [(6000, [1.0, 2.0]), (6100, [5.0]), (6101, [7.5])]
    rows += [(7000, [1e200] * 7), (7001, [1e200] * 6 + [1.1e200]), (7100, [1e-200] * 7), (7101, [-1e-200] * 7), (-100, [-1.0] * 7)]
    got = ann.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") % 100 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    same(got.collect(), brute_neighbours(rows))
    assert ann.nearest_neighbours(vectors_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    same(ann.nearest_neighbours(vectors_of(spark, rows[:3]), F.col("vec_id") % 100 == 0).collect(), brute_neighbours(rows[:3]))


def test_neighbours_in_blocks(spark, monkeypatch):
    """Blocks of 16 vectors: a cell is many tasks, and gives the same."""
    monkeypatch.setattr(ann, "BLOCK_NUMBERS", 64)
    rng = np.random.default_rng(5)
    rows = [(i, (v + (0 if i % 3 else 5)).tolist()) for i, v in enumerate(rng.normal(size=(1200, 4)))]
    same(ann.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") % 20 == 0).collect(), brute_neighbours(rows, every=20))


def test_rows_of_a_query_stay_as_many_with_more_cells(spark, monkeypatch):
    """All of 20,000 vectors in 256 cells are reranked: a query leaves the nearest of each group of cells, not of each cell."""
    made, reranked = [], ann.reranked

    def counted(*args):
        made.append(reranked(*args).cache())
        return made[-1]

    monkeypatch.setattr(ann, "reranked", counted)
    x = np.random.default_rng(9).normal(size=(20_000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest_neighbours(rows, F.col("vec_id") % 500 == 0, least=20_000).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for i in range(0, len(x), 500):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        assert got[i] == np.argsort(far)[:10].tolist()
    assert len(got) == 40 and made[0].count() <= 40 * 11 * 80


def test_nearest_of_ranges():
    """Ranges that some queries visit, many equal distances, and vectors far from zero, where rough squares tell nothing."""
    rng = np.random.default_rng(10)
    for shift, kinds in ((0.0, 50), (0.0, 3), (1e9, 50)):
        e, q = (rng.integers(0, kinds, size=(n, 3)).astype(float) + shift for n in (3000, 300))
        first, scale = rng.permutation(3000), int(np.frexp(np.abs(e).max())[1])
        visits = [(a, a + 1500, np.flatnonzero(rng.random(300) < 0.7)) for a in (0, 1500)]
        i, j, far = ann.closest(q, e, first, visits, 11, scale)
        for n in range(300):
            seen = np.concatenate([np.arange(a, b) for a, b, asked in visits if n in asked] or [np.empty(0, int)])
            want = np.sqrt(((e[seen] - q[n]) ** 2).sum(axis=1))
            order = np.lexsort((first[seen], want))[:11]
            assert j[i == n].tolist() == seen[order].tolist() and far[i == n] == pytest.approx(want[order])


def test_groups_of_cells():
    index = ann.MultiIndex(np.random.default_rng(11).normal(size=(400, 4)), 2, 0)
    index.counts.flat[:] = [3, 0, 4, 50, 1, 9, 10, 0, 5, 5, 5, 5, 0, 31, 2, 2]
    group, own = index.groups(10)
    assert own.tolist() == [1, 1, 1, 5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 3, 1, 1]
    load = np.zeros(group.max() + own.max())
    for g, n, held in zip(group, own, index.counts.ravel()):
        load[g : g + n] += held / n
    assert load.sum() == 132 and load.max() <= 25 and len(load[load > 0]) <= 20


def test_recall_of_neighbours(spark):
    """A third of the vectors in one tight group, the rest in clusters and alone; the index reranks what the audit asks for."""
    rng = np.random.default_rng(6)
    tight = rng.normal(size=(1, 32)) + 1e-3 * rng.normal(size=(4000, 32))
    clusters = np.repeat(rng.normal(size=(80, 32)), 60, axis=0) + 0.2 * rng.normal(size=(4800, 32))
    x = np.concatenate([tight, clusters, rng.normal(size=(3200, 32))])[rng.permutation(12_000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in ann.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") % 100 == 0, least=64).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 100):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        hits += len(got[i] & set(np.argsort(far)[:10].tolist()))
    assert len(got) == 120 and hits / 1200 >= 0.95


def test_pairs_of_centroids_come_by_summed_distance():
    rng = np.random.default_rng(7)
    index = ann.MultiIndex(rng.normal(size=(2000, 6)), 4, 0)
    index.counts[:] = rng.integers(0, 5, index.counts.shape)
    for q in rng.normal(size=(20, 6)):
        one, two = (d[0] for d in index.distances(q[None]))
        sums = (one[:, None] + two).ravel()
        order = [int(c) for c in np.argsort(sums, kind="stable") if index.counts.flat[c]]
        assert index.walk(one, two, 10**9) == order
        held = np.cumsum(index.counts.flat[order])
        assert index.walk(one, two, 100) == order[: int(np.searchsorted(held, 100)) + 1]
        assert (index.passed(one, two, np.array(order)) == held).all()


def test_codebooks_follow_density():
    rng = np.random.default_rng(8)
    x = np.concatenate([1e-3 * rng.normal(size=(1000, 4)) + 3, rng.normal(size=(2000, 4))])
    book = ann.codebook(x, 6)
    assert 12 <= (np.abs(book - 3).max(axis=1) < 0.01).sum() <= 27
