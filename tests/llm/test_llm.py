import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import chat, common, embedding_dup, line_dedup, mixing, near_dup, packing, quality, token_counts, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, template string, copies int"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = "the quick brown fox jumps over lazy dog while seven wise owls read long old books about stars and small rivers".split()


def prose(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary or WORDS) + str(rng.randrange(0, 1)).replace("0", "") for _ in range(n))


def unlike(rng, n):
    """Words that hardly recur."""
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def docs_of(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "x", "y", 3) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def hard_rows():
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(1)
    base = unlike(rng, 120)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "a"), (4, "one two", "a"), (None, unlike(rng, 60), None)]
    rows += [(10 + i, base, "b") for i in range(12)]
    rows += [(30, unlike(rng, 30_000), "b")]
    for i in range(25):
        w = base.split()
        w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((40 + i, " ".join(w), "c" if i % 2 else None))
    rows += [(100 + i, unlike(rng, rng.randrange(1, 400)), "d") for i in range(60)]
    return rows


# packing


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (10, 64, 2048):
        lengths = [min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(700)]
        bins, rooms = [], []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                bins.append(x)
                rooms.append(capacity - x)
        runs = packing.best_fit_plan(Counter(lengths), capacity)
        used = defaultdict(list)
        for length, low, high, per, first, offset in runs:
            for r in range(low, high):
                used[first + (r - low) // per].append((offset + (r - low) % per * length, length))
        assert len(used) == len(bins)
        assert Counter(n for x in used.values() for _, n in x) == Counter(lengths)
        for x in used.values():
            x.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[0][0] == 0 and sum(x[-1]) <= capacity


def test_packing(spark, hard_rows):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    got = packing.pack_documents(docs_of(spark, hard_rows), TOKENIZER).collect()
    whole = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 and r.start == 2048 * r.piece
        whole[r.doc_id, r.piece].append(bytes(r.ids))
    want = Counter()
    for doc, text, _ in hard_rows:
        ids = np.array(encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.update((doc, k, ids[at : at + 8192]) for k, at in enumerate(range(0, len(ids), 8192)))
    assert Counter((d, k, x) for (d, k), xs in whole.items() for x in xs) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        x.sort()
        assert x[0][0] == 0 and sum(x[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:]))
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.pack_documents(docs_of(spark, []), TOKENIZER).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_chunks_are_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    whole = Tokenizer.from_file(TOKENIZER) if not hasattr(test_chunks_are_the_tokenizers_ids, "t") else test_chunks_are_the_tokenizers_ids.t
    test_chunks_are_the_tokenizers_ids.t = whole
    known = packing.chunk_ids(TOKENIZER)
    got = b"".join(known[c] for c in text.encode().split())
    assert got == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# token counts


def test_token_counts(spark, hard_rows):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    whole = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = [*hard_rows, (900, "  two  spaces \n▁mark ▁ 😀é中 <s> <0x0A>", "a"), (901, "▁", "a"), (902, "x" * 3000, "a")]
    got = token_counts.count_tokens(docs_of(spark, rows), vocab)
    assert Counter(map(tuple, got.collect())) == Counter((d, len(whole.encode(t or "").ids)) for d, t, _ in rows)
    assert token_counts.count_tokens(docs_of(spark, []), vocab).count() == 0


# near duplicates


def brute_near(rows, width, similarity):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t, _ in rows]
    root = {d: d for d, _, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return Counter((d, len(s), d if d is None else find(d), d is None or find(d) == d) for (d, _, _), s in zip(rows, sets))


def test_near_duplicates(spark, hard_rows):
    rng = random.Random(8)
    rows = list(hard_rows)
    for g in range(30):  # groups about the threshold
        base = unlike(rng, rng.choice((6, 40, 150))).split()
        for i in range(rng.randrange(2, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = unlike(rng, 1)
            rows.append((1000 + 10 * g + i, " ".join(w), "e"))
    passage = unlike(rng, 60)
    rows += [(2000 + i, unlike(rng, 60) + " " + passage + " " + unlike(rng, 40), "f") for i in range(60)]
    rows += [(3000, "Ab c\td  e", "g"), (3001, "aB C d e", "g"), (3002, "É b", "g"), (3003, "é b", "g")]
    for width in (4, 5):
        got = near_dup.near_duplicates(docs_of(spark, rows), width=width)
        assert Counter(map(tuple, got.collect())) == brute_near(rows, width, 80)
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_duplicates_in_large_families(spark, monkeypatch, broadcast):
    rng = random.Random(18)
    rows = []
    for g, n in ((0, 260), (1, 90)):  # members are near some of each other, so that stars leave many apart
        base = unlike(rng, 80).split()
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 2, 3))):
                w[rng.randrange(len(w))] = unlike(rng, 1)
            rows.append((len(rows), " ".join(w), "a"))
    rows += [(len(rows) + i, unlike(rng, 50), "b") for i in range(30)]
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = near_dup.near_duplicates(docs_of(spark, rows), width=4)
    assert Counter(map(tuple, got.collect())) == brute_near(rows, 4, 80)


def test_blocks_hold_every_pair_of_labels_once(spark):
    rng = random.Random(19)
    members = [(u, i, label, n) for u, size in ((1, 900), (2, 5), (3, 40)) for i in range(size) for label, n in [(7 if rng.random() < 0.8 else 100 + rng.randrange(60), rng.choice((1, 90, 3000)))]]
    members += [(4, i, 3, 1) for i in range(50)]  # one label only
    tasks = defaultdict(list)
    for r in common.dealt_blocks(spark.createDataFrame(members, "unit long, rep long, label long, n long")).collect():
        tasks[r.task].append((r.side, r.rep, r.label))
    label = {(u, i): x for u, i, x, _ in members}
    want = {(i, j) for u in (1, 2, 3) for (v, i), x in label.items() for (w, j), y in label.items() if u == v == w and i < j and x != y}
    seen = set()
    for t in tasks.values():
        sides = sorted({s for s, _, _ in t})
        assert len(sides) <= 2
        a, b = [x for x in t if x[0] == sides[0]], [x for x in t if x[0] == sides[-1]]
        seen |= {(min(x[1], y[1]), max(x[1], y[1])) for x in a for y in b if x[2] != y[2]}
        assert len(sides) == 1 or {x[2] for x in a} != {x[2] for x in b} or len({x[2] for x in t}) > 1
    assert want <= seen
    assert sum(map(len, tasks.values())) < 25 * len(members)


def test_every_pair_within_the_distance_meets(spark):
    rng = np.random.default_rng(4)
    n = near_dup.CHUNKS * near_dup.CHUNK_SIZE
    a = rng.integers(0, 256, n, dtype=np.uint8)
    rows = [(0, 50, a.tobytes())]
    for i in range(1, 40):
        b = a.copy()
        at = rng.choice(n, 2 * near_dup.CHUNKS - 1, replace=False)
        b[at] ^= 1
        rows.append((i, 50, b.tobytes()))
    keys = near_dup.index_keys(spark.createDataFrame(rows, "rep long, n long, sig binary"), near_dup.CHUNKS, near_dup.CHUNK_SIZE).collect()
    by = defaultdict(set)
    for r in keys:
        by[r.rep].add(r.key)
    assert all(by[0] & by[i] for i in range(1, 40))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
            if x is not y:
                x |= y
                for v in y:
                    root[v] = x
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(v, min(s)) for v, s in root.items()} and len(got) == len(root)


# embeddings


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        rows.append((i, rng.normal(size=24).tolist(), int(i % 3)))
    for c in range(6):  # clusters, one larger than a block
        base = rng.normal(size=24)
        for i in range(3 if c else 700):
            rows.append((2000 + 1000 * c + i, (base + rng.normal(size=24) * 0.08).tolist(), c % 3))
    rows += [(9000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(9100, None, 1), (9101, [], 1), (9102, [0.0] * 24, 1), (9103, [float("nan")] * 24, 1), (9104, rows[7][1], None), (9105, [None] * 24, 1), (9106, rows[7][1][:5], rows[7][2]), (9107, [2 * x for x in rows[7][1]], rows[7][2])]
    rows += [(9200, rows[9][1], rows[9][2])] * 2
    df = spark.createDataFrame([(i, e, y, "z", 1) for i, e, y in rows], "vec_id long, embedding array<double>, label int, node string, component long")
    got = Counter(map(tuple, embedding_dup.embedding_duplicates(df).collect()))
    ok = [k for k, (_, e, y) in enumerate(rows) if y is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = defaultdict(set)
    for label in (0, 1, 2):
        for dim in (5, 24):
            own = [k for k in ok if rows[k][2] == label and len(rows[k][1]) == dim]
            x = np.array([rows[k][1] for k in own]).reshape(len(own), dim)
            x /= np.linalg.norm(x, axis=1)[:, None]
            hit = x @ x.T >= 0.93
            for i, j in zip(*np.nonzero(hit)):
                if i != j:
                    links[own[i]].add(own[j])
    want = Counter()
    for k, (v, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min(rows[j][0] for j in seen)
        want[v, len(links[k]), low, low == v] += 1
    assert got == want
    assert embedding_dup.embedding_duplicates(df.limit(0)).count() == 0


def brute_embeddings(rows, threshold=0.93):
    x = np.array([e for _, e, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([y for _, _, y in rows])
    hit = (x @ x.T >= threshold) & (label[:, None] == label)
    np.fill_diagonal(hit, False)
    low = np.array([v for v, _, _ in rows])
    while (now := np.minimum(low, np.where(hit, low, low.max()).min(axis=1))).tolist() != low.tolist():
        low = now
    return Counter((v, int(h.sum()), int(c), bool(c == v)) for (v, _, _), h, c in zip(rows, hit, low))


def embedding_rows(spark, rows):
    return spark.createDataFrame([(i, e, y) for i, e, y in rows], "vec_id long, embedding array<double>, label int")


def test_embedding_groups_beyond_saturated_lists(spark):
    rng = np.random.default_rng(21)
    rows = []
    for label in range(3):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        for side in (a, 0.957 * a + np.sqrt(1 - 0.957**2) * b):  # cosine about 0.995 inside, 0.95 across
            for _ in range((13, 40, 40)[label]):
                rows.append((len(rows), (side + rng.normal(size=64) * 0.008).tolist(), label))
        for _ in range(200):
            rows.append((len(rows), rng.normal(size=64).tolist(), label))
    got = embedding_dup.embedding_duplicates(embedding_rows(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute_embeddings(rows)


def test_embedding_pairs_that_lists_miss(spark):
    rng = np.random.default_rng(22)
    rows, hot = [], rng.normal(size=64)
    for _ in range(700):
        x = rng.normal(size=64)
        rows += [(len(rows), x.tolist(), 1), (len(rows) + 1, (x + rng.normal(size=64) * 0.35).tolist(), 1)]
    rows += [(len(rows) + i, (hot + rng.normal(size=64) * 0.1).tolist(), 1) for i in range(300)]
    recall = []
    got = embedding_dup.embedding_duplicates(embedding_rows(spark, rows), trees=1, leaf=16, report=recall.append)
    got, want = (Counter({r: n for r, n in x.items()}) for x in (Counter(map(tuple, got.collect())), brute_embeddings(rows)))
    assert recall[0] >= embedding_dup.AUDIT_RECALL
    linked = sum(n for r, n in want.items() if r[1])
    assert sum((want - got).values()) <= 0.03 * linked


def test_embeddings_of_finite_extremes(spark):
    rng = np.random.default_rng(23)
    x = rng.normal(size=8)
    rows = [(i, (x * s).tolist(), 1) for i, s in enumerate((1e200, 1e200, 1e-200, 3.0, 1e-308, 1e300, -1e300))]
    rows.append((7, [1e300, 1e-300], 2))
    rows.append((8, [1e-300, 0.0], 2))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.embedding_duplicates(embedding_rows(spark, rows)).collect()}
    assert got == {**{i: (5, 0) for i in range(6)}, 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_recall_of_many_embeddings(spark):
    rng = np.random.default_rng(24)
    rows = []
    for _ in range(5000):  # pairs by themselves, which no cluster helps to find
        x, label = rng.normal(size=64), int(rng.integers(2))
        rows += [(len(rows), x.tolist(), label), (len(rows) + 1, (x + rng.normal(size=64) * rng.uniform(0.1, 0.36)).tolist(), label)]
    for n in (3, 30, 400, 2000):
        x, label = rng.normal(size=64), int(rng.integers(2))
        rows += [(len(rows) + i, (x + rng.normal(size=64) * 0.25).tolist(), label) for i in range(n)]
    rows += [(len(rows) + i, rng.normal(size=64).tolist(), i % 2) for i in range(20_000 - len(rows))]
    recall = []
    got = {r.vec_id: r for r in embedding_dup.embedding_duplicates(embedding_rows(spark, rows), report=recall.append).collect()}
    want = {r[0]: r for r in brute_embeddings(rows)}
    assert len(got) == 20_000 and recall[0] >= embedding_dup.AUDIT_RECALL
    links = sum(r[1] for r in want.values())
    assert 0.99 * links <= sum(r.n_links for r in got.values()) <= links
    assert sum(got[v].n_links == r[1] for v, r in want.items() if r[1]) >= 0.99 * sum(1 for r in want.values() if r[1])
    assert sum(got[v].component_id == r[2] for v, r in want.items()) >= 0.99 * len(want)


# toxicity


def accuracy(model, rows, labels):
    at = {int(b): i for i, b in enumerate(model.buckets)}
    return np.mean([(model.score([at[int(b)] for b in r if int(b) in at]) >= 0.5) == y for r, y in zip(rows, labels)])


def test_pairs_of_terms_are_learned():
    rng = random.Random(6)
    buckets, rows, labels, both = toxicity.TermBuckets(), [], [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = prose(rng, 12) + " " + unlike(rng, 6) + (" fools" if insult else " friends") + (" strangers" if group else " neighbours")
        rows.append(np.array(sorted(toxicity.term_buckets(text, buckets))))
        labels.append(float(insult == group))  # no sum of weights tells these apart
        both.append(float(insult and group))
    labels, both = np.array(labels), np.array(both)
    for y in (labels, both):
        model = toxicity.fit(rows[:3000], y[:3000])
        assert accuracy(model, rows[3000:], y[3000:]) > 0.97
    model = toxicity.fit(rows[:3000], labels[:3000])
    additive = toxicity.Model(model.bias, model.buckets, model.weights, np.zeros_like(model.factors))
    assert accuracy(additive, rows[3000:], labels[3000:]) < 0.65
    assert set(model.buckets) >= set(toxicity.term_buckets("fools friends strangers neighbours", buckets))


def test_toxic_groups_of_words_that_clean_texts_have_as_often():
    rng = random.Random(16)
    buckets, rows, labels = toxicity.TermBuckets(), [], []
    for _ in range(6000):  # a rare insult, harmless among friends; the group's name is as common in clean texts
        toxic = rng.random() < 0.2
        insult, group = (True, True) if toxic else rng.choice([(True, False), (False, True), (False, False)])
        text = unlike(rng, 20) + " " + prose(rng, 20) + " clowns" * insult + " strangers" * group
        rows.append(np.array(sorted(toxicity.term_buckets(text, buckets))))
        labels.append(float(toxic))
    labels = np.array(labels)
    assert accuracy(toxicity.fit(rows[:5000], labels[:5000]), rows[5000:], labels[5000:]) > 0.98


def test_toxicity(spark):
    rng = random.Random(5)
    insults = ["loser", "clown", "scum"]
    rows, labels = [], []
    for i in range(2000):
        toxic = rng.random() < 0.15
        words = unlike(rng, rng.randrange(20, 200)).split() + [rng.choice(WORDS) for _ in range(50)]
        if toxic:
            for w in rng.sample(insults, rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice((w, w.title() + ",", w.upper() + "!")))
        rows.append((i, " ".join(words), "a"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
        rows[-1] = (*rows[-1][:2], "toxic" if toxic else "clean")
    rows += [(5000, None, "clean"), (5001, "", "clean"), (None, "plain words here", "clean"), (5002, prose(rng, 40_000), "clean"), (5003, prose(rng, 40_000) + " loser", "toxic")]
    rows += [rows[11]] * 3
    labels += [(None, 1, 1), (7, 1, None), (99999, 0, 1)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs_of(spark, rows), df).collect()
    truth = {d: s == "toxic" for d, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (5002, 5003)} == {5002: 0, 5003: 1}
    none = toxicity.toxicity(docs_of(spark, rows[:3]), df.limit(0)).collect()
    assert len(none) == 3 and len({r.score for r in none}) == 1
    assert toxicity.toxicity(docs_of(spark, []), df).count() == 0


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.one_of(st.text(max_size=20), st.text(alphabet="<[/\\|sINST]>\n", max_size=20))), min_size=1, max_size=5))
def test_escapes_are_reversible(turns):
    whole, spans = chat.locate(chat.render, turns)
    assert chat.parse(whole) == turns
    assert [chat.unescape(whole[s[2] : s[3]]) for s in spans] == [t for _, t in turns]
    for _, text in turns:
        assert not any(x in chat.escape(text) for x in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))


def test_templates_that_rewrite_history():
    def forgets(turns):
        return "".join(("" if r == "assistant" and i < len(turns) - 2 else t) + ";" for i, (r, t) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert chat.locate(forgets, turns)[1] is None
    long = [("user", "x"), ("assistant", "y")] * 100
    assert chat.locate(forgets, long)[1] is None

    def numbered(turns):  # depends on the number of turns before
        return "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))

    whole, spans = chat.locate(numbered, long)
    assert [whole[s[2] : s[3]] for s in spans] == [t for _, t in long]


@pytest.mark.parametrize("n", [4, 8, 16, 17, 20, 40, 60])
def test_templates_that_rewrite_history_between(n):
    def only_at(k):  # from turn k on the first turn is gone; or it is gone at k turns only
        return [lambda turns: chat.render(turns[1:] if len(turns) >= k else turns), lambda turns: chat.render(turns[1:] if len(turns) == k else turns)]

    turns = [("user", f"x{i}") for i in range(n)]
    for k in (2, 6, 17, 33):
        for template in only_at(k):
            assert (chat.locate(template, turns)[1] is None) == (n >= k)


def test_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"<|turn {i}</s> " * 3) for i in range(3000)] + [(2, 0, "assistant", "[INST] " * 400_000), (2, 1, "user\ue000", "\ue000")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for conv in (1, 2):
        own = [(r[2], r[3]) for r in rows if r[0] == conv]
        whole, spans = by[conv].formatted, by[conv].spans
        assert chat.parse(whole) == own and [chat.unescape(whole[s.text_start : s.text_end]) for s in spans] == [t for _, t in own]
        assert "".join(whole[s.start : s.end] for s in spans) == whole


def test_conversations(spark):
    import hashlib

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] x"), (2, 5, "system", None), (2, 5, None, "b"), (2, None, "user", ""), (None, 0, "assistant", "n"), (3, 0, "user", "r"), (3, 0, "user", "r")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i} " + "w" * (i % 50)) for i in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render([(x[2] or "", x[3] or "") for x in own]))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# URLs


def test_url_filters(spark):
    rng = random.Random(7)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "/en/x", "block"), ("example.net", "/en/", "block"), ("x-y.net", "/", "allow"), ("NET", "/zz", "allow"), (None, "/", "block"), ("b.c", None, "block")]
    hosts = ["net", "example.net", "A.Example.NET", "a.b.example.net", "example.com", "www.example.com", "fr.org", "org", "notexample.net", "xnet", "x-y.net", "q.x-y.net", "net.com", "", "example.net:80", "example.net.", ".net"]
    paths = ["", "/", "/en/", "/en/x/1", "/de/a?b=/fr/", "/fr/", "?q", "#f", "/zz/1", "/EN/"]
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(900)] + ["https://example.net/en/" + "x" * 2_000_000, "https://" + "a." * 300_000 + "org/fr/"] + ["https://hot.net/en/1"] * 500 + [None, "", "net/en/", "a://b://net/", "://net/", "x://net\n/en/"]
    usable = [r for r in rules if None not in r]

    def judge(url):
        host, path = url_filters.split_url(url)
        fits = [(len(h + p), len(h), v == "block", h.lower() + p if False else h + p, v) for h, p, v in usable if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    df = spark.createDataFrame([(i % 700 if i % 9 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filters.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert Counter(map(tuple, got.collect())) == Counter((i % 700 if i % 9 else None, *judge(u)) for i, u in enumerate(urls))
    assert url_filters.split_url("HTTP://Ab.C:8/x?y#z") == ("ab.c:8", "/x")
    assert url_filters.filter_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filters.filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is null").count() == len(urls)


# lines


def test_line_dedup(spark):
    rng = random.Random(12)
    passage = unlike(rng, 55)
    notice = "Copyright notice number {} belongs to nobody here at all"
    field = "Posted by user {} in the forum about gardening and weather today"
    rows = []
    for i in range(40):
        lines = [unlike(rng, 30) for _ in range(6)]
        if i < 20:
            lines.insert(2, passage)
        if i >= 10:
            lines.insert(0, notice.format(i))
            lines.append(field.format(unlike(rng, 1)))
        if i == 5:
            lines.insert(1, "")
        rows.append((i, "\n".join(lines), "a"))
    copy = "\n".join(unlike(rng, 25) for _ in range(8))
    rows += [(100 + i, copy, "b") for i in range(30)]
    rows += [(200 + i, copy + "\n" + unlike(rng, 12), "b") for i in range(30)]
    rows += [(300, None, "c"), (301, "", "c"), (302, "\n\n", "c"), (303, passage, "c"), (303, passage, "c"), (None, unlike(rng, 20), None), (304, "12 3 45\n12 3 45", "c"), (305, "9 9 9", "c")]
    got = line_dedup.drop_recurring_lines(docs_of(spark, rows)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    for i, text, _ in rows:
        own = (text or "").split("\n")
        if i is not None and i < 40:
            want = "\n".join(x for x in own if x != passage and "Copyright" not in x and "Posted" not in x)
        else:
            want = text
        if i != 303:
            assert want in by[i], i
    assert all(r.kept == "x" and r.copies == 3 for r in got)
    assert by[303] == ["", ""]
    assert line_dedup.drop_recurring_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_of_long_passages_in_short_texts(spark):
    rng = random.Random(31)
    passage, copy = unlike(rng, 60), [unlike(rng, 20) for _ in range(9)]
    rows = [(i, f"{passage}\n{unlike(rng, 30)}", "a") for i in range(40)]
    rows += [(100 + i, "\n".join([*copy, unlike(rng, 10)]), "b") for i in range(20)]  # copies of one another
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert got == {i: t.split("\n")[1] if i < 100 else t for i, t, _ in rows}


def test_line_dedup_of_passages_in_two_texts(spark):
    rng = random.Random(32)
    line, run = unlike(rng, 60), [unlike(rng, 9) for _ in range(3)] + ["", "Les."] + [unlike(rng, 9) for _ in range(3)]
    short = unlike(rng, 20)
    own = [[unlike(rng, 40) for _ in range(3)] for _ in range(6)]
    numbers = "\n".join("1 2 3" for _ in range(30))
    texts = [[own[0][0], line, own[0][1]], [line, own[1][0]], [*own[2], *run], [own[3][0], *run, own[3][1]], [own[4][0], short, "Les.", numbers], [own[5][0], short, numbers]]
    want = [[own[0][0], own[0][1]], [own[1][0]], [*own[2], ""], [own[3][0], "", own[3][1]], texts[4], texts[5]]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, [(i, "\n".join(x), "a") for i, x in enumerate(texts)])).collect()}
    assert got == {i: "\n".join(x) for i, x in enumerate(want)}


def test_line_templates_generalise_any_field(spark):
    rng = random.Random(33)
    notice = unlike(rng, 16).split()

    def varied(words, at):
        return " ".join(unlike(rng, 1) if i in at else w for i, w in enumerate(words))

    kinds = {
        "short": lambda: f"Posted by {unlike(rng, 1)}",
        "first": lambda: f"{unlike(rng, 1)} replied to this thread",
        "both": lambda: f"{unlike(rng, 1)} wrote on {rng.randrange(99)} May in General",
        "four": lambda: varied(notice, (4, 7, 9, 12)),
        "long": lambda: varied((notice * 4)[:60], (10, 50)),
    }
    rows, own = [], {}
    for i in range(30):
        own[i] = [unlike(rng, 25), unlike(rng, 7)]
        rows.append((i, "\n".join([own[i][0], *(f() for f in kinds.values()), own[i][1]]), "a"))
    # two fields only, or mostly fields: no template
    for i in range(100, 130):
        own[i] = [unlike(rng, 25), f"{unlike(rng, 1)} {unlike(rng, 1)}", f"by {unlike(rng, 9)}", "Les."]
        rows.append((i, "\n".join(own[i]), "a"))
    rows.append((200, unlike(rng, 30_000) + "\n" + "\n".join(["1"] * 20_000), "a"))
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert got == {**{i: "\n".join(x) for i, x in own.items()}, 200: rows[-1][1]}


def test_line_dedup_keeps_the_lines_of_near_copies(spark):
    rng = random.Random(34)
    rows = []
    for g in range(8):
        base = [unlike(rng, rng.randrange(8, 40)).split() for _ in range(rng.randrange(6, 10))]
        for _ in range(12):
            lines = [list(x) for x in base]
            for _ in range(rng.choice((0, 1, 2))):
                own = rng.choice(lines)
                own[rng.randrange(len(own))] = unlike(rng, 1)
            rows.append((len(rows), "\n".join(map(" ".join, lines)), "a"))
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert sum(got[i] == t for i, t, _ in rows) >= 0.9 * len(rows)


def test_line_dedup_and_near_copies_leave_no_gap(spark):
    """What texts share goes, or they are near copies; nothing lies between."""
    rng = random.Random(36)
    boiler, often, form = [unlike(rng, 12) for _ in range(7)], [unlike(rng, 13) for _ in range(9)], [unlike(rng, 11).split() for _ in range(8)]
    rows, own = [], {}
    for i in range(40):
        mine = unlike(rng, 16)
        rows.append((i, "\n".join([*boiler[:4], mine, *boiler[4:]]), "a"))  # 84 of 100 words in common
        own[i] = mine
        words = [unlike(rng, 1) for _ in often]
        rows.append((100 + i, "\n".join(x for pair in zip(often, words) for x in pair), "a"))  # 93 %, a word of one's own after each line
        own[100 + i] = "\n".join(words)
        rows.append((200 + i, "\n".join(" ".join([*w[:4], unlike(rng, 1), *w[4:]]) for w in form), "a"))  # each line with another word
        own[200 + i] = ""
        ends = [unlike(rng, 30), f"{unlike(rng, 1)} liked this photo taken by {unlike(rng, 1)}", unlike(rng, 20)]
        rows.append((300 + i, "\n".join(ends), "a"))  # fields at both ends
        own[300 + i] = f"{ends[0]}\n{ends[2]}"
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert got == own


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "one line that these three texts have in common today"
    df = spark.createDataFrame([(i, f"{line}\n{unlike(random.Random(i), 20)}", 1, 2, 3) for i in range(4)], "doc_id long, text string, _h int, __drop int, lines int")
    got = line_dedup.drop_recurring_lines(df)
    assert got.columns == df.columns and {tuple(r)[2:] for r in got.collect()} == {(1, 2, 3)} and not got.where(F.col("text").contains("common")).count()


# mixing


def test_mixing(spark, hard_rows):
    rng = random.Random(14)
    rows = [*hard_rows, *[(5000 + i, unlike(rng, rng.randrange(0, 90)), rng.choice(("a", "b", "zz", None))) for i in range(800)]]
    df = docs_of(spark, rows)
    size = mixing.word_count(F.col("text"))
    sized = df.withColumn("size", size)
    state = mixing.thresholds(sized)
    got = mixing.mix(df, state, size).withColumn("size", size).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in sizes) < 1.5 * sum(sizes.values()) else (low, level)
    taken, most = Counter(), Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(min(2 * sizes[r.source], level * weight[r.source]), rel=1e-6, abs=1e-6)
        taken[r.source] += r.copies * r.size
        most[r.source] = max(most[r.source], r.size)
    for r in got:
        assert abs(taken[r.source] - r.target) <= most[r.source] / 2 + 1e-6
    again = mixing.mix(df.repartition(5), mixing.thresholds(sized.repartition(3)), size)
    assert Counter((r.doc_id, r.copies) for r in again.collect()) == Counter((r.doc_id, r.copies) for r in got)
    empty = docs_of(spark, [])
    assert mixing.mix(empty, mixing.thresholds(empty.withColumn("size", size)), size).count() == 0


def test_larger_budgets_take_supersets(spark):
    rng = random.Random(15)
    sized = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(1, 50)) for i in range(500)], "doc_id long, source string, size long")
    state = mixing.thresholds(sized)
    assert all(r.below <= r.budget for r in state.collect())
    taken = []
    for share in (0.1, 0.35, 0.9):  # the same documents below a lower threshold, whatever the budget
        fixed = state.withColumn("budget", F.col("source_size") * share).withColumn("whole", F.lit(0).cast("long"))
        found = mixing.thresholds_of(sized, fixed)
        taken.append({r.doc_id for r in mixing.mix(sized, found, F.col("size")).where("copies > 0").collect()})
    assert taken[0] < taken[1] < taken[2]


def test_mixing_many_sources_and_clashing_names(spark):
    rng = random.Random(25)
    rows = [(i, None if i % 50 == 0 else f"s{rng.randrange(300):03}", None if i % 7 == 0 else rng.randrange(1, 50), 1, 2, 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, _h int, _size int, key int")
    state = mixing.thresholds(df)
    by = {r.source: r for r in state.collect()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    low, high = 0.0, 1e9
    size, weight = {s: by[s].source_size for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in size) < 1.5 * sum(size.values()) else (low, level)
    assert all(by[s].target == pytest.approx(min(2 * size[s], level * weight[s]), rel=1e-6) for s in order)
    got = mixing.mix(df, state, F.col("size")).collect()
    assert len(got) == 3000 and {(r._h, r._size, r.key) for r in got} == {(1, 2, 3)}


# quality


def test_quality(spark, hard_rows):
    rng = random.Random(16)
    rows = list(hard_rows)
    rows += [(700 + i, " ".join(w.upper() + "!!" for w in unlike(rng, 80).split()), "a") for i in range(5)]
    rows += [(710 + i, " ".join(w + "***" for w in unlike(rng, 80).split()), "a") for i in range(5)]
    rows += [(720, "spam " * 100, "a"), (721, "\n".join([unlike(rng, 30)] * 3 + [unlike(rng, 30)]), "a")]

    def measures(text):
        w = (text or "").encode().split()
        count = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    got = quality.quality_report(docs_of(spark, rows)).collect()
    want = Counter()
    for d, t, _ in rows:
        m = measures(t)
        want[d, *m, m[0] < 50 or 100 * m[4] > 50 * m[0], all(not r.rejects(quality.Measures(t)) for r in quality.RULES)] += 1
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all((r.rejected_by is None) == r.kept for r in got)
    kept = quality.quality_filter(docs_of(spark, rows))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert kept.columns == docs_of(spark, []).columns
    assert quality.quality_report(docs_of(spark, [])).count() == 0 and quality.quality_filter(docs_of(spark, [])).count() == 0
    assert {r.doc_id for r in got if r.doc_id and 700 <= r.doc_id <= 721 and r.kept} == set()


def test_measures_of_long_texts():
    rng = random.Random(26)
    words = [rng.choice(WORDS) + str(rng.randrange(3000)) for _ in range(400_000)]
    text = "".join(w + rng.choice((" ", "\n", "\t ", " \u00a0")) for w in words) + "x" * 3_000_000
    w = text.encode().split()
    count = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if count[x] > 1 for j in (i, i + 1, i + 2)}
    m = quality.Measures(text)
    assert (m.n_words, m.n_repeat_words) == (len(w), len(covered))


def test_rules_run_by_rejections_per_cost(spark):
    def slow(m):
        return sum(hash(m.text + str(i)) & 0 for i in range(3000)) or True

    rules = (quality.Rule("slow", slow), quality.Rule("never", lambda m: False), quality.Rule("quick", lambda m: not m.text.startswith("keep")))
    df = docs_of(spark, [(i, "keep" if i % 10 == 0 else "drop", "a") for i in range(300)])
    assert quality.rule_order(df, rules) == ["quick", "slow", "never"]


def test_operators_leave_what_their_results_read(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    places = lambda: {x.getPath().getName() for x in fs.listStatus(folder)}
    before = places()

    @common.tidy
    def outer():
        inner = common.tidy(lambda: common.stored(common.stored(spark.range(5)).where("id > 1")))()
        assert len(places() - before) == 1
        return common.cut(common.cut(inner.withColumn("x", F.lit(1)))).where("id > 2")

    out = outer()
    assert len(places() - before) == 1 and out.count() == 2
    edges = common.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert len(places() - before) == 2 and edges.count() == 3
