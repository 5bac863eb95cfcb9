import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_llm import brute_near, unlike

import corpus_pipeline
from quire.llm import quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Small documents and what each stage makes of its predecessor's rows."""
    rng = random.Random(21)
    passage, rows = unlike(rng, 60), []
    for i in range(120):
        lines = [unlike(rng, rng.randrange(15, 40)) for _ in range(rng.randrange(3, 7))]
        if i % 6 == 0:
            lines.insert(rng.randrange(len(lines)), passage)
        rows.append((i, "\n".join(lines), "abc"[i % 3]))
    rows += [(200 + i, rows[1][1], "a") for i in range(8)]
    for i in range(10):
        w = rows[2][1].split(" ")
        w[rng.randrange(len(w))] += "x"
        rows.append((300 + i, " ".join(w), None))
    rows += [(400, "short", "a"), (401, None, "b"), (402, "spam " * 200, "c"), (403, " ".join(x + "***" for x in unlike(rng, 90).split()), "c"), (None, unlike(rng, 70), "b")]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, folder).write.parquet(f"{folder}/{k}")
        out.append((name, docs, spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][2]
    return folder, passage, out


def test_stages_return_documents(stages):
    _, _, out = stages
    assert len(out) == 5
    for _, before, after in out[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage(stages):
    _, before, after = stages[2][0]
    want = Counter(tuple(r) for r in before.collect() if quality.first_rejection(r.text, corpus_pipeline.QUALITY) is None)
    assert Counter(map(tuple, after.collect())) == want and len(want) == after.count()


def test_line_stage(stages):
    _, passage, out = stages
    _, before, after = out[1]
    was, now = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    assert was.keys() == now.keys()
    for i, text in was.items():
        # only the passage recurs in documents that are no copies
        assert now[i].text == "\n".join(x for x in text.split("\n") if x != passage), i
        assert now[i].n_chars == len(now[i].text)
    assert any(passage in t for t in was.values())


def test_near_duplicate_stage(stages):
    _, before, after = stages[2][2]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    kept = Counter(x[0] for x, n in brute_near(rows, 5, 80).items() if x[3] for _ in range(n))
    assert Counter(r.doc_id for r in after.collect()) == kept and sum(kept.values()) < len(rows)


def test_mixing_stage(stages):
    _, before, after = stages[2][3]
    size, most, copies = Counter(), Counter(), Counter(r.doc_id for r in after.collect())
    taken, words = Counter(), {}
    for r in before.collect():
        words[r.doc_id] = len((r.text or "").encode().split())
        size[r.source] += words[r.doc_id]
        most[r.source] = max(most[r.source], words[r.doc_id])
        taken[r.source] += copies[r.doc_id] * words[r.doc_id]
    assert max(copies.values()) <= 2
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in size) < 1.5 * sum(size.values()) else (low, level)
    for s in size:
        assert abs(taken[s] - min(2 * size[s], level * weight[s])) <= most[s] / 2 + 1e-6


def test_packing_stage_and_run(spark, stages):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    folder, _, out = stages
    _, before, after = out[4]
    import zlib

    want = Counter()
    for r in before.collect():
        ids = np.array(encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        want.update((r.doc_id, k, zlib.crc32(ids[at : at + 8192])) for k, at in enumerate(range(0, len(ids), 8192)))
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and sum(x[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:]))
    again = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == want


def test_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
