import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import language_model
from corpusloom.llm.language_model import Shape, Tokens, Unigrams, score_documents, softmax, word_counts
from tests.llm.conftest import HARD

SMALL = Shape(classes=4, slots=4, bits=10)


def want(rows, folds=5, held=1):
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t, *_ in rows]
    out = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % folds == held for r in rows]
    c = Counter(w for ws, h in zip(tokens, out, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    return sorted((-1 if r[0] is None else r[0], h, len(ws), sum(c[w] > 0 for w in ws), n, round(base(ws), 6)) for r, ws, h in zip(rows, tokens, out, strict=True))


def made(frame):
    rows = frame.collect()
    assert all(math.isfinite(r["score"]) and r["score"] < 1e-9 for r in rows)
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_hard_clashing_empty(hard, clashing, empty):
    assert made(score_documents(hard, shape=SMALL)) == want(HARD)
    assert made(score_documents(clashing, shape=SMALL)) == want(HARD)
    assert score_documents(empty, shape=SMALL).collect() == []


def test_nothing_to_learn_from(make_docs):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "some words") for i in held]
    assert made(score_documents(make_docs(rows), shape=SMALL)) == want(rows)


def texts(n, seed):
    """A little grammar: what comes next hangs on the word before."""
    random.seed(seed)
    heads = [f"h{i}a" for i in range(30)]
    tails = {h: [f"{h}t{k}u" for k in range(3)] for h in heads}
    found = []
    for i in range(n):
        words = []
        for _ in range(random.randrange(20, 60)):
            h = random.choice(heads)
            words += [h, random.choice(tails[h])]
        found.append((i, " ".join(words)))
    return found


def test_counts_over_shards_and_held_out_likelihood(make_docs, monkeypatch):
    monkeypatch.setattr(language_model, "TASK_BYTES", 20_000)
    rows = texts(400, 1) + texts(3, 1) + [(1000, "never seen words"), (1001, None)]
    frame = score_documents(make_docs(rows).repartition(5), shape=Shape(bits=12), shard_bytes=15_000).cache()
    assert made(frame) == want(rows)
    held = [r for r in frame.collect() if r["held_out"]]
    per_token = [sum(r[c] for r in held) / sum(r["n_tokens"] for r in held) for c in ("base_score", "score")]
    assert len(held) > 40 and per_token[1] > per_token[0] + 0.3  # half of the tokens are one of three


def test_probabilities_add_up_to_one(spark, make_docs):
    """All known words, and one unseen one of each class and slot, have the whole probability, whatever the context."""
    rows = texts(60, 2)
    docs = make_docs(rows)
    counts = word_counts(docs, SMALL)
    unigrams = Unigrams.of(counts, SMALL)
    weights = language_model.train(docs, SMALL, rounds=2)
    known = counts.toPandas()
    context = b"h1a h1at2u h7a"
    first = Tokens.of([context], SMALL)
    total, words = 0.0, np.array(known["n"])
    for bucket in range(SMALL.classes * SMALL.slots):
        c, s = divmod(bucket, SMALL.slots)
        here = Tokens(first.hashes, first.endings, np.full_like(first.classes, c), np.full_like(first.slots, s), first.bounds)
        a, b = here.features(SMALL)
        p = softmax(weights.weights[0], a[:, -1:])[c, 0] * softmax(weights.weights[1], b[:, -1:])[s, 0]
        n = np.concatenate((words[known["bucket"] == bucket], [0]))
        total += float(p) * (10 ** unigrams.within(n, np.full(len(n), bucket))).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_a_tree_of_sums_equals_one_sum(make_docs, monkeypatch):
    docs = make_docs(texts(80, 3)).repartition(7).cache()
    docs.count()
    whole = language_model._learnt(docs, language_model.Weights(SMALL), SMALL, 7).sort_by([("which", "ascending"), ("block", "ascending")])
    monkeypatch.setattr(language_model, "FAN", 2)
    tree = language_model._learnt(docs, language_model.Weights(SMALL), SMALL, 7).sort_by([("which", "ascending"), ("block", "ascending")])
    assert whole.num_rows == tree.num_rows == 2
    for x, y in zip(whole.column("data").to_pylist(), tree.column("data").to_pylist(), strict=True):
        np.testing.assert_allclose(np.frombuffer(x, np.float32), np.frombuffer(y, np.float32), rtol=1e-3, atol=1e-3)


def test_contexts_stay_within_a_text():
    one, two = Tokens.of([b"a b c"], SMALL), Tokens.of([b"x y", b"a b c", b""], SMALL)
    for x, y in zip(one.features(SMALL), two.features(SMALL), strict=True):
        assert (x == y[:, 3:7]).all()
