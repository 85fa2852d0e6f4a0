import random
import zlib

import numpy as np

from corpusloom.llm.decontaminate import BlockMaxIndex, decontaminate, grams, question_and_answer, terms_of
from corpusloom.llm.quality import bin_prior, estimate_prior, features, fit, fit_nnpu, keep_good, quality
from tests.conftest import SF
from tests.llm.conftest import HARD


def test_non_negative_risk_finds_the_positives():
    rng = np.random.default_rng(0)
    positive = rng.normal(1.5, 1, (4000, 3))
    mixed = np.concatenate((rng.normal(1.5, 1, (2400, 3)), rng.normal(-1.5, 1, (1600, 3))))
    model = fit_nnpu(positive, mixed, 0.6)
    assert (model.score(positive) > 0.5).mean() > 0.95 and (model.score(mixed[2400:]) < 0.5).mean() > 0.95
    guessed = fit_nnpu(positive, mixed, None)
    assert 0.45 < guessed.prior < 0.75
    for share in (0.3, 0.6, 0.9):
        n = int(4000 * share)
        other = np.concatenate((rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (4000 - n, 3))))
        assert abs(estimate_prior(positive, other) - share) < 0.08
    assert bin_prior(model.binned(positive), model.binned(positive), 3 * 17) == 0.99


def test_features_of_odd_texts():
    for t in ("", " \n", "x", "x" * 100_000, "日本語", "||| !!!"):
        assert len(features(t)) == 14 and np.isfinite(features(t)).all()


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    told = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if held_out(r.doc_id)]
    assert np.mean([p == q for p, q in told]) >= 0.95
    assert 0.7 < fit(docs, labels).prior < 0.99  # nearer to the share among labels (0.87) than a blind guess
    assert np.mean([p for p, q in told if q == 1]) > 0.95
    again = {r.doc_id: r.score for r in quality(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_held_out_labels_are_not_used(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(docs, labels), fit(docs, other)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_quality_of_hard_rows(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (9, 0, 1), (None, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    nothing = labels.filter("false")
    for docs in (hard, clashing):
        for told in (labels, nothing):
            got = quality(docs, told).collect()
            assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert quality(empty, labels).collect() == [] and keep_good(empty, labels).collect() == []
    assert keep_good(clashing, labels).columns == clashing.columns
    assert {r.score for r in quality(hard, nothing).collect()} == {0.5}


def brute_hits(texts, items, overlap=0.8):
    """Passages as told, every item verified in every passage."""
    split = [(i, question_and_answer(t)) for i, t in items if terms_of(t)]
    step = max((len(terms_of(t)) for _, t in items), default=1) or 1
    out = []
    for t in texts:
        words, found = terms_of(t), set()
        for p in range(max(1, -(-len(words) // step) - 1)):
            passage = words[p * step : (p + 2) * step]
            for i, sides in split:
                halves = [h for h in map(grams, sides) if h]
                sizes = [len(next(iter(h))) for h in halves]
                if all(len(h & {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}) >= overlap * len(h) for h, n in zip(halves, sizes, strict=True)):
                    found.add(i)
        out.append(sorted(found, key=lambda i: (i is None, i or 0)))
    return out


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{int(rng.paretovariate(0.6)) % 900}" for _ in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(rng.randint(12, 60)))) for k in range(120)] + [(500, "alpha beta"), (501, "solo"), (502, ""), (503, None)]
    texts = []
    for _ in range(120):
        words = text(rng.randint(0, 400))
        for _ in range(rng.choice((0, 0, 1, 2))):
            item = (rng.choice(items)[1] or "").split()
            if rng.random() < 0.4 and len(item) > 20:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append(rng.choice((" ", "\n", ", ")).join(words).upper() if rng.random() < 0.2 else " ".join(words))
    return items, texts


def test_hits_equal_brute_force():
    for seed in range(3):
        items, texts = cases(seed)
        got = BlockMaxIndex(items, 0.6).hits(texts)
        assert got == brute_hits(texts, items)
        assert sum(map(len, got)) > 40


def test_wand_returns_all_above_the_threshold():
    items, texts = cases(9)
    for threshold in (0.2, 0.45, 0.8):
        for block in (1, 3, 16):
            index = BlockMaxIndex(items, threshold, block)
            for t in texts[:60]:
                terms = sorted({index.number[w] for w in terms_of(t)[:80] if w in index.number})
                scores = np.zeros(len(index.ids))
                for k in terms:
                    scores[index.items[k]] += index.weights[k]
                got = dict(index.search(terms))
                assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())
                passing = index.sift(np.zeros(len(terms), dtype=np.int64), np.array(terms, dtype=np.int64), 1)
                assert len(passing) or not got


def test_documents(spark, hard, clashing, empty, make_docs):
    items, texts = cases(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(list(enumerate(texts)))
    for size in (8_000_000, 4_000):  # the second makes several indexes
        got = {r.doc_id: r.item_ids for r in decontaminate(docs, bench, index_bytes=size).collect()}
        assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)
    small = [(1, "one two three four five six"), (2, "c 12,5 it's"), (3, "W w"), (3, "W w"), (None, "no id here"), (4, ""), (5, None)]
    small_bench = spark.createDataFrame(small, "item_id long, text string")
    want = sorted(((i, hits) for (i, *_), hits in zip(HARD, brute_hits([t or "" for _, t, *_ in HARD], small), strict=True)), key=repr)
    for d in (hard, clashing):
        for size in (8_000_000, 10):
            found = decontaminate(d, small_bench, index_bytes=size)
            assert sorted(((r.doc_id, r[-1]) for r in found.collect()), key=repr) == want
    assert decontaminate(empty, bench).collect() == []
    assert all(r.item_ids == [] for r in decontaminate(hard, bench.filter("false")).collect())


def test_question_and_answer():
    assert question_and_answer("What is it? Is it blue? A: a blue bird") == (["what", "is", "it", "is", "it", "blue"], ["a", "blue", "bird"])
    assert question_and_answer("Who came? The cat") == (["who", "came"], ["the", "cat"])
    assert question_and_answer("one two three?") == (["one"], ["two", "three"])
    assert question_and_answer("") == ([], []) and question_and_answer("solo") == ([], ["solo"])
