import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm.quality import features, fit
from tests.conftest import SF
from tests.llm.test_mixing import n_words, want_targets
from tests.llm.test_quality_decontaminate import brute_hits
from tests.llm.test_simhash import labels, slow


def near_groups(texts):
    """Documents linked by SimHash within 2 bits, or by 0.8 of their five-word shingles: all pairs."""
    prints = {i: slow(t) for i, t in texts.items()}
    by_print = labels(prints.values())
    group = {i: by_print[f] for i, f in prints.items()}
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    for a in texts:
        for b in texts:
            if a < b and group[a] != group[b] and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = {i: new if g == old else g for i, g in group.items()}
    return group


def test_pipeline_against_brute_force(spark):
    """Every stage recomputed in plain Python; of the classifier the fitted weights are taken as given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(np.array([features(r.text or "")]))[0] >= 0.7]
    group = near_groups({r.doc_id: r.text for r in rows})
    rows = [r for r in rows if r.doc_id == min(i for i, g in group.items() if g == group[r.doc_id])]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, hit in zip(rows, brute_hits([r.text for r in rows], bench), strict=True) if not hit]

    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    copies = {}
    for r in got:
        copies[r[0]] = copies.get(r[0], 0) + 1
    by_id = {r.doc_id: r for r in rows}
    assert set(copies) <= set(by_id) and max(copies.values()) <= 3
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        n = n_words(r.text)
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + n * copies.get(r.doc_id, 0)
        largest[r.source] = max(largest.get(r.source, 0), n)
    target = want_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)

    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    for doc_id, at, n, crc in got:
        ids = np.array(library.encode(by_id[doc_id].text, add_special_tokens=False).ids + [2], "<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += n


def test_stages():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
