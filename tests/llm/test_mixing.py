import hashlib
import random
from collections import defaultdict

import pytest

from corpusloom.llm.mixing import mix, mixed_documents
from tests.llm.conftest import HARD


def n_words(t):
    return len((t or "").encode().split())


def want_targets(sizes, weights=(1, 2, 3), most=3):
    """Resharing in rounds, as told: sources above the bound stop at it, the excess goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = fixed | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += n_words(t)
    target = want_targets(dict(sizes))
    assert len(got) == len(rows)
    source = defaultdict(list)
    for i, t, _, s, *_ in rows:
        source[i, n_words(t)].append(s)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id, r.size].pop()
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6, (s, taken[s], target[s])


def made(n):
    rng = random.Random(4)
    names = ["b", "a", "é", None, "tiny", "big"]
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choices(names, (5, 5, 5, 5, 0.3, 40))[0]) for i in range(n)]
    return [*rows, (n, "one", "en", "tiny"), (n + 1, "z " * 3000, "en", "a")]


def test_targets_and_taken(make_docs):
    rows = made(1500)
    got = mix(make_docs(rows).repartition(3)).collect()
    check(rows, got)
    again = mix(make_docs(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_hard(hard, clashing, empty):
    for docs in (hard, clashing):
        got = mix(docs).collect()
        assert len(got) == len(HARD) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mix(empty).collect() == [] and mixed_documents(empty).collect() == []
    assert mixed_documents(clashing).columns == clashing.columns


def test_a_larger_budget_takes_what_a_smaller_one_takes(make_docs):
    rows = [(i, "w " * 10, "en", "a") for i in range(300)] + [(1000 + i, "w " * 10, "en", "b") for i in range(100)]
    less = {r.doc_id for r in mix(make_docs(rows), weights=(1, 1)).collect() if r.taken and r.doc_id < 1000}
    more = {r.doc_id for r in mix(make_docs(rows), weights=(5, 3)).collect() if r.taken and r.doc_id < 1000}
    assert less < more


def test_documents_are_repeated_as_taken(make_docs):
    rows = made(400)
    docs = make_docs(rows)
    taken = {r.doc_id: r.taken for r in mix(docs).collect()}
    words = defaultdict(int)
    for r in mixed_documents(docs).collect():
        words[r.doc_id] += n_words(r.text)
    assert words == {i: n for i, n in taken.items() if n} | {i: 0 for i in words if not taken[i]}


def test_hash_is_md5(make_docs):
    from pyspark.sql import functions as F

    from corpusloom.llm.mixing import hash60

    got = make_docs([(5, "x"), (None, "y")]).select("doc_id", hash60().alias("h")).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [r.h for r in got] == [int(hashlib.md5(x).hexdigest()[:15], 16) for x in (b"mix:5", b"mix:null")]
