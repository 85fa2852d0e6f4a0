import hashlib
import os
import random

from corpusloom.llm.cuckoo import CuckooIndex
from corpusloom.llm.exact_dedup import exact_dedup, live_digests


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(hard, clashing):
    from tests.llm.conftest import HARD

    assert sorted(map(tuple, exact_dedup(hard).collect()), key=repr) == brute(HARD)
    assert sorted(map(tuple, exact_dedup(clashing).collect()), key=repr) == brute(HARD)


def test_empty(empty):
    assert exact_dedup(empty).collect() == []


def test_large_group_moves_to_the_largest_id(make_docs):
    rows = [(i, "same") for i in range(3000)] + [(i, f"other {i % 7}") for i in range(3000, 3100)]
    random.Random(1).shuffle(rows)
    assert sorted(map(tuple, exact_dedup(make_docs(rows).repartition(5)).collect()), key=repr) == brute(rows)


def test_cuckoo_index_inserts_deletes_and_resizes():
    rng = random.Random(7)
    index, model = CuckooIndex(2), {}
    keys = [os.urandom(2) + rng.randbytes(38) for _ in range(3000)]
    for step in range(9000):
        key = rng.choice(keys)
        if key in model and rng.random() < 0.4:
            assert index.delete(key)
            del model[key]
        elif key not in model:
            index.insert(key, [step])
            model[key] = [step]
        assert (index.get(key) is None) == (key not in model)
    assert dict(index.items()) == model and index.live == len(model) and index.resizes > 0
    assert not index.delete(b"\0" * 40)
    assert all(index.get(k) == model.get(k) for k in keys)


def test_cuckoo_hits_are_verified_against_content():
    index = CuckooIndex(1)
    same_place = b"\1\2" + b"\0" * 8
    index.insert(same_place + b"a" * 30, ["a"])
    assert index.get(same_place + b"b" * 30) is None and index.false_hits >= 1
    for k in range(7):  # tag and buckets are the same for all; two buckets hold eight
        index.insert(same_place + bytes([k]) * 30, [k])
    assert index.get(same_place + b"\3" * 30) == [3] and index.get(same_place + b"a" * 30) == ["a"]


def test_tags_of_a_bucket_are_spread():
    """The digests of one bucket share no bits that the filter uses: few false hits among many keys."""
    index = CuckooIndex()
    keys = [hashlib.sha256(str(i).encode()).digest() + (9).to_bytes(8, "little") for i in range(20_000)]
    for k in keys:
        index.insert(k, [1])
    for i in range(20_000):
        assert index.get(hashlib.sha256(f"other {i}".encode()).digest() + bytes(8)) is None
    assert index.false_hits < 60 and len({index._place(k)[0] for k in keys}) > 15_000
    assert index.mask + 1 <= 16_384


def test_small_buckets(make_docs):
    rows = [(i, f"text {i % 301}") for i in range(900)]
    got = live_digests(make_docs(rows).repartition(3), bucket_rows=7).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == sorted((max(i for i in range(900) if i % 301 == k), len(range(k, 900, 301))) for k in range(301))
