import hashlib
import random
from collections import Counter
from unittest import mock

import numpy as np

from corpusloom.llm import substring_dedup
from corpusloom.llm.line_dedup import line_dedup
from corpusloom.llm.substring_dedup import passages_for, remove_repeats, repeated_words
from corpusloom.llm.words import joined, window_hashes, word_hashes
from tests.llm.conftest import HARD


def runs_of(t, run, long):
    lines = [] if t is None else t.split("\n")
    return lines, [(k, tuple(lines[k : k + run])) for k in range(len(lines) - run + 1)] + [(k, (x,)) for k, x in enumerate(lines) if len(x) >= long]


def brute_lines(rows, run, long=200):
    first = {}
    for i, t, *_ in rows:
        for k, key in runs_of(t, run, long)[1]:
            place = (i is not None, i or 0, k)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t, *_ in rows:
        lines, runs = runs_of(t, run, long)
        gone = set()
        for k, key in runs:
            if first[key] < (i is not None, i or 0, k):
                gone |= set(range(k, k + len(key)))
        kept = None if t is None else "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out.append((i, len(lines), len(gone), kept))
    return sorted(out, key=repr)


def test_lines_against_brute_force(hard, clashing, empty, make_docs):
    for docs in (hard, clashing):
        for run in (2, 3):
            assert sorted(map(tuple, line_dedup(docs, run).collect()), key=repr) == brute_lines(HARD, run)
    assert line_dedup(empty).collect() == []


def test_lines_random(make_docs):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice("abcd") if rng.random() < 0.6 else str(rng.random()) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(200 + i, "\n".join("pqrstu")) for i in range(200)] + [(500, "\n".join("a" * 40)), (501, "a long line"), (502, "x\na long line"), (503, "a long line\na long line")]
    for run, long in ((2, 200), (3, 8), (5, 200)):
        assert sorted(map(tuple, line_dedup(make_docs(rows).repartition(3), run, long).collect()), key=repr) == brute_lines(rows, run, long)


def brute_windows(rows, width):
    seen, split = Counter(), []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        split.append((i, words))
        seen.update(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if seen[tuple(words[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=repr)


def test_windows_against_brute_force(hard, clashing, empty):
    for docs in (hard, clashing):
        assert sorted(map(tuple, remove_repeats(docs, 35).collect()), key=repr) == brute_windows(HARD, 35)
    assert sorted(map(tuple, remove_repeats(hard, 3, 2).collect()), key=repr) == brute_windows(HARD, 3)
    assert remove_repeats(empty).collect() == []


def test_windows_random(make_docs):
    """Passages that straddle, overlap, repeat within a document, and whole copies; shards so small that all of it crosses them."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 30))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            words += p[a : rng.randint(a, len(p))] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        rows.append((i, rng.choice((" ", "\n", " \t ")).join(words)))
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, "a " * 500), (401, "a " * 7 + "b " + "a " * 7)]
    for width, gram in ((7, 3), (12, 6), (7, 7), (5, 1)):
        got = remove_repeats(make_docs(rows).repartition(3), width, gram, shard_bytes=700, block=4).collect()
        assert sorted(map(tuple, got), key=repr) == brute_windows(rows, width)


def test_what_goes_is_what_the_automaton_has():
    """With the same texts, a passage more takes more words, a passage less takes fewer, and an automaton that finds nothing takes none."""
    words, bounds = joined([b"a b c d e f g h", b"x a b c d e f g h y", b"k l m n o p q", b"k l m n o p z"])
    gone = lambda *passages: repeated_words(words, bounds, list(passages), 5, 2).tolist()
    one, two = [True] * 8 + [False] + [True] * 8 + [False] + [False] * 14, [False] * 18 + [True] * 6 + [False] + [True] * 6 + [False]
    assert gone(b"a b c d e f g h") == one
    assert gone(b"k l m n o p") == two
    assert gone(b"a b c d e f g h", b"k l m n o p") == [a or b for a, b in zip(one, two, strict=True)]
    assert gone(b"b c d e f") == [False] + [True] * 5 + [False] * 4 + [True] * 5 + [False] * 17
    assert not any(gone()) and not any(gone(b"")) and not any(gone(b"a b c d"))
    with mock.patch.object(substring_dedup, "_locate", lambda words, *_: np.zeros(len(words), dtype=bool)):
        assert not any(gone(b"a b c d e f g h"))
    phrases = []
    with mock.patch.object(substring_dedup, "_locate", lambda words, bounds, p, gram: phrases.extend(p) or np.zeros(len(words), dtype=bool)):
        gone(b"a b c d e f g h")
    assert phrases and all(p in b"a b c d e f g h" for p in phrases)


def test_owners_send_each_holder_its_passages():
    words, bounds = joined([b"a b c d e f g", b"u v w x y z", b"a b c d e f g"])
    hashes = window_hashes(word_hashes(words), 5)
    asked = hashes[[0, 1, 2, 0, 7, 8, 1, 2]]
    holders = np.array([4, 4, 4, 2, 4, 2, 9, 9], dtype=np.int32)
    assert passages_for(words, bounds, asked, holders, 5) == {4: b"a b c d e f g\nu v w x y", 2: b"a b c d e\nv w x y z", 9: b"b c d e f g"}


def test_windows_of_equal_hash_are_compared_by_words():
    """A window whose hash is that of a passage but whose words are others stays."""
    words, bounds = joined([b"a b c d e", b"a b c d e", b"p b c q r"])
    blind = lambda hashes, width, base=0: np.full(max(0, len(hashes) - width + 1), 7, dtype=np.uint64) if width == 5 else window_hashes(hashes, width)
    with mock.patch.object(substring_dedup, "window_hashes", blind):
        gone = repeated_words(words, bounds, [b"a b c d e"], 5, 2)
    assert gone.tolist() == [True] * 10 + [False] * 5


def test_one_phrase_in_every_document(make_docs):
    """A hot phrase and a hot passage, over many shards and blocks."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(9))
    rows = [(i, " ".join([*(f"u{i}_{k}" for k in range(rng.randint(0, 9))), "we all say so", passage if i % 3 else "none"])) for i in range(400)]
    got = remove_repeats(make_docs(rows), 7, 3, shard_bytes=300, block=5).collect()
    assert sorted(map(tuple, got), key=repr) == brute_windows(rows, 7)
