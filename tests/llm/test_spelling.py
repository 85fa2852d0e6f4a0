import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm.spelling import group_variants, near_pairs, prefix_and_pivots
from tests.llm.conftest import HARD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def want(rows, min_length=6, min_count=5, ratio=5, rate=199):
    """All pairs of words, straight from the definition."""
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_length and c >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, all_near in near.items():
        best = min(all_near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def made(frame):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in frame.collect())


def test_hard_clashing_empty(spark, hard, clashing, empty):
    assert made(group_variants(hard, min_length=4, min_count=1)) == want(HARD, min_length=4, min_count=1)
    assert made(group_variants(clashing, min_length=4, min_count=1)) == want(HARD, min_length=4, min_count=1)
    assert made(group_variants(empty)) == []


def test_random_words_equal_all_pairs(make_docs):
    random.seed(5)
    alphabet = "abcéÉ×ÿ"
    stems = ["".join(random.choices(alphabet, k=random.randrange(4, 10))) for _ in range(60)]

    def edited(w):
        at = random.randrange(len(w))
        return random.choice((w[:at] + w[at + 1 :], w[:at] + random.choice(alphabet) + w[at:], w[:at] + random.choice(alphabet) + w[at + 1 :]))

    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = random.choice(stems[: 1 + int(random.paretovariate(0.5)) % 60])
            for _ in range(random.choice((0, 0, 0, 1, 1, 2))):
                w = edited(w) if w else w
            words.append(w if random.random() < 0.8 else w.title())
        rows.append((i, " ".join(words)))
    got = made(group_variants(make_docs(rows), min_length=4, min_count=2, ratio=2, rate=7))
    expected = want(rows, min_length=4, min_count=2, ratio=2, rate=7)
    assert got == expected
    assert sum(r[4] for r in got) > 1_000 and any(r[1] and r[2] != r[1] for r in got)


def test_every_pair_of_a_dense_set_of_words_is_found(spark):
    # all words over two letters, with grams that repeat: ties at the end of prefixes
    words = [f"{k:0{size}b}".replace("0", "a").replace("1", "b") for size in (4, 5, 6) for k in range(2**size)]
    got = near_pairs(spark.createDataFrame([(k, w, 1) for k, w in enumerate(words)], "id long, word string, n long"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_ties_and_chains(make_docs):
    counts = {"kitten": 100, "kittens": 20, "xkittens": 4, "mitten": 100, "sitten": 20, "abcdefgh": 5, "abcdefghi": 24}
    rows = [(i, w) for w, n in counts.items() for i in range(n)]
    got = {r[0]: r[1:] for r in made(group_variants(make_docs(rows), min_count=4, rate=10**12))}
    assert got["xkittens"] == ("kittens", "kitten", 4, 1, 20)  # root over two steps
    assert got["sitten"] == ("kitten", "kitten", 20, 2, 100)  # kitten and mitten tie
    assert got["kitten"][0] == "" and got["kitten"][1] == "kitten" and got["kitten"][3] == 3
    assert got["abcdefgh"] == ("", "abcdefgh", 5, 1, 0)  # 24 is below 5 * 5


def test_pivots_do_not_overlap_and_are_the_rarest_two():
    random.seed(6)
    for _ in range(300):
        word = "".join(random.choices("abcd", k=random.randrange(4, 12)))
        grams = sorted({a + b for a in "abcd" for b in "abcd"})
        ranks = {g: (k, k * k) for k, g in enumerate(random.sample(grams, len(grams)))}
        prefix, pivots, last = prefix_and_pivots(word, ranks)
        cost = lambda ps: sum(ranks[word[p : p + 2]][1] for p in ps)
        pairs = [(p, q) for p in prefix for q in prefix if q >= p + 2]
        assert len(pivots) == 2 and tuple(pivots) in pairs
        assert cost(pivots) == min(map(cost, pairs))
        assert prefix == [i for i in range(len(word) - 1) if ranks[word[i : i + 2]][0] <= last] and len(prefix) >= 3


def test_very_long_words(make_docs):
    long = ["x" * 30_000, "x" * 30_001, "x" * 15_000 + "y" + "x" * 14_999, "ab" * 32, "ab" * 32 + "c", "ab" * 32 + "a"]
    rows = [(k, w) for k, w in enumerate(long)]
    got = {r[0]: r[4] for r in made(group_variants(make_docs(rows), min_count=1, rate=10**12))}
    assert [got[w] for w in long] == [2, 1, 1, 2, 2, 2]


def test_parameters_are_checked(empty):
    with pytest.raises(ValueError, match="letters"):
        group_variants(empty, min_length=3)
    with pytest.raises(ValueError, match="ratio"):
        group_variants(empty, ratio=1)
