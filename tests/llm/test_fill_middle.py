import hashlib
import random
import re

import pytest

from corpusloom.llm import fill_middle
from corpusloom.llm.fill_middle import ChunkCache, Cutter, fill_in_middle, restored
from pyspark.sql import functions as F
from tests.llm.conftest import HARD


def want(doc_id, text, seed=1):
    """By a regular expression over the whole text."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def made(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_cuts_equal_the_regular_expression_on_any_bytes():
    random.seed(7)
    cached = ChunkCache(most=3_000)
    for size in (0, 1, 5, 700, 5_000, 90_000):
        for letters in ("ab", "abcXYZ  .\n", "aé€𝄞 ñb", "x"):
            text = "".join(random.choices(letters, k=size))
            ends = [0]
            for t in re.findall("[A-Za-z]+|[^A-Za-z]", text):
                ends.append(ends[-1] + len(t.encode()))
            cutter = Cutter(text.encode(), cached)
            assert cutter.n == len(ends) - 1
            for k in {0, min(1, cutter.n), cutter.n // 3, cutter.n // 2, cutter.n, *random.choices(range(cutter.n + 1), k=20)}:
                assert cutter.offset(k) == ends[k]


def test_shared_passages_share_chunks(monkeypatch):
    random.seed(8)
    passage = "".join(random.choices("abcdefgh ", k=20_000)).encode()
    seen = []
    monkeypatch.setattr(fill_middle, "summary", lambda chunk, f=fill_middle.summary: seen.append(len(chunk)) or f(chunk))
    cached = ChunkCache()
    Cutter(passage, cached)
    first = sum(seen)
    Cutter(b"another start " + passage + b" and end", cached)
    assert first == len(passage) and sum(seen) - first < 4_000


def test_hard_rows_and_forms(spark, hard, make_docs):
    assert made(fill_in_middle(hard).collect()) == made(want(r[0], r[1]) for r in HARD)
    random.seed(9)
    rows = [(i, "".join(random.choices("ab <PSM>é\n", k=random.randrange(60)))) for i in range(400)]
    rows += [(1000 + i, f"{'<' * (i % 3)}S one <{'P' * (i % 2)} two <S") for i in range(60)]
    got = fill_in_middle(make_docs(rows))
    assert made(got.collect()) == made(want(*r) for r in rows)
    assert {r["form"] for r in got.select("form").collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert made(back.collect()) == made(rows)


def test_clashing_columns_and_empty_table(clashing, empty):
    assert made(fill_in_middle(clashing).collect()) == made(want(r[0], r[1]) for r in HARD)
    assert fill_in_middle(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_seed_is_part_of_the_hash(make_docs, seed):
    rows = [(i, "some words to cut, here and there") for i in range(50)]
    assert made(fill_in_middle(make_docs(rows), seed=seed).collect()) == made(want(*r, seed=seed) for r in rows)
