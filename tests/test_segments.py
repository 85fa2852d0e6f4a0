"""Segmentation against plain definitions on whole strings, on made texts and on all documents of the smallest data set."""

import random
import re

import pyarrow.parquet as pq
import pytest

from corpusloom.operators import chunking, segments
from tests.conftest import SF

TOKENS = re.compile(r"\w+|[^\w\s]")


def size(text):
    found = TOKENS.findall(text)
    letters = [c for c in text if c.isalpha()]
    wide = sum("؀" <= c <= "ۿ" or "ݐ" <= c <= "ݿ" or "ࢠ" <= c <= "ࣿ" for c in text)
    if letters and wide / len(letters) >= 0.3:
        return max(len(found), round(1.35 * len([t for t in found if any(c.isalnum() for c in t)])))
    return len(found)


def parts(text, target):
    """Every way of parting in turn, on strings."""
    if size(text) > target:
        for rule in (r"(?<=[:;])\s+", r"\s+\|\s+", r"(?<=,)\s+(?=[A-Zء-ي])"):
            cut = [p.strip() for p in re.split(rule, text)]
            fine = sum((parts(p, target) for p in cut), []) if len(cut) > 1 else [text]
            if all(size(p) < size(text) for p in fine):
                return fine
        words = text.split()
        if len(words) > 1:
            half = len(words) // 2
            return parts(" ".join(words[:half]), target) + parts(" ".join(words[half:]), target)
    return [text]


def windows(units, target, overlap):
    out, k = [], 0
    while k < len(units):
        n = 1
        while k + n < len(units) and sum(map(size, units[k : k + n + 1])) <= target:
            n += 1
        out.append(" ".join(units[k : k + n]))
        k += max(1, n - overlap)
    return out


def paragraph_windows(units, target, overlap):
    out, held = [], []
    for p in units:
        if held and size("\n\n".join([*held, p])) > target:
            out.append("\n\n".join(held))
            held = held[len(held) - min(overlap, len(held)) :]
        held.append(p)
    return out + ["\n\n".join(held)] * bool(held)


def merged(texts, least):
    out, k = [], 0
    while k < len(texts):
        n = 1
        while k + n < len(texts) and size("\n".join(texts[k : k + n])) < least:
            n += 1
        text = "\n".join(texts[k : k + n])
        if size(text) < least and out:
            out[-1] = (f"merge_back_{k + n - 1}", out[-1][1] + "\n" + text)
        else:
            out.append((str(k) if n == 1 else f"merge_fwd_{k + n - 2}", text))
        k += n
    return out


def made_texts():
    random.seed(3)
    words = ["a", "b:", "c;", "d,", "Eee", "|", "f.", "3.14", "Dr.", "U.S.", "مدرسة", "كتاب،", "g!", "(h)", " ", "i\tj", "-", "x_1"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", "\t"]
    return ["".join(random.choice(words) + random.choice(gaps) for _ in range(random.randrange(120))) for _ in range(300)]


@pytest.fixture(scope="module")
def all_texts():
    return made_texts() + [t or "" for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]


def test_counters_and_sizes(all_texts):
    for t in all_texts:
        assert segments.counters(t).size == size(t)


def test_oversized_units_by_definition(all_texts):
    for t in all_texts:
        for u in segments.split_sentences(t):
            for target in (1, 3, 9, 40):
                got = segments.split_oversized(u, target)
                assert [p.text for p in got] == parts(u, target)
                assert all(p.c == segments.counters(p.text) for p in got)


def test_windows_by_definition(all_texts):
    for t in all_texts:
        for target, overlap in ((5, 0), (12, 1), (140, 0), (140, 1), (30, 3)):
            units = segments.sentence_units(t, target)
            got = segments.pack_sentences(units, target, overlap)
            assert [p.text for p in got] == windows([u.text for u in units], target, overlap)
            assert all(p.c == segments.counters(p.text) for p in got)


def test_paragraphs_and_merges_by_definition(all_texts):
    for t in all_texts:
        told = segments.paragraphs(t)
        assert [p.text for p in told] == [p.strip() for p in re.split(r"\n+", t) if p.strip()]
        for target, overlap in ((260, 1), (20, 0), (9, 2)):
            got = segments.pack_paragraphs(told, target, overlap)
            assert [p.text for p in got] == paragraph_windows([p.text for p in told], target, overlap)
            assert all(p.c == segments.counters(p.text) for p in got)
        for least in (3, 25, 80):
            got = segments.merge_small(told, least)
            assert [(i, p.text) for i, p in got] == merged([p.text for p in told], least)
            assert all(p.c == segments.counters(p.text) for _, p in got)


def test_sentences_are_the_text_without_white_space(all_texts):
    for t in all_texts:
        assert "".join("".join(segments.split_sentences(t)).split()) == "".join(t.split())


def test_very_long_texts_take_time_in_proportion():
    text = "word, " * 100_000
    got = segments.pack_sentences(segments.sentence_units(text, 140), 140, 0)
    assert sum(p.c.tokens for p in got) == 200_000 and max(p.c.size for p in got) <= 140


def test_chunks_of_documents_by_definition(spark, all_texts):
    rows = [(str(k), t) for k, t in enumerate(all_texts)] + [("none", None)]
    clean = spark.createDataFrame([(k, t, t, 0) for k, t in rows], "doc_id string, raw_text string, clean_text string, page_num int")
    for strategy, overlap in (("sentence_window", 0), ("paragraph", 1), ("paragraph", 0)):
        want = set()
        for k, t in rows:
            if strategy == "paragraph":
                found = paragraph_windows([p.strip() for p in re.split(r"\n+", t or "") if p.strip()], 260, overlap)
            else:
                units = [q for u in segments.split_sentences(t or "") for q in parts(u, 140)]
                found = windows(units, 140, overlap)
            found = merged(found, 80) if not overlap else [(str(i), c) for i, c in enumerate(found)]
            want |= {(k, i, c, size(c)) for i, (_, c) in enumerate(found) if size(c) >= 12 and sum(map(str.isalpha, c)) >= 20}
        got = chunking.chunk_documents(clean, strategy, overlap=overlap).select("source_doc_id", "chunk_index", "text", "token_count")
        assert {tuple(r) for r in got.collect()} == want


def test_own_segmentation(spark):
    clean = spark.createDataFrame([("d", "x", "one two three four five six seven eight nine ten eleven twelve / " * 2, 0)], "doc_id string, raw_text string, clean_text string, page_num int")
    cut = lambda t: [segments.Piece(p.strip(), segments.counters(p)) for p in t.split("/") if p.strip()]
    got = chunking.chunk_documents(clean, "slashes", overlap=1, segment=cut).select("text", "token_count", "strategy").collect()
    assert [(r["token_count"], r["strategy"]) for r in got] == [(12, "slashes")] * 2
