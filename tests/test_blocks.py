"""Large text files by blocks against the same files whole: charsets, repaired texts, line ends, both strategies; the stream reads no large file into a cell."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.packing import Packing
from corpusloom.operators.segments import Counters, Piece, merge_small, numbered, pack_paragraphs, pack_sentences
from corpusloom.plans.ingest import Index, file_chunks, folder_chunks
from corpusloom.sources import blocks, charsets
from corpusloom.sources.documents import read_files
from corpusloom.streaming import activity

WORDS = "the quick brown Fox 3.5 e.g. Dr. U.S. (see) re- well-known \"quoted.\" | : Paris, item; end! why? a\tb  two x-".split(" ")
LATIN = [*WORDS, "école", "âge", "Größe", "naïve", "señor", "Ã©", "x\xa0y", "\x85", "½"]
WIDE = [*LATIN, "ﬁnal", "été", "‏مدرسة", "كـتاب", "أَحْمَد", "؟", "—", " ", "\x07", "q-‏"]
ARABIC = "هذا نص عربي طويل يحتوي على كلمات كثيرة ومفيدة للقراءة في المدرسة ، نعم ؟".split()
ENDS = ["\n", "\n", "\n", "\n\n\n", "\r\n", ".\n", "-\n", " \n", ".\n)", "\ń", "\n "]


def text_of(rng, words, ends, n=400):
    return "".join(" ".join(rng.choices(words, k=rng.randrange(1, 14))) + rng.choice(ends) for _ in range(n))


def files_of(rng):
    latin_ends = [e for e in ENDS if e.isascii()]
    yield "ascii", text_of(rng, WORDS, latin_ends).encode()
    yield "latin", text_of(rng, LATIN, latin_ends).encode()
    yield "wide", text_of(rng, WIDE, ENDS).encode()
    yield "western", text_of(rng, LATIN, latin_ends).encode("windows-1252", "ignore")
    yield "arabic", text_of(rng, ARABIC, ["\n", ".\n", "-\n"]).encode("windows-1256")
    yield "arabic8", text_of(rng, [*ARABIC, "ـ", "نعمـ"], ["\n", "ـ\n", "\n\n"]).encode()
    yield "misread", text_of(rng, [*WORDS, "école", "مدرسة", "—"], latin_ends).encode().decode("latin-1").encode()
    yield "half misread", (text_of(rng, [*WORDS, "école"], latin_ends).encode().decode("latin-1") + "\nécole\n").encode()
    yield "marked", b"\xef\xbb\xbf" + text_of(rng, WIDE, ENDS).encode()
    yield "utf16", text_of(rng, WIDE, ENDS).encode("utf-16")
    yield "utf16be", b"\xfe\xff" + text_of(rng, WIDE, ENDS).encode("utf-16-be")
    yield "utf32", text_of(rng, WIDE, ENDS).encode("utf-32")
    yield "one line", (" ".join(rng.choices(WORDS, k=3000))).encode()
    yield "line ends alone", b"\n" * 5000
    yield "few words", b"a\n" * 5 + b" " * 4000


@pytest.mark.parametrize("strategy", ["sentence_window", "paragraph"])
def test_blocks_give_the_chunks_of_whole_files(spark, tmp_path, monkeypatch, strategy):
    folder = tmp_path / "in [1]{a}"
    folder.mkdir()
    for name, content in files_of(random.Random(5)):
        (folder / f"{name}.txt").write_bytes(content)
        (folder / f"{name} again.md").write_bytes(content)
    monkeypatch.setattr(blocks, "_STEP", 1000)
    files = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in sorted(folder.iterdir())], "path string, length long")
    whole = file_chunks(read_files(spark, [r["path"] for r in files.collect()]), strategy).collect()
    parted = folder_chunks(files, f"file://{tmp_path}/units", strategy, large=1, block=300, span=2000).collect()
    shown = lambda rows: sorted((r["metadata_json"], r["file_hash"], r["chunk_id"], r["text"], r["chunk_content_hash"]) for r in rows)
    assert len({r["file_hash"] for r in whole}) == 13 and shown(parted) == shown(whole)
    assert spark.read.parquet(f"file://{tmp_path}/units").groupBy("file_hash").count().filter("count >= 20").count() >= 9  # they were cut


def test_charsets_of_files_as_of_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "_STEP", 7)
    rng = random.Random(3)
    odd = [bytes(rng.choices(b"\xc7\xe1\xc8 a\xe9\xd3.", k=rng.randrange(1, 60))) for _ in range(200)] + [b"\xff\xfe" + b"ab", b"\xff\xfea\x00", b"\xef\xbb\xbf" + b"x" * 200, "é".encode() * 9 + b"\xc3"]
    for raw in [*odd, *(c for _, c in files_of(rng))]:
        (tmp_path / "f").write_bytes(raw)
        with blocks._opened(f"file:{tmp_path}/f") as file:
            told = next(blocks._told(iter([blocks.pa.RecordBatch.from_pylist([{"path": f"file:{tmp_path}/f", "length": len(raw)}])]))).to_pylist()[0]
            text = "".join(blocks._texts(file, told["codec"], told["start"], "replace"))
        assert text == charsets.decode(raw, False)[0]


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_packing_by_blocks_equals_packing_of_all(overlap):
    rng = random.Random(overlap)
    for by_sums, between, pack in ((False, " ", pack_sentences), (True, "\n\n", pack_paragraphs)):
        for _ in range(150):
            arabic = rng.random() < 0.3
            units = [Piece(f"u{k}", Counters(n := rng.choice((1, 3, 9, 30, 60)), n, n * (arabic and rng.randrange(3)), 2 * n)) for k in range(rng.randrange(0, 60))]
            windows = pack(units, 40, overlap)
            want = numbered(windows) if overlap else merge_small(windows, 25)
            packing, at, parts = Packing(40, overlap, by_sums, between, None if overlap else 25), 0, []
            held = {}
            while at < len(units):
                held[at] = units[at : at + rng.randrange(1, 9)]
                parts += packing.add(at, [u.c for u in held[at]])
                at += len(held[at])
            parts += packing.end()
            assert [a for a, _ in parts] == list(held)
            made = {}
            for at_, some in parts:
                for n, index, c, many, pieces in some:
                    made.setdefault(n, (index, c, many, []))[3].append("".join(lead + between.join(u.text for u in held[at_][a:b]) for lead, a, b in pieces))
            assert [(i, Piece("".join(t), c)) for i, c, many, t in made.values() if many == len(t)] == want


def test_a_large_file_in_a_stream_is_never_one_cell(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "large.txt").write_text("".join(f"Number {k} is a line of a file that is larger than any cell may be.\n" for k in range(3000)))
    (folder / "small.txt").write_text("A small file has some words as well, and more than twelve of them, so that it stays here. " * 3)
    monkeypatch.setattr(activity, "folder_chunks", lambda batch, *rest: folder_chunks(batch, *rest, large=50_000, block=1000, span=20_000))
    index = Index(spark, f"file://{tmp_path}/index", buckets=2)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60000")  # reading the large one whole is an error
    try:
        activity.stream_folder(spark, f"file://{folder}", index, f"file://{tmp_path}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    chunks = index.manifest().groupBy(F.regexp_extract("metadata_json", "([a-z]+).txt", 1).alias("f")).count().collect()
    found = {r["f"]: r["count"] for r in chunks}
    assert found["small"] == 1 and found["large"] > 300 and index.vectors().count() == sum(found.values())
