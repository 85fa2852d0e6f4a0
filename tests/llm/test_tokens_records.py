import json
import random
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from corpusloom.llm import records
from corpusloom.llm.records import BARE, CorruptRecord, _Ids, encode_and_read_back, frame, parts_of, read_at, read_records, unframe, write_records
from corpusloom.llm.tokens import RankMerger, count_tokens, cut
from tests.llm.conftest import HARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TRICKY = ["", " ", "  a", "a  b", "a \n b", "\ta b", "a b ", "aaaaaaaaaaaaaaaa" * 9, "it's we'll  they've 'S", "x y z", "a  b", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "日本語 テスト 🙂🙂 a", "1234567 8 90", "²³ ½ Ⅷ a", "a_b __c ___", "é ñ", "\x1c \x1d a", "\x85 b", "!!! ??? ...", "\r\n\r\n x\r\n"]


def random_texts(n):
    rng = random.Random(11)
    letters = "abcde  \n\t.,'!é日½_  12"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_equal_the_library(library):
    merger = RankMerger.from_file(PATH)
    texts = TRICKY + random_texts(400)
    assert merger.count_parts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_cut_parts_are_independent(library):
    for t in TRICKY + random_texts(400):
        parts = cut(t)
        assert " ".join(parts) == t
        ids = [i for k, p in enumerate(parts) for i in library.encode((" " if k else "") + p, add_special_tokens=False).ids]
        assert ids == library.encode(t, add_special_tokens=False).ids


def test_fine_parts_are_independent(library):
    rng = random.Random(3)
    pieces = ["word", "Wörd", "a", "1", "12", ",", ".", "!", "'s", "_", "\n", " ", " ", " ", "\n\n", "\x01", "e\u0301", "-", "²"]
    for t in TRICKY + random_texts(300) + ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(3000)]:
        ids = [i for p in parts_of(t) for i in library.encode(p[1:] if p[:1] == BARE else " " + p, add_special_tokens=False).ids]
        assert ids == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_count_query(hard, clashing, empty, library):
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t, *_ in HARD), key=repr)
    for docs in (hard, clashing):
        assert sorted(map(tuple, count_tokens(docs, PATH).collect()), key=repr) == want
    assert count_tokens(empty, PATH).collect() == []


def want_records(rows, library):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ordered]
    starts = [0, *accumulate(map(len, ids))]
    return [(r[0], s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(ordered, starts, ids, strict=False)]


def test_round_trip(make_docs, clashing, empty, library):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TRICKY + random_texts(100))]
    rng.shuffle(rows)
    got = sorted(map(tuple, encode_and_read_back(make_docs(rows).repartition(3), PATH).collect()), key=lambda r: r[1])
    assert got == want_records(rows, library)
    assert encode_and_read_back(empty, PATH).collect() == []
    got = sorted(map(tuple, encode_and_read_back(clashing, PATH).collect()), key=lambda r: r[1])
    assert [r[2:] for r in got if r[0] is not None] == [r[2:] for r in want_records(HARD, library) if r[0] is not None]
    assert [r[0] for r in got] == [r[0] for r in want_records(HARD, library)]


def test_shards_roll_over_and_the_index_finds_each_record(make_docs, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(random_texts(60))]
    folder = f"file://{tmp_path}/records"
    shards = write_records(make_docs(rows), folder, PATH, shard_bytes=500)
    listed = shards.collect()
    assert len(listed) > 4 and sum(s.n_docs for s in listed) == 60
    assert sorted(map(tuple, read_records(shards, folder).collect()), key=lambda r: r[1]) == want_records(rows, library)
    held = {}
    for s in listed:
        for k in range(s.n_docs):
            doc_id, ids = read_at(folder, s.path, k)
            held[doc_id] = ids.tolist()
    assert held == {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
    assert not [f for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/records")) if f.base_name.startswith("_")]


def test_frames():
    small, large = np.array([1, 2, 65535], "<u4"), np.array([1, 65536], "<u4")
    for doc_id, ids in ((5, small), (None, large), (-3, np.array([], "<u4"))):
        data = frame(doc_id, ids)
        back, got, end = unframe(data)
        assert (back, got.tolist(), end) == (doc_id, ids.tolist(), len(data))
        for at in range(len(data)):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(CorruptRecord):
                unframe(bytes(broken))
        with pytest.raises(CorruptRecord):
            unframe(data[:-1])
    assert len(frame(1, small)) + 6 == len(frame(1, np.array([1, 2, 65536], "<u4")))


def test_other_tokenizer_files_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        told = json.load(file)
    changes = [{"normalizer": {"type": "NFC"}}, {"truncation": {"max_length": 8}}, {"pre_tokenizer": None}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": told["model"] | {"dropout": 0.1}}, {"model": told["model"] | {"vocab": {"a": 0}}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}]
    paths = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model")]
    for k, change in enumerate(changes):
        (tmp_path / f"{k}.json").write_text(json.dumps(told | change))
        paths.append(str(tmp_path / f"{k}.json"))
    for path in paths:
        for made in (RankMerger.from_file, _Ids):
            with pytest.raises(ValueError):
                made(path)
    RankMerger.from_file(PATH), _Ids(PATH)


def test_no_garbage_collection_while_texts_are_encoded():
    """Each would go through the caches; it is on again afterwards."""
    import gc

    held, seen = _Ids(public_tokenizers.path("byte_bpe_50k.json")), []
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(3_000)]
    watch = lambda phase, info: seen.append(phase)
    gc.callbacks.append(watch)
    try:
        made = held.encode(texts)
    finally:
        gc.callbacks.remove(watch)
    assert not seen and gc.isenabled() and len(made) == len(texts)


def test_slices_of_texts_equal_the_library_and_look_up_each_part_once(library, monkeypatch):
    """Texts lie one behind another and are cut by their bytes: what ends one or begins the next must not matter, nor a cache that is full."""
    rng = random.Random(5)
    pieces = ["word", "Wörd", "a", "1", "×", "é", "à", "語", "ж", "’", ",", ".", "!!", "'s", "\n", " ", " ", " ", "\x85", "\xa0", "　", " ", " ", "\x1c", "\t", "<|endoftext|>"]
    texts = TRICKY + ["", " ", "\n", "word ", " word", ".", ""] + ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(3000)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    held = _Ids(PATH)
    assert [x.tolist() for x in held.encode(texts)] == want
    monkeypatch.setattr(records, "CACHE_ENTRIES", 50)
    column = pa.array(texts)
    for at in (0, 1, 700, 1400, 2100):
        assert [x.tolist() for x in held.encode(column.slice(at, 700))] == want[at : at + 700]
    assert held.encode([]) == [] and [x.tolist() for x in held.encode(["", ""])] == [[], []]

    class Watched(dict):
        asked = 0

        def get(self, key):
            Watched.asked += 1
            return super().get(key)

    held.places = Watched(held.places)
    held.encode(["one two three " * 500] * 20)
    assert Watched.asked < 50
