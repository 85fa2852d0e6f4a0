"""Token ids as length-delimited binary records in shards, with a separate offset index for shuffled reads.

Format of a shard `part-….rec`: records one after another, each

    length   unsigned 64 bit, little-endian: bytes of the payload
    check    unsigned 32 bit: masked checksum of the eight length bytes
    payload  doc_id (signed 64 bit; -2**63 for null), width (one byte: 2 or 4), then the ids, little-endian, width bytes each
    check    unsigned 32 bit: masked checksum of the payload

The checksum is CRC-32 as zlib has it, turned right by 15 bits plus 0xA282EAD8 (so that a checksum of data that holds
checksums stays sound). Ids take two bytes each where all of a record's ids fit, else four.

Format of an index `part-….idx`: for each record of the shard, in order, the offset and the length of its frame (two unsigned
64 bit numbers). A reader that shuffles seeks by these; one that scans needs only the shard.

Writing: documents are range-partitioned and sorted by doc_id (null first); each task rolls to a new shard after `shard_bytes`, writes to a
name of its own attempt and renames at the end, so a task that is run again leaves no half shard. The shard list (one row per shard) is a
table in the shared folder. Reading goes shard by shard, as rows of that table.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import fresh_path, partitions, slices, table
from corpusloom.llm.tokens import byte_letters, byte_level_file

MASK = 0xA282EAD8
#: Entries of a worker's cache before it keeps those of the latest slice only.
CACHE_ENTRIES = 800_000
NULL_ID = -(1 << 63)
SHARDS = "path string, part int, nth int, n_docs long, n_ids long, n_bytes long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class CorruptRecord(ValueError):
    """A frame whose lengths or checksums do not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack("<qB", NULL_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids (unsigned 32 bit) and the place after the record that starts at `at`."""
    head = bytes(data[at : at + 12])
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise CorruptRecord(f"bad length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head[:8])[0]
    payload, check = bytes(data[at + 12 : end]), bytes(data[end : end + 4])
    if len(check) < 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise CorruptRecord(f"bad payload at byte {at}")
    doc_id, width = struct.unpack("<qB", payload[:9])
    return None if doc_id == NULL_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4"), end + 4


#: Stands before a part that has no space before it.
BARE = "\x01"
_MARKS = np.isin(np.arange(256), list(b",.;:!?"))
#: Bytes at which a text may be cut, bytes that are or may begin white space, and ASCII letters and digits.
_SPOTS = _MARKS | np.isin(np.arange(256), list(b" \n"))
_SPACE = np.isin(np.arange(256), [*b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", 0xC2, 0xE1, 0xE2, 0xE3])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])

#: Letters and signs behind them, which are a pre-token each; without the apostrophe, which has rules of its own.
_MARKED = re.compile("([^\\W\\d_]+)([!-&(-/:-@\\[-`{-~]+)")


def cuts_of(data: np.ndarray) -> np.ndarray:
    """For each place in UTF-8 bytes, and the one behind them, whether they can be cut there into independent parts, so fine that these recur: words with the space before them, marks that end them, newlines.

    A pre-token is white space, or other characters with one space before them at most. So one ends where white space follows something else, where a mark follows a letter or
    digit, and behind a newline that stands alone. Characters that may be white space in UTF-8 count as such.
    """
    spots = np.flatnonzero(_SPOTS[data])
    padded = np.concatenate((np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)))
    here, third, second, last, following = data[spots], padded[spots], padded[spots + 1], padded[spots + 2], padded[spots + 4]
    high = last >= 0x80
    latin = high & (second == 0xC3)
    solid = ~(high | _SPACE[last]) | high & ((second >= 0xC3) & (second < 0xE0) | (second < 0xC0) & (third >= 0xE4) & (third < 0xF0))
    word = _ALNUM[last] | latin & (last != 0x97) & (last != 0xB7)
    before = np.where(_MARKS[here], word & ((following == 32) | (following == 10)), solid)
    behind = (here == 10) & solid & ~_SPACE[following]
    cuts = np.zeros(len(data) + 1, dtype=bool)
    cuts[spots[before]] = True
    cuts[spots[behind] + 1] = True
    return cuts


def parts_of(text: str) -> list[str]:
    """The parts of one text: without the space before them, or else BARE stands there."""
    if BARE in text:
        return [BARE + text]
    data = text.encode()
    cuts = [0, *(np.flatnonzero(cuts_of(np.frombuffer(data, np.uint8))[1:-1]) + 1).tolist(), len(data)]
    parts = [data[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
    return [p[1:] if p[:1] == " " else BARE + p for p in parts]


class _Ids:
    """Token ids by the tokenizers library; parts of texts that a worker has seen are not encoded again.

    The texts of a slice are cut where their bytes tell (`cuts_of`), so that only its distinct parts are looked up; the ids of all parts known so far stand in one array, from which
    those of the texts are taken by place. New words of Latin letters, also those before signs, are encoded many at a time, as one line that needs no pattern to be
    split; the token that begins with a space begins a word. When the cache is full, all but the parts of the latest slice are dropped.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        byte_level_file(path)
        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.pre_tokenizer = Split("\u0120", "merged_with_next")  # what byte-level text has for a space
        self.letters = dict(enumerate(byte_letters()))
        size = self.tokenizer.get_vocab_size()
        self.begins = np.array([self.tokenizer.id_to_token(i).startswith("\u0120") for i in range(size)])
        self.places: dict[bytes, int] = {}
        self.ids, self.sizes, self.starts = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.latest: list[bytes] = []

    @staticmethod
    def _whole(texts: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.frombuffer(b"".join(array("I", x).tobytes() for x in found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _line(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each with a space before it, and how many each has."""
        line = f" {' '.join(words)}".encode().decode("latin-1").translate(self.letters)
        ids, _ = self._whole([line], self.words)
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(words):
            raise ValueError(f"{len(words)} words made {len(cuts)} groups of tokens")
        return ids, np.diff(np.append(cuts, len(ids)))

    def _taken(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts at these places, one after another, and how many each has."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def _add(self, parts: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.places.update(zip(parts, range(len(self.sizes), len(self.sizes) + len(parts)), strict=True))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.sizes = np.concatenate([self.sizes, *(sizes for _, sizes in found)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _learn(self, missing: list[bytes]) -> None:
        words, marked, bare, others = [], [], [], []
        for part in missing:
            p = part.decode()
            stem = p[1:] if p[:1] == " " else ""
            if not (p.isascii() or max(p) < "\u0250"):
                others.append(p)
            elif stem.isalpha():
                words.append(stem)
            elif p.isalpha():
                bare.append(p)
            elif (form := _MARKED.fullmatch(stem)) is not None and form[1].isalpha():
                marked.append((part, form[1], form[2]))
            else:
                others.append(p)
        words += [w for w in {stem for _, stem, _ in marked}.difference(words) if f" {w}".encode() not in self.places]
        others += [m for m in {mark for _, _, mark in marked}.difference(others) if m.encode() not in self.places]
        found = [self._line(words[at : at + 1_000]) for at in range(0, len(words), 1_000)]
        found.append(self._whole([p.encode().decode("latin-1").translate(self.letters) for p in bare], self.words))
        found += [self._whole(others[at : at + 2_000], self.tokenizer) for at in range(0, len(others), 2_000)]
        self._add([*(f" {w}".encode() for w in words), *(p.encode() for p in bare), *(p.encode() for p in others)], found)
        ids, sizes = self._taken(np.array([self.places[x.encode()] for _, stem, mark in marked for x in (" " + stem, mark)], dtype=np.int64))
        self._add([part for part, _, _ in marked], [(ids, sizes[::2] + sizes[1::2])])

    def _placed(self, parts: list[bytes]) -> np.ndarray:
        """The places of distinct parts, which are encoded if they are new."""
        found = list(map(self.places.get, parts))
        missing = [p for p, k in zip(parts, found, strict=True) if k is None]
        if missing:
            self._learn(missing)
            found = [self.places[p] if k is None else k for p, k in zip(parts, found, strict=True)]
        self.latest = parts
        return np.array(found, dtype=np.int64)

    def _shrink(self) -> None:
        """Keep the parts of the latest slice only."""
        found = self._taken(self._placed(self.latest))
        self.places, self.ids, self.sizes = {}, self.ids[:0], self.sizes[:0]
        self._add(self.latest, [found])

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        # many strings, none of them in a cycle: looking for cycles would go through the cache again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            if len(self.places) > CACHE_ENTRIES:
                self._shrink()
            column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
            if not len(column):
                return []
            _, offsets, data = column.buffers()
            bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset :][: len(column) + 1]
            data = np.frombuffer(data or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            cuts = cuts_of(data)
            cuts[bounds] = True
            cuts = np.flatnonzero(cuts)
            parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
            distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
            ids, sizes = self._taken(self._placed(distinct)[parts.indices.to_numpy()])
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(cuts, bounds)].tolist()
            return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        finally:
            if collects:
                gc.enable()


_HELD: dict[str, _Ids] = {}


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, shard_bytes: int = 32_000_000) -> DataFrame:
    """Encode and write `docs` (doc_id, text) below `folder`; returns the list of shards as a table.

    Defined results: null text is empty and has the end id alone; repeated rows each get a record; an empty
    table writes no shard; extra columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, out, made = TaskContext.get().partitionId(), 0, None, []
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        if tokenizer_path not in _HELD:
            _HELD[tokenizer_path] = _Ids(tokenizer_path)
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")

        def close() -> None:
            nonlocal out, nth
            stream, temporary, offsets, n_docs, n_ids, at = out
            stream.close()
            name = f"{root}/part-{part:06d}-{nth:06d}"
            with store.open_output_stream(f"{temporary}.idx") as index:
                index.write(np.array(offsets, dtype="<u8").tobytes())
            store.move(f"{temporary}.idx", f"{name}.idx")
            store.move(f"{temporary}.rec", f"{name}.rec")
            made.append((f"part-{part:06d}-{nth:06d}", part, nth, n_docs, n_ids, at))
            out, nth = None, nth + 1

        for batch in batches:
            for piece in slices(batch):
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), _HELD[tokenizer_path].encode(piece.column("text")), strict=True):
                    if out is None:
                        temporary = f"{root}/_{uuid.uuid4().hex}"
                        out = [store.open_output_stream(f"{temporary}.rec"), temporary, [], 0, 0, 0]
                    ids = np.concatenate((ids, tail))
                    data = frame(doc_id, ids)
                    out[0].write(data)
                    out[2] += [out[5], len(data)]
                    out[3] += 1
                    out[4] += len(ids)
                    out[5] += len(data)
                    if out[5] >= shard_bytes:
                        close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True) if made else [[]] * 6, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "part", "nth", "n_docs", "n_ids", "n_bytes"])

    ordered = plain.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    return table(ordered.mapInArrow(run, SHARDS), "record-shards")


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before the record), n_tokens, ids_crc32 of each record, checked on the way."""
    spark = shards.sparkSession
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard of many MB
    placed = shards.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for path, start, n_docs in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "n_docs")), strict=True):
                with store.open_input_file(f"{root}/{path}.rec") as file:
                    data = memoryview(file.read())
                rows, at = [], 0
                while at < len(data):
                    doc_id, ids, at = unframe(data, at)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if len(rows) != n_docs:
                    raise CorruptRecord(f"{path}: {len(rows)} records, {n_docs} were written")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(partitions(spark), "path").mapInArrow(run, RECORDS)


def read_at(folder: str, path: str, nth: int) -> tuple[int | None, np.ndarray]:
    """The nth record of a shard, by the offset index: what a shuffled reader does for each record."""
    store, root = _open(folder)
    with store.open_input_file(f"{root}/{path}.idx") as index:
        offset, length = np.frombuffer(index.read_at(16, 16 * nth), dtype="<u8").tolist()
    with store.open_input_file(f"{root}/{path}.rec") as file:
        doc_id, ids, _ = unframe(file.read_at(length, offset))
    return doc_id, ids


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Write docs as records to `folder` (default: a new one in the shared folder) and read all of them back."""
    folder = folder or fresh_path(docs.sparkSession, "records")
    return read_records(write_records(docs, folder, tokenizer_path, end_id), folder)
