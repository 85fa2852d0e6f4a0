"""Fill-in-the-middle: documents are cut into prefix, middle and suffix at token bounds, by memoised chunks.

A token is a run of ASCII letters or one other code point. A rolling hash over the bytes cuts every text into
content-defined chunks, so texts with passages in common have chunks in common. Of each chunk a worker keeps a summary, found
again by the chunk's content: how many tokens and code points begin in it, where, and whether it opens and ends with a letter. A text's token
count is the sum over its chunks, less one for each seam at which a word goes on; prefix sums of these counts say in which
chunk a cut lies, and the summary says where in it.

The memory of a worker is bounded: chunks of `CACHE_BYTES` in two generations, and one slice of a batch. Nothing is shuffled.

Where a document is cut, and into which form, depends on the SHA-256 of `<seed>:<doc_id>` alone:
psm is `<P>`prefix`<S>`suffix`<M>`middle, spm is `<S>`suffix`<P>`prefix`<M>`middle, plain is the text as it is. Texts that hold a
marker stay plain, so that `restored` can always rebuild the text.

Defined results: null text counts as empty; an empty text is plain, with no token; a null doc_id counts as an empty number; repeated
rows are cut alike; a very long text is cut whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import slices
from corpusloom.llm.words import text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A chunk ends where so many top bits of the rolling hash are zero: 512 bytes on average.
CHUNK_BITS = 9
#: Bytes that the rolling hash sees, a power of two; a chunk of constant bytes ends at MAX_CHUNK.
WINDOW, MAX_CHUNK = 16, 32_768
#: Bytes of chunks that one generation of a worker's cache holds.
CACHE_BYTES = 16_000_000
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
_STEP = 0x2545F491
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes that end at each byte (of fewer at the start), by doubling the width."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] * np.uint32(pow(_STEP, width, 1 << 32))
        h, width = wider, 2 * width
    return h


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of one text end; the last ends with the text."""
    if not len(data):
        return []
    ends = (np.flatnonzero(rolling(data) >> np.uint32(32 - CHUNK_BITS) == 0) + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    if len(data) <= MAX_CHUNK:
        return ends
    full, start = [], 0
    for end in ends:
        full += [*range(start + MAX_CHUNK, end, MAX_CHUNK), end]
        start = end
    return full


@dataclass(slots=True)
class Summary:
    """Of one chunk: where its tokens begin, how many code points begin, and its first and last byte."""

    starts: np.ndarray
    chars: int
    opens: bool
    ends: bool


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, dtype=np.uint8)
    letter, first = _LETTER[data], (data & 0xC0) != 0x80
    begins = first.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return Summary(np.flatnonzero(begins).astype(np.uint16), int(np.count_nonzero(first)), bool(letter[0]), bool(letter[-1]))


class ChunkCache:
    """Summaries by the chunk itself: a dict finds the hash of the bytes and then compares them. Two generations bound it."""

    def __init__(self, most: int = CACHE_BYTES) -> None:
        self.most, self.held = most, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def __call__(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)
        if found is None:
            if self.held > self.most:
                self.old, self.young, self.held = self.young, {}, 0
            found = self.old.get(chunk) or summary(chunk)
            self.young[chunk] = found
            self.held += len(chunk)
        return found


class Cutter:
    """The tokens of one text, counted by its chunks."""

    def __init__(self, text: bytes, cached: ChunkCache) -> None:
        ends = chunk_ends(np.frombuffer(text, dtype=np.uint8))
        self.bounds = [0, *ends]
        self.parts = [cached(text[a:b]) for a, b in zip(self.bounds, ends, strict=False)]
        # a word that goes on over a seam is counted by the chunk in which it begins
        self.seams = [0, *(int(x.ends and y.opens) for x, y in zip(self.parts, self.parts[1:], strict=False))]
        self.upto = np.concatenate(([0], np.cumsum([len(p.starts) - s for p, s in zip(self.parts, self.seams, strict=False)], dtype=np.int64)))
        self.size, self.n = len(text), int(self.upto[-1])

    def offset(self, k: int) -> int:
        """Bytes of the first k tokens."""
        if k >= self.n:
            return self.size
        c = int(np.searchsorted(self.upto, k, side="right")) - 1
        return self.bounds[c] + int(self.parts[c].starts[k - int(self.upto[c]) + self.seams[c]])


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def _chars(part: bytes) -> int:
    return len(part.decode())


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain), output."""

    def one(doc_id: int | None, text: bytes, cached: ChunkCache) -> tuple:
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        cutter = Cutter(text, cached)
        if not text or h3 % 100 >= 100 - plain_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
            return cutter.n, "plain", None, None, text
        a, b = sorted(cutter.offset(h % (cutter.n + 1)) for h in (h1, h2))
        prefix, middle, form = text[:a], text[a:b], "spm" if h4 % 100 < spm_percent else "psm"
        return cutter.n, form, _chars(prefix), _chars(middle), arranged(prefix, middle, text[b:], form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = ChunkCache()
        for batch in batches:
            for part in slices(batch):
                rows = [one(i, t, cached) for i, t in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                whole = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), whole[0], pa.array(form, pa.string()), *whole[1:], pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form. A text holds no marker, so the first of each kind parts it."""
    body = F.substr(output, F.lit(4))
    one = F.when(form == "psm", F.substring_index(body, SUFFIX.decode(), 1)).otherwise(F.substring_index(body, PREFIX.decode(), 1))
    rest = F.substr(body, F.length(one) + 4)
    two = F.substring_index(rest, MIDDLE.decode(), 1)
    middle = F.substr(rest, F.length(two) + 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
