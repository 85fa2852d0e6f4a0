"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words. A word goes if a window that covers it has the same words as a window that starts
elsewhere (all occurrences go, the first one too; windows are judged on the input).

1. Candidates. Every window holds at least one short phrase that has the least hash among its phrases; which one
   depends on the window's words alone, so equal windows hold equal sampled phrases. These phrases (about one word
   position in fifteen) are counted over all documents; the windows around those that occur twice are candidates.
2. Confirming recurring passages. Documents are dealt to shards of bounded size. Each shard sends the hashes of its candidate windows,
   packed by hash range, to its block of shards, which merges equal ones and sends each distinct window once to the task that
   counts its range over all blocks. What occurs twice goes back to the blocks. There each recurring window has an owner, the first
   shard of the block that holds it, which is told who else does.
3. Passages. The owner joins its windows to passages, runs of windows that start at neighbouring words, and sends each shard the words of those
   that it holds.
4. Automata. Each shard compiles one Aho-Corasick automaton (pyahocorasick) from the sampled phrases of the passages sent to it, and streams its
   documents through it. Around each phrase found, windows are looked up among those of the passages and their words compared with the
   passage's; windows that are equal word by word delete the words they cover. A passage that was not sent, or that the automaton does not find, deletes nothing.

A hot window sends one entry per shard to its block and one per block beyond; a hot phrase is one row per Arrow batch and shard, counted by
partial sums and joined back by a sort-merge join between two written tables, which AQE splits. A shard holds about `shard_bytes` of text, or one
longer document, or rows that are equal in doc_id and text. A passage goes to the shards of one block at most. Within a block words are compared; whether a window occurs in
another block is judged by a hash of 64 bits and those of its range (the more, the larger the input).

Defined results: null text has no words; repeated rows count as separate occurrences (so equal texts of at least
`window` words lose all words); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import partitions, slices, table
from corpusloom.llm.words import covered, inside, joined, minima, other_hashes, text_bytes, window_hashes, word_hashes

SHARD_BYTES = 4_000_000
#: Shards whose windows are merged before they are counted over all.
BLOCK = 256
#: Bytes of text for each range of window hashes.
RANGE_BYTES = 8_000_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
WINDOWS = "block int, range int, shard int, windows binary"


def _locate(words: list[bytes], bounds: np.ndarray, phrases: list[bytes], gram: int) -> np.ndarray:
    """For each word: does one of the phrases start here? One automaton, one pass over each text."""
    found = np.zeros(len(words), dtype=bool)
    if not phrases or not words:
        return found
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:  # bytes as Latin-1 letters: one letter a byte
        automaton.add_word(f" {p.decode('latin-1')} ")
    automaton.make_automaton()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= gram:
            starts = np.cumsum(np.fromiter(map(len, words[a:b]), dtype=np.int64, count=b - a) + 1)
            line = f" {b' '.join(words[a:b]).decode('latin-1')} "
            hits = np.array([end - size + 1 for end, size in automaton.iter(line)], dtype=np.int64)
            if len(hits):
                found[a + np.searchsorted(starts, hits, side="left") + (hits > 0)] = True
    return found


def _packed(ranges: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Windows in order of their ranges: the ranges, and the windows of each as bytes."""
    kept, first = np.unique(ranges, return_index=True)
    return kept, [x.tobytes() for x in np.split(windows, first[1:])] if len(kept) else []


def _unpacked(windows: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(windows.to_pylist()), dtype=np.uint64)


def _among(packed: bytes, known: np.ndarray) -> np.ndarray:
    """The distinct hashes of a packed sorted list that are in `known` (sorted, without repeats), in time that does not grow with its size."""
    some = np.frombuffer(packed, dtype=np.uint64)
    if not len(known) or not len(some):
        return some[:0]
    at = np.minimum(np.searchsorted(known, some), len(known) - 1)
    some = some[known[at] == some]
    return some[np.concatenate((np.ones(min(1, len(some)), dtype=bool), some[1:] != some[:-1]))]


def _rows(block, ranges: np.ndarray, shard, windows: list[bytes]) -> pa.Table:
    n = len(windows)
    fill = lambda x: pa.array([x] * n if np.isscalar(x) or x is None else x, pa.int32())
    return pa.table({"block": fill(block), "range": pa.array(np.asarray(ranges, dtype=np.int32)), "shard": fill(shard), "windows": pa.array(windows, pa.binary())})


def _equal_words(words: list[bytes], here: np.ndarray, there: np.ndarray, width: int) -> np.ndarray:
    """Are the runs of `width` words at `here` and `there` the same, word by word?"""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    same = np.ones(len(here), dtype=bool)
    for k in range(width):
        same &= ids[here + k] == ids[there + k]
    return same


def passages_for(words: list[bytes], bounds: np.ndarray, asked: np.ndarray, holders: np.ndarray, window: int) -> dict[int, bytes]:
    """For each holder the passages, a line each, that its windows make here. asked: hashes of windows, of each the holder."""
    hashes, whole = window_hashes(word_hashes(words), window), inside(bounds, window, len(words))
    starts = np.flatnonzero(whole)
    known, first = np.unique(hashes[starts], return_index=True)
    at = starts[first[np.searchsorted(known, asked)]]
    order = np.lexsort((at, holders))
    at, holders = at[order], holders[order]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (holders[1:] != holders[:-1]), [True])))
    made: dict[int, list[bytes]] = {}
    for a, b, holder in zip(at[cut[:-1]].tolist(), at[cut[1:] - 1].tolist(), holders[cut[:-1]].tolist(), strict=True):
        made.setdefault(holder, []).append(b" ".join(words[a : b + window]))
    return {holder: b"\n".join(lines) for holder, lines in made.items()}


def repeated_words(words: list[bytes], bounds: np.ndarray, passages: list[bytes], window: int, gram: int) -> np.ndarray:
    """Which words of a shard lie in a window that is part of one of the passages (words, joined by spaces)."""
    told, edges = joined(passages)
    if len(told) < window or len(words) < window:
        return np.zeros(len(words), dtype=bool)
    # the passages: their windows, and the sampled phrases by which the automaton finds them
    hashed, whole = word_hashes(told), inside(edges, window, len(told))
    starts = np.flatnonzero(whole)
    known, first = np.unique(window_hashes(hashed, window)[starts], return_index=True)
    anchors = minima(window_hashes(hashed, gram), whole, window - gram + 1)
    found = _locate(words, bounds, list(dict.fromkeys(b" ".join(told[i : i + gram]) for i in anchors.tolist())), gram)
    # the texts: windows around what was found
    marks = np.concatenate(([0], np.cumsum(found)))
    reach, last = window - gram + 1, len(words) - window + 1
    near = np.flatnonzero(inside(bounds, window, len(words)) & (marks[reach : reach + last] > marks[:last]))
    equal = np.zeros(last, dtype=bool)
    if len(near):
        hashes = window_hashes(word_hashes(words), window)[near]
        spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        near, spot = near[known[spot] == hashes], spot[known[spot] == hashes]
        equal[near[_equal_words(words + told, near, len(words) + starts[first[spot]], window)]] = True
    return covered(equal, window, len(words))


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 6, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space)."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # bits of the hash that choose a range within a block, and those that part it for the count over all blocks
    bits = max(n, -(-min(total, block * shard_bytes) // RANGE_BYTES)).bit_length()
    finer = max(0, (total // RANGE_BYTES).bit_length() - bits)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    dealt = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc_id, F.xxhash64(text)), F.lit(shards)).cast("int").alias("shard"))

    def sampled(words: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashed = word_hashes(words)
        grams = window_hashes(hashed, gram)
        return hashed, grams, minima(grams, inside(bounds, window, len(words)), window - gram + 1)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, bounds = joined(text_bytes(part.column("text")))
                _, grams, at = sampled(words, bounds)
                shard = np.repeat(part.column("shard").to_numpy(), np.diff(bounds))[at]
                pairs = np.rec.fromarrays((grams[at], shard), names="h,shard") if len(at) else np.rec.fromarrays((np.zeros(0, np.uint64), np.zeros(0, np.int32)), names="h,shard")
                each, times = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each["h"].view(np.int64)), pa.array(each["shard"].astype(np.int32)), pa.array(times)], ["h", "shard", "n"])

    phrases = table(dealt.mapInArrow(sample, "h long, shard int, n long"), "phrases")
    often = table(phrases.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "phrases-often")
    recurring = phrases.select("h", "shard").hint("merge").join(often, "h", "left_semi").repartition(n, "shard")
    sharded = dealt.repartition(n, "shard")

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """Hashes of the windows around recurring phrases, by range; a window that occurs twice is sent twice."""
        words, bounds = joined(text_bytes(left.column("text").combine_chunks()))
        hashed, grams, at = sampled(words, bounds)
        mark = np.zeros(len(words) + 1, dtype=np.int64)
        mark[1 + at[np.isin(grams[at], np.unique(right.column("h").to_numpy()).view(np.uint64))]] = 1
        marks = np.cumsum(mark)
        reach = window - gram + 1
        ok = inside(bounds, window, len(words))
        ok &= marks[reach : reach + len(ok)] > marks[: len(ok)]
        ranges, windows = (other_hashes(hashed, window)[ok] >> np.uint64(64 - bits)), window_hashes(hashed, window)[ok]
        order = np.lexsort((windows, ranges))
        ranges, windows = ranges[order], windows[order]
        # of equal neighbours two are sent
        third = np.zeros(len(windows), dtype=bool)
        third[2:] = (windows[2:] == windows[:-2]) & (ranges[2:] == ranges[:-2])
        kept, packed = _packed(ranges[~third], windows[~third])
        shard = left.column("shard")[0].as_py() if left.num_rows else 0
        return _rows(shard // block, kept, shard, packed)

    def merge(group: pa.Table) -> pa.Table:
        """Of one block and range: each distinct window, twice if the block has it twice, in finer ranges."""
        seen, times = np.unique(_unpacked(group.column("windows")), return_counts=True)
        sent = np.repeat(seen, np.minimum(times, 2))
        coarse = group.column("range")[0].as_py()
        ranges = (np.full(len(sent), coarse, dtype=np.int64) << finer) | ((sent >> np.uint64(64 - finer)).astype(np.int64) if finer else 0)
        kept, packed = _packed(ranges, sent)
        return _rows(group.column("block")[0].as_py(), kept, None, packed)

    def confirm(group: pa.Table) -> pa.Table:
        """Of one range: for each block its windows that occur twice or more in all."""
        packed = group.column("windows").to_pylist()
        order = np.sort(np.frombuffer(b"".join(packed), dtype=np.uint64))
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        held = [_among(p, twice) for p in packed]
        some = [k for k, h in enumerate(held) if len(h)]
        blocks = group.column("block").to_pylist()
        return _rows([blocks[k] for k in some], np.full(len(some), group.column("range")[0].as_py() >> finer if len(some) else 0), None, [held[k].tobytes() for k in some])

    def return_(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one block and range: for each owner its windows among the confirmed ones, each with a shard that holds it."""
        confirmed = np.unique(_unpacked(right.column("windows")))
        held = [_among(p, confirmed) for p in left.column("windows").to_pylist()]
        windows = np.concatenate([np.zeros(0, np.uint64), *held])
        holders = np.repeat(left.column("shard").to_numpy(), list(map(len, held))).astype(np.int32)
        order = np.lexsort((holders, windows))
        windows, holders = windows[order], holders[order]
        first = np.concatenate((np.ones(min(1, len(windows)), dtype=bool), windows[1:] != windows[:-1]))
        owners = holders[np.maximum.accumulate(np.where(first, np.arange(len(windows)), 0))]
        order = np.argsort(owners, kind="stable")
        kept, packed = _packed(owners[order], windows[order])
        _, whose = _packed(owners[order], holders[order])
        return pa.table({"shard": pa.array(kept.astype(np.int32)), "windows": pa.array(packed, pa.binary()), "holders": pa.array(whose, pa.binary())})

    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of an owner: for each shard the passages that it holds."""
        words, bounds = joined(text_bytes(left.column("text").combine_chunks()))
        whose = np.frombuffer(b"".join(right.column("holders").to_pylist()), dtype=np.int32)
        made = passages_for(words, bounds, _unpacked(right.column("windows")), whose, window) if len(whose) else {}
        return pa.table({"shard": pa.array(made.keys(), pa.int32()), "passages": pa.array(made.values(), pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        words, bounds = joined(text_bytes(left.column("text").combine_chunks()))
        gone = repeated_words(words, bounds, b"\n".join(right.column("passages").to_pylist()).split(b"\n"), window, gram)
        kept = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if gone[a:b].any():
                kept.append(b" ".join(words[i] for i in (a + np.flatnonzero(~gone[a:b])).tolist()))
            else:
                kept.append(b" ".join(words[a:b]))
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    sent = sharded.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(candidates, WINDOWS).repartition(n, "block", "range")
    merged = sent.groupBy("block", "range").applyInArrow(merge, WINDOWS)
    counted = merged.groupBy("range").applyInArrow(confirm, WINDOWS).repartition(n, "block", "range")
    owned = sent.groupBy("block", "range").cogroup(counted.groupBy("block", "range")).applyInArrow(return_, "shard int, windows binary, holders binary").repartition(n, "shard")
    passages = sharded.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(extract, "shard int, passages binary").repartition(n, "shard")
    return sharded.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(remove, RESULT)
