"""Chunks of texts that come as blocks: where they begin and end is told by the counters of their units alone, which one task a text goes through; the texts stay where they are.

The rules are those of `segments.py` (`pack_sentences`, `pack_paragraphs`, `merge_small`), applied to units as they come.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.segments import COUNTERS, NOTHING, Counters, _packed, _unpacked

PARTS = f"array<struct<chunk:long,index:string,c:{COUNTERS},blocks:int,pieces:array<struct<lead:string,from:int,to:int>>>>"
_PARTS = pa.list_(pa.struct([("chunk", pa.int64()), ("index", pa.string()), ("c", pa.struct([(n, pa.int32()) for n in Counters._fields])), ("blocks", pa.int32()), ("pieces", pa.list_(pa.struct([("lead", pa.string()), ("from", pa.int32()), ("to", pa.int32())])))]))


class Packing:
    """The chunks of one text as its blocks come.

    by_sums: windows are measured by their summed counters, not by the sum of the units' sizes. smallest: windows below it are merged; None: each is a chunk.
    """

    def __init__(self, target: int, overlap: int, by_sums: bool, between: str, smallest: int | None) -> None:
        self.target, self.overlap, self.by_sums, self.between, self.smallest = target, overlap, by_sums, between, smallest
        self.blocks: deque[tuple[int, int, int, list]] = deque()  # place, first unit, unit after the last, parts of chunks
        self.base, self.known = 0, 0  # the first unit whose counters are held, and how many units have come
        self.upto, self.sums = [0], [0]  # running sums since base, of sizes and of counters
        self.begin = self.scanned = 0  # where the open window begins, and up to where units have been tried as its end
        self.windows = self.chunks = 0
        self.run: list[tuple[int, int]] = []  # windows that wait for a neighbour, with what they count
        self.held = NOTHING
        self.last: tuple[str, list[tuple[int, int]], Counters] | None = None  # the last chunk may yet get a small window

    def add(self, at: int, units: list[Counters]) -> Iterator[tuple[int, list]]:
        """A block's units. Gives the places of blocks and the parts of chunks in them, as far as these are settled."""
        self.blocks.append((at, self.known, self.known + len(units), []))
        self.upto += [self.upto[-1] + n for n in accumulate(u.size for u in units)]
        self.sums += [self.sums[-1] + n for n in accumulate(map(_packed, units))]
        self.known += len(units)
        yield from self._settled(False)

    def end(self) -> Iterator[tuple[int, list]]:
        yield from self._settled(True)

    def _counted(self, begin: int, end: int) -> Counters:
        return _unpacked(self.sums[end - self.base] - self.sums[begin - self.base])

    def _closed(self, ended: bool) -> int | None:
        """Where the open window ends; None if more units could join it."""
        if self.begin >= self.known:
            return None
        if not self.by_sums:
            end = max(self.begin + 1, self.base + bisect_right(self.upto, self.upto[self.begin - self.base] + self.target) - 1)
            return end if end < self.known or ended else None
        while self.scanned + 1 < self.known:
            self.scanned += 1
            if self._counted(self.begin, self.scanned + 1).size > self.target:
                return self.scanned
        return self.known if ended else None

    def _settled(self, ended: bool) -> Iterator[tuple[int, list]]:
        while (end := self._closed(ended)) is not None:
            last = ended and end == self.known
            self._window(self.begin, end, last)
            if self.by_sums:
                self.begin = self.known if last else max(self.begin, end - self.overlap)
            else:
                self.begin = max(self.begin + 1, end - self.overlap)
        if ended:
            self._give()
        open_from = min(self.begin, self.known, *(begin for begin, _ in (*self.run[:1], *(self.last[1][:1] if self.last else ()))))
        while self.blocks and (ended or self.blocks[0][2] <= open_from):
            at, _, _, parts = self.blocks.popleft()
            yield at, parts
        if open_from - self.base > 10_000:
            self.upto, self.sums, self.base = self.upto[open_from - self.base :], self.sums[open_from - self.base :], open_from

    def _window(self, begin: int, end: int, last: bool) -> None:
        k, self.windows = self.windows, self.windows + 1
        self.run.append((begin, end))
        self.held += self._counted(begin, end)
        small = self.smallest is not None and self.held.size < self.smallest
        if small and not last:
            return
        if small and self.last:
            self.last = (f"merge_back_{k}", self.last[1] + self.run, self.last[2] + self.held)
        else:
            self._give()
            self.last = (str(k) if len(self.run) == 1 else f"merge_fwd_{k - 1}", self.run, self.held)
        self.run, self.held = [], NOTHING

    def _give(self) -> None:
        """The last chunk is settled: each of its blocks gets its part."""
        if self.last is None:
            return
        index, windows, c = self.last
        found: dict[int, tuple[list, list]] = {}
        for n, (begin, end) in enumerate(windows):
            for at, first, stop, parts in self.blocks:
                if first < end and stop > begin:
                    lead = self.between if begin < first else "\n" if n else ""
                    found.setdefault(at, (parts, []))[1].append((lead, max(begin, first) - first, min(end, stop) - first))
                elif first >= end:
                    break
        for parts, pieces in found.values():
            parts.append((self.chunks, index, c, len(found), pieces))
        self.chunks, self.last = self.chunks + 1, None


def packed(units: DataFrame, make: Callable[[], Packing]) -> DataFrame:
    """For each block the parts that chunks have in it. units: file_hash, at, c (the counters of a block's units in order)."""

    def rows(found: list) -> pa.RecordBatch:
        names = ("file_hash", "at", "parts")
        shown = [[{"chunk": n, "index": i, "c": c._asdict(), "blocks": b, "pieces": [{"lead": x, "from": y, "to": z} for x, y, z in pieces]} for n, i, c, b, pieces in parts] for _, _, parts in found]
        return pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in found], pa.string()), pa.array([a for _, a, _ in found], pa.int64()), pa.array(shown, _PARTS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, packing = None, make()
        for batch in batches:
            found: list = []
            lists = batch.column("c")
            values = lists.flatten()
            counts = list(map(Counters, *(values.field(n).to_pylist() for n in Counters._fields)))
            ends = [0, *accumulate(lists.value_lengths().to_pylist())]
            for file, at, (a, b) in zip(batch.column("file_hash").to_pylist(), batch.column("at").to_pylist(), pairwise(ends), strict=True):
                if file != here:
                    found += ((here, *x) for x in packing.end())
                    here, packing = file, make()
                found += ((file, *x) for x in packing.add(at, counts[a:b]))
            yield rows(found)
        yield rows([(here, *x) for x in packing.end()])

    ordered = units.repartition("file_hash").sortWithinPartitions("file_hash", "at")
    return ordered.select("file_hash", "at", "c").mapInArrow(run, f"file_hash string, at long, parts {PARTS}")


def assembled(units: DataFrame, parts: DataFrame, between: str) -> DataFrame:
    """Chunks from the parts of blocks: file_hash, place, piece (index, text, c). units: file_hash, at, units (their texts in order).

    Texts of blocks meet their parts by key; only the parts of chunks that lie in several blocks are shuffled once more.
    """

    def text_of(part: Column) -> Column:
        own = lambda p: F.concat(p["lead"], F.array_join(F.slice(F.col("units"), p["from"] + 1, p["to"] - p["from"]), between))
        return F.array_join(F.transform(part["pieces"], own), "")

    both = units.hint("merge").join(parts, ["file_hash", "at"])

    def some(wanted: Callable[[Column], Column]) -> DataFrame:
        shown = F.transform(F.filter("parts", wanted), lambda p: F.struct(p["chunk"].alias("place"), p["index"].alias("index"), text_of(p).alias("text"), p["c"].alias("c")))
        return both.select("file_hash", "at", F.explode(shown).alias("p")).select("file_hash", "at", "p.*")

    parted = some(lambda p: p["blocks"] > 1).groupBy("file_hash", "place").agg(F.first("index").alias("index"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("texts"), F.first("c").alias("c"))
    parted = parted.withColumn("text", F.array_join(F.col("texts.text"), ""))
    whole = some(lambda p: p["blocks"] == 1)
    columns = ("file_hash", "place", F.struct("index", "text", "c").alias("piece"))
    return whole.select(*columns).unionByName(parted.select(*columns))
