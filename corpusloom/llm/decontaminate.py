"""Benchmark decontamination by a BM25 inverted index of test items, searched with block-max WAND.

Every document is cut into passages (`2 * longest item` words, half of them shared with the next, so that any place as long
as an item lies whole in one passage). Each passage queries the index. Scores are BM25 sums divided by what the item would score on itself,
so one threshold serves all items: 1 means that all terms of the item occur.

Block-max WAND visits the postings of the passage's terms in item order. A pivot is the first term at which the summed list
maxima reach the threshold; the maxima of the blocks around the pivot's item decide whether it is scored or the whole block
is skipped. All items at or above the threshold are returned, there is no top-k. Before that, a batch of passages is sifted
at once: the exact sums over the rare terms plus, per item, all it could still get from frequent ones must reach
the threshold somewhere.

Hits are verified: an item is parted into question and answer (after the last "answer:" or "a:" with words on both sides, else after the
last question mark with words on both sides, else in the middle of its words); of the distinct word 5-grams of each at least `overlap` must
occur in the passage.

Size of what is sent to the executors: an index holds at most about `index_bytes` of item text; more items make several, and the
documents are searched with each. What scores and passages rest on (number of items, document frequencies, mean and greatest length) is
counted by Spark over all items and is the same in every index, so hits don't depend on `index_bytes`.

Defined results: null texts and items count as empty; items without words match nothing; a question or answer with fewer
than five words is one gram; repeated items each report their id; repeated rows are kept; an empty table
or benchmark gives no hits; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import slices, table

INDEX_BYTES = 8_000_000
K1, B = 1.2, 0.75  # BM25 as usual
_WORD = re.compile(r"\w+")
_ANSWER, _ASKED = re.compile(r"\b(?:answer|a)\s*:", re.IGNORECASE), re.compile("[?？؟]")


def terms_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(words: Sequence[str], n: int = 5) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of the two sides of an item."""
    for mark in (_ANSWER, _ASKED):
        for found in reversed(list(mark.finditer(text))):
            sides = terms_of(text[: found.start()]), terms_of(text[found.end() :])
            if all(sides):
                return sides
    words = terms_of(text)
    return words[: len(words) // 2], words[len(words) // 2 :]


@dataclass
class Collection:
    """What BM25 has to know of all items: how many have words, mean and greatest number of words, items with each term."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> Collection:
        words = [w for t in texts if (w := terms_of(t))]
        lengths = list(map(len, words))
        return cls(len(words), sum(lengths) / max(1, len(words)), max(lengths, default=1), Counter(t for w in words for t in set(w)))


class BlockMaxIndex:
    """Postings by term: item numbers in order, weights, and the largest weight of each block of postings."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = 0.6, block: int = 16, collection: Collection | None = None) -> None:
        kept = [(i, w, t) for i, t in items if (w := terms_of(t))]
        about = Collection.of([t for _, t in items]) if collection is None else collection
        self.ids = [i for i, _, _ in kept]
        self.words = [w for _, w, _ in kept]
        self.threshold, self.block, self.longest = threshold, block, about.longest
        n = len(kept)
        idf = {t: np.log(1 + (about.n - d + 0.5) / (d + 0.5)) for t, d in about.df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for item, words in enumerate(self.words):
            norm = K1 * (1 - B + B * len(words) / about.mean)
            own = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(words).items()}
            total = sum(own.values())
            for t, x in own.items():
                postings[t].append((item, x / total))
        self.number = {t: k for k, t in enumerate(sorted(postings))}
        self.items = [[i for i, _ in postings[t]] for t in self.number]
        self.weights = [[x for _, x in postings[t]] for t in self.number]
        self.most = np.array([max(w) for w in self.weights], dtype=np.float64)
        self.block_most = [[max(w[a : a + block]) for a in range(0, len(w), block)] for w in self.weights]
        self._sift_tables(n)
        self.halves = [tuple(map(grams, question_and_answer(t))) for _, _, t in kept]

    def _sift_tables(self, n: int) -> None:
        """Frequent terms: the longest lists, as long as no item draws more than half the threshold from them."""
        rest = np.zeros(n)
        frequent = np.zeros(len(self.items), dtype=bool)
        for t in sorted(range(len(self.items)), key=lambda t: (-len(self.items[t]), t)):
            more = rest.copy()
            more[self.items[t]] += self.weights[t]
            if more.max(initial=0) > self.threshold / 2:
                break
            rest, frequent[t] = more, True
        self.frequent, self.from_frequent = frequent, rest
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in self.items]))).astype(np.int64)
        self.flat_items = np.array([i for x in self.items for i in x], dtype=np.int64)
        self.flat_weights = np.array([x for w in self.weights for x in w], dtype=np.float64)

    def sift(self, passage: np.ndarray, term: np.ndarray, passages: int) -> np.ndarray:
        """Passages in which some item may reach the threshold. (passage, term): distinct pairs."""
        rare = ~self.frequent[term]
        passage, term = passage[rare], term[rare]
        sums = np.bincount(passage, self.most[term], passages)
        worth = sums + self.from_frequent.max(initial=0) >= self.threshold - 1e-9
        keep = worth[passage]
        passage, term = passage[keep], term[keep]
        sizes = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(term) else np.zeros(0, dtype=np.int64)
        n = max(1, len(self.ids))
        pair, back = np.unique(np.repeat(passage, sizes) * n + self.flat_items[at], return_inverse=True)
        reach = np.bincount(back, self.flat_weights[at], len(pair)) + self.from_frequent[pair % n] if len(pair) else np.zeros(0)
        return np.unique(pair[reach >= self.threshold - 1e-9] // n)

    def search(self, terms: Sequence[int]) -> list[tuple[int, float]]:
        """All items (by number) at or above the threshold, with their scores. terms: distinct term numbers."""
        lists = [(self.items[t], self.weights[t], self.block_most[t], float(self.most[t])) for t in terms]
        at = [0] * len(lists)
        live = [k for k in range(len(lists)) if lists[k][0]]
        found, floor = [], self.threshold - 1e-9
        while live:
            live.sort(key=lambda k: lists[k][0][at[k]])
            bound, pivot = 0.0, -1
            for j, k in enumerate(live):
                bound += lists[k][3]
                if bound >= floor:
                    pivot = j
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            # block maxima at the pivot item
            bound, skip = 0.0, None
            for k in live[: pivot + 1]:
                items, _, blocks, _ = lists[k]
                b = bisect_left(items, item, at[k]) // self.block
                if b < len(blocks):
                    bound += blocks[b]
                    last = items[min(len(items), (b + 1) * self.block) - 1]
                    skip = last if skip is None else min(skip, last)
            if bound >= floor:
                if lists[live[0]][0][at[live[0]]] == item:
                    total = 0.0
                    for k in live[: pivot + 1]:
                        total += lists[k][1][at[k]]
                        at[k] += 1
                    if total >= floor:
                        found.append((item, total))
                else:
                    for k in live[:pivot]:
                        at[k] = bisect_left(lists[k][0], item, at[k])
            else:
                beyond = max(skip if skip is not None else item, item) + 1
                if pivot + 1 < len(live):
                    beyond = min(beyond, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                for k in live[: pivot + 1]:
                    at[k] = bisect_left(lists[k][0], beyond, at[k])
            live = [k for k in live if at[k] < len(lists[k][0])]
        return found

    def verified(self, item: int, passage: Sequence[str], overlap: float) -> bool:
        """Do question and answer of the item both overlap the passage by their grams?"""
        for half in self.halves[item]:
            if half:
                size = len(next(iter(half)))
                held = half & (grams(passage, 5) if size == 5 else {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)})
                if len(held) < overlap * len(half):
                    return False
        return True

    def hits(self, texts: list[str], overlap: float = 0.8) -> list[list[int | None]]:
        """For each text, the ids of the verified items, in order."""
        out: list[list] = [[] for _ in texts]
        if not self.ids:
            return out
        words = [terms_of(t) for t in texts]
        get = self.number.get
        step = self.longest
        flat = np.fromiter((get(w, -1) for ws in words for w in ws), dtype=np.int64, count=sum(map(len, words)))
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        # passages of 2 * step words begin every step words; a text's last one may be shorter
        each = np.maximum(1, -(-np.diff(bounds) // step) - 1)
        owner = np.repeat(np.arange(len(words)), each)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(each)[:-1])), each)
        known = np.flatnonzero(flat >= 0)
        text = np.searchsorted(bounds, known, side="right") - 1
        cell = (known - bounds[text]) // step
        base = np.concatenate(([0], np.cumsum(each)[:-1]))[text]
        late, early = np.minimum(cell, each[text] - 1), np.maximum(cell - 1, 0)  # the two passages that hold a word
        key = np.concatenate(((base + late), (base + np.minimum(early, late)))) * (len(self.number) + 1) + np.concatenate((flat[known], flat[known]))
        key = np.unique(key)
        passage, term = key // (len(self.number) + 1), key % (len(self.number) + 1)
        for p in self.sift(passage, term, len(owner)).tolist():
            a, b = np.searchsorted(passage, [p, p + 1])
            ws = words[owner[p]][nth[p] * step : (nth[p] + 2) * step]
            for item, _ in self.search(term[a:b].tolist()):
                if self.ids[item] not in out[owner[p]] and self.verified(item, ws, overlap):
                    out[owner[p]].append(self.ids[item])
        return [sorted(x, key=lambda i: (i is None, i)) for x in out]


def _terms(items: DataFrame) -> DataFrame:
    """part, term, length: a row for each item and distinct term of it; first is set on one row of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms_of(text)
                rows += [(part, t, len(words), k == 0) for k, t in enumerate(dict.fromkeys(words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), pa.string(), pa.int64(), pa.bool_()), strict=True)], ["part", "term", "length", "first"])

    return items.mapInArrow(run, "part int, term string, length long, first boolean")


def indexes(items: DataFrame, threshold: float, index_bytes: int = INDEX_BYTES) -> Iterator[BlockMaxIndex]:
    """One index for each part of the items; a part holds about index_bytes of text, and only parts come to the driver."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // index_bytes))
    dealt = plain.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    terms = table(_terms(dealt.select("part", "text")), "benchmark-terms")
    about = terms.agg(F.count_if("first").alias("n"), F.avg(F.when(F.col("first"), F.col("length"))).alias("mean"), F.max("length").alias("longest")).first()
    df = table(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "benchmark-df")
    for part in range(parts):
        rows = dealt.filter(F.col("part") == part).select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        own = df.hint("merge").join(terms.filter(F.col("part") == part).select("term").distinct(), "term").select("term", "df").toArrow()
        known = dict(zip(own.column("term").to_pylist(), own.column("df").to_pylist(), strict=True))
        collection = Collection(about["n"], about["mean"] or 1.0, about["longest"] or 1, known)
        yield BlockMaxIndex(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True)), threshold, collection=collection)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All columns of docs and item_ids: the ids of the items that each text holds, in order."""
    names = docs.columns
    at = names.index("text")
    short = docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("held", F.array().cast("array<bigint>"))
    for index in indexes(items, threshold, index_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, f"c{at}"):
                    found = sent.value.hits([t or "" for t in part.column(at).cast(pa.string()).to_pylist()], overlap)
                    before = part.column(part.num_columns - 1).to_pylist()
                    both = [sorted({*(a or []), *b}, key=lambda i: (i is None, i)) for a, b in zip(before, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(both, pa.list_(pa.int64()))], part.schema.names)

        short = short.mapInArrow(run, short.schema)
    return short.toDF(*names, "item_ids") if "item_ids" not in names else short.toDF(*names, "item_ids_found")
