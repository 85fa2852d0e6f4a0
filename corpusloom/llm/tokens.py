"""Token counts by rank-synchronous merging of byte arrays, and token ids by the library with a cache of words.

Both rest on one fact of byte-level BPE: a single space between two characters that are not white space always starts a
new pre-token, so a text may be cut before each such space and the parts handled alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import slices

#: Entries that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 400_000

#: The pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space other than spaces and newlines, as `str.isspace` has it.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def is_oddly_spaced(text: str) -> bool:
    """Is there a space at an end or beside other white space, or white space but spaces and newlines?"""
    return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text) is not None


def cut(text: str) -> list[str]:
    """The parts of a text between single spaces; all but the first stand for a space and themselves."""
    return _CUT.split(text) if is_oddly_spaced(text) else text.split(" ")


def byte_level_file(path: str) -> dict:
    """A tokenizer file, if it is of the form that this module and the records count on; ValueError for any other.

    That is: byte-level BPE with PRE_TOKEN as its pattern, no normalizer, dropout, affixes or fallback, and added tokens that are found as they stand.
    A post-processor doesn't matter, as no special tokens are added.
    """
    try:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, split = told["model"], told["pre_tokenizer"] or {}
        vocab = model["vocab"]
    except (UnicodeDecodeError, json.JSONDecodeError, KeyError, TypeError) as wrong:
        raise ValueError(f"{path} is no tokenizer file in JSON") from wrong
    plain = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    plain += [k for k in ("normalizer", "truncation", "padding") if told.get(k)]
    odd = [t["content"] for t in told.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is not byte-level BPE with the usual pattern and no space put before a text")
    if plain or odd or not set(byte_letters()).issubset(vocab):
        raise ValueError(f"{path} has what is not provided for: {[*plain, *odd] or 'bytes without a symbol'}")
    return told


class RankMerger:
    """Counts BPE symbols of many pre-tokens at a time, held as one ragged numpy array.

    In each round every sequence finds the lowest rank among its adjacent pairs and merges all pairs of that rank,
    from the left where they overlap; sequences without a ranked pair are done. The surviving symbols are the tokens.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: list[str]) -> None:
        size = max(vocab.values(), default=0) + 1
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.bytes = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.none = len(merges)
        self.pattern = regex.compile(PRE_TOKEN)
        self.specials = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    @classmethod
    def from_file(cls, path: str) -> RankMerger:
        told = byte_level_file(path)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
        return cls(told["model"]["vocab"], merges, [t["content"] for t in told.get("added_tokens", [])])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], self.none)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        total = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbols = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), total)
        ranks = np.full(len(symbols), self.none, dtype=np.int64)  # of the pair that starts here
        inner = owner[:-1] == owner[1:]
        ranks[:-1][inner] = self._rank(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(ranks, first)
            sizes = np.diff(np.concatenate((first, [len(owner)])))
            busy = lowest < self.none
            total[owner[first[~busy]]] = sizes[~busy]
            keep = np.repeat(busy, sizes)
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            if not len(symbols):
                break
            hit = ranks == np.repeat(lowest[busy], sizes[busy])
            spots = np.flatnonzero(hit)  # in a run of overlapping pairs every second one merges, from the left
            if len(spots) > 1:
                begins = np.concatenate(([True], (np.diff(spots) > 1) | (owner[spots[1:]] != owner[spots[:-1]])))
                run = np.flatnonzero(begins)
                nth = np.arange(len(spots)) - np.repeat(run, np.diff(np.concatenate((run, [len(spots)]))))
                spots = spots[nth % 2 == 0]
            symbols[spots] = self.made[ranks[spots]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[spots + 1] = False
            stale = np.zeros(len(symbols), dtype=bool)
            stale[spots] = True
            symbols, owner, ranks, stale = symbols[stay], owner[stay], ranks[stay], stale[stay]
            stale[:-1] |= stale[1:]  # the pair to the left of a merged symbol is new, too
            at = np.flatnonzero(stale)
            paired = at[(at + 1 < len(owner))]
            paired = paired[owner[paired] == owner[paired + 1]]
            ranks[at] = self.none
            ranks[paired] = self._rank(symbols[paired], symbols[paired + 1])
        return total

    def count_parts(self, parts: list[str]) -> list[int]:
        """Tokens of whole parts of texts: split into pre-tokens, each distinct pre-token merged once."""
        number: dict[str, int] = {}
        flat: list[int] = []
        sizes: list[int] = []
        extra: list[int] = []
        for part in parts:
            pieces, special = [], 0
            if self.specials is not None and "<|" in part or self.specials is not None and self.specials.search(part):
                special = len(self.specials.findall(part))
                for plain in self.specials.split(part):
                    pieces += self.pattern.findall(plain)
            else:
                pieces = self.pattern.findall(part)
            flat += [number.setdefault(p, len(number)) for p in pieces]
            sizes.append(len(pieces))
            extra.append(special)
        if not number:
            return extra
        each = self.count([p.encode("utf-8", "surrogatepass") for p in number])
        sums = np.concatenate(([0], np.cumsum(each[np.array(flat, dtype=np.int64)])))
        ends = np.cumsum(sizes)
        return (sums[ends] - sums[ends - np.array(sizes)] + np.array(extra)).tolist()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class CountCache:
    """Token counts of parts of texts, with the parts after a space and the first parts of texts apart."""

    def __init__(self, merger: RankMerger) -> None:
        self.merger = merger
        self.spaced: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.spaced) + len(self.first) > CACHE_ENTRIES:
            self.spaced.clear()
            self.first.clear()
        split = [cut(t) for t in texts]
        new = {p for parts in split for p in parts[1:]}.difference(self.spaced)
        self.spaced.update(zip(new, self.merger.count_parts([" " + p for p in new]), strict=True))
        new = {parts[0] for parts in split}.difference(self.first)
        self.first.update(zip(new, self.merger.count_parts(list(new)), strict=True))
        get = self.spaced.__getitem__
        return [self.first[parts[0]] + sum(map(get, parts[1:])) for parts in split]


_HELD: dict[str, object] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    path is a byte-level BPE file in the tokenizers library's JSON format, readable on every executor. Defined results:
    null and empty texts have no bytes and no tokens; the vocabulary's special strings inside a text count as one
    token each, as the library takes them; repeated rows are kept; an empty table gives an empty result; extra columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _HELD:
            _HELD[path] = CountCache(RankMerger.from_file(path))
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(_HELD[path].count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = plain.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
