"""Segmentation of texts into sentences, units, windows and paragraphs, with counters, as Arrow functions.

No built-in expresses it, as sentence ends are told by what comes before them without bound. Every text is gone through once, in time that grows with its
length: words are counted once each (and remembered by the worker), and whatever is made of them has running sums of those counts.
Pieces come back with the four additive counters of `text.token_counters`, so that nothing has to count them again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import in_slices

COUNTERS = "struct<tokens:int,words:int,arabic:int,letters:int>"
PIECES = f"array<struct<index:string,text:string,c:{COUNTERS}>>"
#: Words whose counters a worker remembers.
KNOWN_WORDS = 200_000

_TOKEN = re.compile(r"\w+|[^\w\s]")
_WORD = re.compile(r"\S+")
_WIDE = re.compile("[؀-ۿݐ-ݿࢠ-ࣿ]")
_BREAK = re.compile("\n+|[.!?؟]")
_BLANKS = re.compile(r"\s*")
_CLOSERS = re.compile("[\"')\\]}]*")


class Counters(NamedTuple):
    tokens: int
    words: int
    arabic: int
    letters: int

    def __add__(self, other: Counters) -> Counters:  # type: ignore[override]
        return Counters(self[0] + other[0], self[1] + other[1], self[2] + other[2], self[3] + other[3])

    def __sub__(self, other: Counters) -> Counters:
        return Counters(self[0] - other[0], self[1] - other[1], self[2] - other[2], self[3] - other[3])

    @property
    def size(self) -> int:
        """Approximate tokens: more for Arabic, whose words are cut finer."""
        if self.letters and self.arabic / self.letters >= 0.30:
            return max(self.tokens, round(1.35 * self.words))
        return self.tokens


NOTHING = Counters(0, 0, 0, 0)


class Piece(NamedTuple):
    text: str
    c: Counters


def _of_word(word: str) -> Counters:
    found = _TOKEN.findall(word)
    return Counters(len(found), sum(any(map(str.isalnum, t)) for t in found), len(_WIDE.findall(word)), sum(map(str.isalpha, word)))


def _packed(c: Counters) -> int:
    """All four as one number, as one addition is faster than four."""
    return c[0] | c[1] << 32 | c[2] << 64 | c[3] << 96


def _unpacked(number: int) -> Counters:
    return Counters(number & 0xFFFFFFFF, number >> 32 & 0xFFFFFFFF, number >> 64 & 0xFFFFFFFF, number >> 96)


class _Known(dict):
    """The packed counters of words, KNOWN_WORDS at most; a new word is counted when it is looked up."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = number = _packed(_of_word(word))
        return number


_of_known = _Known().__getitem__


def counters(text: str) -> Counters:
    """Of a whole text: no token spans white space, so those of its words add up."""
    return _unpacked(sum(map(_of_known, text.split())))


def count_tokens(text: str) -> int:
    return counters(text).size


def _ends_sentence(text: str, at: int) -> bool:
    """Is the mark at this place the end of a sentence? Only full stops may not be."""
    if text[at] != ".":
        return True
    if text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit():
        return False
    follows = _BLANKS.match(text, at + 1).end()
    if not text[follows : follows + 1].isalpha():
        return True
    word = text[max(0, at - 400) : at + 1].rsplit(None, 1)[-1].strip("\"')]}")
    letters = [c for c in word if c.isalpha()]
    dots = word.count(".")
    return not (dots > 1 or (dots == 1 and 0 < len(letters) < 5 and any(map(str.isupper, letters))))


def split_sentences(text: str) -> list[str]:
    text, units, start, at = text.strip(), [], 0, 0
    while (mark := _BREAK.search(text, at)) is not None:
        at = mark.end()
        if mark[0][0] == "\n":
            units.append(text[start : mark.start()])
        elif _ends_sentence(text, mark.start()):
            at = _CLOSERS.match(text, at).end()
            units.append(text[start:at])
            at = _BLANKS.match(text, at).end()
        else:
            continue
        start = at
    return [u.strip() for u in (*units, text[start:]) if u.strip()]


class _Sentence:
    """A long sentence as numbered words. Its parts are ranges of these numbers; running sums measure a range at once."""

    def __init__(self, text: str, target: int) -> None:
        self.text, self.target = text, target
        self.spans = [m.span() for m in _WORD.finditer(text)]
        self.words = [text[a:b] for a, b in self.spans]
        self.sums = list(accumulate(map(_of_known, self.words), initial=0))

    def counted(self, part: range) -> Counters:
        return _unpacked(self.sums[part.stop] - self.sums[part.start])

    # Fixed rules: where long sentences are parted, in order.
    def _after_colons(self, part: range) -> list[range]:
        return self._parted(part, [k for k in part[1:] if self.words[k - 1][-1] in ":;"])

    def _at_bars(self, part: range) -> list[range]:
        """Table bars between words go; a bar right after one that went stays, as its white space went with the other."""
        bars: list[int] = []
        for k in part[1:-1]:
            if self.words[k] == "|" and (not bars or bars[-1] < k - 1):
                bars.append(k)
        edges = [part.start - 1, *bars, part.stop]
        return [range(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]

    def _after_commas(self, part: range) -> list[range]:
        return self._parted(part, [k for k in part[1:] if self.words[k - 1][-1] == "," and ("A" <= self.words[k][0] <= "Z" or "ء" <= self.words[k][0] <= "ي")])

    @staticmethod
    def _parted(part: range, cuts: list[int]) -> list[range]:
        return [range(a, b) for a, b in zip((part.start, *cuts), (*cuts, part.stop), strict=True)]

    def fitted(self, part: range, halved: bool = False) -> list[tuple[range, bool]]:
        """Ranges within the target, as far as words allow, and whether each comes from halving (its words are joined by single spaces)."""
        size = self.counted(part).size
        if size <= self.target or len(part) == 1:
            return [(part, halved)]
        for cut in (self._after_colons, self._at_bars, self._after_commas):
            parts = cut(part)
            if len(parts) > 1:
                fine = [f for p in parts for f in self.fitted(p, halved)]
                if all(self.counted(p).size < size for p, _ in fine):
                    return fine
        middle = part.start + len(part) // 2
        return self.fitted(range(part.start, middle), True) + self.fitted(range(middle, part.stop), True)

    def pieces(self) -> list[Piece]:
        whole = range(len(self.words))
        shown = lambda p, halved: " ".join(self.words[p.start : p.stop]) if halved else self.text[self.spans[p.start][0] : self.spans[p.stop - 1][1]]
        return [Piece(shown(p, halved), self.counted(p)) for p, halved in self.fitted(whole)]


def split_oversized(text: str, target: int) -> list[Piece]:
    """Parts of at most `target` tokens, as far as words allow."""
    text = text.strip()
    whole = counters(text)
    if whole.size <= target:
        return [Piece(text, whole)] if text else []
    return _Sentence(text, target).pieces()


def sentence_units(text: str, target: int) -> list[Piece]:
    return [p for u in split_sentences(text) for p in split_oversized(u, target)]


def pack_sentences(units: list[Piece], target: int, overlap: int) -> list[Piece]:
    """Windows of as many units as fit (one at least), each starting `overlap` units before the end of the last one."""
    upto = list(accumulate((u.c.size for u in units), initial=0))
    sums = list(accumulate((u.c for u in units), initial=NOTHING))
    packed, begin = [], 0
    while begin < len(units):
        end = max(begin + 1, bisect_right(upto, upto[begin] + target) - 1)
        packed.append(Piece(" ".join(u.text for u in units[begin:end]), sums[end] - sums[begin]))
        begin = max(begin + 1, end - overlap)
    return packed


def paragraphs(text: str) -> list[Piece]:
    return [Piece(p, counters(p)) for p in map(str.strip, text.split("\n")) if p]


def pack_paragraphs(units: list[Piece], target: int, overlap: int) -> list[Piece]:
    """Paragraphs joined by blank lines while these have `target` tokens at most; a new chunk begins with the last `overlap` paragraphs of the one before."""
    sums = list(accumulate((u.c for u in units), initial=NOTHING))
    packed, begin = [], 0
    for end in range(1, len(units) + 1):
        if end == len(units) or (sums[end + 1] - sums[begin]).size > target:
            packed.append(Piece("\n\n".join(u.text for u in units[begin:end]), sums[end] - sums[begin]))
            begin = max(begin, end - overlap)
    return packed


def numbered(pieces: list[Piece]) -> list[tuple[str, Piece]]:
    return [(str(k), p) for k, p in enumerate(pieces)]


def merge_small(pieces: list[Piece], smallest: int) -> list[tuple[str, Piece]]:
    """Pieces below `smallest` tokens join the next one; a last one joins the one before.

    The index of an untouched piece is its place, of a merged one the direction and place of its last merge.
    """
    done: list[tuple[str, Piece]] = []
    run: list[str] = []  # texts that wait for a neighbour, with what they count
    held, last = NOTHING, len(pieces) - 1
    for k, piece in enumerate(pieces):
        run.append(piece.text)
        held += piece.c
        small = held.size < smallest
        if small and k < last:
            continue
        index = str(k) if len(run) == 1 else f"merge_fwd_{k - 1}"
        if small and done:
            _, before = done.pop()
            done.append((f"merge_back_{k}", Piece("\n".join((before.text, *run)), before.c + held)))
        else:
            done.append((index, Piece("\n".join(run), held)))
        run, held = [], NOTHING
    return done


def arrow_lists(make: Callable[[object], list[str]]) -> Callable[[Column], Column]:
    """A function from one value to a list of strings, as a column function; null gives null."""

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield in_slices(part, lambda some: pa.array((None if x is None else make(x) for x in some.to_pylist()), pa.list_(pa.string())))

    return run.asNondeterministic()  # so that the planner evaluates it once


def arrow_pieces(make: Callable[[object], list[tuple[str, Piece]]]) -> Callable[[Column], Column]:
    """A function from one value to numbered pieces, as a column function of type PIECES; null gives null."""

    def pieces(part: pa.Array) -> pa.Array:
        made = [None if x is None else make(x) for x in part.to_pylist()]
        flat = [row for rows in made if rows for row in rows]
        # a null list has no rows, and its offset says so
        ends = list(accumulate((len(rows) if rows else 0 for rows in made), initial=0))
        offsets = pa.array([None if rows is None else a for rows, a in zip(made, ends, strict=False)] + [ends[-1]], pa.int32())
        counts = pa.StructArray.from_arrays([pa.array([p.c[n] for _, p in flat], pa.int32()) for n in range(4)], list(Counters._fields))
        rows = pa.StructArray.from_arrays([pa.array([i for i, _ in flat], pa.string()), pa.array([p.text for _, p in flat], pa.string()), counts], ["index", "text", "c"])
        return pa.ListArray.from_arrays(offsets, rows)

    @F.arrow_udf(PIECES)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield in_slices(part, pieces)

    return run.asNondeterministic()
