"""Spelling variants: words one edit apart, found by pivotal grams, and the frequent form that each rare word stands for.

1. Words. A run of letters is lower-cased (A-Z only); one in `rate` (document, run) pairs, by CRC-32, loses a code point. Each task adds up
   its words before they are shuffled; words of `least` occurrences in all remain.
2. Grams. The bigrams of a word are ordered by how few words have them. Its prefix is the rarest three (with all that equal the last);
   of these a dynamic programme chooses two that don't overlap and are rarest together, the pivots. One edit leaves a pivot
   whole; of two words one edit apart, that whose prefix ends at the rarer gram has a pivot that survives in the prefix of the other one
   (Deng, Li and Feng, 2014).
3. Join. A surviving pivot stands at the same distance from the start, with the same letters before it, if the edit is behind it; else at the same
   distance from the end, with the same letters behind it. So the position limit is made part of the key: pivots are looked up
   among the prefix grams of other words by a hash of the letters up to and with the gram, and by one of those from the gram on, where lengths
   differ by one at most. What is found is verified by edit distance.
4. Forms. A word's form is its near word of largest count (ties: smallest in code-point order) if that is `ratio` times its own at least. Counts grow by
   that factor along a chain of forms, so a few doublings of the links reach all roots.

There are at most 90 letters, so at most 8,100 bigrams: their counts are bounded and sent to all tasks. Keys that many words share (a gram at the start
or end of a word) are met by a sort-merge join, which AQE splits.

Defined results: null and empty texts have no words; a null doc_id counts as an empty number; repeated rows count each; a very long
text is read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import drop_tables, slices, table
from corpusloom.llm.words import text_bytes

#: Letters A-Z are lower-cased before; U+00C0 to U+00FF are these bytes in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Words that a task adds up before it sends them on.
HELD_WORDS = 300_000
GRAM = 2
#: Longer words are named by their id alone while pairs are sought.
INLINE = 64


def varied(run: bytes, doc: int, rate: int) -> bytes:
    """The run, without one code point if `rate` divides the hash. doc: CRC-32 of the document's part of the key."""
    h = zlib.crc32(run, doc)
    if h % rate:
        return run
    if run.isascii():
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, min_length: int, min_count: int, rate: int) -> DataFrame:
    """word, n: words of at least min_length code points and min_count occurrences."""

    def flushed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for i, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                    doc = zlib.crc32(b"%d:" % i if i is not None else b":")
                    for word, n in Counter(_RUN.findall(text.lower())).items():
                        # a code point above U+007F is two bytes long
                        if len(word) >= min_length:
                            word = varied(word, doc, rate)
                            if len(word) - word.count(b"\xc3") >= min_length:
                                held[word] += n
                if len(held) > HELD_WORDS:
                    yield flushed(held)
                    held = Counter()
        yield flushed(held)

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return told.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Of each bigram its place, the rarest first, and how often words have it."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    counts = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # 90 * 90 at most
    return {g: (k, n) for k, (n, g) in enumerate(sorted((n, g) for g, n in counts.items()))}


def prefix_and_pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """Places of the prefix grams and of the pivots, and the rank at which the prefix ends.

    The prefix has the GRAM + 1 rarest grams, and all that are equal to the last of them. The pivots are two grams of it that don't overlap and
    have the least sum of counts: for each gram as the second pivot, the best first one is that of the places GRAM and more before it.
    """
    held = [ranks[word[i : i + GRAM]] for i in range(len(word) - GRAM + 1)]
    last = sorted(held)[min(GRAM, len(held) - 1)][0]
    prefix = [i for i, (rank, _) in enumerate(held) if rank <= last]
    best: tuple[int, list[int]] | None = None
    first: tuple[int, int] | None = None  # least count and place among grams that end before the second pivot
    behind = 0
    for place in prefix:
        while prefix[behind] + GRAM <= place:
            now = (held[prefix[behind]][1], prefix[behind])
            first = min(first, now) if first else now
            behind += 1
        if first and (best is None or first[0] + held[place][1] < best[0]):
            best = (first[0] + held[place][1], [first[1], place])
    return prefix, best[1] if best else prefix[:1], last


def keys_at(word: str, places: list[int]) -> list[int]:
    """Two keys of each place: of the letters up to and with the gram there, and of those from it on (hashed from the end).

    Each letter is hashed once per direction, so that a very long word takes time in proportion.
    """
    ahead, back, done = xxhash.xxh64(seed=1), xxhash.xxh64(seed=2), 0
    keys = []
    for p in places:
        ahead.update(word[done : p + GRAM].encode())
        done = p + GRAM
        keys.append(ahead.intdigest())
    done = len(word)
    for p in reversed(places):
        back.update(word[p:done][::-1].encode())
        done = p
        keys.append(back.intdigest())
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words that differ by one edit, in both directions.

    words: a written table of id, word (4 letters or more, no repeats) and n. Words of up to INLINE letters are verified inside the join, pairs with longer
    ones after it, so that a very long word is not copied for each of its grams.
    """
    ranks = gram_ranks(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word"):
                rows = []
                for word in part.column("word").to_pylist():
                    prefix, pivots, last = prefix_and_pivots(word, ranks)
                    rows.append((word if len(word) <= INLINE else None, len(word), last, keys_at(word, prefix), keys_at(word, pivots)))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", "short", "length", "last", "prefix", "pivots"])

    grams = table(words.select("id", "word").mapInArrow(run, "id long, short string, length int, last int, prefix array<long>, pivots array<long>"), "spelling-grams")
    a, b = (grams.select(F.explode(keys).alias(f"key_{t}"), *(F.col(c).alias(f"{c}_{t}") for c in ("id", "short", "length", "last"))) for t, keys in (("a", "pivots"), ("b", "prefix")))
    told = F.col("short_a").isNull() | F.col("short_b").isNull()
    may = (F.col("key_a") == F.col("key_b")) & (F.abs(F.col("length_a") - F.col("length_b")) <= 1) & (F.col("last_a") <= F.col("last_b")) & (F.col("id_a") != F.col("id_b"))
    met = a.hint("merge").join(b, may & (told | (F.levenshtein("short_a", "short_b", 1) == 1)))
    pairs = table(met.select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"), told.alias("told")).distinct(), "spelling-pairs")
    both = pairs.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"), "told").select("p.x", "p.y", "told")
    one, other = words.select(F.col("id").alias("x"), F.col("word").alias("a"), F.col("n").alias("n_a")), words.select(F.col("id").alias("y"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    named = both.hint("merge").join(one, "x").hint("merge").join(other, "y").filter(~F.col("told") | (F.levenshtein("a", "b", 1) == 1))
    return named.select("a", "n_a", "b", "n_b")


def _roots(links: DataFrame, ratio: int) -> DataFrame:
    """word, root from word, form, form_n: forms followed to the last one, each step doubling those before."""
    at = table(links.select("word", F.col("form").alias("root")), "spelling-links")
    most = links.agg(F.max("form_n")).first()[0] or 1
    steps = int(math.log(most, ratio)) + 1
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, at = at, table(at.hint("merge").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-links")
        drop_tables([before])
    return at


def group_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, rate: int = 199) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    if min_length < 2 * GRAM:
        raise ValueError(f"words need {2 * GRAM} letters for two grams that don't overlap")
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms have no cycle")
    words = table(word_counts(docs, min_length, min_count, rate).withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    # the largest count, then the smallest word: a minimum of its negative, which combines before the shuffle
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word"))).alias("best")
    near = near_pairs(words).groupBy("a", "n_a").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n_a")
    near = table(near.select(F.col("a").alias("word"), "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "spelling-near")
    roots = _roots(near.filter("form IS NOT NULL"), ratio)
    out = words.drop("id").hint("merge").join(near, "word", "left").hint("merge").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
