"""SimHash near-dedup: segment-popcount embedding, a grid range-join under Manhattan distance, exact verification.

A 64-bit fingerprint is embedded as the bit counts of its two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so pairs farther apart than the radius drop out
without a look at the bits. The segments form groups; a pair within the radius differs in at most `radius` groups, so it shares the
cell of at least one grid, a grid being the coordinates of all groups but `radius`. There are as many groups as keep the expected number of
unrelated fingerprints in a cell below a quarter, whatever their number (`groups_for`): the grid is made finer as the input grows.
Within a cell, pairs are kept by the range condition on Manhattan distance, then by the bits.

What still crowds a cell is a group of near copies, whose pairs must not all be listed. There each fingerprint is linked with the smallest one
that shares its value or one flipped bit of it: two fingerprints within 2 bits share such a value, at most 65 fingerprints do, and so this way is
exact and linear, too.

Links are between distinct fingerprints only: copies are one node. Components come from `components.py`.

Defined results: null text counts as empty; a text without words has fingerprint zero, which links like any other;
a text with fewer words than a shingle is one shingle; repeated rows and repeated doc_ids are kept; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import few_tasks, salted_join, slices, table
from corpusloom.llm.components import components
from corpusloom.llm.near_copies import near_links, only, text_key
from corpusloom.llm.words import text_bytes

SEGMENT_BITS = 2
#: A cell with more distinct fingerprints than this holds a group of near copies.
CROWDED = 32


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles: ASCII letters lower-cased, ASCII white space parts words, repeats count."""
    found = text.lower().split()  # of bytes: ASCII only
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = np.array([fingerprint(t, words, seed) for t in text_bytes(part.column("text"))], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding in one long: segment i's bit count at bits 2i and 2i+1."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Sum of the differences of the bit counts, taken segment by segment."""
    one = lambda x, i: F.shiftrightunsigned(x, 2 * i).bitwiseAND(F.lit(3)).cast("int")
    total = F.lit(0)
    for i in range(64 // SEGMENT_BITS):
        total = total + F.abs(one(a, i) - one(b, i))
    return total


def groups_for(n: int, radius: int) -> int:
    """Groups of segments, so that of n unrelated fingerprints a quarter at most meets another one in a cell.

    The bit count of a two-bit segment is worth 1.5 bits.
    """
    return next((g for g in range(radius + 1, 33) if 4 * n <= 2 ** (1.5 * (64 // SEGMENT_BITS) * (g - radius) / g)), 32)


def grids(radius: int, groups: int) -> list[int]:
    """Bit masks of the coordinates of each grid."""
    n = 64 // SEGMENT_BITS
    edges = [round(n * g / groups) for g in range(groups + 1)]
    masks = [sum(3 << (2 * i) for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return [signed(sum(masks[g] for g in kept)) for kept in combinations(range(groups), groups - radius)]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links a > b between fingerprints of `distinct` (column fp, no repeats) that give its components at the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2: the linear way for full cells holds up to 2 bits")
    emb = popcounts(F.col("fp"))
    number = distinct.count()
    masks = grids(radius, groups_for(number, radius))
    number *= len(masks)
    cells = F.array(*(F.struct(F.lit(g).alias("grid"), emb.bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(masks)))
    placed = distinct.select("fp", F.explode(cells).alias("c")).select("fp", "c.grid", "c.cell")
    sizes = table(few_tasks(placed.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), number), "simhash-sizes")
    shared = table(few_tasks(salted_join(placed, sizes, ["grid", "cell"], "fp"), number), "simhash-cells")

    few = shared.filter(F.col("n") <= CROWDED).groupBy("grid", "cell").agg(F.collect_list("fp").alias("fps"))
    pairs = few.select(F.explode("fps").alias("a"), "fps").select("a", F.explode(F.filter("fps", lambda x: x < F.col("a"))).alias("b"))
    pairs = pairs.filter(_manhattan(popcounts(F.col("a")), popcounts(F.col("b"))) <= radius)
    pairs = pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")

    crowded = shared.filter(F.col("n") > CROWDED).select("fp").distinct()
    flips = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    flipped = [F.col("fp").bitwiseXOR(F.lit(f)) for f in flips]
    if radius == 2:  # any two that share a value are within two bits
        keys = [F.struct(F.lit(0).cast("long").alias("bit"), k.alias("v")) for k in (F.col("fp"), *flipped)]
    else:  # the flipped bit is part of the key, so that only two that differ in this bit alone share it
        keys = [F.struct(F.lit(f).cast("long").alias("bit"), F.least(F.col("fp"), k).alias("v")) for f, k in zip(flips, flipped, strict=True)][: 64 * radius]
    keyed = crowded.select("fp", F.explode(F.array(*keys) if keys else F.array().cast("array<struct<bit:bigint,v:bigint>>")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = keyed.hint("merge").join(first, "key").select(F.col("fp").alias("a"), "b").filter("a > b")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    printed = table(fingerprints(docs, words, seed), "simhash-fp")
    distinct = table(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    groups = components(links(distinct.select("fp"), radius))
    tops = distinct.hint("merge").join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    tops = tops.select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    tops = table(tops, "simhash-roots")
    least = table(tops.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    labelled = table(salted_join(tops, least, ["root"], "fp").select("fp", "component_id"), "simhash-labels")
    out = printed.hint("merge").join(labelled, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2, near: bool = False) -> DataFrame:
    """One row of each component, with the columns of docs as they are: that with the smallest doc_id (null last).

    Of rows with the same doc_id and fingerprint the one with the least text stays. With near, texts whose five-word shingles
    have a Jaccard similarity of 0.8 or more are linked too (`near_copies.py`).
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    zero = F.lit(0).cast("long")
    short = docs.toDF(*names).withColumns({"row_id": F.monotonically_increasing_id(), "fp": zero} | ({"key": zero} if near else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = text_bytes(part.column(text))
                made = [pa.array(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))]
                if near:
                    made.append(pa.array([text_key(t) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) + 1], *made], part.schema.names)

    printed = table(short.mapInArrow(run, short.schema), "simhash-docs")
    every = printed.count()
    rank = F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).cast("long").alias("id"))
    distinct = table(few_tasks(printed.groupBy("fp").agg(F.min(rank).alias("least")), every), "simhash-distinct")
    linked = links(distinct.select("fp"), radius)
    if near:
        linked = table(linked, "simhash-links")
        linked = near_links(printed.select("row_id", "key", "fp", F.col(text).cast("string").alias("text")), linked)
    groups = components(linked).withColumnRenamed("node", "fp")
    tops = few_tasks(distinct.hint("merge").join(groups, "fp", "left"), every).select("fp", F.coalesce("root", "fp").alias("root"), "least")
    first = tops.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("one")).select(F.col("one.fp").alias("kept_fp"), F.col("one.least.id").alias("kept_id"))
    same = (F.col("fp") == F.col("kept_fp")) & F.col(doc_id).cast("long").eqNullSafe(F.col("kept_id"))
    # by row_id only, so that texts stay where they are; texts are compared where a doc_id and fingerprint repeat
    kept = table(few_tasks(printed.select("row_id", doc_id, "fp").hint("merge").join(first, same, "left_semi"), every), "simhash-kept")
    each = kept.groupBy(doc_id, "fp").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))
    repeats = kept.hint("merge").join(each.filter("n > 1").select(F.col(doc_id).alias("same_id"), F.col("fp").alias("same_fp")), F.col(doc_id).eqNullSafe(F.col("same_id")) & (F.col("fp") == F.col("same_fp")), "left_semi")
    told = only(printed.select("row_id", doc_id, "fp", text), table(repeats.select("row_id"), "simhash-repeats"), "left_semi", "row_id")
    least = told.groupBy(doc_id, "fp").agg(F.min(F.struct(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), "row_id")).alias("one")).select("one.row_id")
    stay = table(few_tasks(each.filter("n = 1").select("row_id").unionByName(least), every), "simhash-stay")
    gone = table(few_tasks(printed.select("row_id").hint("merge").join(stay, "row_id", "left_anti"), every), "simhash-gone")
    return only(printed, gone, "left_anti", "row_id").select(*names).toDF(*docs.columns)
