"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least 4/5: an exact set-similarity join.

A text's shingles stand in an order that is the same for all texts: those that are frequent in a sixteenth of the texts come
last, the others go by hash. Two sets of similarity 4/5 share one of the first `n - ceil(4n/5) + 1` shingles of each
(prefix filter), and for the smaller set one of the first `n - ceil(8n/9) + 1`, so texts that meet at no such shingle are
no pair. Of the pairs that meet and have fitting sizes, those whose signatures differ in more bits than the sets may in shingles
drop out; the others are checked on the whole sets. Which shingles count as frequent changes the cost only, not the result.

A shingle at which many texts meet (a group of near copies) compares all with two of them first: the most central text, that is the one which
meets others at the most such shingles, and the one with the smallest key. Then come rounds. In each, a text that is not in the largest component of
its shingle is compared with a few of those of other components there, and the components are found anew; in the next round it is
compared with four times as many, none of them twice, until all have been or nothing is left outside. Most texts of a group are linked by the first few, so what is
compared with many is only what hardly anything is near to. Which texts come first goes by a hash of their keys, so that shingles with the same texts take the same
ones. These comparisons are part of the join, by a sketch that each text of a crowded shingle carries, so that only pairs which may be similar
become rows.

Shingles are compared by a 64-bit hash. Words are as in simhash.py; a text with fewer words than a shingle is near
to equal texts only, which have one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import ROWS_A_TASK, drop_tables, few_tasks, partitions, salted_join, slices, table
from corpusloom.llm.components import components
from corpusloom.llm.words import text_bytes, window_hashes, word_hashes

#: A shingle with more texts than this compares them with its most central one first.
FULL_CELL = 32
#: With so many texts of a crowded shingle those outside its largest component are compared first; when all that is left makes at most so many pairs
#: for each text of the table, it is compared at once.
PIVOTS, AT_ONCE = 8, 8
#: The texts of a frequent shingle are dealt to so many tasks.
SALTS = 16
#: Longs of a sketch, which is a signature: a power of two.
SKETCH = 32
SKETCHES = "key long, n int, sketch array<long>"
#: One text in so many is looked at for frequent shingles; those in OFTEN of them count, MOST_FREQUENT at most.
SAMPLED, OFTEN, MOST_FREQUENT = 16, 3, 1_000_000
#: Pairs of whole sets that one task checks, and comparisons of sketches.
SETS_A_TASK, SKETCHES_A_TASK = 20_000, 1_000_000
#: A list of texts up to this size is broadcast; a longer one is joined by sorting.
SMALL_LIST = 1_000_000


def text_key(text: bytes) -> int:
    """A signed hash of the words, as they are compared."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(text.lower().split()))).astype(np.int64))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct shingles in order of their hashes; none if the text is shorter than one."""
    return np.unique(window_hashes(word_hashes(text.lower().split()), words)).view(np.int64)


def prefix(found: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles at which a text can meet a near copy, and how many of them do for one that is not smaller."""
    n = len(found)
    if n == 0:
        return found, 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        often = frequent[at] == found
        found = np.concatenate((found[~often], found[often]))
    return found[: n - (4 * n + 4) // 5 + 1], n - (8 * n + 8) // 9 + 1


def signature(found: np.ndarray, size: int) -> bytes:
    """A bit for each shingle; two signatures differ in no more bits than the sets in shingles. size: a power of two."""
    bits = np.zeros(size, dtype=bool)
    bits[found & (size - 1)] = True
    return np.packbits(bits).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the similarity of two sets 4/5 or more? Both without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def only(texts: DataFrame, keys: DataFrame, how: str, column: str) -> DataFrame:
    """Rows of texts whose key is (or is not) among keys, without a shuffle of the texts where the list is small."""
    listed = F.broadcast(keys) if keys.count() <= SMALL_LIST else keys.hint("merge")
    return texts.join(listed, column, how)


def _frequent(texts: DataFrame, words: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t, words) for t in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["h"])

    seen = texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    often = seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT)
    return np.sort(np.array(often.select("h").toArrow().column("h"), dtype=np.int64))


def _verified(texts: DataFrame, pairs: DataFrame, words: int, likely: bool = False) -> DataFrame:
    """Of pairs (a, b) of text keys those that are similar. likely: their sketches have been compared already.

    What goes to Python is a text at a time; pairs of sketches and of sets, which may be long, are compared in Spark's expressions, row by row.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t, words) for t in text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "held"])

    def among(pairs: DataFrame, number: int) -> DataFrame:
        keys = table(few_tasks(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), 2 * number), "near-keys")
        return only(texts.select("key", "text"), keys, "left_semi", "key")

    def beside(pairs: DataFrame, held: DataFrame, a_task: int) -> DataFrame:
        one = F.struct(*held.drop("key").columns)
        for side in "ab":
            met = pairs.hint("merge").join(held.select(F.col("key").alias(side), one.alias(f"of_{side}")), side)
            pairs = few_tasks(met, number, a_task)
        return pairs

    near, made, number = pairs, [], pairs.count()
    if not likely:
        bits = table(among(pairs, number).mapInArrow(lambda batches: _sketches(batches, words), SKETCHES), "near-bits")
        near = table(beside(pairs, bits, ROWS_A_TASK).filter(_near(F.col("of_a"), F.col("of_b"))).select("a", "b"), "near-likely")
        made, number = [bits, near], near.count()
    held = table(among(near, number).mapInArrow(sets, "key long, held array<long>"), "near-sets")
    found = table(beside(near, held, SETS_A_TASK).filter(_similar(F.col("of_a.held"), F.col("of_b.held"))).select("a", "b"), "near-links")
    drop_tables([*made, held])
    return found


def _sketches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [shingles(t, words) for t in text_bytes(part.column("text"))]
            made = [np.frombuffer(signature(s, 64 * SKETCH), np.int64) for s in found]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in found], pa.int32()), pa.array(made, pa.list_(pa.int64()))], ["key", "n", "sketch"])


def _similar(a: Column, b: Column) -> Column:
    """`similar` of two arrays without repeats; of two empty ones, too."""
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def _near(a: Column, b: Column) -> Column:
    """May two texts be similar, by their sketches? Sets of similarity 4/5 differ in a ninth of their sizes at most."""
    differ = sum((F.bit_count(F.get(a["sketch"], F.lit(k)).bitwiseXOR(F.get(b["sketch"], F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    return 9 * differ <= a["n"] + b["n"]


def _fits(a: Column, b: Column) -> Column:
    """Can two texts that meet be similar, by their sizes and places? The smaller one meets in its short prefix."""
    smaller = F.when(a["n"] < b["n"], a["short"]).when(a["n"] > b["n"], b["short"]).otherwise(a["short"] & b["short"])
    return smaller & (5 * F.least(a["n"], b["n"]) >= 4 * F.greatest(a["n"], b["n"]))


def near_links(rows: DataFrame, known: DataFrame, words: int = 5) -> DataFrame:
    """Links a > b between fingerprints that give the components of the known links and of similarity 4/5.

    rows: row_id, key (`text_key`), fp, text. known: links a > b between fingerprints.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    every = rows.count()
    ids = table(few_tasks(rows.groupBy("key", "fp").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("copies")), every), "near-ids")
    nodes = ids.select("key", "fp")
    again = rows.select("row_id", "key").hint("merge").join(ids.filter("copies > 1").select("key", "first"), "key").filter("row_id != first").select("row_id")
    texts = only(rows.select("row_id", "key", "text"), table(few_tasks(again, every), "near-copies"), "left_anti", "row_id")
    sent = spark.sparkContext.broadcast(_frequent(texts, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = sent.value
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words) for t in text_bytes(part.column("text"))]
                made = [prefix(s, frequent) for s in sets]
                sizes = [len(p) for p, _ in made]
                key = np.repeat(np.array(part.column("key"), dtype=np.int64), sizes)
                size = np.repeat(np.array([len(s) for s in sets], dtype=np.int32), sizes)
                short = np.concatenate([np.zeros(0, bool), *(np.arange(len(p)) < k for p, k in made)])
                h = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in made)])
                hot = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), bool)
                salt = np.where(hot, key % SALTS, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(hot), pa.array(key), pa.array(size), pa.array(short)], ["h", "salt", "hot", "key", "n", "short"])

    met = texts.select("key", "text").mapInArrow(run, "h long, salt int, hot boolean, key long, n int, short boolean").repartition(n, "h", "salt")
    # all columns are used, so that both sides of the join share one shuffle
    parts = met.groupBy("h", "salt").agg(F.max("hot").alias("hot"), F.count(F.lit(1)).alias("texts"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.max("short").alias("short"))
    whole = parts.filter("hot").groupBy("h").agg(F.sum("texts").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("fewest").alias("fewest"), F.max("most").alias("most"), F.max("short").alias("short"))
    sizes = parts.filter("NOT hot").drop("hot").unionByName(whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    sizes = sizes.filter("low != high AND short AND (texts > 2 OR 5 * fewest >= 4 * most)").select("h", "salt", "texts")
    shared = table(met.hint("merge").join(sizes, ["h", "salt"]).select("h", "hot", "key", "n", "short", "texts"), "near-cells")
    one = F.struct("key", "n", "short")

    few = shared.filter(F.col("texts") <= FULL_CELL).groupBy("h").agg(F.collect_list(one).alias("all"))
    pairs = few.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.filter("all", lambda y: (y["key"] < F.col("x.key")) & _fits(F.col("x"), y))).alias("y"))
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))

    full = shared.filter(F.col("texts") > FULL_CELL)
    # central texts first: those that meet others at many shingles are the least changed copies
    crowd = full.count()
    often = table(few_tasks(full.groupBy("key").agg((-F.count(F.lit(1))).alias("rank")), crowd), "near-often")
    sketched = table(only(texts.select("key", "text"), often.select("key"), "left_semi", "key").mapInArrow(lambda batches: _sketches(batches, words), SKETCHES), "near-sketches")
    full = table(few_tasks(full.hint("merge").join(often, "key").hint("merge").join(sketched.select("key", "sketch"), "key"), crowd), "near-crowds")
    one = F.struct("rank", "key", "n", "short", "sketch")
    least = table(few_tasks(full.groupBy("h").agg(F.min(one).alias("y"), F.min_by(one, "key").alias("z")), crowd), "near-least")
    stars = salted_join(full, least, ["h"], "key").withColumn("x", one)
    stars = stars.select("x", F.explode(F.array("y", "z")).alias("y"))
    stars = stars.filter((F.col("x.key") != F.col("y.key")) & _fits(F.col("x"), F.col("y")) & _near(F.col("x"), F.col("y")))
    pairs = pairs.unionByName(stars.select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b"))).distinct()
    links = known.unionByName(_linked(_verified(texts, table(pairs, "near-pairs"), words), nodes))
    if not crowd:
        return links

    groups = components(links, rows=every).withColumnRenamed("node", "fp")
    rooted = table(few_tasks(nodes.hint("merge").join(groups, "fp", "left").select("key", F.coalesce("root", "fp").alias("root")), every), "near-roots")
    # what is linked already is a star, and the links of the rounds join stars by their roots
    links = groups.filter("fp != root").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    placed = table(few_tasks(full.hint("merge").join(rooted, "key"), crowd), "near-full")
    number, done, reach = rooted.count(), 0, PIVOTS
    drop_tables([full, least])
    while True:
        others = _outside(placed, one, crowd)
        left = others.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("texts") - done).alias("pairs"), F.max("texts").alias("most")).first()
        if not left["rows"]:
            break
        last = left["pairs"] <= AT_ONCE * number or reach >= left["most"]
        turn = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("texts")
        now = placed.filter((turn >= done) & (F.lit(last) | (turn < reach))).select("h", "root", one.alias("y"))
        pairs = others.hint("merge").join(now, "h").filter((F.col("root") != F.col("other")) & _fits(F.col("x"), F.col("y")) & _near(F.col("x"), F.col("y")))
        pairs = few_tasks(pairs.select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b")), left["pairs"], SKETCHES_A_TASK)
        pairs = table(few_tasks(pairs.distinct(), left["pairs"], SKETCHES_A_TASK), "near-round")
        joined = _linked(_verified(texts, pairs, words, likely=True), rooted)
        drop_tables([others, pairs])
        links = links.unionByName(joined)
        if last:
            break
        if not joined.isEmpty():
            changed = joined.count()
            roots = table(few_tasks(components(joined, rows=changed), 2 * changed), "near-moved")
            (rooted, before), (placed, old) = (_moved(rooted, roots, number), rooted), (_moved(placed, roots, crowd), placed)
            drop_tables([before, old, roots])
        done, reach = reach, 4 * reach
    drop_tables([placed, sketched])
    return links


def _moved(rows: DataFrame, roots: DataFrame, number: int) -> DataFrame:
    """The rows, that many, with their newest roots. roots: node, root, one row per root that is one no more."""
    met = salted_join(rows.withColumnRenamed("root", "node"), roots, ["node"], "key", "left")
    return table(few_tasks(met.withColumn("root", F.coalesce("root", "node")).drop("node"), number), "near-moving")


def _outside(placed: DataFrame, one: Column, number: int) -> DataFrame:
    """Of that many rows and each shingle the texts that are not in its largest component: h, texts, other (the component), x."""
    counts = few_tasks(placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("held")), number)
    most = table(few_tasks(counts.groupBy("h").agg(F.max(F.struct("held", "root")).alias("most")).select("h", F.col("most.root").alias("largest")), number), "near-most")
    others = salted_join(placed, most, ["h"], "key").filter("root != largest").select("h", "texts", F.col("root").alias("other"), one.alias("x"))
    found = table(few_tasks(others, number), "near-others")
    drop_tables([most])
    return found


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of pairs of text keys. nodes: key, node."""
    number = pairs.count()
    both = few_tasks(pairs.hint("merge").join(nodes.toDF("a", "x"), "a"), number)
    both = few_tasks(both.hint("merge").join(nodes.toDF("b", "y"), "b"), number).filter("x != y")
    return table(few_tasks(both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), number), "near-linked")
