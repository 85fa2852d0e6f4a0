"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A line goes if it lies in a run of at least `run` consecutive lines that repeats an earlier run: the same lines start
somewhere earlier, in a document with a smaller doc_id or farther up in the same one. A line of `long` characters or more is a run by
itself. The first occurrence stays.

1. Winnowing. Of each window of `run` line hashes the smallest (the leftmost of equal ones) is a fingerprint. Which line that is
   depends on the window's lines alone, so two equal runs of `run` lines share a fingerprint at the same place. Long lines are
   fingerprints of windows of one line as well.
2. Joining positions. Fingerprints are counted over all documents; those that occur once can't lie in a repeated run.
   Positions of the others are kept.
3. Extending both ways. A kept position is extended in both directions by all ways to lay `run` lines over it, from
   the one that ends there to the one that begins there. Each such window is compared with the first window of the
   same lines, so that a fingerprint with a million positions costs a million comparisons, not their pairs.
4. Deleting. Windows that aren't the first of their kind delete their lines.

Counts and first positions are partial aggregates, written before they are joined back to positions; the positions of a hot line are dealt to several tasks
(`salted_join`). Windows are compared by a 64-bit hash of the line hashes together with the fingerprint's own 64-bit hash.

Defined results: null text has no lines; empty text is one empty line; lines are compared as they are; fewer shorter lines than `run` are never removed; repeated
rows with equal doc_id count as one position (neither repeats the other); null doc_ids come first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import salted_join, table


def _lines(text: Column) -> Column:
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def line_hashes(docs: DataFrame, long: int) -> DataFrame:
    """doc_id, hashes (one long per line) and wide (0-based places of long lines)."""
    lines = _lines(F.col("text").cast("string"))
    none = F.array().cast("array<int>")
    wide = F.filter(F.transform(lines, lambda x, i: F.when(F.length(x) >= long, i)), lambda i: i.isNotNull())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"), F.when(F.length("text") >= long, wide).otherwise(none).alias("wide"))


def fingerprints(hashed: DataFrame, run: int) -> DataFrame:
    """doc_id, at (0-based line of a window minimum), fp, and around: the hashes of the lines run-1 to either side."""
    starts = F.sequence(F.lit(0), F.size("hashes") - run)
    chosen = F.transform(starts, lambda i: i + F.array_position(F.slice("hashes", i + 1, run), F.array_min(F.slice("hashes", i + 1, run))).cast("int") - 1)
    at = hashed.filter(F.size("hashes") >= run).select("doc_id", "hashes", F.explode(F.array_distinct(chosen)).alias("at"))
    first = F.greatest(F.col("at") - (run - 1), F.lit(0))
    return at.select("doc_id", "at", F.element_at("hashes", F.col("at") + 1).alias("fp"), first.alias("from"), F.slice("hashes", first + 1, F.col("at") + run - first).alias("around"))


def repeated_lines(docs: DataFrame, run: int = 3, long: int = 200) -> DataFrame:
    """doc_id, gone: the 0-based lines to delete, for the documents that have any."""
    hashed = table(line_hashes(docs, long), "winnow-lines")
    prints = table(fingerprints(hashed, run), "winnow")
    often = table(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "winnow-often")
    kept = salted_join(prints, often, ["fp"], "doc_id", "left_semi")
    laid = F.sequence(F.lit(0), F.size("around") - run)
    window = kept.filter(F.size("around") >= run).select("doc_id", "fp", F.explode(F.transform(laid, lambda i: F.struct((F.col("from") + i).alias("start"), F.xxhash64(F.slice("around", i + 1, run)).alias("lines")))).alias("w"))
    window = window.select("doc_id", "fp", "w.start", "w.lines", F.lit(run).alias("width"))
    alone = hashed.select("doc_id", "hashes", F.explode("wide").alias("start"))
    alone = alone.withColumn("fp", F.element_at("hashes", F.col("start") + 1)).select("doc_id", "fp", "start", F.xxhash64("fp").alias("lines"), F.lit(1).alias("width"))
    window = table(window.unionByName(alone), "winnow-windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), F.col("start").alias("start"))
    firsts = window.groupBy("fp", "lines", "width").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last")
    firsts = table(firsts.select("fp", "lines", "width", "first"), "winnow-firsts")
    later = salted_join(window, firsts, ["fp", "lines", "width"], "doc_id").filter(place > F.col("first"))
    runs = later.groupBy("doc_id").agg(F.collect_set(F.struct("start", "width")).alias("runs"))
    return runs.select("doc_id", F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["width"] - 1))))).alias("gone"))


def line_dedup(docs: DataFrame, run: int = 3, long: int = 200) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, kept_text (kept lines joined by newlines; null if the text is null)."""
    if run < 2:
        raise ValueError("run must be at least 2")
    gone = repeated_lines(docs, run, long)
    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    joined = plain.hint("merge").join(gone.withColumnRenamed("doc_id", "gone_id"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    lines = _lines(F.col("text"))
    # one flag per line up to the last deleted one: false for the lines since the deleted one before, then true
    flags = F.flatten(F.transform("gone", lambda g, k: F.concat(F.array_repeat(F.lit(False), g - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1), F.array(F.lit(True)))))
    left = F.filter(F.zip_with(lines, flags, lambda line, f: F.when(f, F.lit(None)).otherwise(line)), lambda line: line.isNotNull())
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"))
