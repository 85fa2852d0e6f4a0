"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash h in [0, 2**60) of its doc_id. A source whose target is k whole
times its size plus a rest takes every document k times, and once more those with h below a threshold, chosen so that their sizes come nearest to the rest. Thresholds
are found without sorting: sizes are summed by source and leading hash bits, the bucket in which the running sum
passes the rest is found, and only that bucket is split by its next bits, until it is one hash value. A larger rest
gives a larger threshold, so mixes with nested budgets are nested.

Each level reads only the rows of the boundary buckets, which shrink by 2**BITS each time. Only sums per (source, bucket) are
shuffled. The table of sources (one row each) is joined by broadcast where its counted rows are at most `SMALL_TABLE`, else by a sort-merge
join, whose hot keys AQE splits.

Defined results: null text has size 0; null is a source like any other, last in order; rows with equal doc_id have
equal hashes and are taken alike; sources without words have target 0 and take nothing; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._shared import table

HASH_BITS = 60
BITS = 10
SMALL_TABLE = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def hash60(seed: str = "mix") -> Column:
    """The first 15 hex digits of MD5 of seed:doc_id, as a number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def source_key() -> Column:
    """The source, null-safe and in order: null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, key (the source), size, h."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"), size.alias("size"), hash60(seed).alias("h"))


def targets(rows: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """key, source_size, target: shares of the total by weight, none above max_copies times its source's size.

    Sources are ordered by the level at which they reach their bound (bound / weight). Those that reach it get the
    bound; the others share what is left by weight. This is where repeated resharing ends. One row per source.
    """
    total = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("nth", F.row_number().over(Window.orderBy("key")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("nth"), F.lit(len(weights))).cast("int") + 1)
    bound = (F.col("source_size") * max_copies).cast("long")
    level = ranked.withColumns({"weight": weight.cast("long"), "bound": bound}).withColumn("level", F.col("bound") / F.col("weight"))
    up = Window.orderBy("level", "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = level.withColumns({"gone": F.coalesce(F.sum("bound").over(up), F.lit(0)), "used": F.coalesce(F.sum("weight").over(up), F.lit(0)), "all": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    level = level.withColumn("pace", (F.col("all") - F.col("gone")) / (F.col("weights") - F.col("used")))
    pace = F.min(F.when(F.col("level") > F.col("pace"), F.struct("level", "nth", "pace"))).over(every)
    target = F.when(pace.isNull() | (F.struct("level", "nth") < F.struct(pace["level"], pace["nth"])), F.col("bound").cast("double")).otherwise(F.col("weight") * pace["pace"])
    return level.select("key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame, max_copies: int = 3) -> DataFrame:
    """key, source_size, target, copies (whole times) and below: documents with h < below are taken once more."""
    copies = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(F.lit(0))
    wanted = wanted.withColumn("copies", copies.cast("long"))
    # low: hash where the boundary bucket begins, sum: sizes below it
    state = wanted.withColumns({"rest": F.col("target") - F.col("copies") * F.col("source_size"), "low": F.lit(0).cast("long"), "sum": F.lit(0).cast("long")})
    state = table(state, "mix-state")
    small = state.count() <= SMALL_TABLE
    for bits in range(HASH_BITS, 0, -BITS):
        width = 1 << (bits - BITS)
        open_ = state.select("key", "low", "rest", F.col("sum").alias("base"))
        joined = rows.join(F.broadcast(open_), "key") if small else rows.hint("merge").join(open_, "key")
        if bits < HASH_BITS:
            joined = joined.filter((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + (1 << bits)))
        bucket = F.shiftright(F.col("h") - F.col("low"), bits - BITS)
        sums = joined.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("in_bucket"), F.first("low").alias("low"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        up = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**BITS rows
        run = sums.withColumn("upto", F.col("base") + F.sum("in_bucket").over(up))
        # the first bucket with which the sum passes the rest
        passing = run.filter(F.col("upto") > F.col("rest")).groupBy("key").agg(F.min(F.struct("bucket", "upto", "in_bucket")).alias("at"))
        found = passing.select("key", F.col("at.bucket").alias("bucket"), (F.col("at.upto") - F.col("at.in_bucket")).alias("before"), F.col("at.in_bucket").alias("in_bucket"))
        state = state.hint("merge").join(found, "key", "left")
        state = state.select("key", "source_size", "target", "copies", "rest", (F.col("low") + F.coalesce(F.col("bucket"), F.lit(0)) * width).alias("low"), F.coalesce("before", "sum").alias("sum"), F.coalesce("in_bucket", F.lit(0)).alias("last"))
        state = table(state, "mix-state")
    # the boundary is one hash value now: it is taken if that comes nearer to the rest
    nearer = F.abs(F.col("sum") + F.col("last") - F.col("rest")) < F.abs(F.col("rest") - F.col("sum"))
    return state.select("key", "source_size", "target", "copies", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("below"))


def mix(docs: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken (words that the mix takes), copies."""
    rows = table(sized(docs, seed), "mix-rows")
    chosen = table(thresholds(rows, targets(rows, max_copies, weights), max_copies), "mix-thresholds")
    small = chosen.count() <= SMALL_TABLE
    joined = rows.join(F.broadcast(chosen), "key") if small else rows.hint("merge").join(chosen, "key")
    copies = F.least(F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0), F.lit(max_copies))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns as they are."""
    rows = table(sized(docs, seed), "mix-rows")
    chosen = table(thresholds(rows, targets(rows, max_copies, weights), max_copies), "mix-thresholds").select(F.col("key").alias("__key"), "copies", "below")
    small = chosen.count() <= SMALL_TABLE
    names = [f"c{i}" for i in range(len(docs.columns))]
    short = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), source_key().alias("__key"), hash60(seed).alias("__h"))
    joined = short.join(F.broadcast(chosen), "__key") if small else short.hint("merge").join(chosen, "__key")
    copies = F.least(F.col("copies") + F.when(F.col("__h") < F.col("below"), 1).otherwise(0), F.lit(max_copies))
    return joined.select(*names, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("__copy")).drop("__copy").toDF(*docs.columns)
