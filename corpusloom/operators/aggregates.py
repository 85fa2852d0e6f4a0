"""Summaries of runs, chunks, strategies and activity, each one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.postings import Postings
from corpusloom.sources.shared import shared_path, written

TINY, LARGE, HARD = 80, 250, 512  # fixed values: the token range chunks should be in


def ingest_summary(clean: DataFrame) -> DataFrame:
    """Per language: documents, Arabic ones, words."""
    return clean.groupBy("detected_lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if("is_arabic").alias("arabic"), F.sum("word_count").alias("words"))


def size_histogram(chunks: DataFrame) -> DataFrame:
    """strategy, size, n, arabic: how many chunks have a size. It is small, and histograms of parts add up to that of the whole."""
    return chunks.groupBy("strategy", F.col("token_count").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_arabic").alias("arabic"))


def histogram_stats(sizes: DataFrame) -> DataFrame:
    """Per strategy the statistics of its chunk sizes, exact, from `size_histogram` alone."""
    t, c = F.col("size"), F.col("n")
    upto = F.sum("n").over(Window.partitionBy("strategy").orderBy("size"))  # as many rows as there are sizes
    placed = sizes.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy("strategy"))})
    exact = lambda x: F.sum(x.cast("decimal(38,0)"))
    total, squares, n = exact(t * c), exact(t.cast("decimal(18,0)") * t * c), F.sum("n")
    spread = F.when(n > 1, F.sqrt(((n.cast("decimal(20,0)") * squares - total * total) / (n.cast("decimal(20,0)") * (n - 1))).cast("double"))).otherwise(0.0)
    mean = F.sum(t * c) / n
    within = lambda low, high: F.coalesce(F.sum(F.when(t.between(low, high), c)), F.lit(0))
    # the middle chunk, or both of them
    low, high = F.min(F.when(F.col("upto") >= F.floor((F.col("all") + 1) / 2), t)), F.min(F.when(F.col("upto") >= F.floor(F.col("all") / 2) + 1, t))
    return placed.groupBy("strategy").agg(
        n.alias("chunks"),
        F.round(mean, 1).alias("avg_tokens"),
        F.floor((low + high) / 2).cast("long").alias("median_tokens"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        F.round(spread, 1).alias("stdev_tokens"),
        F.round(F.when(mean > 0, spread / mean).otherwise(0.0), 3).alias("variation"),
        F.sum(t * c).cast("long").alias("total_tokens"),
        F.sum("arabic").alias("arabic"),
        (n - F.sum("arabic")).alias("other"),
        within(-(2**31), TINY - 1).alias("tiny"),
        within(TINY, LARGE).alias("in_range"),
        within(LARGE + 1, 2**31 - 1).alias("oversize"),
        within(HARD + 1, 2**31 - 1).alias("hard_oversize"),
        F.round(within(TINY, LARGE) / n * 100, 1).alias("in_range_pct"),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per strategy the sizes of its chunks, which are made once: both counts read what is written of them. Input: strategy, source_doc_id, token_count, is_arabic."""
    chunks = written(chunks.select("strategy", "source_doc_id", "token_count", "is_arabic"), shared_path(chunks.sparkSession, "sizes"))
    documents = chunks.groupBy("strategy").agg(F.countDistinct("source_doc_id").alias("documents"))
    joined = histogram_stats(size_histogram(chunks)).hint("merge").join(documents.withColumnRenamed("strategy", "__of"), F.col("strategy").eqNullSafe(F.col("__of"))).drop("__of")
    order = ["strategy", "chunks", "avg_tokens", "median_tokens", "min_tokens", "max_tokens", "stdev_tokens", "variation", "total_tokens", "arabic", "other", "documents", "tiny", "in_range", "oversize", "hard_oversize", "in_range_pct"]
    return joined.select(*order)


def dataset_summary(clean: DataFrame) -> DataFrame:
    return clean.groupBy("file_type").agg(F.countDistinct("source_path").alias("sources"), F.count(F.lit(1)).alias("documents"), F.count_if("is_arabic").alias("arabic"))


def strategy_score() -> Column:
    return F.round(F.col("in_range_pct") * 1.5 - F.col("tiny") * 3.0 - F.col("oversize") * 4.0 - F.col("hard_oversize") * 8.0 - F.col("variation") * 20.0, 2)


def score_strategies(stats: DataFrame) -> DataFrame:
    """Per strategy its score and whether it has the best one (of ties all have)."""
    scored = stats.select("strategy", strategy_score().alias("score"))
    best = scored.agg(F.max("score").alias("best"))
    return scored.crossJoin(F.broadcast(best)).select("strategy", "score", (F.col("score") == F.col("best")).alias("recommended"))  # one row


def chunking_insights(stats: DataFrame) -> DataFrame:
    """strategy, rule and value for each rule that applies."""
    rule = lambda name, value, holds: F.when(holds, F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value")))
    rules = F.array(
        rule("above the hard limit", F.col("hard_oversize"), F.col("hard_oversize") > 0),
        rule("above the range", F.col("oversize"), F.col("oversize") > 0),
        rule("below the range", F.col("tiny"), F.col("tiny") > 0),
        rule("uneven sizes", F.col("variation"), F.col("variation") > 0.4),
        rule("even sizes", F.col("variation"), F.col("variation") <= 0.4),
        rule("few documents", F.col("documents"), F.col("documents") < 3),
        rule("no Arabic", F.col("arabic"), F.col("arabic") == 0),
    )
    return stats.select("strategy", F.explode(F.array_compact(rules)).alias("r")).select("strategy", "r.rule", "r.value")


def lexical_probe(queries: DataFrame, chunks: DataFrame | Postings) -> DataFrame:
    """query_count, avg_overlap and hit_rate: the best share of a query's words that one chunk has. Both: id and tokens; or the chunks' index."""
    index = chunks if isinstance(chunks, Postings) else Postings.build(chunks)
    each = index.best_overlap(queries.filter(F.size("tokens") > 0)).select((F.col("overlap") / F.col("size")).alias("best"))
    return each.agg(F.count(F.lit(1)).alias("query_count"), F.round(F.avg("best"), 3).alias("avg_overlap"), F.round(F.count_if(F.col("best") >= 0.5) / F.count(F.lit(1)) * 100, 1).alias("hit_rate"))


def documents_overview(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per source path: first page's id, type, size, chunks, latest time. documents: doc_id, source_path, file_type, page_num, file_size, indexed_at; chunks: source_path."""
    counts = chunks.groupBy("source_path").agg(F.count(F.lit(1)).alias("chunk_count"))
    one = documents.groupBy("source_path").agg(F.min_by("doc_id", F.struct("page_num", "doc_id")).alias("id"), F.min("file_type").alias("file_type"), F.max("file_size").alias("file_size"), F.max("indexed_at").alias("indexed_at"))
    return one.join(counts.hint("merge"), "source_path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def system_stats(documents: DataFrame, chunks: DataFrame, activity: DataFrame) -> DataFrame:
    """One row: documents, chunks, health, last ingestion, mean query latency. activity: type, latency."""
    docs = documents.agg(F.countDistinct("source_path").alias("total_documents"), F.max("indexed_at").alias("last_ingestion_at"))
    parts = chunks.agg(F.count(F.lit(1)).alias("total_chunks"))
    speed = activity.filter(F.col("type") == "query").agg(F.round(F.avg("latency"), 2).alias("avg_retrieval_latency_ms"))
    health = F.when(F.col("total_chunks") > 0, "healthy").when(F.col("total_documents") > 0, "degraded").otherwise("offline")
    return docs.crossJoin(parts).crossJoin(speed).withColumn("retrieval_health", health)  # one row each


def dominant_language(clean: DataFrame) -> DataFrame:
    """The most frequent language; ties go to the one that occurs first (by id)."""
    each = clean.groupBy("detected_lang").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    return each.agg(F.coalesce(F.max_by("detected_lang", F.struct("n", -F.col("first"))), F.lit("unknown")).alias("lang"))


def run_sources(rows: DataFrame) -> DataFrame:
    """Per ingestion the number of distinct sources and files, and the ends of their sorted list."""
    return rows.groupBy("ingestion_id").agg(F.countDistinct("source_path").alias("sources"), F.countDistinct("file_hash").alias("files"), F.min("source_path").alias("first_source"), F.max("source_path").alias("last_source"))


def activity_counts(activity: DataFrame) -> DataFrame:
    return activity.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 2).alias("avg_latency"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs under way, done and failed. jobs: status."""
    under_way = F.col("status").isin("processing", "queued")
    return jobs.agg(F.count_if(under_way).alias("active"), F.count_if(F.col("status") == "indexed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def average_score_percent(chunks: DataFrame) -> DataFrame:
    """One row: the mean score of chunks as a whole percentage, 0 without any."""
    return chunks.agg(F.coalesce(F.round(F.avg("score") * 100), F.lit(0.0)).cast("long").alias("average_score"))


def count_chunks(chunks: DataFrame) -> DataFrame:
    """Per ingestion the chunks that aren't blank. chunks: ingestion_id, text."""
    return chunks.groupBy("ingestion_id").agg(F.count_if(F.length(F.trim("text")) > 0).alias("chunks"))
