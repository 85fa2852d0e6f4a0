"""Many questions against many chunks at once: vector top-k, lexical search, reranking, rejection, post-processing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.postings import Postings
from corpusloom.operators.vectors import TopK, VectorTable, tiles
from corpusloom.sources.shared import only, shared_path, written

# Floors, weights and limits of the ranking.
MIN_SCORE, PER_DOCUMENT, OVERSAMPLE = 0.74, 3, 3.0
VARIANT_FLOOR, FALLBACK_FLOOR, LEXICAL_FLOOR, LEXICAL_OVERLAP = 0.76, 0.68, 0.72, 2
MIN_HYBRID, TOP_WINDOW = 0.66, 0.1
LEXICAL_SHARE = 0.55
#: Largest table of query vectors that is sent to every task; more queries are searched in several passes.
QUERY_BATCH = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_topk(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k nearest points of each query; ties go to the smaller chunk_id.

    Queries travel to the points in batches of a fixed size; each task multiplies whole Arrow batches and keeps k rows per query, so k rows per
    query and task are shuffled. queries: query_id, vector; points: chunk_id, vector.
    """
    found = reduce(DataFrame.unionByName, [_best_in_tasks(batch, points, k) for batch in _query_batches(queries)])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _query_batches(queries: DataFrame) -> Iterator[Broadcast]:
    """Ids and vectors of at most about QUERY_BATCH queries at a time, sent once to each executor."""
    parts = max(1, -(-queries.count() // QUERY_BATCH))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    for part in range(parts):
        rows = dealt.filter(F.col("part") == part).select("query_id", "vector").toArrow()
        yield queries.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), np.array(rows.column("vector").to_pylist(), dtype=np.float64)))


def vector_score(queries: DataFrame, points: DataFrame) -> DataFrame:
    """query_id, pairs, best, mean: number, maximum and mean of a query's scores over all points.

    Each task multiplies whole Arrow batches and sends one row per query.
    """

    def of(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            n, best, total = 0, np.full(len(ids), -np.inf), np.zeros(len(ids))
            for batch in batches:
                for at in range(0, batch.num_rows if len(ids) else 0, 1000):
                    block = np.array(batch.column("vector").slice(at, 1000).to_pylist(), dtype=np.float64)
                    n += len(block)
                    for some in tiles(len(ids), len(block)):
                        scores = matrix[some] @ block.T
                        best[some], total[some] = np.maximum(best[some], scores.max(axis=1)), total[some] + scores.sum(axis=1)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), n)), pa.array(best), pa.array(total)], ["query_id", "pairs", "best", "total"])

        return points.select("vector").mapInArrow(run, "query_id long, pairs long, best double, total double")

    parts = reduce(DataFrame.unionByName, map(of, _query_batches(queries)))
    return parts.groupBy("query_id").agg(F.sum("pairs").alias("pairs"), F.max("best").alias("best"), (F.sum("total") / F.sum("pairs")).alias("mean"))


def _best_in_tasks(sent: Broadcast, points: DataFrame, k: int) -> DataFrame:
    kind = dict(points.dtypes)["chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        best, every = TopK(len(ids), k), np.arange(len(ids))
        for batch in batches:
            names = np.array(batch.column("chunk_id").to_pylist())
            for at in range(0, batch.num_rows if len(ids) else 0, 1000):
                best.score(every, matrix, names[at : at + 1000], np.array(batch.column("vector").slice(at, 1000).to_pylist(), dtype=np.float64))
        q, chunks, scores = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(chunks.tolist(), pa.int64() if kind == "bigint" else pa.string()), pa.array(scores, pa.float64())], ["query_id", "chunk_id", "score"])

    return points.select("chunk_id", "vector").mapInArrow(run, f"query_id long, chunk_id {kind}, score double")


def search(queries: DataFrame, table: VectorTable, hits: DataFrame, k: int, filters: dict[str, object] | None = None, dedup: bool = True, cap: int | None = PER_DOCUMENT, min_score: float | None = MIN_SCORE, oversample: float = OVERSAMPLE) -> DataFrame:
    """The k hits of each query after post-processing: `oversample` times as many are looked for, with the filters applied before any is scored.

    queries: query_id, vector; hits: chunk_id, chunk_content_hash, document_group_id of all points. Without dedup and cap the nearest k are returned as they are.
    """
    wanted = max(k, round(k * max(1.0, oversample)))
    found = table.search(queries, wanted, filters)
    named = found.hint("merge").join(only(hits, written(found.select("chunk_id"), shared_path(queries.sparkSession, "found")), "chunk_id"), "chunk_id")
    if not dedup and cap is None:
        return named.filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "chunk_content_hash", "document_group_id", "score")
    return post_process(named.withColumn("chunk_id", F.col("chunk_id").cast("string")), k, dedup, cap, min_score)


def token_overlap(queries: DataFrame, chunks: DataFrame | Postings, least: int = 1) -> DataFrame:
    """query_id, chunk_id, overlap, size: shared distinct tokens of all pairs that share at least `least`.

    queries: query_id, tokens; chunks: chunk_id, tokens, or their index.
    """
    return _indexed(chunks).all_pairs(queries, least)


def covering_pairs(queries: DataFrame, chunks: DataFrame | Postings, least: int = LEXICAL_OVERLAP, share: float = LEXICAL_SHARE) -> DataFrame:
    """As `token_overlap`, but for pairs only that share `share` of the query's tokens and `least` of them at least. Words that are in every chunk make no pairs."""
    return _indexed(chunks).covering(queries, least, share)


def _indexed(chunks: DataFrame | Postings) -> Postings:
    return chunks if isinstance(chunks, Postings) else Postings.build(chunks)


def lexical_search(queries: DataFrame, chunks: DataFrame, k: int, index: Postings | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by token coverage and phrase. queries: query_id, query; chunks: chunk_id, text; index: that of the chunks, if there is one."""
    asked = queries.withColumn("tokens", X.match_tokens(F.col("query")))
    pairs = covering_pairs(asked, index or chunks.select("chunk_id", "text"))
    coverage = F.col("overlap") / F.col("size")
    # without the phrase a pair needs 5/6 of the tokens, with it 5/9: the others are not joined back to their texts
    near = written(pairs.filter(0.42 + coverage * 0.36 + 0.1 >= LEXICAL_FLOOR), shared_path(queries.sparkSession, "near"))
    told = near.hint("merge").join(queries.select("query_id", F.lower("query").alias("asked")), "query_id").select("query_id", "chunk_id", "asked", coverage.alias("coverage"))
    # a text travels once, to all queries that are near to it
    full = told.groupBy("chunk_id").agg(F.collect_list(F.struct("query_id", "asked", "coverage")).alias("near")).hint("merge").join(only(chunks.select("chunk_id", "text"), near, "chunk_id"), "chunk_id")
    each = full.select("chunk_id", F.lower("text").alias("low"), "near").select("chunk_id", F.explode(F.transform("near", lambda x: F.struct(x["query_id"].alias("query_id"), x["coverage"].alias("coverage"), F.col("low").contains(x["asked"]).alias("phrase")))).alias("x")).select("chunk_id", "x.*")
    score = F.least(F.lit(0.9), 0.42 + F.col("coverage") * 0.36 + F.when(F.col("phrase"), 0.1).otherwise(0.0))
    scored = each.filter(F.col("phrase") | (F.col("coverage") >= 0.55)).select("query_id", "chunk_id", score.alias("score")).filter(F.col("score") >= LEXICAL_FLOOR)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k, 3))


def query_bigrams(query: Column) -> Column:
    """Neighbouring query words of three letters or more, one of them of four, as "a b"."""
    words = F.filter(X.ordered_tokens(query), lambda t: F.length(t) >= 3)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when((F.length(a) >= 4) | (F.length(b) >= 4), F.concat(a, F.lit(" "), b)))
    return F.array_compact(pairs)


def count_bigrams(query: Column, text: Column) -> Column:
    """How many of the query's bigrams stand in the text."""
    return F.size(F.filter(query_bigrams(query), lambda p: F.lower(text).contains(p)))


def token_frequency(candidates: DataFrame) -> DataFrame:
    """query_id, token, df: in how many of a query's candidates a token occurs. candidates: query_id, chunk_id, tokens."""
    return candidates.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("df"))


def weighted_coverage(asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, chunk_id, weighted: inverse-frequency share of the query's tokens in the candidate.

    asked: query_id, tokens; candidates: query_id, chunk_id, tokens.
    """
    each = asked.select("query_id", F.explode("tokens").alias("token")).hint("merge").join(token_frequency(candidates), ["query_id", "token"], "left")
    weights = each.withColumn("w", 1.0 / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)))
    have = candidates.select("query_id", "chunk_id", "tokens")
    pairs = weights.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("token", "w"))).alias("weights")).hint("merge").join(have, "query_id")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x["w"])
    hit = total(F.filter("weights", lambda x: F.array_contains("tokens", x["token"])))
    return pairs.select("query_id", "chunk_id", (hit / F.greatest(total(F.col("weights")), F.lit(1e-9))).alias("weighted"))


def hybrid_rerank(candidates: DataFrame, variants: DataFrame) -> DataFrame:
    """Candidates with features and hybrid score, best first. candidates: query_id, chunk_id, text, score; variants: query_id, variant, query.

    Features are the best over the variants that share a script with the text.
    """
    # what depends on one side alone is taken once for each candidate and each variant, before they meet
    text, query = F.col("text"), F.col("query")
    have = candidates.select("query_id", "chunk_id", "score", X.match_tokens(text).alias("tokens"), F.lower(text).alias("low"), X.numbers(text).alias("figures"), X.has_latin(text).alias("latin"), X.has_arabic(text).alias("arabic"), X.digit_ratio(text).alias("digits"))
    have = have.withColumn("long", X.informative_tokens(F.col("tokens")))
    asked = variants.select("query_id", "variant", X.match_tokens(query).alias("asked"), F.when(F.length(query) >= 8, F.lower(query)).alias("phrase"), query_bigrams(query).alias("bigrams"), X.numbers(query).alias("numbers"), X.has_latin(query).alias("asks_latin"), X.has_arabic(query).alias("asks_arabic"))
    asked = asked.withColumn("informative", X.informative_tokens(F.col("asked")))
    df = token_frequency(have)
    weights = asked.select("query_id", "variant", F.explode("asked").alias("token")).hint("merge").join(df, ["query_id", "token"], "left")
    weights = weights.groupBy("query_id", "variant").agg(F.sort_array(F.collect_list(F.struct("token", (1.0 / F.coalesce("df", F.lit(1))).alias("w")))).alias("weights"))
    pairs = have.hint("merge").join(asked.hint("merge").join(weights, ["query_id", "variant"], "left"), "query_id")
    script = (F.col("asks_latin") & F.col("latin")) | (F.col("asks_arabic") & F.col("arabic"))
    live = script & (F.size("asked") > 0)
    shared = F.size(F.array_intersect("asked", "tokens"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x["w"])
    weighted = total(F.filter("weights", lambda x: F.array_contains("tokens", x["token"]))) / F.greatest(total(F.col("weights")), F.lit(1e-9))
    best = pairs.groupBy("query_id", "chunk_id").agg(
        F.first("digits").alias("digits"),
        F.first("score").alias("semantic"),
        F.max(script).alias("script"),
        F.max(F.when(live, F.struct((shared / F.size("asked")).alias("coverage"), shared.alias("overlap")))).alias("best"),
        F.max(F.when(live & (F.size("informative") > 0), F.size(F.array_intersect("informative", "long")) / F.greatest(F.size("informative"), F.lit(1)))).alias("informative"),
        F.max(F.when(live, weighted)).alias("weighted"),
        F.max(F.when(live, F.size(F.filter("bigrams", lambda p: F.col("low").contains(p))))).alias("bigrams"),
        F.max(F.when(live, F.coalesce(F.col("low").contains(F.col("phrase")), F.lit(False)))).alias("phrase"),
        F.max(F.when(live, F.arrays_overlap("numbers", "figures"))).alias("number"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    coverage, overlap = z(F.col("best.coverage")), F.coalesce("best.overlap", F.lit(0))
    bonus = F.when(F.col("phrase"), 0.05).otherwise(0.0) + F.least(F.lit(0.08), F.coalesce("bigrams", F.lit(0)) * 0.04) + F.when(F.col("number"), 0.04).otherwise(0.0)
    table = F.when((F.col("digits") > 0.12) & (overlap < 2), 0.04).otherwise(0.0)
    score = F.least(F.lit(0.99), F.col("semantic") * 0.78 + F.greatest(coverage, z(F.col("weighted"))) * 0.22 + bonus - table)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    scored = best.select("query_id", "chunk_id", "semantic", coverage.alias("coverage"), overlap.alias("overlap"), z(F.col("informative")).alias("informative"), z(F.col("weighted")).alias("weighted"), "script", F.when(F.col("script"), score).otherwise(F.col("semantic")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(order))


def reject_low_confidence(ranked: DataFrame) -> DataFrame:
    """Drops all hits of a query whose best one convinces too little, else those too far below it. Input as of `hybrid_rerank`."""
    ranked = written(ranked, shared_path(ranked.sparkSession, "ranked"))
    top = ranked.filter(F.col("rank") == 1).select("query_id", F.struct("score", "semantic", "coverage", "informative", "weighted", "script").alias("top"))
    floor = F.greatest(F.lit(MIN_HYBRID), F.col("top.score") - TOP_WINDOW)
    weak = (F.col("top.score") < MIN_HYBRID) | (F.col("top.script") & (F.col("top.informative") < 0.25) & (F.col("top.semantic") < 0.82)) | (F.col("top.script") & (F.greatest("top.coverage", "top.weighted") < 0.18) & (F.col("top.semantic") < 0.81))
    kept = (F.col("top.semantic") >= 0.86) | ~weak
    return ranked.hint("merge").join(top, "query_id").filter(kept & (F.col("score") >= floor)).drop("top")


def post_process(hits: DataFrame, k: int, dedup: bool = True, cap: int | None = PER_DOCUMENT, min_score: float | None = MIN_SCORE) -> DataFrame:
    """Greedy walk by rank: score floor, seen chunk, seen content, per-document cap, at most k. One fold per query in the JVM.

    hits: query_id, rank, chunk_id, chunk_content_hash, document_group_id, score; a query's hits are at most a few hundred.
    """
    item = F.struct("rank", "chunk_id", "chunk_content_hash", "document_group_id", "score")
    kind = "array<struct<rank:int,chunk_id:string,chunk_content_hash:string,document_group_id:string,score:double>>"
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).cast(kind).alias("hits"))
    same = lambda x, n: lambda y: y[n].eqNullSafe(x[n]) & x[n].isNotNull()

    def step(acc: Column, x: Column) -> Column:
        ok = F.size(acc) < k
        if min_score is not None:
            ok &= x["score"].isNull() | (x["score"] >= min_score)
        if dedup:
            ok &= ~F.exists(acc, same(x, "chunk_id")) & ~F.exists(acc, same(x, "chunk_content_hash"))
        if cap is not None:
            ok &= x["document_group_id"].isNull() | (F.size(F.filter(acc, same(x, "document_group_id"))) < cap)
        return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

    walked = listed.select("query_id", F.aggregate("hits", F.array().cast(kind), step).alias("kept"))
    return walked.select("query_id", F.posexplode("kept").alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("rank"), "hit.chunk_id", "hit.chunk_content_hash", "hit.document_group_id", "hit.score")


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks. The hits are found once, and chunks that are none of them don't travel."""
    found = written(hits, shared_path(hits.sparkSession, "hits"))
    return found.hint("merge").join(only(chunks, found, "chunk_id"), "chunk_id")


def best_per_chunk(hits: DataFrame) -> DataFrame:
    """The highest score of each chunk of a query."""
    return hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def unique_sources(hits: DataFrame) -> DataFrame:
    """Distinct sources of a query's hits in the order of their first hit."""
    keys = [F.coalesce("source_doc_id", F.lit("unknown")).alias("source_doc_id"), F.coalesce("source_path", F.lit("unknown")).alias("source_path"), F.col("page_num")]
    first = hits.select("query_id", "rank", *keys).groupBy("query_id", "source_doc_id", "source_path", "page_num").agg(F.min("rank").alias("first_rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")))


def retrieve_with_variants(variants: DataFrame, hits: DataFrame, chunks: DataFrame, k: int, index: Postings | None = None) -> DataFrame:
    """The whole second half of a search: gate variants, merge, fall back to words, rerank, reject, post-process.

    variants: query_id, variant (0 first), query; hits: query_id, variant, chunk_id, score; chunks: chunk_id, text, chunk_content_hash, document_group_id.
    """
    hits = written(hits, shared_path(hits.sparkSession, "hits"))
    tops = hits.groupBy("query_id", "variant").agg(F.max("score").alias("top"))
    passed = tops.filter((F.col("variant") == 0) | (F.col("top") >= VARIANT_FLOOR))
    best = best_per_chunk(hits.hint("merge").join(passed.select("query_id", "variant"), ["query_id", "variant"], "left_semi"))
    sure = tops.groupBy("query_id").agg(F.max("top").alias("top")).filter(F.col("top") >= FALLBACK_FLOOR).select("query_id")
    sure = sure.hint("merge").join(passed.select("query_id").distinct(), "query_id", "left_semi")
    unsure = variants.filter(F.col("variant") == 0).hint("merge").join(sure, "query_id", "left_anti").select("query_id", "query")
    words = lexical_search(unsure, chunks, max(3 * k, 5), index).select("query_id", "chunk_id", "score")
    merged = with_chunks(best_per_chunk(best.unionByName(words)), chunks)
    ranked = reject_low_confidence(hybrid_rerank(merged, variants))
    kept = with_chunks(ranked, chunks.select("chunk_id", "chunk_content_hash", "document_group_id"))
    return post_process(kept, k, min_score=None)
