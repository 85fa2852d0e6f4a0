"""Questions: turns, follow-ups, variants, rewrites, contexts, prompts, answers, evaluation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

FILE_REFERENCE = r"(?i)\.(pdf|docx|html|txt|md|csv|xlsx?)\b"
IDK = "I don't know"
CONTEXT_TURNS, CONTEXT_CHARS = 3, 1800

STRICT = "You answer from the context alone.\nIf it does not hold the answer, say \"I don't know\".\nDo not guess.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:\n"
SIMPLE = "Answer the question with the help of the context.\n\nContext:\n{context}\n\nQuestion:\n{question}\n\nAnswer:\n"


def last_user_turn(context: Column) -> Column:
    """What follows the colon in the last line that begins with user:."""
    lines = F.filter(F.transform(F.split(context, r"\r?\n"), X.strip), lambda x: F.lower(x).startswith("user:"))
    return F.when(F.size(lines) > 0, X.strip(F.substring(F.element_at(lines, -1), F.lit(6), F.length(F.element_at(lines, -1)))))


def is_followup(query: Column, previous: Column) -> Column:
    """Does a question lean on the one before?"""
    asked = F.lower(X.strip(query))
    tokens, before = X.ordered_tokens(asked), X.ordered_tokens(F.lower(previous))
    novel = F.size(F.filter(tokens, lambda t: ~F.array_contains(before, t) & (F.length(t) >= 4)))
    few = F.size(tokens) / F.greatest(F.size(before), F.lit(1)) <= 0.45
    return F.when(asked == "", False).when(F.size(tokens) <= 4, True).when(asked.rlike(FILE_REFERENCE) | asked.rlike(r"\p{Nd}"), False).when(novel <= 1, True).otherwise(few & (novel <= 2))


def user_turns(conversations: DataFrame) -> DataFrame:
    """User turns with the one before in the same conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"), F.lag("text").over(order).alias("previous"))


def contextual_variant(query: Column, previous: Column) -> Column:
    leans = previous.isNotNull() & (X.strip(previous) != "") & (X.strip(previous) != X.strip(query)) & is_followup(query, previous)
    return F.when(leans, X.strip(F.concat_ws("\n", previous, query)))


def query_variants(query: Column, previous: Column, rewrites: Column | None = None) -> Column:
    """Distinct forms in order: as asked, with context, both normalised, rewrites."""
    plain, context = X.strip(query), contextual_variant(query, previous)
    forms = F.array(plain, context, X.normalize_query(plain), X.normalize_query(context))
    if rewrites is not None:
        forms = F.concat(forms, F.coalesce(rewrites, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull() & (v != "")))


def rewrite_target(query_language: Column, corpus_language: Column, top: Column, weak: float = 0.72) -> Column:
    """The language a question should be asked in as well, or null."""
    poor = top.isNull() | (top < weak)
    arabic = F.when(~((corpus_language == "ar") & ~poor), "en")
    return F.when(query_language == "ar", arabic).when((corpus_language == "ar") | poor, "ar")


def apply_rewrites(wanted: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Adds the rewrite of each (target, query) pair; each pair is looked up once. rewrites: target, query, rewrite."""
    clean = X.strip(F.regexp_replace(F.regexp_replace(X.strip(F.col("rewrite")), "^[\"']+|[\"']+$", ""), f"[{X.SPACE}]+", " "))
    known = rewrites.select("target", "query", F.nullif(clean, F.lit("")).alias("rewrite")).dropDuplicates(["target", "query"])
    return wanted.join(known.hint("merge"), ["target", "query"], "left")


def build_context(hits: DataFrame) -> DataFrame:
    """Per query one numbered line for each hit, in order. hits: query_id, rank, text, source_path, page_num."""
    source = F.when(F.col("page_num").isNull(), F.col("source_path")).otherwise(F.concat(F.col("source_path"), F.lit(" [page "), F.col("page_num").cast("string"), F.lit("]")))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text"), F.lit(" (source: "), source, F.lit(")"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def build_prompt(question: Column, context: Column, version: str = "strict") -> Column:
    forms = {"strict": STRICT, "simple": SIMPLE}
    name = (version or "strict").strip().lower()
    if name not in forms:
        raise ValueError("the prompt version must be 'simple' or 'strict'")
    before, rest = forms[name].split("{context}")
    between, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(between), question, F.lit(after))


def prompt_question(question: Column, context: Column) -> Column:
    """The question, after the earlier turns if there are any."""
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(F.concat(F.lit("Earlier turns:\n"), context, F.lit("\n\nQuestion now:\n"), question))


def conversation_context(conversations: DataFrame) -> DataFrame:
    """Per user turn the last three question-answer pairs before it, as many as fit into 1800 characters from the oldest on."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    answered = conversations.filter(F.col("role").isin("user", "assistant")).withColumns({"reply": F.lead("text").over(order), "reply_role": F.lead("role").over(order)})
    asked = answered.filter((F.col("role") == "user") & (F.col("reply_role") == "assistant"))
    part = F.concat(F.lit("User: "), F.col("text"), F.lit("\nAssistant: "), F.col("reply"))
    pairs = asked.select("conv_id", "turn", X.strip(part).alias("part"))
    before = pairs.withColumn("parts", F.collect_list("part").over(order.rowsBetween(-CONTEXT_TURNS, -1)))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        full = acc["full"] | (acc["n"] + F.length(p) > CONTEXT_CHARS)
        return F.struct(F.when(full, acc["n"]).otherwise(acc["n"] + F.length(p)).alias("n"), full.alias("full"), F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p))).alias("kept"))

    kept = F.aggregate("parts", start, step, lambda acc: acc["kept"])
    return before.select("conv_id", "turn", F.array_join(kept, "\n\n").alias("context"))


def _isolated(generate: Callable[[pd.Series], pd.Series]) -> Callable[[pd.Series], pd.Series]:
    """A generator of which one failing prompt fails alone: a batch that raises is asked again prompt by prompt, and those that raise have no answer."""

    def one(prompt: str) -> str | None:
        try:
            return next(iter(generate(pd.Series([prompt]))))
        except Exception:  # noqa: BLE001  whatever a model raises
            return None

    def run(prompts: pd.Series) -> pd.Series:
        asked = prompts[prompts.notna()]
        try:
            made = pd.Series(list(generate(asked)), index=asked.index, dtype=object) if len(asked) else asked
            if len(made) != len(asked):
                raise ValueError("as many answers as prompts are needed")
        except Exception:  # noqa: BLE001
            made = asked.map(one)
        return made.reindex(prompts.index)

    return run


def answers(queries: DataFrame, prompts: DataFrame, generate: Callable[[pd.Series], pd.Series] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Adds answer: what `generate` gives for the prompt (a function of batches of prompts), "I don't know" without hits or generator, or where it fails.

    sources (as of `retrieval.unique_sources`): adds sources too, those of the query's hits in their order, whether or not there is an answer; none without hits.
    """
    joined = queries.hint("merge").join(prompts, "query_id", "left")
    if sources is not None:
        one = F.struct("place", "source_doc_id", "source_path", "page_num")
        listed = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))  # a query's few hits
        joined = joined.hint("merge").join(listed, "query_id", "left").withColumn("sources", F.coalesce("sources", F.expr("array()").cast(dict(listed.dtypes)["sources"])))
    if generate is None:
        return joined.withColumn("answer", F.lit(IDK))
    made = F.pandas_udf(_isolated(generate), "string").asNondeterministic()(F.col("prompt"))  # evaluated once; null prompts are not asked
    return joined.withColumn("answer", F.coalesce(made, F.lit(IDK)))


def _holds(text: Column, needles: Column, every: bool) -> Column:
    there = lambda n: X.normalize_eval_text(text).contains(X.normalize_eval_text(n))
    return F.forall(needles, there) if every else F.exists(needles, there)


def evaluate_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: hits found, sources, evidence, pollution, facts, failure. cases as of `load_eval_cases` with answer; hits: id, rank, text, source_path."""
    joined = cases.join(hits.hint("merge"), "id", "left")
    lists = ("expected_source_contains", "expected_chunk_contains", "expected_answer_keywords", "forbidden_source_contains")
    found = F.col("source_path").isNotNull()
    each = joined.groupBy("id").agg(
        F.count_if(found).alias("retrieved_count"),
        F.coalesce(F.min_by("source_path", "rank"), F.lit("")).alias("top_source"),
        F.coalesce(F.bool_or(found & _holds(F.col("source_path"), F.col(lists[0]), False)), F.lit(False)).alias("any_source"),
        F.coalesce(F.bool_or(found & _holds(F.col("text"), F.col(lists[1]), True)), F.lit(False)).alias("evidence_hit"),
        F.coalesce(F.bool_or(found & _holds(F.col("source_path"), F.col(lists[3]), False)), F.lit(False)).alias("forbidden_hit"),
    )
    full = cases.join(each, "id")
    full = full.withColumns({"retrieval_hit": (F.size(lists[0]) == 0) | F.col("any_source"), "answer_keywords_ok": _holds(F.col("answer"), F.col(lists[2]), True)})
    full = full.withColumn("failure_reason", classify_failure())
    return full.select("id", "retrieved_count", "top_source", "retrieval_hit", "evidence_hit", "forbidden_hit", "answer_keywords_ok", "failure_reason", F.col("failure_reason").isNull().alias("passed"))


def classify_failure() -> Column:
    """The first thing that went wrong, or null."""
    return (
        F.when(F.col("forbidden_hit"), "cross-document pollution")
        .when(F.col("retrieved_count") == 0, "empty retrieval")
        .when(~(F.col("retrieval_hit") & F.col("evidence_hit")), "wrong chunk retrieved")
        .when(X.answer_is_idk(F.col("answer")), "relevant context found but answer abstained")
        .when(~F.col("answer_keywords_ok"), "answer missed expected facts")
    )


def eval_report(results: DataFrame) -> DataFrame:
    """Totals per failure reason; the row without one has all cases."""
    return results.withColumn("reason", F.coalesce("failure_reason", F.lit("passed"))).rollup("reason").agg(F.count(F.lit(1)).alias("cases"), F.count_if("retrieval_hit").alias("retrieval_hits"), F.count_if("evidence_hit").alias("evidence_hits"), F.count_if("passed").alias("passed"))


def probe_multi_chunk(hits: DataFrame) -> DataFrame:
    """Per query the page labels of its hits in order, and previews."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "page_label", F.substring("text", 1, 220).alias("preview"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["page_label"]), ",").alias("pages"), F.array_join(F.transform(rows, lambda r: r["preview"]), "\n").alias("previews"))


def query_activity(answered: DataFrame) -> DataFrame:
    """An activity row for each answered query. answered: event_id, ts, question, answer, latency and, if there are any, retrieved (ids)."""
    given = F.size("retrieved") if "retrieved" in answered.columns else F.lit(0)
    return answered.select("event_id", F.lit("query").alias("type"), "ts", F.round("latency", 2).alias("latency"), F.col("question").alias("description"), "question", "answer", given.alias("retrieved_count"))


def sessions_from_activity(activity: DataFrame) -> DataFrame:
    """A session for each query event that has a question and an answer, however empty, newest first: session_id, title, question, answer, at."""
    whole = activity.filter((F.col("type") == "query") & F.col("question").isNotNull() & F.col("answer").isNotNull())
    return whole.select(F.concat(F.lit("activity-session-"), F.col("event_id").cast("string")).alias("session_id"), F.col("question").alias("title"), "question", "answer", F.col("ts").alias("at")).orderBy(F.desc("at"))
