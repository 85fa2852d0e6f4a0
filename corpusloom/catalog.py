"""The registered queries over the given tables, each beside its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalizers
from corpusloom.functions import text as X
from corpusloom.operators import aggregates, chunking, html, questions, retrieval, tables
from corpusloom.operators.postings import Postings
from corpusloom.operators.vectors import VectorTable
from corpusloom.plans import ingest
from corpusloom.plans.buckets import spot_of
from corpusloom.plans.jobs import Jobs
from corpusloom.sources import charsets
from corpusloom.sources import documents as sources
from corpusloom.sources.shared import shuffles_freed
from corpusloom.streaming import activity as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Text with what cleaning has to deal with, set around each document's own.
BEFORE, AFTER = "ﬁn \u200fأَحْمَد مدرسة ى\u0640 -\nx\u0007  \t y\n\n\n\n", " e\u0301 12,5% \u00a0"
MESSY_SQL = f"('{BEFORE}' || text || '{AFTER}')"
SPACE = X.SPACE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def messy() -> Column:
    return F.concat(F.lit(BEFORE), F.col("text"), F.lit(AFTER))


def scalar(name: str, make: Callable[[Column], Column], sql: str | None, plain: bool = False) -> None:
    """A function of one text, over all documents; in sql, {t} is the text."""
    register(name, sql and f"SELECT doc_id, {sql.replace('{t}', 'text' if plain else 't')} AS value FROM (SELECT doc_id, text, {MESSY_SQL} AS t FROM documents)")(lambda spark, d: read(spark, d, "documents").select("doc_id", make(F.col("text") if plain else messy()).alias("value")))


def rx(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def strip_sql(text: str) -> str:
    return rx(text, f"^[{SPACE}]+|[{SPACE}]+$")


def ligatures_sql(text: str) -> str:
    for a, b in X.LIGATURES.items():
        text = f"replace({text}, '{a}', '{b}')"
    return text


ARABIC_SQL = "translate({t}, 'أإآٱىئـ', 'اااايي')"
CLEAN_SQL = strip_sql(rx(rx(rx(rx(rx(ARABIC_SQL.replace("{t}", rx(ligatures_sql("nfc_normalize({t})"), X.BIDI_MARKS)), X.ARABIC_DIACRITICS), "-\\n([\\p{L}\\p{N}_])", "\\1"), X.CONTROLS), "[ \\t]+", " "), "\\n{3,}", "\n\n"))
RATIO_SQL = f"(CASE WHEN {n_of('{t}', f'[\\p{{L}}{X.ARABIC_SCRIPT}]')} > 0 THEN {n_of('{t}', f'[{X.ARABIC_SCRIPT}]')}::DOUBLE / {n_of('{t}', f'[\\p{{L}}{X.ARABIC_SCRIPT}]')} ELSE 0.0 END)"
TOKENS, WORDS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]", r"[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*"
COUNT_SQL = f"(CASE WHEN {n_of('{t}', r'\p{L}')} > 0 AND {n_of('{t}', f'[{X.ARABIC_CHUNK}]')} >= 0.3 * {n_of('{t}', r'\p{L}')} THEN greatest({n_of('{t}', TOKENS)}, round_even(1.35 * {n_of('{t}', WORDS)}, 0)::INT) ELSE {n_of('{t}', TOKENS)} END)"
NORMAL_SQL = strip_sql(rx("{t}", f"[{SPACE}]+", " "))
MATCH_SQL = "list_distinct(list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z0-9_]+|[\\x{0600}-\\x{06FF}]+'), lambda x: lower(x)), lambda x: length(x) > 1))"
HITS = " + ".join
LANG = {k: "(" + HITS(f"(length(s) - length(replace(s, '{m}', ''))) // 3" for m in v) + ")" for k, v in X.LANGUAGE_MARKS.items()}

scalar("c1_repair_mojibake", lambda t: X.repair_mojibake(F.concat(t, F.lit(" cafÃ©"))), "text || CASE WHEN regexp_matches(text, '^[\\x00-\\x7f]*$') THEN ' café' ELSE ' cafÃ©' END", plain=True)
scalar("c2_nfc", X.nfc, "nfc_normalize({t})")
scalar("c3_expand_ligatures", X.expand_ligatures, ligatures_sql("{t}"))
scalar("c4_strip_bidi_marks", X.strip_bidi_marks, rx("{t}", X.BIDI_MARKS))
scalar("c5_normalize_arabic", X.normalize_arabic, ARABIC_SQL)
scalar("c6_strip_arabic_diacritics", X.strip_arabic_diacritics, rx("{t}", X.ARABIC_DIACRITICS))
scalar("c7_unwrap_hyphens", X.unwrap_hyphens, rx("{t}", "-\\n([\\p{L}\\p{N}_])", "\\1"))
scalar("c8_strip_controls", X.strip_controls, rx("{t}", X.CONTROLS))
scalar("c9_collapse_space", lambda t: X.strip(X.collapse_blank_lines(X.collapse_spaces(t))), strip_sql(rx(rx("{t}", "[ \\t]+", " "), "\\n{3,}", "\n\n")))
scalar("c10_clean_text", X.clean_text, CLEAN_SQL)
scalar("c11_arabic_ratio", lambda t: F.round(X.arabic_ratio(t), 9), f"round({RATIO_SQL}, 9)")
scalar("c11_is_arabic", X.is_arabic, f"{RATIO_SQL} >= 0.3")
register("c12_detect_lang", f"SELECT doc_id, CASE WHEN length(text) < 50 THEN 'en' WHEN en >= fr AND en >= de AND en >= es THEN 'en' WHEN fr >= de AND fr >= es THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS value FROM (SELECT doc_id, text, {', '.join(f'{v} AS {k}' for k, v in LANG.items())} FROM (SELECT doc_id, text, lower(substr(text, 1, 2000)) AS s FROM documents))")(lambda spark, d: read(spark, d, "documents").select("doc_id", X.detect_lang(F.col("text")).alias("value")))
scalar("c13_char_count", X.char_count, "length({t})")
scalar("c13_word_count", X.word_count, n_of("{t}", f"[^{SPACE}]+"))
scalar("c15_approx_token_count", X.approx_token_count, COUNT_SQL)
scalar("c16_chunk_content_hash", X.chunk_content_hash, f"sha256({NORMAL_SQL})")
scalar("c18_normalize_query", X.normalize_query, strip_sql(rx(f"translate({rx(strip_sql('{t}'), X.QUERY_DIACRITICS)}, '{X.QUERY_FROM}', '{X.QUERY_TO}')", f"[{SPACE}]+", " ")))
scalar("c19_match_tokens", lambda t: F.array_join(F.array_sort(X.match_tokens(t)), " "), f"array_to_string(list_sort({MATCH_SQL}), ' ')")
scalar("c20_informative_tokens", lambda t: F.array_join(F.array_sort(X.informative_tokens(X.match_tokens(t))), " "), f"array_to_string(list_sort(list_filter({MATCH_SQL}, lambda x: length(x) >= 4)), ' ')")
scalar("c23_numbers", lambda t: F.array_join(F.array_sort(X.numbers(t)), " "), "array_to_string(list_sort(list_distinct(regexp_extract_all({t}, '[0-9]+(?:[.,][0-9]+)?'))), ' ')")
scalar("c24_digit_ratio", lambda t: F.round(X.digit_ratio(t), 9), f"round({n_of('{t}', '\\p{Nd}')}::DOUBLE / greatest(length({{t}}), 1), 9)")
scalar("c25_detect_query_language", X.detect_query_language, "CASE WHEN regexp_matches({t}, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'en' END")
#: An answer that abstains, with as many full stops as the text's length leaves, before every second text; the others are answers as they are.
scalar(
    "c26_answer_is_idk",
    lambda t: X.answer_is_idk(F.when(F.length(t) % 2 == 0, F.concat(F.lit(" I  Don't know"), F.repeat(F.lit("."), F.length(t) % 3), F.when(F.length(t) % 5 == 0, t).otherwise("\n"))).otherwise(t)),
    rx(strip_sql(rx("lower(CASE WHEN length({t}) % 2 = 0 THEN ' I  Don''t know' || repeat('.', length({t}) % 3) || CASE WHEN length({t}) % 5 = 0 THEN {t} ELSE chr(10) END ELSE {t} END)", f"[{SPACE}]+", " ")), "\\.+$") + " = 'i don''t know'",
    plain=True,
)
scalar("c30_is_scanned_page", X.is_scanned_page, f"length({strip_sql('{t}')}) < 50", plain=True)


# --- identity, pages, scores ---

RAW_SQL = "(SELECT doc_id AS id, source || '/' || doc_id AS source_path, 'txt' AS file_type, 0 AS page_num, coalesce(text, '') AS raw_text, sha256(coalesce(text, '')) AS content_hash, sha256(coalesce(text, '')) AS file_hash, sha256(sha256(coalesce(text, '')) || '::0') AS doc_id FROM documents)"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_documents_table(read(spark, d, "documents"))


register("s5_read_documents_table", f"SELECT * FROM {RAW_SQL}")(raw)
register("c14_doc_identity", f"SELECT id, file_hash, doc_id, sha256(doc_id || '::v1::paragraph::0') AS chunk_id FROM {RAW_SQL}")(lambda spark, d: raw(spark, d).select("id", "file_hash", "doc_id", X.chunk_identity(F.col("doc_id"), "paragraph", F.lit(0)).alias("chunk_id")))
register("c17_page_label", "SELECT conv_id, turn, CASE WHEN turn - 1 >= 0 THEN turn ELSE -1 END AS display_page, CASE WHEN role = 'user' THEN role WHEN turn - 1 >= 0 THEN turn::VARCHAR ELSE '' END AS label FROM conversations")(lambda spark, d: read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(X.display_page(F.col("turn") - 1), F.lit(-1)).alias("display_page"), X.page_label(F.when(F.col("role") == "user", F.col("role")).otherwise(""), F.col("turn") - 1).alias("label")))


def paired(spark: SparkSession, d: str) -> DataFrame:
    """Every document with one item of the benchmark: doc_id, text, item_id, query."""
    items = read(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    number = F.col("doc_id") % F.lit(items.count())
    return read(spark, d, "documents").select("doc_id", "text", number.alias("item_id")).hint("merge").join(items, "item_id")


PAIRED_SQL = "(SELECT d.doc_id, d.text, b.item_id, b.text AS query FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"
register(
    "c21_shares_script",
    f"SELECT doc_id, item_id, regexp_matches(text, '[A-Za-z]') AND regexp_matches(query, '[A-Za-z]') OR regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') AND regexp_matches(query, '[\\x{{0600}}-\\x{{06FF}}]') AS shares FROM {PAIRED_SQL}",
)(lambda spark, d: paired(spark, d).select("doc_id", "item_id", X.shares_script(F.col("text"), F.col("query")).alias("shares")))
BIGRAM_SQL = "list_filter(list_transform(regexp_extract_all(query, '[A-Za-z0-9_]+|[\\x{0600}-\\x{06FF}]+'), lambda x: lower(x)), lambda x: length(x) >= 3)"
register(
    "c22_count_bigrams",
    f"SELECT doc_id, len(list_filter(range(1, len(ws)), lambda i: (length(ws[i]) >= 4 OR length(ws[i + 1]) >= 4) AND contains(lower(text), ws[i] || ' ' || ws[i + 1]))) AS bigrams FROM (SELECT doc_id, text, {BIGRAM_SQL} AS ws FROM {PAIRED_SQL})",
)(lambda spark, d: paired(spark, d).select("doc_id", retrieval.count_bigrams(F.col("query"), F.col("text")).alias("bigrams")))
register("c27_derive_chunk_score", f"SELECT doc_id, CASE WHEN n <= 0 THEN 0.0 ELSE round(least(greatest(n / 250.0, 0.1), 0.99)::DOUBLE, 4) END AS score FROM (SELECT doc_id, {COUNT_SQL.replace('{t}', 'text')} AS n FROM documents)")(lambda spark, d: read(spark, d, "documents").select("doc_id", X.derive_chunk_score(X.approx_token_count(F.col("text"))).alias("score")))


# --- loose records ---


def record(**fields: Column) -> Column:
    """A record with these text fields; a field that is null is not there."""
    named = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(v.cast("string") for v in fields.values())))
    return F.map_filter(named, lambda _, v: v.isNotNull())


def normalized(name: str, kind: str, table: str, key: str, sql: str, make: Callable[[], tuple[Column, Column | None]], shown: dict[str, str]) -> None:
    """A query of records made from the rows of a table; shown: field of the result to column."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        one = normalizers.normalize(kind, *make(), F.col(key))
        return read(spark, d, table).select(key, one.alias("r")).select(key, *(F.col(f"r.{k}").alias(v) for k, v in shown.items()))

    register(name, sql)(run)


def job_record() -> tuple[Column, None]:
    word = F.create_map(*map(F.lit, ("error", "FAILED", "purchase", "Indexed", "click", "processing")))
    return record(mime_type=F.col("event_type"), status=F.coalesce(F.try_element_at(word, "event_type"), F.lit("odd")), chunks_created=F.get_json_object("props", "$.k")), None


register("c28_normalize_job", "SELECT event_id, coalesce(nullif(trim(event_type), ''), 'unknown') AS kind, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'indexed' WHEN 'click' THEN 'processing' ELSE 'queued' END AS status, coalesce(try_cast(regexp_extract(props, '[0-9]+') AS BIGINT), 0) AS chunks FROM events")(
    lambda spark, d: read(spark, d, "events").select("event_id", normalizers.normalize("job", *job_record()).alias("r")).select("event_id", F.col("r.file_type").alias("kind"), "r.status", F.coalesce("r.chunks_created", F.lit(0)).cast("long").alias("chunks"))
)
normalized(
    "c28_normalize_document",
    "document",
    "documents",
    "doc_id",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || doc_id ELSE 'd' || doc_id END AS id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Unknown document' END AS name, lang AS type, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE n_chars END::DOUBLE AS size, n_chars::DOUBLE AS chunks FROM documents",
    lambda: (
        record(
            doc_id=F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))),
            file_name=F.lit("  "),
            name=F.when(F.col("doc_id") % 2 == 0, F.col("source")),
            type=F.col("lang"),
            file_size=F.when(F.col("doc_id") % 5 == 0, "large"),
            size=F.col("n_chars"),
            total_chunks=F.col("n_chars"),
        ),
        None,
    ),
    {"id": "id", "file_name": "name", "file_type": "type", "file_size": "size", "chunk_count": "chunks"},
)
normalized(
    "c28_normalize_chunk",
    "chunk",
    "documents",
    "doc_id",
    "SELECT doc_id, 'c' || doc_id AS id, text, n_chars::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Unknown source' END AS source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 END::DOUBLE AS page FROM documents",
    lambda: (
        record(content=F.col("text"), similarity=F.col("n_chars"), page_num=F.when(F.col("doc_id") % 4 == 0, "ix")),
        record(chunk_id=F.concat(F.lit("c"), F.col("doc_id").cast("string")), source_path=F.when(F.col("doc_id") % 2 == 0, F.col("source")), page=F.col("doc_id") % 9),
    ),
    {"id": "id", "text": "text", "score": "score", "source": "source", "page_number": "page"},
)
normalized(
    "c28_normalize_answer",
    "answer",
    "conversations",
    "turn",
    "SELECT turn, 'answer-' || turn AS id, CASE WHEN role = 'user' THEN text ELSE '' END AS question, CASE WHEN role = 'user' THEN '' ELSE text END AS answer, length(text)::DOUBLE AS tokens FROM conversations",
    lambda: (record(query=F.when(F.col("role") == "user", F.col("text")), answer=F.when(F.col("role") != "user", F.col("text")), tokens_used=F.length("text")), None),
    {"id": "id", "question": "question", "answer": "answer", "tokens_used": "tokens"},
)
normalized(
    "c28_normalize_stats",
    "stats",
    "documents",
    "doc_id",
    "SELECT doc_id, n_chars::DOUBLE AS documents, 0.0::DOUBLE AS chunks, CASE WHEN lang = 'en' THEN 'healthy' ELSE 'offline' END AS health FROM documents",
    lambda: (record(documents_count=F.col("n_chars"), total_chunks=F.lit("many"), retrieval_health=F.when(F.col("lang") == "en", "healthy").otherwise("odd")), None),
    {"total_documents": "documents", "total_chunks": "chunks", "retrieval_health": "health"},
)
normalized(
    "c28_normalize_activity",
    "activity",
    "events",
    "event_id",
    "SELECT event_id, 'activity-' || event_id AS id, CASE event_type WHEN 'error' THEN 'error' ELSE 'query' END AS type, CASE WHEN event_id % 2 = 0 THEN props ELSE 'Activity event' END AS description FROM events",
    lambda: (record(type=F.col("event_type"), title=F.when(F.col("event_id") % 2 == 0, F.col("props"))), None),
    {"id": "id", "type": "type", "description": "description"},
)


# --- sources ---


def as_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files; every fifth has another extension."""
    ext = F.element_at(F.array(*map(F.lit, ("txt", "HTML", "bin", "json", "md"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), ext)).alias("path"), sources.file_fingerprint(F.col("text").cast("binary")).alias("file_hash"))


FILES_SQL = "(SELECT doc_id, source || '/' || doc_id || '.' || ['txt', 'HTML', 'bin', 'json', 'md'][(doc_id % 5 + 1)::INT] AS path, sha256(text) AS file_hash FROM documents)"
register("s2_file_fingerprint", f"SELECT doc_id, file_hash FROM {FILES_SQL}")(lambda spark, d: as_files(spark, d).select("doc_id", "file_hash"))
register("s3_route_by_extension", f"SELECT doc_id, reader, reader IS NULL AS skipped FROM (SELECT doc_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'html' THEN 'html' WHEN 'json' THEN 'json' END AS reader FROM {FILES_SQL})")(lambda spark, d: sources.route_by_extension(as_files(spark, d)).select("doc_id", "reader", "skipped"))
register("s4_dedup_files", f"SELECT doc_id, path FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY lower(path), path) AS n FROM {FILES_SQL}) WHERE n = 1")(lambda spark, d: sources.dedup_files(as_files(spark, d)).select("doc_id", "path"))
register("s7_read_jsonl_tolerant", "SELECT regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events WHERE event_id % 3 = 0")(lambda spark, d: sources.tolerant_json(read(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[1, "), "props")).otherwise("  ").alias("line")), "line", "k long"))
POINTS_NEW = "SELECT vec_id + 100 AS vec_id, label + 10 AS label FROM embeddings WHERE vec_id % 3 = 0"


def points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", "label")


register("s11_upsert_vectors", f"WITH n AS ({POINTS_NEW}) SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n) UNION ALL SELECT * FROM n")(lambda spark, d: tables.upsert(points(spark, d), points(spark, d).filter("vec_id % 3 = 0").select((F.col("vec_id") + 100).alias("vec_id"), (F.col("label") + 10).alias("label")), ["vec_id"]))
register("s12_delete_points", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT conv_id FROM conversations)")(lambda spark, d: tables.delete_keys(points(spark, d), read(spark, d, "conversations").select(F.col("conv_id").alias("vec_id")), ["vec_id"]))
register("s13_existing_ids", "SELECT DISTINCT conv_id AS vec_id FROM conversations WHERE conv_id IN (SELECT vec_id FROM embeddings)")(lambda spark, d: tables.existing_ids(points(spark, d), read(spark, d, "conversations").select(F.col("conv_id").alias("vec_id")), "vec_id"))
register("s15_embedding_cache", "SELECT chunk_content_hash, c.content_hash IS NOT NULL AS cached FROM (SELECT DISTINCT sha256(text) AS chunk_content_hash FROM documents) h LEFT JOIN (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0) c ON c.content_hash = h.chunk_content_hash")(lambda spark, d: tables.resolve_vectors(read(spark, d, "documents").select(F.sha2("text", 256).alias("chunk_content_hash")), read(spark, d, "documents").filter("doc_id % 2 = 0").select(F.lit("m").alias("model_key"), F.sha2("text", 256).alias("content_hash")), "m"))
register("s13_list_ids", "SELECT vec_id FROM embeddings WHERE label IN (1, 2, 3)")(lambda spark, d: tables.list_ids(points(spark, d), {"label": [1, 2, 3]}, "vec_id"))
register("s13_points_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT conv_id FROM conversations)")(lambda spark, d: tables.points_by_ids(points(spark, d), read(spark, d, "conversations").select(F.col("conv_id").alias("vec_id")), "vec_id"))


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("file_hash"))


register("s16_manifest_by_file", "SELECT source, count(*) AS chunks, count(DISTINCT sha256(text)) AS files FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0) GROUP BY source")(
    lambda spark, d: tables.manifest_by_files(file_rows(spark, d), file_rows(spark, d).filter("doc_id % 7 = 0")).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_hash").alias("files"))
)
register("s16_replace_manifest", "WITH n AS (SELECT doc_id + 1000000000 AS doc_id, 'new' AS source, sha256(text) AS file_hash FROM documents WHERE doc_id % 7 = 0) SELECT doc_id, source, sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT file_hash FROM n) UNION ALL SELECT * FROM n")(
    lambda spark, d: tables.replace_manifest(file_rows(spark, d), file_rows(spark, d).filter("doc_id % 7 = 0").withColumns({"doc_id": F.col("doc_id") + 1000000000, "source": F.lit("new")}))
)


def log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "ts", "event_type")


register("s17_append_activity", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")(lambda spark, d: tables.append_activity(log(spark, d).filter("event_id % 3 > 0"), log(spark, d).filter("event_id % 3 = 0")))


def saved_jobs(spark: SparkSession, d: str, low: int, high: int) -> DataFrame:
    """The events of some users as saves of jobs, one job a user."""
    rows = read(spark, d, "events").filter(F.col("user_id") % 10 < high).filter(F.col("user_id") % 10 >= low)
    return rows.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), F.struct("ts", "event_id").alias("updated_at"))


def job_table(spark: SparkSession, d: str) -> DataFrame:
    """Users 0 to 5 (modulo 10) are there with their first event, then all events of 3 to 9 are saved."""
    first = tables.first_by_key(saved_jobs(spark, d, 0, 6), "id", F.col("updated_at"))
    return tables.save_jobs(first, saved_jobs(spark, d, 3, 10)).select("id", "status", "created_at")


JOBS_SQL = "(SELECT user_id::VARCHAR AS id, CASE WHEN user_id % 10 < 3 THEN arg_min(event_type, (ts, event_id)) ELSE arg_max(event_type, (ts, event_id)) END AS status, CASE WHEN user_id % 10 < 6 THEN min(ts) ELSE arg_max(ts, (ts, event_id)) END AS created_at FROM events GROUP BY user_id)"
register("s18_save_jobs", f"SELECT * FROM {JOBS_SQL}")(job_table)
register("s18_delete_job", f"SELECT * FROM {JOBS_SQL} WHERE id <> '3'")(lambda spark, d: tables.delete_job(job_table(spark, d), "3"))
register("s18_get_job", f"SELECT * FROM {JOBS_SQL} WHERE id = '3'")(lambda spark, d: tables.get_job(job_table(spark, d), "3"))
register("s18_list_jobs", f"SELECT * FROM {JOBS_SQL} ORDER BY created_at DESC, id DESC LIMIT 200")(lambda spark, d: tables.list_jobs(job_table(spark, d)))
register("a13_job_counts", "SELECT count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS active, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events")(
    lambda spark, d: aggregates.job_counts(read(spark, d, "events").select(F.when(F.col("event_type") == "purchase", "indexed").when(F.col("event_type") == "error", "failed").otherwise("queued").alias("status")))
)
register("s17_list_activities", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")(lambda spark, d: tables.recent(read(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id"))
register("s18_latest_jobs", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")(lambda spark, d: tables.latest_by_key(read(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.struct("ts", "event_id")).drop("ts"))
CASES_SQL = "(SELECT 'case-' || item_id AS id, item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN ['src' || (item_id % 20)] ELSE [] END AS src, [substr(text, 1, 40)] AS ev, CASE WHEN item_id % 5 = 0 THEN ['src3/'] ELSE [] END AS bad FROM benchmark)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    item = F.col("item_id")
    given = read(spark, d, "benchmark").select(F.concat(F.lit("case-"), item.cast("string")).alias("id"), item, F.col("text").alias("query"), F.when(item % 2 == 0, F.array(F.concat(F.lit("src"), (item % 20).cast("string")))).alias("expected_source_contains"), F.array(F.substring("text", 1, 40)).alias("expected_chunk_contains"), F.lit(None).cast("array<string>").alias("expected_answer_keywords"), F.when(item % 5 == 0, F.array(F.lit("src3/"))).alias("forbidden_source_contains"), F.lit(None).cast("int").alias("top_k"), F.lit(None).cast("string").alias("prompt_version"))
    return sources.with_case_defaults(given)


register("s19_eval_cases", f"SELECT id, len(src) AS sources, len(bad) AS forbidden, 5 AS top_k, 'strict' AS prompt_version FROM {CASES_SQL}")(lambda spark, d: cases(spark, d).select("id", F.size("expected_source_contains").alias("sources"), F.size("forbidden_source_contains").alias("forbidden"), "top_k", "prompt_version"))


# --- filters ---


def clean(spark: SparkSession, d: str) -> DataFrame:
    return sources.clean_documents(raw(spark, d))


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Clean documents written as JSON lines and read back."""
    path = streams.shared_path(spark, "clean")
    sources.save_documents(clean(spark, d).withColumn("metadata", record(file_hash=F.col("file_hash"))), path)
    return sources.load_documents(spark, path)


CLEAN_DOCS = f"(SELECT id, doc_id, source_path, file_type, page_num, file_hash, t AS clean_text, {n_of('t', f'[^{SPACE}]+')} AS word_count, {COUNT_SQL.replace('{t}', 't')} AS token_count, {n_of('t', r'\p{L}')} AS letters FROM (SELECT *, {CLEAN_SQL.replace('{t}', 'raw_text')} AS t FROM {RAW_SQL}))"
register("f1_drop_near_empty", f"SELECT id, word_count FROM {CLEAN_DOCS} WHERE word_count >= 12")(lambda spark, d: sources.drop_near_empty(clean(spark, d)).select("id", "word_count"))
register("f2_informative_chunks", f"SELECT id FROM {CLEAN_DOCS} WHERE token_count >= 12 AND letters >= 20")(lambda spark, d: chunking.informative(clean(spark, d).withColumn("text", F.col("clean_text")).withColumn("token_count", X.approx_token_count(F.col("text")))).select("id"))
register("f3_metadata_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')")(lambda spark, d: read(spark, d, "documents").filter(tables.metadata_filter({"lang": "en", "source": ["src1", "src2", "src3"], "n_chars": None, "text": []})).select("doc_id"))
register("f5_inspect_chunks", f"SELECT doc_id, score, count(*) OVER () AS total FROM (SELECT doc_id, source, lang, round(least(greatest(n / 250.0, 0.1), 0.99)::DOUBLE, 4) AS score FROM (SELECT *, {COUNT_SQL.replace('{t}', 'text')} AS n FROM documents)) WHERE contains(lower(source), 'src1') AND lang IN ('en', 'fr') AND score BETWEEN 0.3 AND 0.9")(
    lambda spark, d: tables.inspect_chunks(read(spark, d, "documents").select("doc_id", F.col("source").alias("source_path"), F.col("lang").alias("file_type"), X.derive_chunk_score(X.approx_token_count(F.col("text"))).alias("score")), "SRC1", ["en", "fr"], 0.3, 0.9).select("doc_id", "score", "total")
)
register("a13_average_score", f"SELECT coalesce(round(avg(score) * 100), 0)::BIGINT AS average_score FROM ({SQL['c27_derive_chunk_score']})")(
    lambda spark, d: aggregates.average_score_percent(read(spark, d, "documents").select(X.derive_chunk_score(X.approx_token_count(F.col("text"))).alias("score")))
)
register("s10_load_documents", f"SELECT doc_id, source_path, page_num, length(t) AS char_count, word_count, md5(t) AS digest FROM (SELECT *, clean_text AS t FROM {CLEAN_DOCS})")(
    lambda spark, d: round_trip(spark, d).select("doc_id", "source_path", "page_num", "char_count", "word_count", F.md5("clean_text").alias("digest"))
)


# --- chunks ---

PARAGRAPHS_SQL = f"list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: {strip_sql('x')}), lambda x: length(x) > 0)"
register("k1_split_paragraphs", f"SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {PARAGRAPHS_SQL} AS p FROM documents)")(lambda spark, d: read(spark, d, "documents").select("doc_id", chunking.split_paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("paragraphs"), F.md5(F.array_join("p", "|")).alias("digest")))
register("k2_split_sentences")(lambda spark, d: read(spark, d, "documents").select("doc_id", chunking.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest")))
register("k3_split_oversized")(lambda spark, d: read(spark, d, "documents").select("doc_id", chunking.units_of(F.col("text"), 40).alias("u")).select("doc_id", F.size("u").alias("units"), F.md5(F.array_join("u", "|")).alias("digest")))
register("k4_sentence_windows")(lambda spark, d: read(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentence_windows(F.col("text"), 140, 1)).alias("chunk_index", "text")))
register("k5_paragraph_chunks")(lambda spark, d: read(spark, d, "documents").select("doc_id", F.posexplode(chunking.paragraph_chunks(F.col("text"), 260, 1)).alias("chunk_index", "text")))
register("k6_merge_tiny")(lambda spark, d: read(spark, d, "documents").select("doc_id", F.explode(chunking.merge_tiny(chunking.split_paragraphs(F.col("text")))).alias("c")).select("doc_id", "c.index", "c.text"))
CHUNK_COLUMNS = ("chunk_id", "source_doc_id", "source_path", "chunk_index", "token_count", "chunk_content_hash", "detected_lang", "page_label", "ingestion_id", "document_group_id", "text")
register("k7_chunk_documents")(lambda spark, d: ingest.chunks_of(read(spark, d, "documents")).select(*CHUNK_COLUMNS))
register("k8_chunk_metadata", f"SELECT id, sha256(doc_id || '::v1::whole::0') AS chunk_id, sha256({NORMAL_SQL.replace('{t}', 'raw_text')}) AS chunk_content_hash, page_num + 1 AS display_page_num, (page_num + 1)::VARCHAR AS page_label FROM {RAW_SQL}")(lambda spark, d: chunking.chunk_metadata(raw(spark, d).select("id", "page_num", X.chunk_identity(F.col("doc_id"), "whole", F.lit(0)).alias("chunk_id"), X.chunk_content_hash(F.col("raw_text")).alias("chunk_content_hash"))).drop("page_num"))
register("k9_stamp_lineage", "SELECT doc_id AS source_doc_id, CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'run-9' END AS ingestion_id, 'now' AS ingested_at, 'now' AS first_ingested_at, 'now' AS last_ingested_at, doc_id AS document_group_id FROM documents")(lambda spark, d: chunking.stamp_lineage(read(spark, d, "documents").select(F.col("doc_id").alias("source_doc_id"), F.when(F.col("doc_id") % 2 == 0, "old").alias("ingestion_id")), "run-9", "now"))
register("k10_merge_short_sections")(lambda spark, d: html.extract_sections(read(spark, d, "pages")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("section_no", F.col("title").alias("heading"), "text"))).alias("s")).select("page_id", F.posexplode(chunking.merge_short_sections(F.col("s"), 200)).alias("section_no", "m")).select("page_id", "section_no", "m.heading", "m.text"))


# --- joins and diffs ---


def manifest(spark: SparkSession, d: str, current: bool) -> DataFrame:
    rows = read(spark, d, "documents").filter(F.col("doc_id") % 10 != (1 if current else 0))
    meta = F.map_from_arrays(F.array(F.lit("ingested_at"), F.lit("lang"), F.lit("a")), F.array(F.lit("now" if current else "then"), F.col("lang"), F.col("source")))
    text = F.when(F.lit(current) & (F.col("doc_id") % 10 == 2), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return rows.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), F.sha2(text, 256).alias("chunk_content_hash"), tables.stable_metadata(meta).alias("metadata_json"))


register("j1_manifest_diff", "SELECT sha256(doc_id::VARCHAR) AS chunk_id, CASE doc_id % 10 WHEN 1 THEN 'stale' WHEN 0 THEN 'new' WHEN 2 THEN 'changed' ELSE 'unchanged' END AS status FROM documents")(lambda spark, d: tables.manifest_diff(manifest(spark, d, False), manifest(spark, d, True)))
register("i2_stable_metadata", "SELECT doc_id, '{\"a\":\"' || source || '\",\"lang\":\"' || lang || '\"}' AS metadata_json FROM documents WHERE doc_id % 10 <> 1")(lambda spark, d: manifest(spark, d, True).select("doc_id", "metadata_json"))
register("u1_stale_ids", "SELECT sha256(doc_id::VARCHAR) AS chunk_id FROM documents WHERE doc_id % 10 = 1")(lambda spark, d: manifest(spark, d, False).select("chunk_id").join(manifest(spark, d, True).select("chunk_id"), "chunk_id", "left_anti"))
register("j2_resolve_vectors", "WITH c AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT count(*) FILTER (n.h IS NULL) AS misses, count(*) FILTER (n.h IS NOT NULL) AS hits FROM c LEFT JOIN n USING (h)")(lambda spark, d: tables.resolve_vectors(read(spark, d, "documents").filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("chunk_content_hash")), read(spark, d, "documents").filter("doc_id % 3 = 0").select(F.lit("m").alias("model_key"), F.sha2("text", 256).alias("content_hash")), "m").agg(F.count_if(~F.col("cached")).alias("misses"), F.count_if("cached").alias("hits")))
register("a14_index_report", "SELECT count(*) FILTER (doc_id % 10 IN (0, 2)) AS new_or_changed, count(*) FILTER (doc_id % 10 > 2) AS unchanged, count(*) FILTER (doc_id % 10 = 1) AS deleted FROM documents")(lambda spark, d: tables.manifest_diff(manifest(spark, d, False), manifest(spark, d, True)).agg(F.count_if(F.col("status").isin("new", "changed")).alias("new_or_changed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"), F.count_if(F.col("status") == "stale").alias("deleted")))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    every = read(spark, d, "embeddings")
    return every.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), every.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


PAIRS_SQL = "(SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.label, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0)"
TOPK_SQL = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {PAIRS_SQL})"
register("j3_vector_score", f"SELECT query_id, count(*) AS pairs, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM {PAIRS_SQL} GROUP BY query_id")(
    lambda spark, d: retrieval.vector_score(*vectors(spark, d)).withColumns({c: F.round(c, 6) for c in ("best", "mean")})
)
register("r1_vector_topk", f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM {TOPK_SQL} WHERE rank <= 15")(lambda spark, d: retrieval.vector_topk(*vectors(spark, d), 15).withColumn("score", F.round("score", 6)))
register("f4_min_score", f"SELECT query_id, chunk_id FROM {TOPK_SQL} WHERE rank <= 15 AND score >= 0.2")(lambda spark, d: retrieval.vector_topk(*vectors(spark, d), 15).filter(F.col("score").isNull() | (F.col("score") >= 0.2)).select("query_id", "chunk_id"))
CAPPED = "(SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM " + TOPK_SQL + " WHERE rank <= 15)"


def capped(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.vector_topk(*vectors(spark, d), 15).hint("merge").join(points(spark, d).withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    hits = hits.select("query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.sha2(F.col("chunk_id").cast("string"), 256).alias("chunk_content_hash"), F.col("label").cast("string").alias("document_group_id"), "score")
    return retrieval.post_process(hits, 5, min_score=None).select("query_id", "rank", "chunk_id", "document_group_id")


register("r2_post_process", f"SELECT query_id, place AS rank, chunk_id::VARCHAR AS chunk_id, label::VARCHAR AS document_group_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM {CAPPED} WHERE n <= 3) WHERE place <= 5")(capped)


def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """From a table in cells: of the points with one of four labels the five best after post-processing, out of fifteen."""
    every = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    named = every.select("chunk_id", F.sha2(F.col("chunk_id").cast("string"), 256).alias("chunk_content_hash"), F.col("label").cast("string").alias("document_group_id"))
    found = retrieval.search(vectors(spark, d)[0], VectorTable.build(every, cells=16), named, 5, {"label": [1, 2, 3, 4], "none": None}, min_score=None)
    return found.select("query_id", "rank", "chunk_id", "document_group_id")


register(
    "r1_filtered_search",
    f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {PAIRS_SQL} WHERE label IN (1, 2, 3, 4)), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM t WHERE rank <= 15) SELECT query_id, place AS rank, chunk_id::VARCHAR AS chunk_id, label::VARCHAR AS document_group_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c WHERE n <= 3) WHERE place <= 5",
)(filtered_search)


def docs_as_chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.sha2("text", 256).alias("chunk_content_hash"), F.col("source").alias("document_group_id"))


def bench(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple[str, str], Postings] = {}


def index_of(spark: SparkSession, d: str) -> Postings:
    """The stored index of the words of the documents: written by the first query of a session that searches them, read by the others."""
    key = (spark.sparkContext.applicationId, d)
    spot, store = spot_of(spark, f"{_INDEXES[key].folder}/words") if key in _INDEXES else (None, None)
    if spot is None or not store.exists(spot):
        _INDEXES[key] = Postings.build(docs_as_chunks(spark, d).select("chunk_id", "text"))
    return _INDEXES[key]


def bench_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bench(spark, d).withColumn("tokens", X.match_tokens(F.col("query")))


TOK_SQL = f"q AS (SELECT item_id AS query_id, lower(text) AS asked, {MATCH_SQL.replace('{t}', 'text')} AS qt FROM benchmark), c AS (SELECT doc_id AS chunk_id, text, {MATCH_SQL.replace('{t}', 'text')} AS ct FROM documents), o AS (SELECT query_id, chunk_id, asked, text, len(qt) AS size, len(list_intersect(qt, ct)) AS overlap FROM q, c)"
register("j4_token_overlap", f"WITH {TOK_SQL} SELECT query_id, chunk_id, overlap, size FROM o WHERE overlap >= 2")(lambda spark, d: retrieval.token_overlap(bench_tokens(spark, d), index_of(spark, d), retrieval.LEXICAL_OVERLAP))
LEXICAL = "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, least(0.9, 0.42 + overlap::DOUBLE / size * 0.36 + CASE WHEN phrase THEN 0.1 ELSE 0.0 END) AS score FROM (SELECT *, contains(lower(text), asked) AS phrase FROM o WHERE overlap >= 2) WHERE phrase OR overlap::DOUBLE / size >= 0.55) WHERE score >= 0.72)"
register("r6_lexical_search", f"WITH {TOK_SQL} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM {LEXICAL} WHERE rank <= 15")(lambda spark, d: retrieval.lexical_search(bench(spark, d), docs_as_chunks(spark, d), 15, index_of(spark, d)).withColumn("score", F.round("score", 6)))
register("u2_token_intersection", f"SELECT doc_id, len(list_intersect({MATCH_SQL.replace('{t}', 'text')}, {MATCH_SQL.replace('{t}', 'query')})) AS shared FROM {PAIRED_SQL}")(
    lambda spark, d: paired(spark, d).select("doc_id", F.size(F.array_intersect(X.match_tokens(F.col("text")), X.match_tokens(F.col("query")))).alias("shared"))
)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """The lexical hits of the benchmark, with texts, as candidates of a rerank."""
    hits = retrieval.lexical_search(bench(spark, d), docs_as_chunks(spark, d), 15, index_of(spark, d)).select("query_id", "chunk_id", "score")
    return retrieval.with_chunks(hits, docs_as_chunks(spark, d))


CANDS = f"WITH {TOK_SQL}, h AS (SELECT query_id, chunk_id, score FROM {LEXICAL} WHERE rank <= 15), k AS (SELECT h.query_id, h.chunk_id, h.score, qt, ct, asked, c.text FROM h JOIN q USING (query_id) JOIN c USING (chunk_id)), f AS (SELECT query_id, t, count(*) AS df FROM (SELECT query_id, unnest(ct) AS t FROM k) GROUP BY query_id, t)"
WEIGHTED = "g AS (SELECT x.query_id, x.chunk_id, sum(w) FILTER (list_contains(ct, t)) / greatest(sum(w), 1e-9) AS weighted FROM (SELECT k.query_id, k.chunk_id, k.ct, u.t, 1.0 / coalesce(f.df, 1) AS w FROM k, (SELECT query_id AS qid, unnest(qt) AS t FROM q) u LEFT JOIN f ON f.query_id = u.qid AND f.t = u.t WHERE u.qid = k.query_id) x GROUP BY 1, 2)"
register("a10_token_frequency", f"{CANDS} SELECT query_id, t AS token, df FROM f")(lambda spark, d: retrieval.token_frequency(candidates(spark, d).withColumn("tokens", X.match_tokens(F.col("text")))))
register("a11_weighted_coverage", f"{CANDS}, {WEIGHTED} SELECT query_id, chunk_id, round(coalesce(weighted, 0), 6) AS weighted FROM g")(lambda spark, d: retrieval.weighted_coverage(bench(spark, d).withColumn("tokens", X.match_tokens(F.col("query"))), candidates(spark, d).withColumn("tokens", X.match_tokens(F.col("text")))).withColumn("weighted", F.round("weighted", 6)))


def variants(spark: SparkSession, d: str) -> DataFrame:
    """Each item of the benchmark as asked, in its normal form, and with two rewrites: its first eight words, and its last eight."""
    words = F.split(F.trim("query"), r"\s+")
    rewrites = F.array(F.array_join(F.slice(words, 1, 8), " "), F.array_join(F.slice(words, F.greatest(F.size(words) - 7, F.lit(1)), F.lit(8)), " "))
    return bench(spark, d).select("query_id", F.posexplode(questions.query_variants(F.col("query"), F.lit(None).cast("string"), rewrites)).alias("variant", "query"))


def variant_hits(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """The nearest documents of each variant by their embeddings: query_id, variant, chunk_id, score."""
    asked = ingest.embed(variants(spark, d), "query", "query").select((F.col("query_id") * 1000 + F.col("variant")).alias("query_id"), F.col("embedding").alias("vector"))
    points_ = ingest.embed(docs_as_chunks(spark, d), "text").select("chunk_id", F.col("embedding").alias("vector"))
    return retrieval.vector_topk(asked, points_, k).select(F.floor(F.col("query_id") / 1000).alias("query_id"), (F.col("query_id") % 1000).cast("int").alias("variant"), "chunk_id", "score")


def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Vector and word hits of all variants, with texts."""
    both = variant_hits(spark, d).select("query_id", "chunk_id", "score").unionByName(candidates(spark, d).select("query_id", "chunk_id", "score"))
    return retrieval.with_chunks(retrieval.best_per_chunk(both), docs_as_chunks(spark, d))


register("r3_hybrid_rerank")(lambda spark, d: retrieval.hybrid_rerank(merged_candidates(spark, d), variants(spark, d)))
register("r4_reject_low_confidence")(
    lambda spark, d: retrieval.reject_low_confidence(retrieval.hybrid_rerank(merged_candidates(spark, d), variants(spark, d))).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
)
register("r5_retrieve_with_variants")(lambda spark, d: retrieval.retrieve_with_variants(variants(spark, d), variant_hits(spark, d), docs_as_chunks(spark, d), 5, index_of(spark, d)))
register("r7_recent_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")(lambda spark, d: tables.recent(read(spark, d, "events").select("event_id", "event_type", "ts"), "ts", "event_id", 20).drop("ts"))
register("r9_best_per_chunk", "SELECT user_id AS query_id, event_type AS chunk_id, max(value) AS score FROM events GROUP BY 1, 2")(lambda spark, d: retrieval.best_per_chunk(read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("chunk_id"), F.col("value").alias("score"))))
register("u3_candidate_union", f"WITH {TOK_SQL} SELECT query_id, chunk_id, max(round(score, 6)) AS score FROM (SELECT query_id, chunk_id, score FROM {LEXICAL} WHERE rank <= 15 UNION ALL SELECT query_id, chunk_id, score FROM {TOPK_SQL} WHERE rank <= 15) GROUP BY 1, 2")(lambda spark, d: retrieval.best_per_chunk(retrieval.lexical_search(bench(spark, d), docs_as_chunks(spark, d), 15, index_of(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score")).unionByName(retrieval.vector_topk(*vectors(spark, d), 15).select("query_id", "chunk_id", F.round("score", 6).alias("score")))))
register("u5_unique_sources", "SELECT query_id, label::VARCHAR AS source_doc_id, 'unknown' AS source_path, place FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM " + TOPK_SQL + " WHERE rank <= 15 GROUP BY query_id, label)")(lambda spark, d: retrieval.unique_sources(retrieval.vector_topk(*vectors(spark, d), 15).hint("merge").join(points(spark, d).withColumnRenamed("vec_id", "chunk_id"), "chunk_id").select("query_id", "rank", F.col("label").cast("string").alias("source_doc_id"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("int").alias("page_num"))).select("query_id", "source_doc_id", "source_path", "place"))
ADJACENT = "(SELECT query_id, rank, score, nth, n.vec_id AS chunk_id FROM (SELECT t.query_id, t.rank, t.score, e.label, o.nth, e.vec_id + o.off AS at FROM " + TOPK_SQL + " t JOIN embeddings e ON e.vec_id = t.chunk_id, (VALUES (0, 0), (1, -1), (2, 1)) o(nth, off) WHERE t.rank <= 5) x JOIN embeddings n ON n.vec_id = x.at AND n.label = x.label)"


def adjacent(spark: SparkSession, d: str) -> DataFrame:
    place = points(spark, d).select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("group_id"), F.col("vec_id").alias("chunk_index"))
    hits = retrieval.vector_topk(*vectors(spark, d), 5).hint("merge").join(place, "chunk_id")
    return tables.expand_adjacent(hits, place).select("query_id", "chunk_id", "rank")


register("j5_expand_adjacent", f"SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank * 10 + nth)) AS rank FROM {ADJACENT} GROUP BY query_id, chunk_id")(adjacent)
register(
    "j6_document_chunk_counts",
    "SELECT source AS source_path, count(DISTINCT doc_id) AS documents, coalesce(any_value(n), 0) AS chunk_count FROM documents LEFT JOIN (SELECT 'src' || (item_id % 7) AS s, count(*) AS n FROM benchmark GROUP BY 1) c ON c.s = source GROUP BY source",
)(lambda spark, d: tables.chunk_counts(read(spark, d, "documents").withColumnRenamed("source", "source_path"), read(spark, d, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("source_path"))))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("project_id"), F.lit("txt").alias("file_type"), F.concat(F.lit("/in/"), (F.col("event_id") % 97).cast("string")).alias("input_path"), F.array((F.col("user_id") % 50).cast("string")).alias("file_hashes"), F.array((F.col("user_id") % 11).cast("string")).alias("source_paths"))


register("j7_match_ingestion_job", "WITH j AS (SELECT event_id AS job_id, ts, event_type AS p, event_id % 97 AS a, user_id % 50 AS b, user_id % 11 AS c FROM events), m AS (SELECT p, a, max((ts, job_id)) AS m FROM j GROUP BY 1, 2), n AS (SELECT p, b, max((ts, job_id)) AS m FROM j GROUP BY 1, 2), o AS (SELECT p, c, max((ts, job_id)) AS m FROM j GROUP BY 1, 2) SELECT j.job_id AS run_id, greatest(m.m, n.m, o.m)[2] AS job_id FROM j JOIN m USING (p, a) JOIN n USING (p, b) JOIN o USING (p, c)")(lambda spark, d: tables.match_ingestion_job(jobs(spark, d).withColumnRenamed("job_id", "run_id"), jobs(spark, d)))
register("j8_deletion_targets", f"SELECT id, source_path FROM {RAW_SQL} WHERE source_path = 'src1' OR starts_with(source_path, 'src1/')")(lambda spark, d: tables.deletion_targets(raw(spark, d), "src1/").select("id", "source_path"))
register("j9_delete_rows", f"WITH r AS (SELECT * FROM {RAW_SQL}) SELECT id FROM r WHERE source_path NOT IN (SELECT source_path FROM r WHERE id % 4 = 0) AND file_hash NOT IN (SELECT file_hash FROM r WHERE id % 4 = 0)")(lambda spark, d: tables.delete_rows(raw(spark, d), raw(spark, d).filter("id % 4 = 0").select("source_path"), raw(spark, d).filter("id % 4 = 0").select("file_hash")).select("id"))
register("j10_related_jobs", "SELECT event_id AS job_id FROM events WHERE '/in/' || (event_id % 97) = '/in/9' OR starts_with('/in/' || (event_id % 97), '/in/9/')")(lambda spark, d: tables.deletion_targets(jobs(spark, d).withColumnRenamed("input_path", "source_path"), "/in/9").select("job_id"))
register("j11_dedup_chunk_ids", "SELECT sha256(text) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")(lambda spark, d: tables.first_by_key(read(spark, d, "documents").select(F.sha2("text", 256).alias("chunk_id"), "doc_id"), "chunk_id", F.col("doc_id")))
register("i5_delete_ingestion", f"WITH r AS (SELECT * FROM {RAW_SQL}), t AS (SELECT * FROM r WHERE starts_with(source_path, 'src2/')) SELECT id FROM r WHERE source_path NOT IN (SELECT source_path FROM t) AND file_hash NOT IN (SELECT file_hash FROM t)")(lambda spark, d: ingest.delete_ingestion(raw(spark, d), "src2")[0].select("id"))


# --- aggregates ---

SIZES_SQL = f"(SELECT doc_id, lang AS strategy, {COUNT_SQL.replace('{t}', 'text')} AS n FROM documents)"
STATS_SQL = f"""(SELECT strategy, count(*) AS chunks, round(avg(n), 1) AS avg_tokens, floor(median(n))::BIGINT AS median_tokens, min(n) AS min_tokens, max(n) AS max_tokens,
 round(coalesce(stddev_samp(n), 0), 1) AS stdev_tokens, round(coalesce(stddev_samp(n), 0) / avg(n), 3) AS variation, sum(n)::BIGINT AS total_tokens, 0 AS arabic, count(*) AS other, count(DISTINCT doc_id) AS documents,
 count(*) FILTER (n < 80) AS tiny, count(*) FILTER (n BETWEEN 80 AND 250) AS in_range, count(*) FILTER (n > 250) AS oversize, count(*) FILTER (n > 512) AS hard_oversize,
 round(count(*) FILTER (n BETWEEN 80 AND 250)::DOUBLE / count(*) * 100, 1) AS in_range_pct FROM {SIZES_SQL} GROUP BY strategy)"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks, their language as strategy."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("source_doc_id"), F.col("lang").alias("strategy"), X.approx_token_count(F.col("text")).alias("token_count"), X.is_arabic(F.col("text")).alias("is_arabic"))
    return aggregates.chunk_stats(rows)


register("a1_ingest_summary", f"SELECT value AS detected_lang, count(*) AS documents, 0 AS arabic, sum({n_of('text', f'[^{SPACE}]+')})::BIGINT AS words FROM ({SQL['c12_detect_lang']}) JOIN documents USING (doc_id) GROUP BY value")(lambda spark, d: aggregates.ingest_summary(clean(spark, d)))
register("a2_chunk_stats", f"SELECT * FROM {STATS_SQL}")(stats)
register("a2_chunk_stats_of_chunks")(lambda spark, d: aggregates.chunk_stats(ingest.chunks_of(read(spark, d, "documents"), "paragraph")))
register("a3_dataset_summary", f"SELECT file_type, count(DISTINCT source_path) AS sources, count(*) AS documents, 0 AS arabic FROM {RAW_SQL} GROUP BY file_type")(lambda spark, d: aggregates.dataset_summary(clean(spark, d)))
SCORE_SQL = f"(SELECT strategy, round(in_range_pct * 1.5 - tiny * 3.0 - oversize * 4.0 - hard_oversize * 8.0 - variation * 20.0, 2) AS score FROM {STATS_SQL})"
register("a4_score_strategies", f"SELECT strategy, score, score = max(score) OVER () AS recommended FROM {SCORE_SQL}")(lambda spark, d: aggregates.score_strategies(stats(spark, d)))
register("a5_chunking_insights", f"SELECT strategy, rule, value FROM (SELECT strategy, unnest([{{'rule': 'above the hard limit', 'value': hard_oversize::DOUBLE, 'on': hard_oversize > 0}}, {{'rule': 'above the range', 'value': oversize::DOUBLE, 'on': oversize > 0}}, {{'rule': 'below the range', 'value': tiny::DOUBLE, 'on': tiny > 0}}, {{'rule': 'uneven sizes', 'value': variation::DOUBLE, 'on': variation > 0.4}}, {{'rule': 'even sizes', 'value': variation::DOUBLE, 'on': variation <= 0.4}}, {{'rule': 'few documents', 'value': documents::DOUBLE, 'on': documents < 3}}, {{'rule': 'no Arabic', 'value': 0.0::DOUBLE, 'on': true}}], recursive := true) FROM {STATS_SQL}) WHERE \"on\"")(lambda spark, d: aggregates.chunking_insights(stats(spark, d)))
register("a6_lexical_probe", f"WITH {TOK_SQL} SELECT count(*) AS query_count, round(avg(best), 3) AS avg_overlap, round(count(*) FILTER (best >= 0.5)::DOUBLE / count(*) * 100, 1) AS hit_rate FROM (SELECT query_id, max(overlap::DOUBLE / size) AS best FROM o GROUP BY query_id)")(lambda spark, d: aggregates.lexical_probe(bench_tokens(spark, d), index_of(spark, d)))


def as_documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("source_path"), F.lit("txt").alias("file_type"), (F.col("doc_id") % 9).alias("page_num"), F.col("n_chars").alias("file_size"), F.col("n_chars").alias("indexed_at"))


register("a7_documents_overview", "SELECT source AS source_path, arg_min(doc_id, (doc_id % 9, doc_id)) AS id, 'txt' AS file_type, max(n_chars) AS file_size, max(n_chars) AS indexed_at, count(*) AS chunk_count FROM documents GROUP BY source")(lambda spark, d: aggregates.documents_overview(as_documents(spark, d), as_documents(spark, d).select("source_path")))
register("a8_system_stats", "SELECT (SELECT count(DISTINCT source) FROM documents) AS total_documents, (SELECT max(n_chars) FROM documents) AS last_ingestion_at, (SELECT count(*) FROM documents) AS total_chunks, (SELECT round(avg(value), 2) FROM events WHERE event_type = 'view') AS avg_retrieval_latency_ms, 'healthy' AS retrieval_health")(lambda spark, d: aggregates.system_stats(as_documents(spark, d), as_documents(spark, d), read(spark, d, "events").select(F.when(F.col("event_type") == "view", "query").otherwise("other").alias("type"), F.col("value").alias("latency"))))
register("a9_dominant_language", "SELECT lang FROM (SELECT lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY lang) ORDER BY n DESC, f LIMIT 1")(lambda spark, d: aggregates.dominant_language(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("detected_lang"))))
register("a13_activity_counts", "SELECT event_type AS type, count(*) AS n, round(avg(value), 2) AS avg_latency FROM events GROUP BY event_type")(lambda spark, d: aggregates.activity_counts(read(spark, d, "events").select(F.col("event_type").alias("type"), F.col("value").alias("latency"))))
register("a15_count_chunks", "SELECT source AS ingestion_id, count(*) FILTER (length(trim(text)) > 0) AS chunks FROM documents GROUP BY source")(lambda spark, d: aggregates.count_chunks(read(spark, d, "documents").select(F.col("source").alias("ingestion_id"), "text")))
register("a16_run_sources", f"SELECT id % 10 AS ingestion_id, count(DISTINCT source_path) AS sources, count(DISTINCT file_hash) AS files, min(source_path) AS first_source, max(source_path) AS last_source FROM {RAW_SQL} GROUP BY 1")(lambda spark, d: aggregates.run_sources(raw(spark, d).withColumn("ingestion_id", F.col("id") % 10)))


# --- pages ---

register("s6_extract_html_sections")(lambda spark, d: html.extract_sections(read(spark, d, "pages")).drop("metadata"))
register("h2_html_title", "SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title FROM pages")(lambda spark, d: read(spark, d, "pages").select("page_id", html.html_title(F.col("html")).alias("title")))
register("h6_detect_charset", "SELECT page_id, coalesce(nullif(lower(regexp_extract(substr(html, 1, 4096), 'charset=[\"'']?([A-Za-z0-9_-]+)', 1, 'i')), ''), 'utf-8') AS charset FROM pages")(lambda spark, d: read(spark, d, "pages").select("page_id", html.detect_charset(F.col("html")).alias("charset")))


def tagged_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with meta tags put before their title: an author by name, a title by property, one that isn't looked for."""
    page = F.col("page_id").cast("string")
    tags = F.concat(F.lit('<META NAME="Author" content="page '), page, F.lit('"><meta property="og:title" content="no '), page, F.lit('"><meta name="robots" content="none"><title>'))
    return read(spark, d, "pages").select("page_id", F.replace("html", F.lit("<title>"), tags).alias("html"))


register("h2_meta_tags", "SELECT page_id, 2 AS tags, 'page ' || page_id AS author, 'no ' || page_id AS og_title FROM pages")(
    lambda spark, d: html.extract_sections(tagged_pages(spark, d)).filter("section_no = 0").select("page_id", F.size("metadata").alias("tags"), F.col("metadata")["meta_author"].alias("author"), F.col("metadata")["meta_og_title"].alias("og_title"))
)


def encoded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as bytes: a third in UTF-8, a third in Latin-1 and declared so, a third in UTF-16 with nothing but a byte order mark to tell."""
    which = F.col("page_id") % 3
    text = F.when(which == 1, F.replace("html", F.lit('charset="utf-8"'), F.lit('charset="iso-8859-1"'))).when(which == 2, F.replace("html", F.lit('charset="utf-8"'), F.lit("none"))).otherwise(F.col("html"))
    content = F.when(which == 1, F.encode(text, "ISO-8859-1")).when(which == 2, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8"))
    return read(spark, d, "pages").select("page_id", content.alias("content"))


register(
    "h6_decode_pages",
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' ELSE 'utf-16' END AS charset, md5(CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, 'charset=\"utf-8\"', 'charset=\"iso-8859-1\"') ELSE replace(html, 'charset=\"utf-8\"', 'none') END) AS digest FROM pages",
)(lambda spark, d: encoded_pages(spark, d).select("page_id", charsets.decoded(F.col("content")).alias("v")).select("page_id", "v.charset", F.md5("v.text").alias("digest")))


# --- files ---


def source_files(spark: SparkSession, d: str) -> str:
    """A folder with a file of each source: its documents by doc_id, a line end after each."""
    folder = streams.shared_path(spark, "files")
    texts = read(spark, d, "documents").select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id")
    with shuffles_freed(texts):
        texts.select("source", "text").write.partitionBy("source").text(folder)
    return folder


FILES_SQL = "(SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY source)"
register("s1_scan_files", f"SELECT source, strlen(content) AS length, sha256(content) AS file_hash FROM {FILES_SQL}")(lambda spark, d: sources.scan_files(spark, source_files(spark, d), ["TXT"]).select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "length", sources.file_fingerprint(F.col("content")).alias("file_hash")))


def folder_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The files stream into an index in batches of seven; a second call finds no new ones. Sources with their file's hash, and whether all chunks have a vector."""
    folder = source_files(spark, d)
    index, checkpoint = ingest.Index(spark, streams.shared_path(spark, "folder-index"), buckets=8), streams.shared_path(spark, "folder-checkpoint")
    for _ in range(2):
        streams.stream_folder(spark, folder, index, checkpoint, ["txt"], files_a_batch=7)
    found = index.manifest().hint("merge").join(index.vectors().select("chunk_id", F.lit(True).alias("has")), "chunk_id", "left")
    path = F.get_json_object("metadata_json", "$.source_path")
    return found.groupBy("file_hash").agg(F.regexp_extract(F.min(path), "source=([^/]*)/", 1).alias("source"), F.coalesce(F.every("has"), F.lit(False)).alias("has_vectors"))


register("t1_stream_folder", f"SELECT sha256(content) AS file_hash, source, true AS has_vectors FROM {FILES_SQL}")(folder_streamed)


# --- questions ---

TURNS_SQL = "(SELECT conv_id, turn, text AS query, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user')"
WORD_SQL = "list_transform(regexp_extract_all({t}, '[A-Za-z0-9_]+|[\\x{0600}-\\x{06FF}]+'), lambda x: lower(x))"
FOLLOW_SQL = f"(SELECT *, CASE WHEN asked = '' THEN false WHEN len(qt) <= 4 THEN true WHEN regexp_matches(asked, '\\.(pdf|docx|html|txt|md|csv|xlsx?)\\b', 'i') OR regexp_matches(asked, '\\p{{Nd}}') THEN false WHEN novel <= 1 THEN true ELSE len(qt)::DOUBLE / greatest(len(pt), 1) <= 0.45 AND novel <= 2 END AS followup FROM (SELECT *, len(list_filter(qt, lambda t: NOT list_contains(pt, t) AND length(t) >= 4)) AS novel FROM (SELECT *, {WORD_SQL.replace('{t}', 'asked')} AS qt, {WORD_SQL.replace('{t}', 'lower(previous)')} AS pt FROM (SELECT *, lower({strip_sql('query')}) AS asked FROM {TURNS_SQL} WHERE previous IS NOT NULL))))"
SAID_SQL = "(SELECT conv_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM (SELECT conv_id, regexp_split_to_array(string_agg(role || ': ' || text, chr(10) ORDER BY turn), '\\r?\\n') AS lines FROM conversations GROUP BY conv_id))"


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as one text with a turn after the other."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("said"))


register("p1_last_user_turn", f"SELECT conv_id, {strip_sql('substr(last, 6)')} AS last FROM (SELECT conv_id, arg_max({strip_sql('line')}, nth) FILTER (starts_with(lower({strip_sql('line')}), 'user:')) AS last FROM {SAID_SQL} GROUP BY conv_id)")(
    lambda spark, d: transcripts(spark, d).select("conv_id", questions.last_user_turn(F.col("said")).alias("last"))
)
register("p2_is_followup", f"SELECT conv_id, turn, followup FROM {FOLLOW_SQL}")(lambda spark, d: questions.user_turns(read(spark, d, "conversations")).filter("previous IS NOT NULL").select("conv_id", "turn", questions.is_followup(F.col("query"), F.col("previous")).alias("followup")))
CONTEXTUAL = f"CASE WHEN followup AND {strip_sql('previous')} <> '' AND {strip_sql('previous')} <> {strip_sql('query')} THEN {strip_sql('previous || chr(10) || query')} END"
register("p3_contextual_variant", f"SELECT conv_id, turn, {CONTEXTUAL} AS variant FROM {FOLLOW_SQL}")(lambda spark, d: questions.user_turns(read(spark, d, "conversations")).filter("previous IS NOT NULL").select("conv_id", "turn", questions.contextual_variant(F.col("query"), F.col("previous")).alias("variant")))
NQ = strip_sql(rx(f"translate({rx(strip_sql('{t}'), X.QUERY_DIACRITICS)}, '{X.QUERY_FROM}', '{X.QUERY_TO}')", f"[{SPACE}]+", " "))
register("p4_query_variants", f"SELECT conv_id, turn, i - 1 AS variant, vs[i] AS query FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM (SELECT conv_id, turn, list_filter(l, lambda x, k: x IS NOT NULL AND x <> '' AND list_position(l, x) = k) AS vs FROM (SELECT conv_id, turn, [p, c, {NQ.replace('{t}', 'p')}, {NQ.replace('{t}', 'c')}] AS l FROM (SELECT conv_id, turn, {strip_sql('query')} AS p, {CONTEXTUAL} AS c FROM {FOLLOW_SQL}))))")(lambda spark, d: questions.user_turns(read(spark, d, "conversations")).filter("previous IS NOT NULL").select("conv_id", "turn", F.posexplode(questions.query_variants(F.col("query"), F.col("previous"))).alias("variant", "query")))
register("p5_rewrite_target", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN CASE WHEN label < 5 AND label >= 3 THEN NULL ELSE 'en' END WHEN label < 5 THEN 'ar' WHEN label < 7 THEN 'ar' END AS target FROM embeddings")(lambda spark, d: points(spark, d).select("vec_id", questions.rewrite_target(F.when(F.col("vec_id") % 2 == 0, "ar").otherwise("en"), F.when(F.col("label") < 5, "ar").otherwise("en"), F.when(F.col("label") < 3, 0.1).when(F.col("label") < 5, 0.9).when(F.col("label") < 7, F.lit(None)).otherwise(0.8)).alias("target")))
register("p6_apply_rewrites", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'X ' || conv_id END AS rewrite FROM conversations")(lambda spark, d: (lambda c: questions.apply_rewrites(c.select("conv_id", "turn", F.lit("en").alias("target"), F.col("conv_id").cast("string").alias("query")), c.filter("conv_id % 2 = 0").select(F.lit("en").alias("target"), F.col("conv_id").cast("string").alias("query"), F.concat(F.lit('"X  '), F.col("conv_id").cast("string"), F.lit('" ')).alias("rewrite"))).select("conv_id", "turn", "rewrite"))(read(spark, d, "conversations")))
CONTEXT_SQL = "(SELECT conv_id AS query_id, string_agg('[' || turn || '] ' || text || ' (source: ' || role || ' [page ' || turn || '])', chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id)"


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return questions.build_context(read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.col("role").alias("source_path"), F.col("turn").alias("page_num")))


def prompt_sql(form: str) -> str:
    a, rest = form.replace("'", "''").split("{context}")
    b, c = rest.split("{question}")
    return f"'{a}' || context || '{b}' || query_id || '{c}'"


register("p7_build_context", f"SELECT * FROM {CONTEXT_SQL}")(contexts)
register("p8_build_prompt", f"SELECT query_id, {prompt_sql(questions.STRICT)} AS strict, {prompt_sql(questions.SIMPLE)} AS simple FROM {CONTEXT_SQL}")(lambda spark, d: contexts(spark, d).select("query_id", *(questions.build_prompt(F.col("query_id").cast("string"), F.col("context"), v).alias(v) for v in ("strict", "simple"))))
register("p9_prompt_question", f"SELECT conv_id, turn, CASE WHEN coalesce(previous, '') = '' THEN query ELSE 'Earlier turns:' || chr(10) || previous || chr(10) || chr(10) || 'Question now:' || chr(10) || query END AS question FROM {TURNS_SQL}")(lambda spark, d: questions.user_turns(read(spark, d, "conversations")).select("conv_id", "turn", questions.prompt_question(F.col("query"), F.col("previous")).alias("question")))
register("p10_conversation_context")(lambda spark, d: questions.conversation_context(read(spark, d, "conversations")))


def size_of_prompt(prompts: pd.Series) -> pd.Series:
    """A generator that can be checked: it tells how long the prompt is, and has no answer to long ones."""
    return prompts.map(lambda p: f"{len(p)} letters" if len(p) < 4000 else None)


register(
    "p11_answer",
    f"SELECT doc_id AS query_id, CASE WHEN length(context) < 4000 THEN length(context) || ' letters' ELSE 'I don''t know' END AS answer FROM documents LEFT JOIN {CONTEXT_SQL} ON query_id = doc_id",
)(lambda spark, d: questions.answers(read(spark, d, "documents").select(F.col("doc_id").alias("query_id")), contexts(spark, d).select("query_id", F.col("context").alias("prompt")), size_of_prompt).select("query_id", "answer"))


def moody(prompts: pd.Series) -> pd.Series:
    """A generator that fails on every batch in which a prompt has a number of letters that five divides."""
    if any(len(p) % 5 == 0 for p in prompts):
        raise RuntimeError("not this one")
    return prompts.map(lambda p: f"{len(p)} letters")


def answered_with_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each query vector's hits in two fifths of the cases, as a prompt of as many letters as its id says, and as sources."""
    hits = retrieval.vector_topk(*vectors(spark, d), 5).hint("merge").join(points(spark, d).withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    hits = hits.filter(F.col("query_id") % 100 < 40).withColumns({"source_doc_id": F.col("label").cast("string"), "source_path": F.lit(None).cast("string"), "page_num": F.lit(0)})
    prompts = hits.select("query_id", F.repeat(F.lit("x"), (F.col("query_id") / 20 + 1).cast("int")).alias("prompt")).distinct()
    made = questions.answers(vectors(spark, d)[0].select("query_id"), prompts, moody, retrieval.unique_sources(hits))
    return made.select("query_id", "answer", F.array_join(F.transform("sources", lambda s: s["source_doc_id"]), ",").alias("sources"))


register(
    "p11_answer_with_sources",
    f"WITH h AS (SELECT query_id, label, min(rank) AS first FROM {TOPK_SQL} WHERE rank <= 5 AND query_id % 100 < 40 GROUP BY query_id, label), s AS (SELECT query_id, string_agg(label::VARCHAR, ',' ORDER BY first) AS sources FROM h GROUP BY query_id) SELECT vec_id AS query_id, CASE WHEN s.query_id IS NOT NULL AND (vec_id // 20 + 1) % 5 <> 0 THEN (vec_id // 20 + 1) || ' letters' ELSE 'I don''t know' END AS answer, coalesce(sources, '') AS sources FROM embeddings LEFT JOIN s ON s.query_id = vec_id WHERE vec_id % 20 = 0",
)(answered_with_sources)


def asked_and_answered(spark: SparkSession, d: str) -> DataFrame:
    """The turns of users with the assistant's next turn as query activity."""
    said = read(spark, d, "conversations").filter("text <> ''")
    answers = said.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answers.hint("merge"), ["conv_id", "turn"])
    return questions.query_activity(both.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event_id"), F.col("turn").alias("ts"), "question", "answer", F.lit(0.0).alias("latency")))


register("p12_sessions_from_activity", "SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.text <> '' AND a.text <> ''")(
    lambda spark, d: questions.sessions_from_activity(asked_and_answered(spark, d)).select(F.regexp_extract("session_id", r"-(\d+):", 1).cast("long").alias("conv_id"), F.col("at").alias("turn"), "question", "answer")
)
register("p15_query_activity_record", "SELECT event_id, 'query' AS type, ts, round(value, 2) AS latency, 'user ' || user_id AS description FROM events WHERE event_type = 'view'")(
    lambda spark, d: questions.query_activity(read(spark, d, "events").filter("event_type = 'view'").select("event_id", "ts", F.col("value").alias("latency"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("question"), F.lit("").alias("answer"))).select("event_id", "type", "ts", "latency", "description")
)


# --- evaluation ---


def case_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.lexical_search(bench(spark, d), docs_as_chunks(spark, d), 5, index_of(spark, d))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"))
    return retrieval.with_chunks(hits, docs).select(F.concat(F.lit("case-"), F.col("query_id").cast("string")).alias("id"), "query_id", "rank", "text", "source_path")


def norm_sql(t: str) -> str:
    return strip_sql(rx(f"lower({t})", f"[{SPACE}]+", " "))


EVAL_SQL = f"""(WITH {TOK_SQL}, h AS (SELECT 'case-' || query_id AS id, rank, c.text, source || '/' || doc_id AS path FROM (SELECT * FROM {LEXICAL} WHERE rank <= 5) l JOIN documents c ON c.doc_id = l.chunk_id), k AS (SELECT * FROM {CASES_SQL}),
e AS (SELECT k.id, count(h.path) AS retrieved_count, coalesce(arg_min(h.path, h.rank), '') AS top_source, len(any_value(src)) = 0 OR coalesce(bool_or(len(src) > 0 AND contains({norm_sql('h.path')}, {norm_sql('src[1]')})), false) AS retrieval_hit,
 coalesce(bool_or(contains({norm_sql('h.text')}, {norm_sql('ev[1]')})), false) AS evidence_hit, coalesce(bool_or(len(bad) > 0 AND contains({norm_sql('h.path')}, {norm_sql('bad[1]')})), false) AS forbidden_hit FROM k LEFT JOIN h ON h.id = k.id GROUP BY k.id)
SELECT *, true AS answer_keywords_ok, CASE WHEN forbidden_hit THEN 'cross-document pollution' WHEN retrieved_count = 0 THEN 'empty retrieval' WHEN NOT (retrieval_hit AND evidence_hit) THEN 'wrong chunk retrieved' ELSE 'relevant context found but answer abstained' END AS failure_reason, false AS passed FROM e)"""


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    return questions.evaluate_cases(cases(spark, d).withColumn("answer", F.lit(questions.IDK)), case_hits(spark, d))


register("e1_embed")(lambda spark, d: ingest.embed(read(spark, d, "documents"), "text").select("doc_id", "embedding"))
register("e3_evaluate_cases", f"SELECT * FROM {EVAL_SQL}")(evaluated)
register("e4_classify_failure", f"SELECT id, failure_reason FROM {EVAL_SQL}")(lambda spark, d: evaluated(spark, d).select("id", "failure_reason"))
register("a12_eval_report", f"SELECT failure_reason AS reason, count(*) AS cases, count(*) FILTER (retrieval_hit) AS retrieval_hits, count(*) FILTER (evidence_hit) AS evidence_hits, 0 AS passed FROM {EVAL_SQL} GROUP BY ROLLUP (failure_reason)")(lambda spark, d: questions.eval_report(evaluated(spark, d)))
register("e5_probe_multi_chunk", f"WITH {TOK_SQL} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS pages FROM {LEXICAL} WHERE rank <= 5 GROUP BY query_id")(lambda spark, d: questions.probe_multi_chunk(case_hits(spark, d).withColumn("page_label", F.element_at(F.split("source_path", "/"), 2))).select("query_id", "pages"))
register("f7_matches", "SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'les') AS any_of, contains(lower(text), 'the') AND contains(lower(text), 'and') AS all_of, true AS none_given FROM documents")(lambda spark, d: read(spark, d, "documents").select("doc_id", questions._holds(F.col("text"), F.array(F.lit("THE"), F.lit(" les ")), False).alias("any_of"), questions._holds(F.col("text"), F.array(F.lit("the"), F.lit("AND")), True).alias("all_of"), questions._holds(F.col("text"), F.array().cast("array<string>"), True).alias("none_given")))


# --- runs ---


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """Index all chunks twice, the second time with changes: the second report."""
    folder = streams.shared_path(spark, "index")
    index = ingest.Index(spark, folder, buckets=8)
    rows = read(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), "text", F.sha2((F.col("doc_id") % 7).cast("string"), 256).alias("file_hash"), F.lit("{}").alias("metadata_json"))
    hashed = lambda df: df.withColumn("chunk_content_hash", X.chunk_content_hash(F.col("text")))
    index.index_chunks(hashed(rows.filter("doc_id % 10 <> 0")))
    second = rows.filter("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("new "), "text")).otherwise(F.col("text")))
    return index.index_chunks(hashed(second))


HASH_SQL = f"sha256({NORMAL_SQL.replace('{t}', 'text')})"
register("i1_index_chunks", f"WITH c AS (SELECT {HASH_SQL} AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT DISTINCT h FROM (SELECT {HASH_SQL} AS h FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT {HASH_SQL.replace('text', '(' + chr(39) + 'new ' + chr(39) + ' || text)')} FROM documents WHERE doc_id % 10 = 2)), r AS (SELECT h IN (SELECT h FROM c) AS hit FROM n) SELECT (SELECT count(*) FROM documents WHERE doc_id % 10 IN (0, 2)) AS new_or_changed, (SELECT count(*) FROM documents WHERE doc_id % 10 > 2) AS unchanged, (SELECT count(*) FROM documents WHERE doc_id % 10 = 1) AS deleted, count(*) FILTER (NOT hit) AS embedded, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT hit) AS cache_misses FROM r")(indexed)


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    folder = streams.shared_path(spark, "run")
    ingest.write_latest_and_snapshot(read(spark, d, "documents").select("doc_id", "source"), folder, "run-1")
    return ingest.read_latest(spark, folder).join(spark.read.parquet(f"{folder}/snapshots").filter("run = 'run-1'").select("doc_id"), "doc_id", "left_semi")


register("s9_latest_and_snapshot", "SELECT doc_id, source FROM documents")(snapshot)
register("i4_ingest_job_record", "SELECT 'job-' || source AS id, count(*) AS documents, count(DISTINCT sha256(text)) AS files, 'indexed' AS status FROM documents GROUP BY source")(
    lambda spark, d: tables.ingest_job_record(read(spark, d, "documents").select("source", F.sha2("text", 256).alias("file_hash")), "source", "now").select("id", "documents", "files", "status")
)


def whole_run(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files: a fifth can't be read, and a fifth has null content."""
    ext = F.element_at(F.array(*map(F.lit, ("txt", "MD", "bin", "txt", "md"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    files = read(spark, d, "documents").select(path.alias("path"), F.when(F.col("doc_id") % 5 != 4, F.col("text").cast("binary")).alias("content"))
    folder = streams.shared_path(spark, "run")
    counts = ingest.run_pipeline(files, folder, "run-1", "now", "paragraph", index=ingest.Collections(spark, folder).create("p"))
    return counts.drop("chunks")


register(
    "i3_run_pipeline",
    f"WITH r AS (SELECT file_hash, word_count FROM {CLEAN_DOCS} WHERE id % 5 IN (0, 1, 3)), u AS (SELECT file_hash, any_value(word_count) AS word_count FROM r GROUP BY file_hash) SELECT count(*) AS files, count(*) AS raw_pages, count(*) FILTER (word_count >= 12) AS clean_docs, (SELECT count(*) FROM documents) - count(*) FILTER (word_count >= 12) AS skipped FROM u",
)(whole_run)


def job_deleted(spark: SparkSession, d: str) -> DataFrame:
    """All documents as files of a run, a job for each source; the first source's job is deleted with all that it made. The paths that are left in the latest pages."""
    path = F.concat(F.lit("in/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    folder = streams.shared_path(spark, "run")
    index = ingest.Index(spark, f"{folder}/index", buckets=8)
    ingest.run_pipeline(read(spark, d, "documents").select(path.alias("path"), F.col("text").cast("binary").alias("content")), folder, "run-1", "now", "paragraph", index=index)
    made = Jobs(spark, f"{folder}/jobs")
    every = read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<string>")
    told = {"id": F.col("source"), "project_id": F.lit("p"), "file_type": F.lit("txt"), "input_path": F.concat(F.lit("in/"), F.col("source")), "file_hashes": none, "source_paths": none, "ingestion_id": F.lit(None).cast("string"), "status": F.lit("indexed"), "created_at": F.lit("1"), "updated_at": F.lit("1")}
    made.save(every.select(*(c.alias(k) for k, c in told.items())))
    made.delete(made.all().agg(F.min("id")).first()[0], folder, index)
    left = ingest.read_latest(spark, f"{folder}/pages").select("source_path").distinct()
    # as many as have a job
    return left.hint("merge").join(made.all().select(F.col("id").alias("job")), F.regexp_extract("source_path", "^in/([^/]*)/", 1) == F.col("job"), "left_semi")


register(
    "i5_delete_job",
    f"WITH f AS (SELECT file_hash, arg_min('in/' || source_path || '.txt', lower('in/' || source_path || '.txt')) AS source_path, any_value(word_count) AS word_count FROM {CLEAN_DOCS} GROUP BY file_hash) SELECT source_path FROM f WHERE word_count >= 12 AND NOT starts_with(source_path, 'in/' || (SELECT min(source) FROM documents) || '/')",
)(job_deleted)


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Even documents in one project, odd ones in another that is deleted, and a third without any."""
    every = ingest.Collections(spark, streams.shared_path(spark, "projects"))
    rows = read(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text", X.chunk_content_hash(F.col("text")).alias("chunk_content_hash"), F.lit("{}").alias("metadata_json"), F.sha2("text", 256).alias("file_hash"))
    for name, rest in (("even", 0), ("odd", 1)):
        every.create(name).index_chunks(rows.filter(F.col("doc_id") % 2 == rest))
    every.create("empty")
    every.delete("odd")
    said = [(name, every.exists(name), every.has_points(name)) for name in ("even", "odd", "empty")]
    counted = every.create("even").vectors().agg(F.count(F.lit(1)).alias("points"))
    return spark.createDataFrame(said, "project string, there boolean, filled boolean").crossJoin(counted)  # three rows and one


register("s14_collections", "SELECT project, there, filled, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS points FROM (VALUES ('even', true, true), ('odd', false, false), ('empty', true, false)) p(project, there, filled)")(projects)


# --- streams ---


def stream_ingested(spark: SparkSession, d: str) -> DataFrame:
    out, checkpoint = streams.shared_path(spark, "ingest"), streams.shared_path(spark, "ingest-checkpoint")
    streams.stream_ingest(streams.read_stream(spark, d, "documents"), lambda b: sources.read_documents_table(b).select("doc_id", "id", X.word_count(X.clean_text(F.col("raw_text"))).alias("words")), "id", out, checkpoint)
    return streams.read_ingested(spark, out, "id").select("id", "doc_id", "words")


register("t1_stream_ingest", f"SELECT id, doc_id, word_count AS words FROM {CLEAN_DOCS}")(stream_ingested)


def stream_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Documents stream in as chunks of an index; a second stream over the same table changes nothing."""
    index = ingest.Index(spark, streams.shared_path(spark, "stream-index"), buckets=8)
    chunks = lambda b: b.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("chunk_id"), "text", X.chunk_content_hash(F.col("text")).alias("chunk_content_hash"), F.lit("{}").alias("metadata_json"), F.sha2("text", 256).alias("file_hash"))
    for k in range(2):
        streams.stream_index(streams.read_stream(spark, d, "documents"), chunks, index, streams.shared_path(spark, f"stream-index-checkpoint-{k}"))
    return index.manifest().join(index.vectors().hint("merge"), "chunk_id").select("chunk_id", "chunk_content_hash")


register("t1_stream_index", f"SELECT sha256(doc_id::VARCHAR) AS chunk_id, sha256({NORMAL_SQL.replace('{t}', 'text')}) AS chunk_content_hash FROM documents")(stream_indexed)
register("t2_stream_activity_stats", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")(lambda spark, d: streams.run_to_table(streams.window_stats(streams.read_stream(spark, d, "events")), "stats", "complete"))
register("t2_stream_sliding_stats", "SELECT window_start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start, event_type, value FROM events) GROUP BY 1, 2")(
    lambda spark, d: streams.run_to_table(streams.window_stats(streams.read_stream(spark, d, "events"), "2 days", "1 day"), "sliding", "complete")
)
register("t3_stream_dedup", "SELECT count(DISTINCT user_id) AS users FROM events")(lambda spark, d: streams.run_to_table(streams.stream_dedup(streams.read_stream(spark, d, "events"), "user_id", "ts"), "dedup").agg(F.count(F.lit(1)).alias("users")))
register("t4_stream_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")(lambda spark, d: streams.run_to_table(streams.sessions(streams.read_stream(spark, d, "events")), "sessions", "complete"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
