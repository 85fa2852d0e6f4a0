"""Readers: document tables, directories of files, tolerant JSON lines, evaluation cases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.html import extract_sections
from corpusloom.sources.charsets import decoded

#: Which reader takes which extension.
READERS = {"txt": "text", "md": "text", "html": "html", "htm": "html", "json": "json", "jsonl": "json"}
CLEAN_SCHEMA = "doc_id string, source_path string, file_type string, page_num int, clean_text string, char_count int, word_count int, detected_lang string, is_arabic boolean, metadata map<string,string>"
CASE_SCHEMA = "id string, query string, expected_source_contains array<string>, expected_chunk_contains array<string>, expected_answer_keywords array<string>, forbidden_source_contains array<string>, notes string, top_k int, prompt_version string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


FILES = "path string, modificationTime timestamp, length long, content binary"


def _allowed(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.filter(extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions]))


def scan_files(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """path, content and length of the files below folder with one of the extensions, whatever their case, in the order of their lower-cased paths.

    A folder without such files, or that isn't there, gives no rows.
    """
    spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spot):
        return spark.createDataFrame([], FILES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return _allowed(files, extensions).orderBy(F.lower("path"), "path")


def stream_files(spark: SparkSession, folder: str, extensions: list[str], files_a_batch: int = 10_000) -> DataFrame:
    """path and length of the same files as a stream: those that come to the folder, each once. What is in them isn't read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_a_batch)).load(folder)
    return _allowed(files.select("path", "length"), extensions)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of these files."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    named = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", path) for path in paths]  # names, not patterns
    return spark.read.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(named).select("path", "content")


def file_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def route_by_extension(files: DataFrame, readers: dict[str, str] = READERS) -> DataFrame:
    """Adds reader (null if none takes the extension) and skipped."""
    pairs = [F.lit(x) for pair in readers.items() for x in pair]
    reader = F.element_at(F.create_map(*pairs), extension(F.col("path")))
    return files.withColumn("reader", reader).withColumn("skipped", F.col("reader").isNull())


def dedup_files(files: DataFrame) -> DataFrame:
    """Of files with equal bytes (file_hash) the first by lower-cased path stays.

    A partial minimum per hash, then a semi join: a hash with very many files is never gathered in a window.
    """
    place = F.struct(F.lower("path").alias("lowered"), F.col("path").alias("path"))
    first = files.groupBy("file_hash").agg(F.min(place).alias("first")).select("file_hash", F.col("first.path").alias("path"))
    return files.join(first, ["file_hash", "path"], "left_semi")


def read_documents_table(docs: DataFrame) -> DataFrame:
    """A table of texts as raw documents: one page each, with hashes and identity."""
    raw = docs.select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"),
        F.lit("txt").alias("file_type"),
        F.lit(0).alias("page_num"),
        F.coalesce("text", F.lit("")).alias("raw_text"),
    )
    raw = raw.withColumn("content_hash", X.content_hash(F.col("raw_text"))).withColumn("file_hash", F.col("content_hash"))
    return raw.withColumn("doc_id", X.doc_identity(F.col("file_hash"), F.col("page_num")))


def load_text(files: DataFrame) -> DataFrame:
    """Files as one page each: source_path, file_type, file_hash, page_num, raw_text. Decoded by `charsets.py`; no content gives a null text."""
    text = decoded(F.col("content"), declares=False)["text"]
    return files.select(F.col("path").alias("source_path"), extension(F.col("path")).alias("file_type"), "file_hash", F.lit(0).alias("page_num"), text.alias("raw_text"))


def load_html(files: DataFrame) -> DataFrame:
    """Each section of a page as a document of its own; no content gives one row with a null text. Decoded by the charset the page declares, else seems to have."""
    pages = files.select("path", "file_hash", decoded(F.col("content"))["text"].alias("html"))
    parts = extract_sections(pages.filter("html IS NOT NULL"), "path", "file_hash")
    made = parts.select("path", "file_hash", F.col("section_no").alias("page_num"), F.concat_ws("\n", F.nullif("title", F.lit("")), "text").alias("raw_text"))
    lost = pages.filter("html IS NULL").select("path", "file_hash", F.lit(0).alias("page_num"), F.lit(None).cast("string").alias("raw_text"))
    return made.unionByName(lost).select(F.col("path").alias("source_path"), extension(F.col("path")).alias("file_type"), "file_hash", "page_num", "raw_text")


#: The reader of a file takes one of these; another format is added with a function from files to pages.
LOADERS = {"text": load_text, "html": load_html}


def save_documents(documents: DataFrame, path: str) -> None:
    """Clean documents as JSON lines. Null fields are written, so that every key is there on reading."""
    documents.selectExpr(*(c.split()[0] for c in CLEAN_SCHEMA.split(", "))).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Clean documents from JSON lines. A line that is no object of the schema, has an unknown key or lacks one (but metadata) is an error."""
    known = [c.split()[0] for c in CLEAN_SCHEMA.split(", ")]
    keys = F.json_object_keys("value")
    unlike = keys.isNull() | (F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0) | (F.size(F.array_except(F.array(*map(F.lit, known[:-1])), keys)) > 0)
    line = F.when(F.coalesce(unlike, F.lit(True)), F.raise_error(F.concat(F.lit("not a clean document: "), F.substring("value", 1, 200))).cast("string")).otherwise(F.col("value"))
    rows = spark.read.text(path).select(F.from_json(line, CLEAN_SCHEMA, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    return rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def clean_documents(raw: DataFrame, diacritics: bool = True, unicode_form: bool = True) -> DataFrame:
    """Raw documents with clean_text, counts, language and the hash of the clean text."""
    clean = raw.withColumn("clean_text", X.once(X.clean_text(F.col("raw_text"), diacritics, unicode_form)))
    text, ratio = F.col("clean_text"), F.col("arabic_char_ratio")
    counted = clean.withColumns({"char_count": X.char_count(text), "word_count": X.word_count(text), "raw_content_hash": F.col("content_hash"), "content_hash": X.content_hash(text), "arabic_char_ratio": X.arabic_ratio(text)})
    counted = counted.withColumn("is_arabic", ratio >= X.ARABIC_THRESHOLD)
    return counted.withColumns({"detected_lang": X.detect_lang(text, F.col("is_arabic")), "arabic_char_ratio": F.bround(ratio, 3)})


def drop_near_empty(clean: DataFrame, min_words: int = 12) -> DataFrame:
    return clean.filter(F.col("word_count") >= min_words)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON objects; blank, malformed and non-object lines are left out, and a missing path is an empty table."""
    spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not any(True for _ in store.globStatus(spot) or []):
        return spark.createDataFrame([], schema)
    return tolerant_json(spark.read.text(path), "value", schema)


def tolerant_json(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The same over a column of lines."""
    text = F.trim(F.col(column))
    wrapped = F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    objects = lines.filter(text.startswith("{")).select(wrapped.alias("row"))
    return objects.filter(F.col("row").isNotNull() & F.col("row._bad").isNull()).select("row.*").drop("_bad")


def with_case_defaults(cases: DataFrame) -> DataFrame:
    """Evaluation cases with defaults: case-N for the id, empty lists, five hits, the strict prompt."""
    nth = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a hand-written list of cases
    lists = ("expected_source_contains", "expected_chunk_contains", "expected_answer_keywords", "forbidden_source_contains")
    filled = {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists}
    return cases.withColumns(filled | {"id": F.coalesce("id", F.concat(F.lit("case-"), nth.cast("string"))), "top_k": F.coalesce("top_k", F.lit(5)), "prompt_version": F.coalesce("prompt_version", F.lit("strict"))})


def load_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a JSON array; anything but an array is an error."""
    head = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+", "")).substr(1, 1).alias("c")).first()
    if head is None or head["c"] != "[":
        raise ValueError("evaluation cases must be a JSON array")
    return with_case_defaults(spark.read.schema(CASE_SCHEMA).option("multiLine", "true").json(path))
