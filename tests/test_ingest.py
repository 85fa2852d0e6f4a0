"""Whole runs, projects, jobs and activities, loose records, strict documents: on small inputs of our own."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.normalizers import FIELDS, normalize
from corpusloom.operators import aggregates, questions, tables
from corpusloom.plans.ingest import Collections, Index, delete_ingestion, read_latest, run_pipeline, write_latest
from corpusloom.sources import documents as sources
from corpusloom.sources.documents import LOADERS

LONG = "The quick brown fox jumps over the lazy dog while twelve other animals watch. " * 8
PAGE = f"<html><body><article><h1>First</h1><p>{LONG}</p></article><article><h1>Second</h1><p>short</p></article></body></html>"
FILES = [
    ("in/a.txt", LONG.encode()),
    ("in/B.TXT", LONG.encode()),
    ("in/c.html", PAGE.encode()),
    ("in/d.bin", b"x"),
    ("in/noextension", b"x"),
    ("in/e.md", b"few words"),
    ("in/f.md", None),
    ("in/g.txt", b""),
    ("in/h.txt", b"\xff\xfe " + LONG.upper().encode()),
]


def files(spark, rows=FILES):
    return spark.createDataFrame(rows, "path string, content binary")


def test_whole_run_counts_what_it_skips(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    index = Collections(spark, folder).create("p")
    got = run_pipeline(files(spark), folder, "r1", "now", index=index).first()
    assert (got.files, got.raw_pages, got.clean_docs) == (5, 6, 3)  # a, c, e, g, h read; c has two sections
    assert got.skipped == 2 + 1 + 1 + 3  # unsupported, copy, no content, near-empty pages
    chunks = read_latest(spark, f"{folder}/chunks")
    assert chunks.count() == got.chunks == index.vectors().count() == index.manifest().count() == 3
    assert {r.source_path for r in chunks.select("source_path").collect()} == {"in/a.txt", "in/c.html", "in/h.txt"}
    again = run_pipeline(files(spark), folder, "r2", "later", index=index).first()
    assert again == got and index.manifest().count() == got.chunks
    assert spark.read.parquet(f"{folder}/chunks/snapshots").groupBy("run").count().count() == 2


def test_failed_indexing_leaves_latest(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    run_pipeline(files(spark), folder, "r1", "now")

    def broken(rows, column):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        run_pipeline(files(spark, FILES[:1]), folder, "r2", "now", index=Index(spark, f"{folder}/index", broken, "other"))
    assert read_latest(spark, f"{folder}/pages").count() == 3
    assert spark.read.parquet(f"{folder}/pages/snapshots/run=r2").count() == 1


def test_a_loader_of_ones_own_and_no_files(spark, tmp_path):
    folder = f"file://{tmp_path}/run"

    def shout(some):
        return LOADERS["text"](some).withColumn("raw_text", F.upper("raw_text"))

    got = run_pipeline(files(spark), folder, "r1", "now", loaders={"text": shout}).first()
    assert got.raw_pages == 4 and read_latest(spark, f"{folder}/pages").filter(F.col("clean_text") == F.upper("clean_text")).count() == 2
    none = run_pipeline(files(spark, []), folder, "r2", "now").first()
    assert none.asDict() == {"files": 0, "raw_pages": 0, "clean_docs": 0, "skipped": 0, "chunks": 0}


def test_latest_needs_a_complete_run(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_latest(spark, f"file://{tmp_path}/none")
    write_latest(spark.range(2), f"file://{tmp_path}", "z")
    write_latest(spark.range(3), f"file://{tmp_path}", "a")
    (tmp_path / "latest" / "zz").mkdir()
    assert read_latest(spark, f"file://{tmp_path}").count() == 3


def test_projects(spark, tmp_path):
    every = Collections(spark, f"file://{tmp_path}/projects")
    assert not every.exists("a") and not every.delete("a") and not every.has_points("a")
    rows = spark.createDataFrame([("c", "x", "h", "{}", "f"), ("d", "y", "i", "{}", "g")], "chunk_id string, text string, chunk_content_hash string, metadata_json string, file_hash string")
    every.create("a").index_chunks(rows)
    every.create("b")
    assert every.has_points("a") and not every.has_points("b") and every.exists("b")
    assert every.create("a").vectors().count() == 2
    assert every.create("a").index_chunks(rows.limit(1), reset=True).first().cache_hits == 1
    assert every.create("a").vectors().count() == 1
    every.delete("a")
    assert not every.exists("a") and every.exists("b")
    for name in ("", "..", "a/b"):
        with pytest.raises(ValueError):
            every.path(name)


def test_deletion_counts_and_needs_a_match(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "a/x", "f"), ("c2", "a/y", "g"), ("c3", "b", "h")], "chunk_id string, source_path string, file_hash string")
    index = Index(spark, f"file://{tmp_path}/index")
    index.index_chunks(rows.withColumns({"text": F.col("chunk_id"), "chunk_content_hash": F.col("chunk_id"), "metadata_json": F.lit("{}")}))
    kept, counts = delete_ingestion(rows, "a", index)
    assert [r.chunk_id for r in kept.collect()] == ["c3"]
    assert counts.first().asDict() == {"paths": 2, "hashes": 2, "rows_matched": 2}
    assert [r.chunk_id for r in index.vectors().collect()] == [r.chunk_id for r in index.manifest().collect()] == ["c3"]
    with pytest.raises(LookupError):
        delete_ingestion(rows, "nowhere", index)


def test_documents_round_trip_is_strict(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    made = spark.createDataFrame([("d", "a", "txt", 0, "x\n\"y\" é", 5, None, "en", False, {"k": "v"})], sources.CLEAN_SCHEMA)
    sources.save_documents(made.withColumn("more", F.lit(1)), path)
    assert sources.load_documents(spark, path).collect() == made.collect()
    whole = '{"doc_id": "d", "source_path": "a", "file_type": "t", "page_num": 0, "clean_text": "", "char_count": 0, "word_count": 0, "detected_lang": "en", "is_arabic": false'
    (tmp_path / "ok.jsonl").write_text(whole + "}\n")
    assert sources.load_documents(spark, f"{tmp_path}/ok.jsonl").first().metadata == {}
    for k, bad in enumerate((whole + ', "colour": 1}', '{"doc_id": "d"}', "no json", "[1]", whole.replace('"page_num": 0', '"page_num": "z"') + "}")):
        (tmp_path / f"bad{k}.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="clean document|MALFORMED"):
            sources.load_documents(spark, f"{tmp_path}/bad{k}.jsonl").collect()


def test_jobs(spark):
    schema = "id string, status string, created_at int, updated_at int"
    jobs = spark.createDataFrame([("a", "queued", 1, 1), ("b", "queued", 2, 2)], schema)
    saved = tables.save_jobs(jobs, spark.createDataFrame([("a", "failed", 5, 5), ("a", "indexed", 6, 6), ("c", "queued", 7, 7)], schema))
    assert sorted((r.id, r.status, r.created_at) for r in saved.collect()) == [("a", "indexed", 1), ("b", "queued", 2), ("c", "queued", 7)]
    assert tables.get_job(saved, "a").count() == 1 and tables.get_job(saved, "z").count() == 0
    assert [r.id for r in tables.list_jobs(tables.delete_job(saved, "b"), 5).collect()] == ["c", "a"]
    assert aggregates.job_counts(saved).first().asDict() == {"active": 2, "completed": 1, "failed": 0}
    assert aggregates.average_score_percent(spark.createDataFrame([], "score double")).first().average_score == 0
    grown = tables.append_activity(jobs.select(F.col("id").alias("event_id"), F.col("created_at").alias("ts")), spark.createDataFrame([("n", 9)], "event_id string, ts int"), n=2)
    assert [r.event_id for r in grown.collect()] == ["n", "b"]


def test_sessions_need_question_and_answer(spark):
    rows = [(1, "query", 1, "q", ""), (2, "query", 2, "q", None), (3, "error", 3, "q", "a"), (4, "query", 4, "r", "b")]
    got = questions.sessions_from_activity(spark.createDataFrame(rows, "event_id long, type string, ts int, question string, answer string"))
    assert [r.session_id for r in got.collect()] == ["activity-session-4", "activity-session-1"]


def test_normalizers(spark):
    def made(kind, record, metadata=None, number=7):
        df = spark.createDataFrame([(record, metadata, number)], "r map<string,string>, m map<string,string>, n int")
        return df.select(normalize(kind, F.col("r"), F.col("m"), F.col("n")).alias("v")).first()["v"]

    for kind in FIELDS:
        empty = made(kind, None)
        assert empty == made(kind, {}) and ("id" not in FIELDS[kind] or empty["id"].endswith("-7"))
    chunk = made("chunk", {"source": "  ", "similarity": "0.5", "page": "x"}, {"source_path": "p", "page": "3"})
    assert (chunk.source, chunk.score, chunk.page_number) == ("p", 0.5, None)
    assert made("chunk", {"score": "NaN"}).score == made("chunk", {"score": "1e999"}).score == 0.0
    job = made("job", {"status": "INDEXED", "chunks_created": "", "created_at": "2024-01-02T03:04:05"})
    assert (job.status, job.chunks_created, job.created_at.year) == ("indexed", 0.0, 2024)
    assert made("job", {"status": "lost", "progress": "half"}).status == "queued"
    assert made("stats", {"retrieval_health": "HEALTHY"}).retrieval_health == "offline"
    assert made("activity", {"type": "error", "message": "m", "title": "t"}).description == "m"
