"""What a run and the deletion of a job leave on disk: no table twice, no work tables; texts aren't shuffled to meet keys."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.ingest import Index, load_files, read_latest, run_pipeline
from corpusloom.plans.jobs import Jobs
from corpusloom.sources import shared

TEXT = "The quick brown fox jumps over the lazy dog while twelve other animals watch number {}. " * 6


def files(spark, *names):
    return spark.createDataFrame([(f"in/{n}.txt", TEXT.replace("{}", n.split("=")[-1]).encode()) for n in names], "path string, content binary")


def size(path):
    return sum(os.path.getsize(f"{folder}/{f}") for folder, _, found in os.walk(path) for f in found if f.endswith(".parquet"))


def paths(spark, folder, name):
    return sorted(r["source_path"] for r in read_latest(spark, f"{folder}/{name}").select("source_path").distinct().collect())


def broken(rows, column):
    raise RuntimeError("no model")


def test_a_run_writes_no_table_twice(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    index = Index(spark, f"{folder}/index", buckets=2)
    run_pipeline(files(spark, "a", "b"), folder, "r1", "now", index=index)
    assert size(f"{tmp_path}/run/pages/latest") == size(f"{tmp_path}/run/chunks/latest") == 0 < size(f"{tmp_path}/run/pages/snapshots")
    assert not os.path.exists(f"{tmp_path}/run/index/work") and index.manifest().count() == 2
    pages, snapshot = read_latest(spark, f"{folder}/pages"), spark.read.parquet(f"{folder}/pages/snapshots/run=r1")
    assert set(snapshot.columns) - set(pages.columns) == {"kept", "failed"}
    assert paths(spark, folder, "pages") == paths(spark, folder, "chunks") == ["in/a.txt", "in/b.txt"]


def test_latest_stays_when_its_snapshot_changes_or_goes(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    run_pipeline(files(spark, "a", "b"), folder, "r1", "now")
    with pytest.raises(RuntimeError):  # the same run again, which fails after its snapshots are written
        run_pipeline(files(spark, "c"), folder, "r1", "now", index=Index(spark, f"{folder}/index", broken, "other"))
    assert paths(spark, folder, "pages") == paths(spark, folder, "chunks") == ["in/a.txt", "in/b.txt"]
    run_pipeline(files(spark, "c"), folder, "r1", "now")
    assert paths(spark, folder, "pages") == paths(spark, folder, "chunks") == ["in/c.txt"]
    run_pipeline(files(spark), folder, "r2", "now")  # no pages: nothing of the latest tables belongs to the job, but its snapshots go
    jobs = Jobs(spark, f"{folder}/jobs")
    jobs.save(spark.createDataFrame([("x", "p", "txt", "in/a", ["h"], [], "r2", "indexed", "1", "1")], Jobs.SCHEMA))
    assert jobs.delete("x", folder) == {"vectors": 0, "rows": 0, "snapshots": 2, "jobs": 0}
    assert paths(spark, folder, "pages") == paths(spark, folder, "chunks") == []


@pytest.mark.parametrize("most", [500_000, 0])
def test_rows_that_share_a_path_or_file_with_a_job_go_too(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(shared, "SMALL_LIST", most)
    folder = f"file://{tmp_path}/run"
    run_pipeline(files(spark, "x/1", "y/2", "y/3", "z/4", "z/5"), folder, "r1", "now")
    hashes = {r["source_path"]: r["file_hash"] for r in read_latest(spark, f"{folder}/pages").collect()}
    jobs = Jobs(spark, f"{folder}/jobs")
    jobs.save(spark.createDataFrame([("x", "p", "txt", "in/x", [hashes["in/y/2.txt"]], ["in/z/5.txt", "in/none"], None, "indexed", "1", "1")], Jobs.SCHEMA))
    assert jobs.delete("x", folder)["rows"] == 6
    assert paths(spark, folder, "pages") == paths(spark, folder, "chunks") == ["in/y/3.txt", "in/z/4.txt"]


def test_texts_are_not_shuffled_to_meet_keys(spark, tmp_path):
    rows = files(spark, "b/=1", "a/=1", "c/=2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages, counts = load_files(rows)
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert [r["source_path"] for r in pages.collect()] == ["in/a/=1.txt", "in/c/=2.txt"] and counts.first().asDict() == {"given": 3, "files": 2}
        left = shared.without(rows.withColumn("k", F.col("path")), spark.createDataFrame([("in/c/=2.txt",), ("in/d",)], "k string"), "k")
        assert left.count() == 2
        for shown in (plan, left._jdf.queryExecution().executedPlan().toString()):
            assert "BroadcastHashJoin" in shown and "LeftAnti" in shown.split("BroadcastHashJoin")[1].split("\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
