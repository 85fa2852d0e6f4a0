"""The incremental index: which files a run writes, commits, breaking off, many small batches against one of all."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.plans.buckets import BucketTables
from corpusloom.plans.ingest import Index, embed

SCHEMA = "chunk_id string, text string, chunk_content_hash string, metadata_json string, file_hash string"


def rows_of(files, version=0, chunks=2):
    return [(f"{f}-{k}", f"text {f} {k} {version}", f"h-{f}-{k}-{version}", "{}", f"file{f}") for f in files for k in range(chunks)]


def current(index, name):
    """The data files that make up a table now."""
    held = index.tables()
    return {f"{p}/{f}" for paths in held.places[name].values() for p in paths for f in os.listdir(f"{index.folder.removeprefix('file://')}/{p}") if f.endswith(".parquet")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", buckets=16)
    first = index.index_chunks(spark.createDataFrame(rows_of(range(40)), SCHEMA)).first()
    assert (first.new_or_changed, first.embedded, first.deleted) == (80, 80, 0)
    before = {n: current(index, n) for n in ("manifest", "vectors", "cache")}
    assert len(before["manifest"]) == 16
    same = index.index_chunks(spark.createDataFrame(rows_of(range(40)), SCHEMA)).first()
    assert (same.new_or_changed, same.unchanged) == (0, 80) and before == {n: current(index, n) for n in before}
    changed = index.index_chunks(spark.createDataFrame(rows_of([3], 1) + rows_of([4]), SCHEMA)).first()
    assert (changed.new_or_changed, changed.unchanged, changed.embedded) == (2, 2, 2)
    for name in ("manifest", "vectors"):
        assert len(before[name] - current(index, name)) == 1  # the bucket of file 3; that of file 4 is as it was
    assert before["cache"] < current(index, "cache")
    assert index.manifest().filter("chunk_content_hash LIKE '%-1'").count() == 2 and index.vectors().count() == 80


def test_a_stream_of_batches_equals_one_batch(spark, tmp_path):
    random.seed(4)
    whole, parts = (Index(spark, f"file://{tmp_path}/{n}", buckets=4) for n in "ab")
    rows = rows_of(range(30)) + rows_of(range(30, 40), chunks=5)
    whole.index_chunks(spark.createDataFrame(rows, SCHEMA))
    # a file once came with other chunks; its newest state counts
    parts.index_chunks(spark.createDataFrame(rows_of([1, 2], 9, chunks=4), SCHEMA))
    for k in range(0, 40, 8):
        parts.index_chunks(spark.createDataFrame([r for r in rows if int(r[0].split("-")[0]) in range(k, k + 8)], SCHEMA))
    for name in ("manifest", "vectors"):
        assert sorted(map(str, getattr(whole, name)().collect())) == sorted(map(str, getattr(parts, name)().collect()))
    parts.delete_files(spark.createDataFrame([(f"file{k}",) for k in range(20)], "file_hash string"))
    assert sorted({r.file_hash for r in parts.manifest().collect()}) == sorted(f"file{k}" for k in range(20, 40))
    assert parts.vectors().count() == 70


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    Index(spark, folder).index_chunks(spark.createDataFrame(rows_of(range(5)), SCHEMA))

    def broken(rows, column):
        return embed(rows, column).withColumn("embedding", F.when(F.col(column).contains("text 7"), F.raise_error(F.lit("no model"))).otherwise(F.col("embedding")))

    more = spark.createDataFrame(rows_of(range(4, 9)), SCHEMA)
    with pytest.raises(Exception, match="no model"):
        Index(spark, folder, broken).index_chunks(more)
    index = Index(spark, folder)
    assert index.manifest().count() == index.vectors().count() == 10
    report = index.index_chunks(more).first()
    assert (report.new_or_changed, report.unchanged, report.embedded) == (8, 2, 8) and index.vectors().count() == 18


def test_reset_empty_and_emptied(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index", buckets=4)
    empty = spark.createDataFrame([], SCHEMA)
    assert index.index_chunks(empty).first().new_or_changed == 0 and index.manifest().count() == 0
    index.index_chunks(spark.createDataFrame(rows_of(range(6)), SCHEMA))
    assert index.index_chunks(empty).first().deleted == 0 and index.manifest().count() == 12
    report = index.index_chunks(spark.createDataFrame(rows_of([0, 1]), SCHEMA), reset=True).first()
    assert (report.new_or_changed, report.cache_hits, report.embedded) == (4, 4, 0) and index.vectors().count() == 4
    index.delete_files(spark.createDataFrame([("file0",), ("file1",), ("nofile",)], "file_hash string"))
    assert index.manifest().count() == index.vectors().count() == 0


def test_commits_are_whole_and_guarded(spark, tmp_path):
    def opened():
        return BucketTables(spark, f"file://{tmp_path}/t", {"a": "k string, v int", "b": "k string"}, {"a": "k", "b": "k"}, 3)

    one, two = opened(), opened()
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(20)] + [(None, 99)], "k string, v int")
    one.append("a", rows)
    assert one.read("a").count() == 0 and one.written("a").count() == 21 and opened().read("a").count() == 0
    one.commit()
    assert opened().read("a").count() == 21 and opened().read("b").count() == 0
    two.append("a", rows)
    with pytest.raises(RuntimeError, match="another writer"):
        two.commit()
    assert opened().read("a").count() == 21


def test_appended_buckets_are_made_one_and_old_files_go(spark, tmp_path):
    held = BucketTables(spark, f"file://{tmp_path}/t", {"a": "k string"}, {"a": "k"}, 2)
    for i in range(5):
        held.append("a", spark.createDataFrame([(f"k{i}-{j}",) for j in range(10)], "k string"), most=3)
        held.commit()
    assert max(map(len, held.places["a"].values())) < 3 and held.read("a").distinct().count() == held.read("a").count() == 50
    assert held.vacuum(keep=1) > 0
    again = BucketTables(spark, f"file://{tmp_path}/t", {"a": "k string"}, {"a": "k"})
    assert again.buckets == 2 and again.read("a").count() == 50 and again.number == held.number
