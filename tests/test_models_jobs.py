"""A model of one's own, jobs with all that belongs to them, statistics that add up, answers of a generator that fails."""

import math
import os
import random
import statistics

import numpy as np
import pandas as pd
import pytest

from corpusloom.operators import aggregates, questions
from corpusloom.operators.embedding import Model
from corpusloom.plans.ingest import Index, embed, read_latest, run_pipeline
from corpusloom.plans.jobs import Jobs


def loader(folder):
    """A model that notes in which process it was loaded, and what it was asked."""

    def load():
        with open(f"{folder}/loads", "a") as file:
            file.write(f"{os.getpid()}\n")

        def predict(texts):
            with open(f"{folder}/asked-{os.getpid()}", "a") as file:
                file.write(f"{len(texts)}\n")
            return np.array([[len(t), t.count("a"), 1.0] for t in texts])

        return predict

    return load


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    model = Model("counts", str(tmp_path), loader(tmp_path), batch_rows=7)
    rows = spark.createDataFrame([(i, "a" * (i % 5)) for i in range(100)] + [(100, None)], "c1 long, text string").repartition(12)
    for _ in range(2):
        got = model.embed(rows, "text").collect()
    assert len(got) == 101
    for r in got:
        said = f"passage: {r['text'] or ''}"
        want = np.array([len(said), said.count("a"), 1.0])
        np.testing.assert_allclose(r["embedding"], want / np.linalg.norm(want), rtol=1e-6)
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) and max(int(n) for f in tmp_path.glob("asked-*") for n in f.read_text().split()) <= 7
    asked = model.embed(rows.limit(1), "text", "query").first()
    assert asked["embedding"][0] < 1 and model.key == f"counts|{tmp_path}|normalize_embeddings=True"


def test_vectors_of_two_models_are_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "h", "{}", "f")], "chunk_id string, text string, chunk_content_hash string, metadata_json string, file_hash string")
    one = Model("counts", "1", loader(tmp_path))
    two = Model("counts", "1", loader(tmp_path), normalize=False)
    for model, norm in ((one, 1.0), (two, None)):
        index = Index(spark, f"file://{tmp_path}/index", embed=model.embed, model_key=model.key)
        report = index.index_chunks(rows, reset=True).first()
        assert report.embedded == 1 and report.cache_hits == 0
        length = float(np.linalg.norm(index.vectors().first()["embedding"]))
        assert length == pytest.approx(1.0) if norm else length > 2


def murmur3(data, seed=42):
    """32 bits, for tests: the hash of the default model."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    mix = lambda k: rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if len(data) > whole:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_default_model_by_definition(spark):
    texts = ["", "one two two", "The passage HAS been 12_3 مدرسة here", "é ñ ..."]
    got = embed(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    for r in got:
        import re

        counts = np.zeros(256)
        for w in re.findall(r"[A-Za-z0-9_]+|[؀-ۿ]+", f"passage: {r['t']}"):
            counts[murmur3(w.lower().encode()) % 256] += 1
        np.testing.assert_allclose(r["embedding"], counts / np.linalg.norm(counts), atol=1e-6)


def test_statistics_add_up_over_parts(spark):
    rng = random.Random(1)
    rows = [(s, f"d{rng.randrange(9)}", rng.choice((0, 1, 79, 80, 250, 251, 512, 513, rng.randrange(1000))), rng.random() < 0.3) for s, n in (("a", 101), ("b", 40), ("c", 1), (None, 2)) for _ in range(n)]
    frame = spark.createDataFrame(rows, "strategy string, source_doc_id string, token_count int, is_arabic boolean")
    parts = aggregates.size_histogram(frame.filter("token_count < 200")).unionByName(aggregates.size_histogram(frame.filter("token_count >= 200")))
    for got in (aggregates.histogram_stats(parts).collect(), aggregates.chunk_stats(frame).collect()):
        assert len(got) == 4
        for r in got:
            sizes = [t for s, _, t, _ in rows if s == r["strategy"]]
            spread = statistics.stdev(sizes) if len(sizes) > 1 else 0.0
            assert r["median_tokens"] == math.floor(statistics.median(sizes)) and r["total_tokens"] == sum(sizes)
            assert r["stdev_tokens"] == pytest.approx(spread, abs=0.051) and r["avg_tokens"] == pytest.approx(statistics.mean(sizes), abs=0.051)
            assert (r["tiny"], r["in_range"], r["oversize"], r["hard_oversize"]) == tuple(sum(map(f, sizes)) for f in (lambda t: t < 80, lambda t: 80 <= t <= 250, lambda t: t > 250, lambda t: t > 512))
    assert aggregates.chunk_stats(frame.limit(0)).collect() == []


def test_one_failing_prompt_fails_alone(spark):
    asked = spark.createDataFrame([(i,) for i in range(40)], "query_id long").coalesce(1)
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "query_id long, prompt string")

    def generate(batch):
        if any(p.endswith("7") for p in batch):
            raise RuntimeError("no")
        return pd.Series([None if p == "p3" else f"to {p}" for p in batch])

    sources = spark.createDataFrame([(1, "b", "x", 0, 2), (1, "a", "y", 1, 1), (7, "c", "z", 0, 1)], "query_id long, source_doc_id string, source_path string, page_num int, place int")
    got = {r["query_id"]: r for r in questions.answers(asked, prompts, generate, sources).collect()}
    assert {i: r["answer"] for i, r in got.items()} == {i: f"to p{i}" if i < 30 and i not in (3, 7, 17, 27) else questions.IDK for i in range(40)}
    assert [s["source_doc_id"] for s in got[1]["sources"]] == ["a", "b"] and len(got[7]["sources"]) == 1 and got[35]["sources"] == []
    assert {r["answer"] for r in questions.answers(asked, prompts, lambda b: pd.Series(["one"])).collect()} <= {"one", questions.IDK}
    assert questions.answers(asked, prompts, None, sources).filter("size(sources) > 0").count() == 2


def job(id_, path, hashes=(), paths=(), run=None, project="p", at="1"):
    return (id_, project, "txt", path, list(hashes), list(paths), run, "indexed", at, at)


def test_jobs_keep_the_id_of_what_they_repeat(spark, tmp_path):
    jobs = Jobs(spark, f"file://{tmp_path}/jobs")
    make = lambda *rows: spark.createDataFrame(list(rows), Jobs.SCHEMA)
    jobs.save(make(job("a", "in/x", ["h1"]), job("b", "in/y", ["h2"], ["s"]), job("c", "in/x", project="other")))
    jobs.save(make(job("d", "in/x", at="5"), job("e", "in/z", ["h2"], at="6"), job("f", "new", ["h9"], at="7")))
    got = {r["id"]: (r["input_path"], r["created_at"], r["updated_at"]) for r in jobs.all().collect()}
    assert got == {"a": ("in/x", "1", "5"), "b": ("in/z", "1", "6"), "c": ("in/x", "1", "1"), "f": ("new", "7", "7")}


def test_deleting_a_job_takes_all_that_is_its(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    text = "The quick brown fox jumps over the lazy dog while twelve other animals watch number {}. " * 6
    files = lambda *names: spark.createDataFrame([(f"in/{n}.txt", text.replace("{}", n).encode()) for n in names], "path string, content binary")
    index, jobs = Index(spark, f"{folder}/index", buckets=4), Jobs(spark, f"{folder}/jobs")
    run_pipeline(files("x/1", "x/sub/2", "y/3", "xy/4"), folder, "r1", "now", index=index)
    jobs.save(spark.createDataFrame([job("x", "in/x", run="r9"), job("sub", "in/x/sub"), job("y", "in/y", run="r1"), job("xy", "in/xy")], Jobs.SCHEMA))
    with pytest.raises(LookupError):
        jobs.delete("nobody", folder, index)
    counts = jobs.delete("x", folder, index)
    assert counts == {"vectors": 2, "rows": 4, "snapshots": 0, "jobs": 1}
    assert {r["id"] for r in jobs.all().collect()} == {"y", "xy"}
    for name in ("pages", "chunks"):
        assert {r["source_path"] for r in read_latest(spark, f"{folder}/{name}").collect()} == {"in/y/3.txt", "in/xy/4.txt"}
    assert index.manifest().count() == index.vectors().count() == 2

    # a deletion that broke off after the index is run again
    kept = read_latest(spark, f"{folder}/chunks").filter("source_path = 'in/y/3.txt'")
    index.delete_files(kept)
    again = jobs.delete("y", folder, index)  # the rows and snapshots of its run r1 as well
    assert again["vectors"] == 1 and again["rows"] == 4 and again["snapshots"] == 2
    assert index.manifest().count() == 0 and read_latest(spark, f"{folder}/pages").count() == 0
    with pytest.raises(LookupError):
        jobs.delete("y", folder, index)
    with pytest.raises(LookupError, match="nothing belongs"):
        jobs.delete("xy", folder, index)
