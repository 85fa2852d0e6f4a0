"""Vector search in cells against scoring all, with filters, ties and clusters."""

import numpy as np
import pytest

from corpusloom.operators import retrieval
from corpusloom.operators.vectors import TopK, VectorTable


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centers = unit(rng.normal(size=(12, 16)))
    points = unit(np.repeat(centers, 60, axis=0) + 0.05 * rng.normal(size=(720, 16)))
    points[100:110] = points[100]  # ties
    queries = unit(np.concatenate((centers[:6] + 0.05 * rng.normal(size=(6, 16)), rng.normal(size=(4, 16)), points[100:101])))
    label = np.arange(720) % 7
    rows = [(f"c{i:03d}", p.tolist(), int(label[i])) for i, p in enumerate(points)]
    table = VectorTable.build(spark.createDataFrame([*rows, ("none", None, 1)], "chunk_id string, vector array<double>, label int"), f"file://{tmp_path_factory.mktemp('v')}/t", cells=24)
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, vector array<double>")
    return points, queries, label, table, asked


def want(points, queries, k, keep):
    out = set()
    for q, v in enumerate(queries):
        order = sorted((-round(float(v @ points[i]), 9), f"c{i:03d}") for i in np.flatnonzero(keep))
        out |= {(q, c, n) for n, (_, c) in enumerate(order[:k], 1)}
    return out


def got(frame):
    return {(r["query_id"], r["chunk_id"], r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize(("k", "labels"), [(5, None), (15, [1, 2]), (40, [3]), (200, [3]), (1, None)])
def test_search_equals_scoring_all(made, k, labels):
    points, queries, label, table, asked = made
    keep = np.isin(label, labels) if labels else np.ones(len(label), dtype=bool)
    assert got(table.search(asked, k, {"label": labels}, query_batch=4)) == want(points, queries, k, keep)


def test_fewer_cells_are_scored_than_there_are(made, monkeypatch):
    points, queries, label, table, asked = made
    turns = []
    whole = VectorTable._scored
    monkeypatch.setattr(VectorTable, "_scored", lambda self, rows, matrix, numbers, wanted, *a: turns.append(wanted.copy()) or whole(self, rows, matrix, numbers, wanted, *a))
    assert got(table.search(asked, 5)) == want(points, queries, 5, np.ones(len(label), dtype=bool))
    seen = turns[0] | turns[1]
    assert not (turns[0] & turns[1]).any()
    assert seen.sum() < 0.5 * seen.size  # of pairs of query and cell


def test_filters_reach_the_files(made):
    *_, table, _ = made
    from corpusloom.operators.tables import metadata_filter

    plan = table.points.filter("cell IN (1, 2)").filter(metadata_filter({"label": [1, 2]})).select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "PushedFilters: [In(label" in plan


def test_search_with_oversampling(made, spark):
    points, queries, label, table, asked = made
    hits = spark.createDataFrame([(f"c{i:03d}", f"h{i // 2}", str(i // 60)) for i in range(len(points))], "chunk_id string, chunk_content_hash string, document_group_id string")
    found = retrieval.search(asked, table, hits, 4, cap=None, min_score=None).collect()
    for q, v in enumerate(queries):
        order = sorted((-round(float(v @ p), 9), i) for i, p in enumerate(points))[:12]
        best, seen = [], set()
        for _, i in order:
            if i // 2 not in seen and len(best) < 4:
                best.append(f"c{i:03d}")
                seen.add(i // 2)
        assert [r["chunk_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == best
    plain = retrieval.search(asked, table, hits, 4, dedup=False, cap=None)
    assert got(plain) == want(points, queries, 4, np.ones(len(label), dtype=bool))


def test_empty_tables(spark, made):
    *_, table, asked = made
    assert table.search(asked.limit(0), 3).collect() == []
    nothing = VectorTable.build(spark.createDataFrame([], "chunk_id long, vector array<float>"))
    assert nothing.search(asked, 3).collect() == []
    with pytest.raises(ValueError, match="cells"):
        VectorTable.build(asked, cells=0)


def test_best_k_in_blocks():
    rng = np.random.default_rng(5)
    best, every = TopK(7, 3), []
    best.most = 40
    for at in range(0, 300, 50):
        which, scores = np.flatnonzero(rng.random(7) < 0.7), rng.integers(0, 12, (7, 50)).astype(float)
        best.add(which, np.arange(at, at + 50), scores[which])
        every += [(q, -scores[q, c], at + c) for q in which for c in range(50)]
    q, ids, scores = best.settle()
    assert sorted(zip(q.tolist(), (-scores).tolist(), ids.tolist(), strict=True)) == sorted(x for k in range(7) for x in sorted(e for e in every if e[0] == k)[:3])


def test_scores_are_held_in_tiles(monkeypatch):
    """All queries against a block of points at once took memory with the number of queries."""
    from corpusloom.operators import vectors

    monkeypatch.setattr(vectors, "SCORE_BLOCK", 600)
    rng = np.random.default_rng(7)
    matrix, points = rng.normal(size=(90, 4)), np.repeat(rng.normal(size=(100, 4)), 2, axis=0)  # each point twice: ties
    best, seen, add = TopK(90, 3), [], TopK.add
    monkeypatch.setattr(TopK, "add", lambda self, which, ids, scores: seen.append(scores.size) or add(self, which, ids, scores))
    for at in range(0, 200, 50):
        best.score(np.arange(90), matrix, np.arange(at, at + 50), points[at : at + 50])
    assert max(seen) <= 600 and sum(seen) == 90 * 200
    assert best.size < 4 * 90 * 8  # of a block, no more than the best with their ties were held
    q, ids, _ = best.settle()
    scores = matrix @ points.T
    want = [(k, i) for k in range(90) for i in sorted(range(200), key=lambda i: (-round(scores[k, i], 9), i))[:3]]
    assert list(zip(q.tolist(), ids.tolist(), strict=True)) == want
