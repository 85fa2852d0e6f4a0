import random

import numpy as np

import corpus_pipeline
from corpusloom.llm import near_copies
from corpusloom.llm.near_copies import prefix, shingles, similar
from corpusloom.llm.simhash import keep_representatives
from tests.conftest import SF
from tests.llm.conftest import HARD
from tests.llm.test_simhash import slow


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def kept_ids(rows):
    """The smallest id of each component of: SimHash of three words within 2 bits, or five-word sets of similarity 0.8; all pairs."""
    rows = sorted(rows)
    prints, sets, parent = [slow(t) for _, t in rows], [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 2 or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(i for k, (i, _) in enumerate(rows) if find(k) == k)


def cases():
    """Copies changed at up to so many places, a large group around one text with others at its edge, a passage that many hold."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]

    def changed(words, n):
        words = list(words)
        for k in rng.sample(range(len(words)), n):
            words[k] = f"x{rng.randrange(100_000)}"
        return words

    rows = [text(rng.randint(0, 90)) for _ in range(60)]
    rows += [changed(w, rng.randint(1, 3)) for w in rows if len(w) > 20]
    large = text(120)
    rows += [changed(large, rng.choice((1, 1, 2, 3, 4))) for _ in range(90)]
    passage = text(25)
    rows += [text(rng.randint(0, 12)) + passage + text(rng.randint(0, 12)) for _ in range(60)]
    rows += [["w"] * n for n in (5, 6, 9, 40)] + [large, large, large]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_stage_links_what_brute_force_links(spark, make_docs, monkeypatch):
    rows = cases()
    for often in (3, 1):  # whatever counts as frequent, the result is the same
        monkeypatch.setattr(near_copies, "OFTEN", often)
        got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, make_docs(rows), SF).collect())
        assert got == kept_ids(rows)
    assert len(got) < keep_representatives(make_docs(rows)).count()  # what SimHash alone leaves


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect())
    assert got == kept_ids([(r.doc_id, r.text) for r in docs.collect()])


def test_stage_on_hard_rows(spark, hard, clashing, empty):
    assert corpus_pipeline.near_dedup_stage(spark, empty, SF).collect() == []
    assert corpus_pipeline.near_dedup_stage(spark, clashing, SF).columns == clashing.columns
    assert 0 < corpus_pipeline.near_dedup_stage(spark, hard, SF).count() < len(HARD)


def test_similar_sets_meet_in_their_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 40)))
        b = np.unique(np.concatenate((rng.permutation(a)[: rng.integers(1, len(a) + 1)], rng.integers(0, 60, rng.integers(0, 4)))))
        a, b = sorted((a, b), key=len)
        frequent = np.unique(rng.integers(0, 60, rng.integers(0, 30)))
        if similar(a, b):
            (x, short), (y, _) = prefix(a, frequent), prefix(b, frequent)
            assert set(x[:short]) & set(y)
    assert not len(shingles(b"a b c d")) and len(shingles(b"A b c d e")) == 1


def test_pairs_of_a_group_at_the_edge_grow_with_its_size(spark, make_docs, monkeypatch):
    """Texts of 300 words with four changed each: most pairs are just below 0.8, but all are one group."""
    verified = []
    whole = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda texts, pairs, *a, **b: verified.append(pairs.count()) or whole(texts, pairs, *a, **b))
    rng = random.Random(4)
    base, made = [f"w{rng.randrange(100_000)}" for _ in range(300)], {}
    for n in (300, 900):
        rows = []
        for i in range(n):
            words = list(base)
            for k in rng.sample(range(300), 4):
                words[k] = f"x{rng.randrange(100_000)}"
            rows.append((i, " ".join(words)))
        verified.clear()
        got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, make_docs(rows), SF).collect())
        made[n] = sum(verified)
        if n == 300:
            assert got == kept_ids(rows)
        else:
            assert got == [0]
    assert made[900] <= 1.3 * 3 * made[300]


def test_small_tables_of_the_rounds_take_few_tasks(spark, make_docs):
    """Also where AQE is told not to merge partitions: most of the many stages see a few hundred rows, and should not have a task for each partition of a shuffle."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(100_000)}" for _ in range(120)]
    rows = [(i, " ".join(f"x{i}" if k == i % 120 else w for k, w in enumerate(base))) for i in range(60)]
    given = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in given}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "near-dedup of 60 texts")
        assert [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, make_docs(rows), SF).collect()] == [0]
        stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
        ran = [x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x is not None and x.numCompletedTasks]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(n >= 40 for n in ran) < 0.2 * len(ran)


def test_sets_of_pairs_stay_out_of_python(spark, make_docs, monkeypatch):
    """A batch of pairs of long sets takes as much of a worker's memory as its rows need, whatever the input; as rows of Spark they are compared one at a time."""
    plans, whole = {}, near_copies.table
    monkeypatch.setattr(near_copies, "table", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and whole(df, name))
    rows = cases()
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, make_docs(rows), SF).collect())
    assert got == kept_ids(rows)
    assert all("Join" in plans[k] and "MapInArrow" not in plans[k] for k in ("near-likely", "near-links"))


def test_sets_in_spark_are_similar_as_in_numpy(spark):
    rng = random.Random(7)
    pairs = [([], []), ([1], []), ([1], [1])]
    for _ in range(300):
        a = rng.sample(range(1 << 40), rng.randint(1, 40))
        b = rng.sample(a, rng.randint(max(0, len(a) - 6), len(a))) + rng.sample(range(1 << 41, 1 << 42), rng.randint(0, 5))
        pairs.append((a, b))
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    got = [r[0] for r in frame.select(near_copies._similar(frame["a"], frame["b"])).collect()]
    assert got == [similar(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs] and True in got and False in got
