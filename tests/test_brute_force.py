"""Queries without SQL, recomputed in plain Python over the smallest data set."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.operators import retrieval
from tests.conftest import SF

TOKEN = re.compile(r"[A-Za-z0-9_]+|[؀-ۿ]+")


def test_conversation_contexts(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        if r["role"] in ("user", "assistant"):
            turns[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    want = {}
    for conv, said in turns.items():
        said.sort()
        pairs = []
        for (turn, role, text), (_, next_role, reply) in zip(said, said[1:], strict=False):
            if role == "user" and next_role == "assistant":
                kept, n = [], 0
                for p in pairs[-3:]:
                    if n + len(p) > 1800:
                        break
                    kept.append(p)
                    n += len(p)
                want[conv, turn] = "\n\n".join(kept)
                pairs.append(f"User: {text}\nAssistant: {reply}".strip())
    got = {(r["conv_id"], r["turn"]): r["context"] for r in catalog.queries()["p10_conversation_context"](spark, SF).collect()}
    assert got == want and any(want.values())


def test_short_sections(spark):
    """All sections of all pages, some of a few words."""
    pages = defaultdict(list)
    for r in catalog.queries()["s6_extract_html_sections"](spark, SF).collect():
        pages[r["page_id"]].append((r["section_no"], r["title"], r["text"]))
    want = set()
    for page, sections in pages.items():
        done = []
        waiting = []
        ordered = [(t, x) for _, t, x in sorted(sections)]
        for k, section in enumerate(ordered):
            waiting.append(section)
            text = "\n".join(x for _, x in waiting)
            short = len(text.split()) < 200
            if short and k + 1 < len(ordered):
                continue
            if short and done:
                before = done.pop()
                waiting = [before, *waiting]
            done.append((next((t for t, _ in waiting if t), waiting[-1][0]), "\n".join(x for _, x in waiting)))
            waiting = []
        want |= {(page, k, t, x) for k, (t, x) in enumerate(done)}
    assert {tuple(r) for r in catalog.queries()["k10_merge_short_sections"](spark, SF).select("page_id", "section_no", "heading", "text").collect()} == want
    assert want


def words(text):
    return {t.lower() for t in TOKEN.findall(text) if len(t) > 1}


def features(query, text, df):
    """Of one variant against one candidate, straight from the rules."""
    asked, have, low = words(query), words(text), text.lower()
    script = any(re.search(s, query) and re.search(s, text) for s in ("[A-Za-z]", "[؀-ۿ]"))
    if not script:
        return None
    out = {"live": bool(asked)}
    if asked:
        out["coverage"], out["overlap"] = len(asked & have) / len(asked), len(asked & have)
        long = {t for t in asked if len(t) >= 4}
        out["informative"] = len(long & {t for t in have if len(t) >= 4}) / len(long) if long else 0.0
        weight = {t: 1 / df.get(t, 1) for t in asked}
        out["weighted"] = sum(w for t, w in weight.items() if t in have) / max(sum(weight.values()), 1e-9)
        row = [t.lower() for t in TOKEN.findall(query) if len(t) >= 3]
        out["bigrams"] = sum(f"{a} {b}" in low for a, b in zip(row, row[1:], strict=False) if len(a) >= 4 or len(b) >= 4)
        out["phrase"] = len(query) >= 8 and query.lower() in low
        numbers = lambda t: set(re.findall(r"[0-9]+(?:[.,][0-9]+)?", t))
        out["number"] = bool(numbers(query) & numbers(text))
    return out


@pytest.fixture(scope="module")
def reranked(spark):
    """Candidates with texts and variants, ranked by the engine and by hand."""
    texts = [
        "The river crossed the old valley in 1987 and 12.5 miles below it",
        "An old river valley crossed by rivers",
        "مدرسة قديمة في الوادي",
        "1 2 3 4 5 6 7 8 9 river 1987",
        "nothing of note",
        "Old valley, the river crossed: the old valley",
    ]
    asked = [(1, 0, "old river valley"), (1, 1, "river crossed the old valley 1987"), (2, 0, "مدرسة الوادي"), (3, 0, "of no number 12.5"), (3, 1, "?")]
    hits = [(q, f"c{k}", texts[k], 0.60 + 0.04 * ((7 * q + 3 * k) % 9)) for q in (1, 2, 3) for k in range(6) if (q + k) % 4]
    frames = spark.createDataFrame(hits, "query_id long, chunk_id string, text string, score double"), spark.createDataFrame(asked, "query_id long, variant int, query string")
    made = {}
    for q in (1, 2, 3):
        mine = [h for h in hits if h[0] == q]
        df = defaultdict(int)
        for h in mine:
            for t in words(h[2]):
                df[t] += 1
        rows = []
        for _, chunk, text, semantic in mine:
            each = [f for _, _, v in [a for a in asked if a[0] == q] if (f := features(v, text, df))]
            live = [f for f in each if f["live"]]
            top = lambda k, rows=live: max((f[k] for f in rows), default=0)
            coverage, overlap = max(((f["coverage"], f["overlap"]) for f in live), default=(0.0, 0))
            digits = sum(c.isdigit() for c in text) / max(len(text), 1)
            score = semantic * 0.78 + max(coverage, top("weighted")) * 0.22 + 0.05 * bool(top("phrase")) + min(0.08, 0.04 * top("bigrams")) + 0.04 * bool(top("number")) - (0.04 if digits > 0.12 and overlap < 2 else 0)
            rows.append((chunk, semantic, coverage, top("informative"), top("weighted"), bool(each), min(0.99, score) if each else semantic))
        made[q] = sorted(rows, key=lambda r: (-r[6], r[0]))
    return frames, made


def test_hybrid_rerank(reranked):
    (hits, asked), made = reranked
    got = defaultdict(list)
    for r in retrieval.hybrid_rerank(hits, asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    for q, rows in made.items():
        assert [r["chunk_id"] for r in got[q]] == [r[0] for r in rows]
        for r, (_, semantic, coverage, informative, weighted, script, score) in zip(got[q], rows, strict=True):
            assert (r["semantic"], r["coverage"], r["informative"], r["weighted"], r["score"]) == pytest.approx((semantic, coverage, informative, weighted, score))
            assert r["script"] == script


def test_rejection(reranked):
    (hits, asked), made = reranked
    want = set()
    for q, rows in made.items():
        _, semantic, coverage, informative, weighted, script, score = rows[0]
        weak = score < 0.66 or (script and informative < 0.25 and semantic < 0.82) or (script and max(coverage, weighted) < 0.18 and semantic < 0.81)
        if semantic >= 0.86 or not weak:
            want |= {(q, r[0]) for r in rows if r[6] >= max(0.66, score - 0.1)}
    got = {(r["query_id"], r["chunk_id"]) for r in retrieval.reject_low_confidence(retrieval.hybrid_rerank(hits, asked)).select("query_id", F.col("chunk_id")).collect()}
    assert got == want and 0 < len(want) < hits.count()
