"""Operators on small inputs of our own: what the tables lack."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, html, questions, retrieval, segments, tables
from corpusloom.plans.ingest import Index, delete_ingestion, embed, write_latest_and_snapshot
from corpusloom.sources import documents as sources


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first()["v"]


def test_cleaning_english(spark):
    assert one(spark, "A  b\x00 hy-\nphen\n\n\n\nend  ", X.clean_text) == "A b hyphen\n\nend"


def test_cleaning_arabic_and_others(spark):
    got = one(spark, "‏أَحْمَد‎ مـدرسة إلى é ﬁn", X.clean_text)
    assert got == "احمد مدرسة الي é fin"
    assert one(spark, "أَحمد", lambda t: X.clean_text(t, diacritics=False)) == "اَحمد"
    assert one(spark, "مدرسة مؤمن", X.normalize_query) == "مدرسه مومن"
    assert one(spark, "مرحبا بكم abc", X.is_arabic) and one(spark, "نص", X.detect_lang) == "ar"


def test_mojibake(spark):
    assert one(spark, "cafÃ©", X.repair_mojibake) == "café"
    assert one(spark, "cafÃ© 日", X.repair_mojibake) == "cafÃ© 日"
    assert one(spark, "plain é", X.repair_mojibake) == "plain é"


def test_token_count_matches_python(spark):
    for t in ("a_b c, d! 12.5", "مرحبا بكم في المدرسة الكبيرة", "", "x́ y"):
        assert one(spark, t, X.approx_token_count) == segments.count_tokens(t)


def test_sentences():
    assert segments.split_sentences("Dr. Smith paid 3.14 today. It was fine! (Really?) Yes\nNew line U.S. Army this.") == ["Dr. Smith paid 3.14 today.", "It was fine!", "(Really?)", "Yes", "New line U.S. Army this."]
    assert segments.split_sentences("ما هذا؟ نعم.") == ["ما هذا؟", "نعم."]
    assert segments.split_sentences("") == []


def test_oversized_units():
    text = "first part of it: " + " ".join(f"w{i}" for i in range(30))
    parts = [p.text for p in segments.split_oversized(text, 8)]
    assert " ".join(parts).split() == text.split() and all(segments.count_tokens(p) <= 8 for p in parts)
    assert [p.text for p in segments.split_oversized("x" * 500, 1)] == ["x" * 500]


def test_windows_overlap_and_differ():
    units = [f"s{i} a b." for i in range(6)]
    pack = lambda overlap: [p.text for p in segments.pack_sentences([segments.Piece(u, segments.counters(u)) for u in units], 8, overlap)]
    packed = pack(0)
    assert packed == [" ".join(units[i : i + 2]) for i in (0, 2, 4)]
    lapped = pack(1)
    assert all(a != b and a.split(". ")[-1].rstrip(".") in b for a, b in zip(lapped, lapped[1:]))


def greedy(paragraphs, target, overlap):
    out, held = [], []
    for p in paragraphs:
        if held and segments.count_tokens("\n\n".join([*held, p])) > target:
            out.append("\n\n".join(held))
            held = held[-overlap:] if overlap else []
        held.append(p)
    return out + (["\n\n".join(held)] if held else [])


def test_paragraph_packing(spark):
    text = "\n".join("w " * n for n in (3, 5, 2, 9, 1, 1, 1, 20, 2))
    parts = [p.strip() for p in text.split("\n")]
    for target, overlap in ((8, 1), (10, 0), (6, 2), (1, 1)):
        got = one(spark, text, lambda t, a=target, b=overlap: chunking.paragraph_chunks(t, a, b))
        assert got == greedy(parts, target, overlap)


def test_merge_tiny(spark):
    def merged(texts, least=5):
        rows = spark.createDataFrame([(texts,)], "t array<string>").select(chunking.merge_tiny(F.col("t"), least).alias("v")).first()["v"]
        return [(r["index"], r["text"]) for r in rows]

    big = "a b c d e f"
    assert merged([big, "x", big]) == [("0", big), ("merge_fwd_1", f"x\n{big}")]
    assert merged([big, "x", "y"]) == [("merge_back_2", f"{big}\nx\ny")]
    assert merged(["x"]) == [("0", "x")] and merged([]) == []
    assert merged(["x", "y"]) == [("merge_fwd_0", "x\ny")]


def test_merge_short_sections(spark):
    kind = "s array<struct<heading:string,text:string>>"
    rows = spark.createDataFrame([([("", "few"), ("H", "words here are four"), ("T", "end")],)], kind)
    got = rows.select(chunking.merge_short_sections(F.col("s"), 3).alias("v")).first()["v"]
    assert [tuple(r) for r in got] == [("H", "few\nwords here are four\nend")]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunking.chunk_documents(spark.createDataFrame([("x",)], "clean_text string"), "other")


def test_html():
    page = "<html><head><title>T</title><meta name=author content=Me></head><body><nav>no</nav><article><h1>Head <b>bold</b></h1><p>one<p>two<script>x</script><aside>no</aside></article><section id=s>inner</section></body>"
    p = html.parse(page)
    assert p.sections() == [("Head bold", "Head\nbold\none\ntwo"), ("s", "inner")] and p.title == "T" and p.meta == {"meta_author": "Me"}
    assert html.parse("<body>lead<h1>A</h1><p>x</p><ul><li>y<li>z</ul><h2>B</h2><p>w</p>").sections() == [("A", "x\ny\nz"), ("B", "w")]
    assert html.parse("just text").sections() == [("", "just text")]


HITS = "query_id long, rank int, chunk_id string, chunk_content_hash string, document_group_id string, score double"


def test_post_process(spark):
    rows = [(1, 1, "a", "h1", "d1", 0.9), (1, 2, "a", "h2", "d1", 0.89), (1, 3, "b", "h1", "d2", 0.88), (1, 4, "c", "h3", "d1", 0.87), (1, 5, "d", "h4", "d1", 0.86), (1, 6, "e", "h5", "d1", 0.85), (1, 7, "f", "h5", "d2", 0.8), (1, 8, "g", "h6", "d3", 0.739), (1, 9, "i", "h7", "d4", None)]
    ids = lambda **k: [r.chunk_id for r in retrieval.post_process(spark.createDataFrame(rows, HITS), 5, **k).orderBy("rank").collect()]
    # e is over its document's cap and does not mark h5 as seen
    assert ids() == ["a", "c", "d", "f", "i"]
    assert ids(dedup=False, cap=None) == ["a", "a", "b", "c", "d"]
    assert ids(min_score=None) == ["a", "c", "d", "f", "g"]


def rerank(spark, query, texts):
    cands = spark.createDataFrame([(1, str(k), t, s) for k, (t, s) in enumerate(texts)], "query_id long, chunk_id string, text string, score double")
    return retrieval.hybrid_rerank(cands, spark.createDataFrame([(1, 0, query)], "query_id long, variant int, query string"))


def test_rerank_prefers_evidence_to_tables(spark):
    got = rerank(spark, "What is the annual leave policy", [("1 2 3 4 5 6 7 8 9 10 11 12 leave", 0.84), ("The annual leave policy grants thirty days", 0.82)]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["1", "0"] and got[0].overlap == 4 and got[0].script


def test_out_of_scope_is_rejected(spark):
    ranked = rerank(spark, "capital of distant planets", [("an unrelated text on cooking", 0.78)])
    assert retrieval.reject_low_confidence(ranked).count() == 0
    assert retrieval.reject_low_confidence(rerank(spark, "capital of distant planets", [("an unrelated text", 0.9)])).count() == 1


def test_variants_fall_back_to_words(spark):
    chunks = spark.createDataFrame([("a", "annual leave policy for staff", "h1", "d"), ("b", "something else entirely", "h2", "d")], "chunk_id string, text string, chunk_content_hash string, document_group_id string")
    variants = spark.createDataFrame([(1, 0, "annual leave policy"), (1, 1, "weak")], "query_id long, variant int, query string")
    hits = spark.createDataFrame([(1, 1, "b", 0.7)], "query_id long, variant int, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.retrieve_with_variants(variants, hits, chunks, 5).collect()] == ["a"]


def test_followups(spark):
    rows = [("and then?", "How do I apply for annual leave"), ("Is it in report.pdf or not please", "x"), ("What about the other annual leave rules", "How do I apply for annual leave rules and so on"), ("and about the annual leave", "How do I apply for annual leave"), ("Completely different question about payroll taxation", "How do I apply")]
    got = spark.createDataFrame(rows, "q string, p string").select(questions.is_followup(F.col("q"), F.col("p")).alias("v")).collect()
    assert [r.v for r in got] == [True, False, False, True, False]


def test_context_stops_at_its_limit(spark):
    turns = [(1, 2 * k + j, role, f"{role}{k} " + "x" * 700) for k in range(4) for j, role in enumerate(("user", "assistant"))]
    got = {r.turn: r.context for r in questions.conversation_context(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0] == "" and got[6].startswith("User: user0") and "user1" not in got[6]


def test_prompts_and_answers(spark):
    with pytest.raises(ValueError):
        questions.build_prompt(F.lit("q"), F.lit("c"), "other")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    prompts = spark.createDataFrame([(1, "p")], "query_id long, prompt string")
    assert {r.query_id: r.answer for r in questions.answers(asked, prompts, lambda s: "to " + s).collect()} == {1: "to p", 2: questions.IDK}


def test_index_runs(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    schema = "chunk_id string, text string, chunk_content_hash string, metadata_json string, file_hash string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    first = index.index_chunks(make(("a", "x", "h1", "{}", "f"), ("a", "x", "h1", "{}", "f"), ("b", "x", "h1", "{}", "f"), ("c", "y", "h2", "{}", "g"))).first()
    assert first.asDict() == {"new_or_changed": 3, "unchanged": 0, "deleted": 0, "embedded": 2, "cache_hits": 0, "cache_misses": 2}
    second = index.index_chunks(make(("a", "x", "h1", "{}", "f"), ("d", "y", "h2", "{}", "f"))).first()
    assert second.asDict() == {"new_or_changed": 1, "unchanged": 1, "deleted": 1, "embedded": 0, "cache_hits": 1, "cache_misses": 0}
    assert sorted(r.chunk_id for r in index.vectors().collect()) == ["a", "c", "d"]
    again = index.index_chunks(make(("a", "x", "h1", "{}", "f"), ("d", "y", "h2", "{}", "f"))).first()
    assert again.new_or_changed == again.deleted == 0
    empty = index.index_chunks(make().limit(0)).first()
    assert empty.deleted == 0 and index.manifest().count() == 3


def test_volatile_metadata_is_ignored(spark):
    rows = spark.createDataFrame([({"b": "1", "a": "2", "ingested_at": "x"},), ({"a": "2", "b": "1", "last_ingested_at": "y"},)], "m map<string,string>")
    assert len({r.v for r in rows.select(tables.stable_metadata(F.col("m")).alias("v")).collect()}) == 1


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("b.TXT", "same"), ("sub/a.txt", "same"), ("c.html", "<p>x"), ("d.bin", "z")):
        (tmp_path / name).write_text(data)
    files = sources.scan_files(spark, str(tmp_path), ["txt", ".html"]).withColumn("file_hash", sources.file_fingerprint(F.col("content")))
    assert files.count() == 3
    kept = sources.dedup_files(sources.route_by_extension(files)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in kept) == ["b.TXT", "c.html"]
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n\nnot json\n[1]\n{"k": 2}\n')
    assert sorted(r.k for r in sources.read_jsonl_tolerant(spark, f"{tmp_path}/x.jsonl", "k long").collect()) == [1, 2]
    assert sources.read_jsonl_tolerant(spark, f"{tmp_path}/none.jsonl", "k long").count() == 0
    (tmp_path / "cases.json").write_text('[{"query": "q"}, {"id": "z", "query": "r", "top_k": 2}]')
    got = sources.load_eval_cases(spark, f"{tmp_path}/cases.json").orderBy("query").collect()
    assert [(r.id, r.top_k, r.prompt_version, r.expected_source_contains) for r in got] == [("case-1", 5, "strict", []), ("z", 2, "strict", [])]
    (tmp_path / "bad.json").write_text('{"query": "q"}')
    with pytest.raises(ValueError):
        sources.load_eval_cases(spark, f"{tmp_path}/bad.json")


def test_snapshots_and_deletion(spark, tmp_path):
    rows = spark.createDataFrame([("a/x", "h1"), ("a/y", "h2"), ("b", "h1"), ("c", "h3"), ("ab", "h4")], "source_path string, file_hash string")
    write_latest_and_snapshot(rows, str(tmp_path), "r1")
    assert spark.read.parquet(f"{tmp_path}/latest/r1").count() == 5
    kept, counts = delete_ingestion(rows, "a/")
    assert sorted(r.source_path for r in kept.collect()) == ["ab", "c"] and counts.first().rows_matched == 2


def test_embeddings_have_unit_length(spark):
    v = embed(spark.createDataFrame([("a b c a",)], "t string"), "t").first()["embedding"]
    assert abs(sum(x * x for x in v) - 1) < 1e-5



def test_a_costly_score_is_made_once_for_each_row(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(n):
        seen.add(1)
        return n / 10

    rows = spark.range(10).select("id", F.when(F.col("id") < 8, "A/Src1").otherwise("other").alias("source_path"), F.lit("EN").alias("file_type"), costly(F.col("id")).alias("score"))
    found = tables.inspect_chunks(rows, "src1", ["en"], 0.2, 0.5)
    assert sorted((r["id"], r["total"]) for r in found.collect()) == [(k, 4) for k in (2, 3, 4, 5)]
    assert seen.value == 8  # of the rows that the other conditions leave
