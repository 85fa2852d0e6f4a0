"""What is done once, or not at all, so that large inputs take no longer than they must."""

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import aggregates, segments, tables
from corpusloom.plans.buckets import BucketTables
from corpusloom.plans.ingest import Index

CHUNK = "chunk_id string, text string, chunk_content_hash string, metadata_json string, file_hash string"


def test_sizes_of_chunks_are_taken_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 60, 1, 3).select(F.lit("s").alias("strategy"), (F.col("id") % 20).cast("string").alias("source_doc_id"), F.col("id").cast("int").alias("token_count"), F.lit(False).alias("is_arabic"))
    got = aggregates.chunk_stats(rows.mapInArrow(counted, rows.schema)).collect()
    assert [(r.chunks, r.documents, r.median_tokens) for r in got] == [(60, 20, 29)]
    assert seen.value == 60


def test_texts_of_chunks_with_ids_of_their_own_are_not_gathered_by_id(spark, tmp_path, monkeypatch):
    index = Index(spark, f"file://{tmp_path}/index", buckets=4)
    rows = [(str(k), f"text number {k % 6}", f"h{k % 6}", "{}", f"f{k % 3}") for k in range(9)]
    with monkeypatch.context() as m:
        m.setattr(tables, "first_by_key", None)
        first = index.index_chunks(spark.createDataFrame(rows, CHUNK)).first()
    assert (first.new_or_changed, first.embedded) == (9, 6)
    assert index.vectors().count() == index.manifest().count() == 9
    # an id that comes twice: the first content hash counts, and the others stay as they are
    twice = [*rows[1:], ("0", "b", "hb", "{}", "f0"), ("0", "a", "ha", "{}", "f0")]
    second = index.index_chunks(spark.createDataFrame(twice, CHUNK)).first()
    assert (second.new_or_changed, second.unchanged, second.deleted, second.embedded) == (1, 8, 0, 1)
    assert {(r.chunk_id, r.chunk_content_hash) for r in index.manifest().collect()} == {("0", "ha"), *((r[0], r[2]) for r in rows[1:])}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        held = BucketTables(spark, f"file://{tmp_path}/held", {"t": "k string, v string"}, {"t": "k"}, buckets=1)
        rows = spark.range(0, 20_000, 1, 8).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        held.replace("t", rows, [0])
        held.commit()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert held.read("t").count() == held.read("t").distinct().count() == 20_000
    assert len(list(tmp_path.rglob("bucket=0/*.parquet"))) > 1


def test_counters_of_words_add_up_as_one_number(monkeypatch):
    text = "The quick, brown fox: 3.5 km. كلب صغير " * 50_000
    word = [segments._of_word(w) for w in text.split()]
    assert segments.counters(text) == tuple(map(sum, zip(*word, strict=True)))
    assert segments.counters(" \n") == segments.counters("") == segments.NOTHING
    assert segments._unpacked(segments._packed(word[0]) + segments._packed(word[-1])) == word[0] + word[-1]
    known = segments._Known()
    monkeypatch.setattr(segments, "KNOWN_WORDS", 3)
    assert [known[w] for w in "a b c d e a".split()] == [segments._packed(segments._of_word(w)) for w in "a b c d e a".split()]
    assert len(known) <= 3


def test_texts_within_latin_1_skip_the_steps_for_other_scripts(spark, monkeypatch):
    texts = ["déjà  vu\t\n\n\n\nnaïve-\nté", "plain", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    with monkeypatch.context() as m:
        m.setattr(X, "strip_arabic_diacritics", lambda t: F.raise_error(t).cast("string"))
        got = [r[0] for r in rows.select(X.clean_text(F.col("text"))).collect()]
    assert got == ["déjà vu \n\nnaïveté", "plain", "", None]
    wide = spark.createDataFrame([("cafÃ© au lait",), ("ﬁn أب é",), ("ét",)], "text string")
    assert [r[0] for r in wide.select(X.clean_text(F.col("text"))).collect()] == ["café au lait", "fin اب é", "ét"]
    ratios = spark.createDataFrame([("été",), ("اب ab",), ("٠ é",), ("é 1",), (None,)], "text string")
    assert [r[0] for r in ratios.select(X.arabic_ratio(F.col("text"))).collect()] == [0.0, 0.5, 0.5, 0.0, 0.0]
