"""The fast forms of trimming, counting and spacing against plain patterns, on every kind of white space, and cleaning that is planned once."""

import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.documents import clean_documents, drop_near_empty, read_documents_table

BLANK = re.compile(f"[{re.escape(X.BLANKS)}]+")
WIDE = "؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
TEXTS = [
    "", " ", X.BLANKS, "one", f"{X.BLANKS}one two{X.BLANKS}three\n", "a b　c  d", "\x1c\x1dx\x1ey\x1f", "café au  lait\u0085",
    "مرحبا 1 2٣ بك", "mixed مرحبا and latin", "\U0001d538 \U0001f600 ź", "​ zero ​", "-\nword - \nword", "a\t\tb\n\n\n\nc", "long " * 20_000,
]


def test_fast_forms(spark):
    rows = spark.createDataFrame([*enumerate(TEXTS), (-1, None)], "n int, t string")
    t = F.col("t")
    got = {r["n"]: r for r in rows.select("n", X.strip(t).alias("strip"), X.word_count(t).alias("words"), X.single_spaced(t).alias("spaced"), X.letter_count(t).alias("letters"), X.arabic_ratio(t).alias("ratio"), X.clean_text(t).alias("clean")).collect()}
    none = got.pop(-1)
    assert (none["strip"], none["words"], none["spaced"], none["letters"], none["ratio"], none["clean"]) == (None, None, None, None, 0.0, None)
    for n, text in enumerate(TEXTS):
        trimmed = BLANK.sub(" ", text).strip(" ")
        assert got[n]["strip"] == text.strip(X.BLANKS)
        assert got[n]["words"] == len(trimmed.split(" ")) - (not trimmed)
        assert got[n]["spaced"] == trimmed
        letters = sum(unicodedata.category(c)[0] == "L" for c in text)
        assert got[n]["letters"] == letters
        arabic = len(re.findall(f"[{WIDE}]", text))
        base = sum(unicodedata.category(c)[0] == "L" or re.match(f"[{WIDE}]", c) is not None for c in text)
        assert abs(got[n]["ratio"] - (arabic / base if base else 0.0)) < 1e-12


def test_ascii_texts_skip_nothing(spark):
    """An ASCII text has the same clean form as beside a letter that no step changes."""
    plain = [t for t in TEXTS if t.isascii()]
    rows = spark.createDataFrame([(t, f"é{t}") for t in plain if t == t.strip(X.BLANKS)], "a string, b string")
    assert all(r["b"] == f"é{r['a']}" for r in rows.select(X.clean_text(F.col("a")).alias("a"), X.clean_text(F.col("b")).alias("b")).collect())


def test_filter_does_not_clean_again(spark):
    docs = spark.createDataFrame([(1, "some words " * 20, "s")], "doc_id long, text string, source string")
    plan = drop_near_empty(clean_documents(read_documents_table(docs)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(X.ARABIC_TO) == 1


def test_arrow_functions_hold_few_strings_at_a_time(monkeypatch):
    """A whole batch of long texts was turned into Python's strings at once."""
    import pyarrow as pa

    from corpusloom.functions import text

    monkeypatch.setattr(text, "SLICE", 3)
    seen = []
    values = pa.array([None if k % 4 == 3 else f"é{k}" for k in range(11)])
    made = text.in_slices(values.slice(1), lambda some: seen.append(len(some)) or pa.array([None if t is None else t.upper() for t in some.to_pylist()], pa.string()))
    assert max(seen) <= 3 and made.to_pylist() == [None if t is None else t.upper() for t in values.to_pylist()[1:]]
    assert text.in_slices(values.slice(0, 0), lambda some: pa.array(some.to_pylist(), pa.string())).to_pylist() == []
