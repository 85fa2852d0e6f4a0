"""Personal data: exact base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of a pattern per kind; matches that fail a check are dropped. A
regular expression splits the text and also gives its matches; the lengths of gaps and matches, added up, give positions.

The method on top: words that look like identifiers (a digit or an @, six characters or more without the marks at their
ends) are instances. Those that a base span overlaps are seeds. Seeds induce patterns of two sorts:

- contexts: the two words before with the marks around the instance, the word before and the word after it, the word before
  alone. Digits of the words are folded; the begin and end of a text are words of their own.
- the shape "long code": twelve or more letters and digits, six of them digits.

Patterns and instances form a graph, which is scored in rounds. A context's confidence is the mean trust of all its distinct
instances, so that unknown ones count against it. A shape's confidence is trusted / (trusted + negative): negative are the
instances that stand in `common` or more different contexts, as identifiers don't; these are never accepted. Either counts only if at least `support` trusted
instances back it. An instance's trust is the confidence of its best pattern, seeds have 1. Rounds go on until no instance is added. Instances
that reach `accept` become spans of the kind "id". Base spans stay as they are. So card numbers vouch for long codes, the codes
for the words that stand before them, and these for short passwords in the same place.

The graph is a table of hashed (pattern, instance) pairs; each round is two salted sort-merge joins and two partial aggregates, so
a pattern or an instance with very many partners is dealt to several tasks and never gathered. Text is read once.

Defined results: null counts as empty; an empty or clean text has zero counts and empty spans; positions are code points, ends
exclusive; repeated rows are kept apart; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import drop_tables, salted_join, table, text_or_empty

SPACE = r"\x20\x09-\x0D"
#: The base patterns. Possessive repeats and look-behinds change no match: they keep long runs linear and off the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
SPAN = "struct<kind:string,start:int,end:int>"
FOUND = "struct<start:int,end:int,surface:string>"


#: Found items are gathered in blocks of this size, so that a text with very many of them takes time in proportion.
BLOCK = 512
#: Marks that don't belong to an instance when they stand at its ends, and the least length without them.
EDGE, SHORTEST = "\"'`(),.;:<>[]{}!?#$%&*|=~^/\\", 6


def _gathered(parts: Column, kind: str, item: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Walk over (gap, hit, words, ...) and gather item(x, start, end, nth) for each hit.

    start and end are its places in the text, nth the number of words before it, if `words` counts those of the gaps.
    """
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        nth = acc["nth"] + x["words"]
        one, last, full = F.array(item(x, start, end, nth)), x["hit"].isNull(), F.size(acc["block"]) >= BLOCK
        block = F.when(last, acc["block"]).when(full, one).otherwise(F.concat(acc["block"], one))
        blocks = F.when(full & ~last, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"])
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), (nth + 1).alias("nth"), blocks.alias("blocks"), block.alias("block"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("nth"), F.array().cast(f"array<array<{kind}>>").alias("blocks"), none.alias("block"))
    return F.aggregate(parts, begin, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["block"]))))


def _located(text: Column, pattern: str) -> Column:
    """All matches with their places: array of (start, end, surface)."""
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.array_repeat(F.lit(0), F.size(gaps)).alias("words"))
    return _gathered(parts, FOUND, lambda x, start, end, nth: F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("surface")))


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), one), F.lit(0), lambda a, b: a + b) % 10 == 0


def _is_ip(hit: Column) -> Column:
    return F.forall(F.split(hit, "[.]"), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _is_card(hit: Column) -> Column:
    digits = F.translate(hit, " -", "")
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _is_phone(hit: Column) -> Column:
    return F.length(F.translate(hit, "+ ().-", "")).between(9, 15)


#: Kinds in the order of the result: pattern, what a text must hold for a match to be possible, check.
KINDS = {"email": (EMAIL, "@", None), "ip": (IP, r"[0-9]\.[0-9]", _is_ip), "card": (CARD, "[0-9][ -]?[0-9]", _is_card), "phone": (PHONE, r"\+[0-9]", _is_phone)}


def _spans_of(text: Column, kind: str) -> Column:
    pattern, _, check = KINDS[kind]
    hits = _located(text, pattern)
    if check is not None:
        hits = F.filter(hits, lambda x: check(x["surface"]))
    return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, its spans in order. Texts that can't hold one skip the pattern."""
    none = F.array().cast(f"array<{SPAN}>")
    return {kind: F.when(text.rlike(holds), _spans_of(text, kind)).otherwise(none) for kind, (_, holds, _) in KINDS.items()}


def _candidates(text: Column) -> Column:
    """Words like identifiers with their places: start, end, surface, nth (how many words stand before)."""
    gaps = F.split(text, WORD, -1)
    count = F.transform(gaps, lambda g: F.regexp_count(g, F.lit(f"[^{SPACE}]+")))
    parts = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("hit"), count.alias("words"))
    kind = "struct<start:int,end:int,surface:string,nth:int>"
    made = _gathered(parts, kind, lambda x, start, end, nth: F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("surface"), nth.alias("nth")))
    return F.when(text.rlike("[0-9@]"), made).otherwise(F.array().cast(f"array<{kind}>"))


def _neighbours(found: Column, every: Column) -> Column:
    """Adds the words around each candidate, digits folded: before2, before1, after. every: all words of the text."""
    lean = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    near = lambda w, k, edge: F.coalesce(lean(F.get(every, w["nth"] + k)), F.lit(edge))
    return F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["surface"].alias("surface"), near(w, -2, "^").alias("before2"), near(w, -1, "^").alias("before1"), near(w, 1, "$").alias("after")))


def _instances(rows: DataFrame) -> DataFrame:
    """row_id, start, end, seed, instance (a hash), long_code, patterns (hashes of contexts), for each occurrence."""
    one = rows.select("row_id", "base", F.explode("words").alias("w"))
    bare = F.ltrim(F.col("w.surface"), F.lit(EDGE))
    core = F.rtrim(bare, F.lit(EDGE))
    # the span is the word without the marks at its ends
    start = F.col("w.start") + F.length("w.surface") - F.length(bare)
    left = F.substring(F.col("w.surface"), F.lit(1), F.length("w.surface") - F.length(bare))
    right = F.substring(bare, F.length(core) + F.lit(1), F.length(bare) - F.length(core))
    seed = F.exists("base", lambda b: (b["start"] < F.col("w.end")) & (F.col("w.start") < b["end"]))
    one = one.select("row_id", start.alias("start"), (start + F.length(core)).alias("end"), core.alias("core"), seed.alias("seed"), left.alias("left"), right.alias("right"), "w.before2", "w.before1", "w.after")
    one = one.filter(F.length("core") >= SHORTEST)
    long_code = F.col("core").rlike("^[A-Za-z0-9]{12,}$") & (F.regexp_count("core", F.lit("[0-9]")) >= 6)
    patterns = F.array(F.xxhash64(F.lit("A"), "before2", "before1", "left"), F.xxhash64(F.lit("B"), "before1", "after", "left", "right"), F.xxhash64(F.lit("C"), "before1", "left", "right"))
    return one.select("row_id", "start", "end", "seed", F.xxhash64("core").alias("instance"), long_code.alias("long_code"), patterns.alias("patterns"))


def discover(rows: DataFrame, accept: float = 0.8, support: int = 3, common: int = 20, max_rounds: int = 100) -> DataFrame:
    """row_id and the spans (start, end) of accepted instances that no base span overlaps.

    rows: row_id, base (all base spans), words (candidates with their neighbours).
    """
    seen = table(_instances(rows), "pii-instances")
    each = seen.groupBy("instance").agg(F.max("seed").alias("seed"), F.first("long_code").alias("long_code"))
    contexts = seen.select("instance", F.explode("patterns").alias("pattern")).distinct()
    # a shape is a pattern of its own, known by its name's hash
    shapes = each.filter("long_code").select("instance", F.xxhash64(F.lit("long code")).alias("pattern"))
    graph = table(contexts.withColumn("shape", F.lit(False)).unionByName(shapes.withColumn("shape", F.lit(True))), "pii-graph")
    # two of an instance's patterns at least belong to each context, so this counts contexts from below
    spread = graph.groupBy("instance").agg((F.count(F.lit(1)) / 3).alias("places"))
    known = each.select("instance", F.col("seed").cast("double").alias("trust")).hint("merge").join(spread, "instance")
    known = table(known.select("instance", "trust", (F.col("places") >= common).alias("common")), "pii-trust")
    accepted = lambda: known.filter(F.col("trust") >= accept).count()
    before, made = accepted(), [graph, known]
    for _ in range(max_rounds):
        met = salted_join(graph, known, ["instance"], "pattern")
        sure = F.col("trust") >= accept
        scored = met.groupBy("pattern", "shape").agg(F.avg("trust").alias("mean"), F.sum(F.when(sure, F.col("trust"))).alias("held"), F.count_if(sure).alias("trusted"), F.count_if(~sure & F.col("common")).alias("negative"))
        scored = scored.withColumn("score", F.when(F.col("shape"), F.col("held") / (F.col("trusted") + F.col("negative"))).otherwise(F.col("mean")))
        scored = table(scored.filter((F.col("trusted") >= support) & (F.col("score") >= accept)).select("pattern", "score"), "pii-scored")
        best = salted_join(graph.select("pattern", "instance"), scored, ["pattern"], "instance").groupBy("instance").agg(F.max("score").alias("best"))
        known = known.hint("merge").join(best, "instance", "left").select("instance", F.greatest("trust", F.when(~F.col("common"), F.col("best")), F.lit(0.0)).alias("trust"), "common")
        known = table(known, "pii-trust")
        made += [scored, known]
        now = accepted()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"patterns and instances did not settle in {max_rounds} rounds")
    trusted = table(known.filter(F.col("trust") >= accept).select("instance"), "pii-trusted")
    drop_tables(made)
    return salted_join(seen.filter(~F.col("seed")), trusted, ["instance"], "row_id", "left_semi").select("row_id", "start", "end")


def _printed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, accept: float = 0.8, support: int = 3, common: int = 20) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = base_spans(F.col("text"))
    every = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    rows = plain.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", *(c.alias(k) for k, c in found.items()), _candidates(F.col("text")).alias("words"), every.alias("every"))
    rows = table(rows.withColumn("words", _neighbours(F.col("words"), F.col("every"))).drop("every"), "pii-rows")
    base = F.concat(*(F.col(k) for k in KINDS))
    holding = rows.filter(F.size("words") > 0).select("row_id", base.alias("base"), "words")
    added = discover(holding, accept, support, common).groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))
    joined = rows.drop("words").hint("merge").join(added, "row_id", "left")
    extra = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_printed(base), 256).alias("base_sha256"), _printed(F.concat(base, extra)).alias("spans"))
