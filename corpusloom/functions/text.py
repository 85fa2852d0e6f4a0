"""Cleaning, language detection, counts and normal forms of text, as Spark columns.

All are built-in expressions but `nfc`, for which Spark has none: it is an Arrow function that only texts with letters beyond
Latin-1 reach.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of an Arrow batch that are turned into Python's own at a time.
SLICE = 250
# What the cleaning replaces, removes and looks for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BIDI_MARKS = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
ARABIC_FROM, ARABIC_TO = "أإآٱىئـ", "اااايي"
ARABIC_DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]"
ARABIC_SCRIPT = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
ARABIC_CHUNK = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MOJIBAKE = "Ã.|Â.|â..|ðŸ|ï¿½"
LANGUAGE_MARKS = {"en": ("the", "and", "ing"), "fr": ("les", "des", "est"), "de": ("die", "der", "und"), "es": ("los", "las", "que")}
#: All that counts as white space when text is trimmed or parted into words.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same characters as a plain string, for trimming.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
QUERY_FROM, QUERY_TO = "أإآٱىئؤةـ", "ااااييوه"
QUERY_DIACRITICS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
ARABIC_THRESHOLD = 0.30


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _chars(text: Column, kind: str) -> Column:
    """How many characters are of a class: by what is left without them, as `regexp_count` makes a string of every match."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]+", ""))


def _is_ascii(text: Column) -> Column:
    """As many bytes as characters: such texts have none of the letters that most of the cleaning is about."""
    return F.octet_length(text) == F.length(text)


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; kept only if no hint is left and most letters survive."""
    fits = text.rlike(MOJIBAKE) & text.rlike(r"^[\x{00}-\x{ff}]*$")
    again = F.try_validate_utf8(F.encode(F.when(fits, text), "ISO-8859-1").cast("string"))
    letters = r"\p{L}"
    good = again.isNotNull() & ~again.rlike(MOJIBAKE) & (_chars(again, letters) >= 0.8 * _chars(text, letters))
    return F.when(fits & good, again).otherwise(text)


def in_slices(part: pa.Array, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """make(part), from SLICE values at a time: of a batch of long texts, few are Python's strings at once."""
    made = [make(part.slice(at, SLICE)) for at in range(0, len(part), SLICE)]
    return make(part) if len(made) < 2 else pa.concat_arrays(made)


def _each(part: pa.Array, change: Callable[[str], str]) -> pa.Array:
    return in_slices(part, lambda some: pa.array((None if t is None else change(t) for t in some.to_pylist()), pa.string()))


@F.arrow_udf(T.StringType())
def _nfc(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield _each(part, lambda t: unicodedata.normalize("NFC", t))


_nfc = _nfc.asNondeterministic()  # so that the planner evaluates cleaning once, however often its result is used


def nfc(text: Column) -> Column:
    """Unicode NFC; texts within Latin-1 have it already and don't leave the JVM's hands changed."""
    return F.when(text.rlike(r"[^\x{00}-\x{ff}]"), _nfc(F.when(text.rlike(r"[^\x{00}-\x{ff}]"), text))).otherwise(text)


_HINT = re.compile(MOJIBAKE)


def _mended(text: str) -> str:
    """`repair_mojibake`, then NFC, of one text."""
    if _HINT.search(text):
        try:
            again = text.encode("latin-1").decode()
        except UnicodeError:
            again = ""
        if again and not _HINT.search(again) and sum(map(str.isalpha, again)) >= 0.8 * sum(map(str.isalpha, text)):
            text = again
    return unicodedata.normalize("NFC", text)


@F.arrow_udf(T.StringType())
def _mend(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        yield _each(part, _mended)


_mend = _mend.asNondeterministic()


def _beyond_latin(text: Column) -> Column:
    """Has it a hint of mojibake or a letter beyond Latin-1? Nothing but these is mended, joined, folded or dropped by the steps for other scripts."""
    return ~_is_ascii(text) & text.rlike(rf"{MOJIBAKE}|[^\x{{00}}-\x{{ff}}]")


def mend(text: Column) -> Column:
    """`nfc(repair_mojibake(text))` in one step: only texts with a hint or letters beyond Latin-1 leave the JVM."""
    return F.coalesce(_mend(F.when(_beyond_latin(text), text)), text)


def once(value: Column) -> Column:
    """The same value. The test is always true, but as it isn't deterministic the planner pushes no filter below it, where the value would be made a second time."""
    return F.when(F.spark_partition_id() >= 0, value)


def expand_ligatures(text: Column) -> Column:
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    return text


def strip_bidi_marks(text: Column) -> Column:
    return F.regexp_replace(text, BIDI_MARKS, "")


def normalize_arabic(text: Column) -> Column:
    return F.translate(text, ARABIC_FROM, ARABIC_TO)


def strip_arabic_diacritics(text: Column) -> Column:
    return F.regexp_replace(text, ARABIC_DIACRITICS, "")


def unwrap_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"-\n([\p{L}\p{N}_])", "$1")


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]+", " ")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _spaced(text: Column) -> Column:
    """All white space as plain spaces, which patterns find many times faster than the class of all its characters."""
    return F.translate(text, BLANKS, " " * len(BLANKS))


def single_spaced(text: Column) -> Column:
    """Trimmed, with one space for each run of white space."""
    return F.trim(F.regexp_replace(_spaced(text), " +", " "))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(text, F.lit(BLANKS))


def clean_text(text: Column, diacritics: bool = True, unicode_form: bool = True) -> Column:
    """All cleaning steps in order. unicode_form=False leaves out mojibake repair and NFC. Texts within Latin-1 and without a hint of mojibake skip the steps that can't change them."""

    def widely(some: Column) -> Column:
        wide = normalize_arabic(strip_bidi_marks(expand_ligatures(some)))
        return F.when(some.isNotNull(), strip_arabic_diacritics(wide) if diacritics else wide).otherwise(text)

    other = F.when(_beyond_latin(text), text)
    # as a lambda's variable it is made once, and null says that the text is none of these
    text = F.get(F.transform(F.array(_mend(other) if unicode_form else other), widely), F.lit(0))
    return strip(collapse_blank_lines(collapse_spaces(strip_controls(unwrap_hyphens(text)))))


def arabic_ratio(text: Column) -> Column:
    """Arabic letters over all letters, unrounded; 0 without letters."""
    some = ~_is_ascii(text) & text.rlike(f"[{ARABIC_SCRIPT}]")  # letters of others needn't be counted where there are none of these
    return F.when(some, _chars(text, ARABIC_SCRIPT) / _chars(text, rf"\p{{L}}{ARABIC_SCRIPT}")).otherwise(F.lit(0.0))


def is_arabic(text: Column) -> Column:
    return arabic_ratio(text) >= ARABIC_THRESHOLD


def _occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def detect_lang(text: Column, arabic: Column | None = None) -> Column:
    """ar, or the Latin language with the most marks in the first 2000 characters; short texts are en."""

    def best_of(sample: Column) -> Column:
        scored = []
        for place, (lang, marks) in enumerate(LANGUAGE_MARKS.items()):
            total = sum((_occurrences(sample, m) for m in marks), F.lit(0))
            scored.append(F.struct(total.alias("n"), F.lit(-place).alias("order"), F.lit(lang).alias("lang")))
        return F.array_max(F.array(*scored))["lang"]

    # as a lambda's variable the sample is made once, not at each of its uses
    best = F.get(F.transform(F.array(F.lower(F.substring(text, 1, 2000))), best_of), F.lit(0))
    return F.when(is_arabic(text) if arabic is None else arabic, "ar").when(F.length(text) < 50, "en").otherwise(best)


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """One mark is left for each word with the spaces before it."""
    return F.length(F.regexp_replace(F.rtrim(_spaced(text)), " *+[^ ]++", "x"))


def letter_count(text: Column) -> Column:
    return _chars(text, r"\p{L}")


def is_scanned_page(text: Column) -> Column:
    """Too little text for a page with a text layer."""
    return F.length(strip(text)) < 50


def token_counters(text: Column) -> Column:
    """The additive parts of `approx_token_count`: tokens, word-like tokens, Arabic letters, letters."""
    return F.struct(
        _count(text, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]").alias("tokens"),
        _count(text, r"[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*").alias("words"),
        _chars(text, ARABIC_CHUNK).alias("arabic"),
        letter_count(text).alias("letters"),
    )


def tokens_from(counters: Column) -> Column:
    arabic = (counters["letters"] > 0) & (counters["arabic"] >= ARABIC_THRESHOLD * counters["letters"])
    return F.when(arabic, F.greatest(counters["tokens"], F.bround(counters["words"] * F.lit(1.35)).cast("int"))).otherwise(counters["tokens"])


def approx_token_count(text: Column) -> Column:
    return tokens_from(token_counters(text))


def normalized_chunk_text(text: Column) -> Column:
    return single_spaced(text)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_content_hash(text: Column) -> Column:
    return F.sha2(normalized_chunk_text(text), 256)


def doc_identity(file_hash: Column, page_num: Column) -> Column:
    return F.sha2(F.concat_ws("::", file_hash, page_num.cast("string")), 256)


def chunk_identity(doc_id: Column, strategy: str, index: Column) -> Column:
    return F.sha2(F.concat_ws("::", doc_id, F.lit("v1"), F.lit(strategy), index.cast("string")), 256)


def display_page(page_num: Column) -> Column:
    return F.when(page_num >= 0, page_num + 1)


def page_label(label: Column, page_num: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), display_page(page_num).cast("string"), F.lit(""))


def normalize_query(text: Column) -> Column:
    """The form in which questions are compared: no diacritics, fewer letter variants, single spaces."""
    text = F.regexp_replace(strip(text), QUERY_DIACRITICS, "")
    return single_spaced(F.translate(text, QUERY_FROM, QUERY_TO))


def match_tokens(text: Column) -> Column:
    """Distinct lower-cased words of ASCII or Arabic letters, two characters or more."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[\x{0600}-\x{06FF}]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: F.length(t) > 1))


def informative_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= 4)


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_arabic(text: Column) -> Column:
    return text.rlike(r"[\x{0600}-\x{06FF}]")


def shares_script(a: Column, b: Column) -> Column:
    return (has_latin(a) & has_latin(b)) | (has_arabic(a) & has_arabic(b))


def ordered_tokens(text: Column) -> Column:
    """Words of ASCII or Arabic letters in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[\x{0600}-\x{06FF}]+"), F.lit(0)), F.lower)


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))


def digit_ratio(text: Column) -> Column:
    return _chars(text, r"\p{Nd}") / F.greatest(F.length(text), F.lit(1))


def detect_query_language(text: Column) -> Column:
    return F.when(has_arabic(text), "ar").otherwise("en")


def normalize_eval_text(text: Column) -> Column:
    return single_spaced(F.lower(F.coalesce(text, F.lit(""))))


def answer_is_idk(text: Column) -> Column:
    return F.regexp_replace(normalize_eval_text(text), r"\.+$", "") == "i don't know"


def derive_chunk_score(tokens: Column) -> Column:
    return F.when(tokens <= 0, 0.0).otherwise(F.round(F.least(F.greatest(tokens / 250.0, F.lit(0.1)), F.lit(0.99)), 4))
