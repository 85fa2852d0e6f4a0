"""Bytes of pages and texts as strings, by the charset they declare or else seem to have."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import in_slices

#: How far into a page a charset is looked for (fixed value), and what counts as a declaration.
DECLARED_IN = 4096
DECLARATION = r"charset=[\"']?([A-Za-z0-9_-]+)"
_DECLARATION = re.compile(DECLARATION.encode(), re.IGNORECASE)
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_ARABIC_RUN = re.compile("[ء-ي]{2,}")
DECODED = "struct<text:string,charset:string>"


def _known(name: str) -> bool:
    try:
        return codecs.lookup(name)._is_text_encoding
    except (LookupError, ValueError):
        return False


def declared_charset(raw: bytes) -> str | None:
    found = _DECLARATION.search(raw[:DECLARED_IN])
    return found[1].decode().lower() if found else None


def _reads_well(raw: bytes, name: str) -> bool:
    """Does it decode, with white space as texts have it? The first two bytes of a mark may also stand there by chance."""
    try:
        text = raw.decode(name)
    except UnicodeDecodeError:
        return False
    return 50 * sum(map(str.isspace, text)) >= len(text) - 50


def likely_charset(raw: bytes) -> str:
    """By a byte order mark that makes sense, else UTF-8 if it is that, else Arabic where the bytes beyond ASCII mostly make runs of Arabic letters, else western European."""
    for mark, name in _MARKS:
        if raw.startswith(mark) and _reads_well(raw, name):
            return name
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        beyond = sum(b > 0x7F for b in raw)
        arabic = sum(map(len, _ARABIC_RUN.findall(raw.decode("windows-1256", errors="replace"))))
        return "windows-1256" if arabic >= 0.6 * beyond else "windows-1252"
    return "utf-8"


def decode(raw: bytes, declares: bool = True) -> tuple[str, str]:
    """Text and charset. declares: look for a declaration first; one of a charset that doesn't exist is passed over. What can't be decoded becomes marks."""
    name = declared_charset(raw) if declares else None
    if name is None or not _known(name):
        name = likely_charset(raw)
    return raw.decode(name, errors="replace"), name


def decoded(content: Column, declares: bool = True) -> Column:
    """A struct of text and charset. Bytes that are UTF-8 and declare nothing else stay in the JVM; null gives null."""

    @F.arrow_udf(DECODED)
    def others(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield in_slices(part, told)

    def told(part: pa.Array) -> pa.Array:
        found = [(None, None) if raw is None else decode(raw, declares) for raw in part.to_pylist()]
        texts, names = zip(*found, strict=True) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["text", "charset"])

    text = content.cast("string")
    plain = F.is_valid_utf8(text) & ~F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF"))
    if declares:
        name = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, DECLARED_IN), "ISO-8859-1"), f"(?i){DECLARATION}", 1))
        plain &= name.isin("", "utf-8", "utf8")
    odd = others.asNondeterministic()(F.when(~plain, content))  # evaluated once
    return F.when(content.isNotNull(), F.struct(F.coalesce(odd["text"], text).alias("text"), F.coalesce(odd["charset"], F.lit("utf-8")).alias("charset")))
