"""Text files too large for one cell, as blocks that are cleaned and segmented on their own.

A file is gone through once by one task for its hash and charset, then read in ranges by many. Blocks end where cleaning and segmentation don't look across: at a line end between two
characters that no step drops, joins or takes for white space. The cleaned blocks joined by line ends have the units and words of the cleaned file. A file without such line ends is one block.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import MOJIBAKE
from corpusloom.sources import charsets

#: Bytes from which a text file is read by blocks, that a block has at least, and that a task reads.
LARGE, BLOCK, RANGE = 1 << 20, 16 << 10, 8 << 20
#: File systems that workers can open by themselves; files of others are read whole.
SCHEMES = ("file", "hdfs", "s3", "gs")
TOLD = "path string, length long, file_hash string, codec string, start long, repaired boolean"
BLOCKS = "path string, file_hash string, at long, raw_text string"

_STEP = 4 << 20
_HINT = re.compile(MOJIBAKE)
_HINT_IN_JVM = re.compile(MOJIBAKE.replace(".", "[^\n\r\x85\u2028\u2029]"))
_ARABIC_BYTES = bytes(ord("a") if charsets._ARABIC_RUN.match(bytes([b]).decode("windows-1256", "replace") * 2) else ord(" ") for b in range(256))
_BEYOND_ASCII = bytes(range(0x80, 0x100))
_LONE = re.compile(b"(?<!a)a(?!a)")


def by_blocks(path: str) -> bool:
    return path.partition(":")[0] in SCHEMES


def _opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, spot = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(spot)


def _parts(file: pa.NativeFile, start: int = 0) -> Iterator[bytes]:
    file.seek(start)
    while part := file.read(_STEP):
        yield part


def _texts(file: pa.NativeFile, codec: str, start: int = 0, errors: str = "strict") -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(codec)(errors)
    for part in _parts(file, start):
        yield decoder.decode(part)
    yield decoder.decode(b"", True)


def _reads_well(file: pa.NativeFile, name: str) -> bool:
    """`charsets._reads_well` of a file."""
    chars = spaces = 0
    try:
        for text in _texts(file, name):
            chars, spaces = chars + len(text), spaces + sum(map(str.isspace, text))
    except UnicodeDecodeError:
        return False
    return 50 * spaces >= chars - 50


def _arabic(file: pa.NativeFile) -> bool:
    """Do the bytes beyond ASCII mostly make runs of Arabic letters? Letters in runs are all but the lone ones."""
    beyond = letters = lone = 0
    held = b" "
    for part in _parts(file):
        beyond += len(part) - len(part.translate(None, _BEYOND_ASCII))
        kinds = part.translate(_ARABIC_BYTES)
        letters += kinds.count(b"a")
        held += kinds  # its first byte has been judged, its last one has to wait for the next
        lone += sum(1 for _ in _LONE.finditer(held, 1)) - (held[-1:] == b"a" and held[-2:-1] != b"a")
        held = held[-2:]
    lone += held[-1:] == b"a" and held[-2:-1] != b"a"
    return letters - lone >= 0.6 * beyond


def _charset(file: pa.NativeFile, utf8: bool) -> tuple[str, int]:
    """`charsets.likely_charset` of a file: the codec of what follows a byte order mark, and where that starts."""
    file.seek(0)
    head = file.read(4)
    for mark, name in charsets._MARKS:
        if head.startswith(mark) and _reads_well(file, name):
            order = "" if name == "utf-8-sig" else "-le" if mark in (codecs.BOM_UTF16_LE, codecs.BOM_UTF32_LE) else "-be"
            return name.removesuffix("-sig") + order, len(mark)
    return ("utf-8" if utf8 else "windows-1256" if _arabic(file) else "windows-1252"), 0


def _repaired(file: pa.NativeFile, codec: str, start: int) -> bool:
    """Is the text UTF-8 that was read as Latin-1, as `text.repair_mojibake` tells it of a whole text?"""
    hint, tail = False, ""
    for text in _texts(file, codec, start, "replace"):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        hint = hint or not (tail + text).isascii() and _HINT_IN_JVM.search(tail + text) is not None
        tail = (tail + text)[-2:]
    if not hint:
        return False
    decoder, was, now, tail = codecs.getincrementaldecoder("utf-8")(), 0, 0, ""
    try:
        for text in chain(_texts(file, codec, start, "replace"), (None,)):
            again = decoder.decode(b"", True) if text is None else decoder.decode(text.encode("latin-1"))
            if _HINT.search(tail + again):
                return False
            was, now, tail = was + sum(map(str.isalpha, text or "")), now + sum(map(str.isalpha, again)), (tail + again)[-2:]
    except UnicodeDecodeError:
        return False
    return now >= 0.8 * was


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _opened(row["path"]) as file:
                digest, decoder, utf8 = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), True
                for part in chain(_parts(file), (b"",)):
                    digest.update(part)
                    try:
                        utf8 = utf8 and decoder.decode(part, not part) is not None
                    except UnicodeDecodeError:
                        utf8 = False
                codec, start = _charset(file, utf8)
                found = row | {"file_hash": digest.hexdigest(), "codec": codec, "start": start, "repaired": _repaired(file, codec, start)}
            yield pa.RecordBatch.from_pylist([found])


def _stays(char: str) -> bool:
    """A character that cleaning neither drops nor takes for white space. Those of Latin-1 beyond ASCII may be halves of others in a text that is repaired."""
    return " " < char <= "~" or char > "\xff" and unicodedata.category(char)[0] in "LNPS" and char != "\u0640"


def _is_safe(data: bytearray, at: int, width: int, codec: str) -> bool:
    """May a block end here, right after a line end? A return before the line end is white space at the end of its line for all steps."""
    before = data[max(0, at - width - 8) : at - width].decode(codec, "ignore").removesuffix("\r")[-1:]
    after = data[at : at + 4].decode(codec, "ignore")[:1]
    return bool(before and after) and before != "-" and _stays(before) and _stays(after)


def _blocks(file: pa.NativeFile, row: dict, block: int) -> Iterator[tuple[int, str]]:
    """The text from the first safe line end at or after a range's begin to the first at or after its end, in blocks with their places."""
    codec, start, length, begin, end = (row[k] for k in ("codec", "start", "length", "begin", "end"))
    width = 2 if codec.startswith("utf-16") else 4 if codec.startswith("utf-32") else 1
    line_end = "\n".encode(codec)
    base = max(start, begin - 16)
    file.seek(base)
    data = bytearray(file.read(end - base))

    def safe(at: int, most: int = length) -> int:
        """The first safe line end at or after a place, `most` if there is none before. It reads on as far as it has to."""
        near = max(0, at - width - base)
        while True:
            found = data.find(line_end, near)
            seen = base + (len(data) if found < 0 else found + width)
            if seen >= most:
                return most
            if base + len(data) < length and (found < 0 or found + width + 4 > len(data)):
                near = found if found >= 0 else max(near, len(data) - width + 1)
                data.extend(file.read(1 << 20))
            elif (base + found - start) % width == 0 and _is_safe(data, found + width, width, codec):
                return base + found + width
            else:
                near = found + 1

    at = start if begin == start else safe(begin, end)
    while at < end:
        to = safe(min(at + block, end))
        text = data[at - base : to - base].decode(codec, "replace")
        yield at, text.encode("latin-1").decode() if row["repaired"] else text
        at = to


def surveyed(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """Of files (path, length): the hash of the bytes, the codec, where the text starts, and whether it is UTF-8 that was read as Latin-1. One task a file."""
    rows = spark.createDataFrame(files, "path string, length long").repartition(len(files))
    return spark.createDataFrame(rows.mapInArrow(_told, TOLD).collect(), TOLD)


def read_blocks(told: DataFrame, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """The texts of surveyed files as BLOCKS: in NFC, repaired where they have to be, each with its place in the file. One task a range of `span` bytes (a multiple of four)."""
    begins = F.sequence(F.col("start"), F.greatest("start", F.col("length") - 1), F.lit(span).cast("long"))
    ranges = told.select("*", F.explode(begins).alias("begin")).withColumn("end", F.least(F.col("begin") + span, "length"))
    tasks = told.agg(F.sum(F.ceil(F.col("length") / span))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    found, size = [], 0
                    for at, text in _blocks(file, row, block):
                        found.append({"path": row["path"], "file_hash": row["file_hash"], "at": at, "raw_text": text if text.isascii() else unicodedata.normalize("NFC", text)})
                        size += len(text)
                        if size > _STEP:
                            yield pa.RecordBatch.from_pylist(found)
                            found, size = [], 0
                    if found:
                        yield pa.RecordBatch.from_pylist(found)

    return ranges.repartition(tasks).mapInArrow(run, BLOCKS)
