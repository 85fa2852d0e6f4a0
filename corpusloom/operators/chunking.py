"""Documents to chunks: paragraphs, sentence windows, merging of small pieces.

Texts are cut by the Arrow functions of `segments.py`, one pass a text, which also count; what follows are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import segments
from corpusloom.operators.packing import Packing, assembled, packed
from corpusloom.operators.segments import Piece, arrow_lists, arrow_pieces, counters, merge_small, numbered, pack_paragraphs, pack_sentences, paragraphs, sentence_units

MIN_TOKENS, MIN_INFORMATIVE_TOKENS, MIN_LETTERS = 80, 12, 20  # fixed values
Segment = Callable[[str], list[Piece]]


def _texts(segment: Segment) -> Callable[[Column], Column]:
    return arrow_lists(lambda t: [p.text for p in segment(t)])


def sentences(text: Column) -> Column:
    return arrow_lists(segments.split_sentences)(text)


def units_of(text: Column, target: int = 140) -> Column:
    return _texts(lambda t: sentence_units(t, target))(text)


def by_sentences(target: int = 140, overlap: int = 0) -> Segment:
    return lambda t: pack_sentences(sentence_units(t, target), target, overlap)


def by_paragraphs(target: int = 260, overlap: int = 1) -> Segment:
    return lambda t: pack_paragraphs(paragraphs(t), target, overlap)


def sentence_windows(text: Column, target: int = 140, overlap: int = 0) -> Column:
    return _texts(by_sentences(target, overlap))(text)


def split_paragraphs(text: Column) -> Column:
    """Non-blank trimmed lines; runs of newlines part them."""
    return F.filter(F.transform(F.split(text, r"\n+"), X.strip), lambda p: F.length(p) > 0)


def paragraph_chunks(text: Column, target: int = 260, overlap: int = 1) -> Column:
    """Greedy packing of paragraphs, joined by blank lines; a new chunk begins with the last `overlap` ones."""
    return _texts(by_paragraphs(target, overlap))(text)


def merge_tiny(texts: Column, smallest: int = MIN_TOKENS) -> Column:
    """Chunks below `smallest` tokens join the next one; a last one joins the one before. Gives (index, text, c), c being the counters."""
    return arrow_pieces(lambda ts: merge_small([Piece(t, counters(t)) for t in ts], smallest))(texts)


def informative(chunks: DataFrame) -> DataFrame:
    """Chunks with some text in them. chunks: text, token_count."""
    return chunks.filter((F.length(X.strip(F.col("text"))) > 0) & (F.col("token_count") >= MIN_INFORMATIVE_TOKENS) & (X.letter_count(F.col("text")) >= MIN_LETTERS))


def _informative(piece: Column) -> Column:
    """Is there some text in a piece? By its counters, which are taken once per chunk; letters mean that it isn't blank."""
    return (X.tokens_from(piece["c"]) >= MIN_INFORMATIVE_TOKENS) & (piece["c"]["letters"] >= MIN_LETTERS)


def chunk_documents(clean: DataFrame, strategy: str = "sentence_window", target: int | None = None, overlap: int | None = None, segment: Segment | None = None) -> DataFrame:
    """Chunks of clean documents, one row each, with lineage columns. The texts of a chunk never leave its document's task.

    segment: from a text to its pieces with their counters, instead of the strategy's own; `strategy` then only names it.
    """
    if segment is None:
        by_windows = _by_windows(strategy)
        overlap = (0 if by_windows else 1) if overlap is None else overlap
        segment = by_sentences(target or 140, overlap) if by_windows else by_paragraphs(target or 260, overlap)
    pieces = arrow_pieces(lambda t: numbered(segment(t)) if overlap else merge_small(segment(t), MIN_TOKENS))
    parted = clean.withColumn("pieces", pieces(F.col("clean_text")))
    return _chunks(parted.select("*", F.posexplode("pieces").alias("place", "piece")).drop("pieces", "raw_text", "clean_text"), strategy)


def _by_windows(strategy: str) -> bool:
    if strategy not in ("sentence_window", "paragraph"):
        raise ValueError("strategy must be 'sentence_window' or 'paragraph'")
    return strategy == "sentence_window"


def _chunks(rows: DataFrame, strategy: str) -> DataFrame:
    """Chunks of documents' rows with place and piece, the informative ones."""
    rows = rows.filter(_informative(F.col("piece")))
    text = F.col("piece.text")
    rows = rows.withColumns({"text": text, "chunk_id": X.chunk_identity(F.col("doc_id"), strategy, F.col("piece.index")), "chunk_index": F.col("place"), "strategy": F.lit(strategy), "token_count": X.tokens_from(F.col("piece.c")), "chunk_char_count": F.length(text), "chunk_content_hash": X.chunk_content_hash(text)})
    rows = rows.withColumnRenamed("doc_id", "source_doc_id").drop("piece", "place")
    return chunk_metadata(rows)


def units_of_blocks(clean: DataFrame, strategy: str = "sentence_window") -> DataFrame:
    """The sentences or paragraphs of each block of a text: file_hash, at, word_count, units. clean: blocks as `sources/blocks.py` cuts them, cleaned."""
    units = (lambda t: sentence_units(t, 140)) if _by_windows(strategy) else paragraphs
    return clean.select("file_hash", "at", "word_count", arrow_pieces(lambda t: [("", u) for u in units(t)])(F.col("clean_text")).alias("units"))


def chunk_blocks(units: DataFrame, documents: DataFrame, strategy: str = "sentence_window") -> DataFrame:
    """The chunks that `chunk_documents` makes of whole texts by default, from the units of their blocks. units: a written table of `units_of_blocks`; documents: a row each, with file_hash and doc_id."""
    if _by_windows(strategy):
        between, make = " ", lambda: Packing(140, 0, False, " ", MIN_TOKENS)
    else:
        between, make = "\n\n", lambda: Packing(260, 1, True, "\n\n", None)
    parts = packed(units.select("file_hash", "at", F.col("units.c").alias("c")), make)
    pieces = assembled(units.select("file_hash", "at", F.col("units.text").alias("units")), parts, between)
    return _chunks(pieces.join(F.broadcast(documents), "file_hash"), strategy)  # one row for each large file of a batch


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Page labels for display."""
    label = F.col("page_label") if "page_label" in chunks.columns else F.lit(None).cast("string")
    return chunks.withColumns({"page_label": X.page_label(label, F.col("page_num")), "display_page_num": X.display_page(F.col("page_num"))})


def stamp_lineage(chunks: DataFrame, ingestion_id: str, now: str) -> DataFrame:
    """Ids and times of the run where none are set; last_ingested_at always."""
    have = chunks.columns
    keep = lambda c, v: F.coalesce(F.col(c), v) if c in have else v
    return chunks.withColumns({"ingestion_id": keep("ingestion_id", F.lit(ingestion_id)), "ingested_at": keep("ingested_at", F.lit(now)), "first_ingested_at": keep("first_ingested_at", F.lit(now)), "last_ingested_at": F.lit(now), "document_group_id": keep("document_group_id", F.col("source_doc_id"))})


def merge_short_sections(sections: Column, min_words: int = 12) -> Column:
    """Ordered (heading, text) sections: short ones join the next, a short last one joins the one before; the first heading that isn't blank stays."""
    kind = "array<struct<heading:string,text:string>>"
    numbered = F.transform(sections, lambda s, i: F.struct(i.alias("i"), s["heading"].alias("heading"), s["text"].alias("text")))
    last = F.size(sections) - 1
    both = lambda a, b: F.struct(F.coalesce(F.nullif(a["heading"], F.lit("")), b["heading"]).alias("heading"), F.concat_ws("\n", a["text"], b["text"]).alias("text"))

    def step(acc: Column, s: Column) -> Column:
        here = F.when(acc["wait"].isNotNull(), both(acc["wait"], s)).otherwise(F.struct(s["heading"].alias("heading"), s["text"].alias("text")))
        short = X.word_count(here["text"]) < min_words
        forward = short & (s["i"] < last)
        back = F.concat(F.slice(acc["done"], F.lit(1), F.greatest(F.size(acc["done"]) - 1, F.lit(0))), F.array(both(F.element_at(acc["done"], -1), here)))
        done = F.when(forward, acc["done"]).when(short & (F.size(acc["done"]) > 0), back).otherwise(F.concat(acc["done"], F.array(here)))
        return F.struct(F.when(forward, here).alias("wait"), done.alias("done"))

    start = F.struct(F.lit(None).cast("struct<heading:string,text:string>").alias("wait"), F.array().cast(kind).alias("done"))
    return F.aggregate(numbered, start, step, lambda acc: acc["done"])
