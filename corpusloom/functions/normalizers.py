"""Loose records (a map of text fields) to columns with fixed names, types and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Per kind of record each output field with its type, its default and the names it goes by, first come first.
#: `metadata.x` is looked up in the metadata of the record.
FIELDS: dict[str, dict[str, tuple[str, object, tuple[str, ...]]]] = {
    "chunk": {
        "id": ("text", "", ("id", "chunk_id", "metadata.chunk_id")),
        "text": ("text", "", ("text", "content")),
        "score": ("number", 0.0, ("score", "similarity")),
        "source": ("text", "Unknown source", ("source", "source_file", "source_path", "metadata.source_file", "metadata.source_path")),
        "page_number": ("number", None, ("pageNumber", "page_label", "page_num", "page", "metadata.display_page_num", "metadata.page_label", "metadata.page_num", "metadata.page")),
        "section": ("text", "", ("section", "section_title", "metadata.section_title")),
    },
    "answer": {
        "id": ("text", "", ("id",)),
        "question": ("text", "", ("question", "query")),
        "answer": ("text", "", ("answer",)),
        "timestamp": ("time", None, ("timestamp",)),
        "model_used": ("text", "", ("modelUsed", "model_used")),
        "tokens_used": ("number", None, ("tokensUsed", "tokens_used")),
    },
    "job": {
        "id": ("text", "", ("id", "jobId")),
        "file_name": ("text", "Unknown file", ("fileName", "file_name")),
        "file_size": ("number", 0.0, ("fileSize", "file_size")),
        "file_type": ("text", "unknown", ("fileType", "file_type", "mime_type")),
        "status": ("choice", "queued", ("status",)),
        "progress": ("number", None, ("progress",)),
        "chunks_created": ("number", None, ("chunksCreated", "chunks_created")),
        "error_message": ("text", "", ("errorMessage", "error_message", "error")),
        "created_at": ("time", None, ("createdAt", "created_at", "submittedAt")),
        "updated_at": ("time", None, ("updatedAt", "updated_at", "submittedAt")),
    },
    "document": {
        "id": ("text", "", ("id", "doc_id")),
        "file_name": ("text", "Unknown document", ("fileName", "file_name", "name")),
        "file_type": ("text", "unknown", ("fileType", "file_type", "type")),
        "file_size": ("number", 0.0, ("fileSize", "file_size", "size")),
        "chunk_count": ("number", 0.0, ("chunkCount", "chunk_count", "total_chunks")),
        "indexed_at": ("time", None, ("indexedAt", "indexed_at", "created_at")),
    },
    "stats": {
        "total_documents": ("number", 0.0, ("totalDocuments", "total_documents", "documents_count")),
        "total_chunks": ("number", 0.0, ("totalChunks", "total_chunks", "chunks_count")),
        "retrieval_health": ("choice", "offline", ("retrievalHealth", "retrieval_health")),
        "last_ingestion_at": ("time", None, ("lastIngestionAt", "last_ingestion_at")),
        "avg_retrieval_latency_ms": ("number", None, ("avgRetrievalLatencyMs", "avg_retrieval_latency_ms")),
    },
    "activity": {
        "id": ("text", "", ("id",)),
        "type": ("choice", "query", ("type",)),
        "description": ("text", "Activity event", ("description", "message", "title")),
        "timestamp": ("time", None, ("timestamp", "created_at", "updated_at")),
    },
}
#: What the choices may be.
CHOICES = {"status": ("queued", "processing", "indexed", "failed"), "retrieval_health": ("healthy", "degraded", "offline"), "type": ("query", "ingestion", "error")}


def _found(record: Column, metadata: Column, name: str) -> Column:
    return F.try_element_at(metadata, F.lit(name.removeprefix("metadata."))) if name.startswith("metadata.") else F.try_element_at(record, F.lit(name))


def normalize(kind: str, record: Column, metadata: Column | None = None, number: Column | None = None) -> Column:
    """A struct with the fields of the kind. record, metadata: map<string,string>; number: the place of the record, which names it if it has no id.

    A text is the first alias that isn't blank; a number or time the first that isn't null, and its default if that can't be read
    (an empty number is 0, a time without a default is null). Another word than the choices gives their default; the status of a
    job may be written in any case.
    """
    nothing = F.create_map().cast("map<string,string>")
    record, metadata = F.coalesce(record, nothing), nothing if metadata is None else F.coalesce(metadata, nothing)

    def field(name: str, type_: str, default: object, aliases: tuple[str, ...]) -> Column:
        values = [_found(record, metadata, a) for a in aliases]
        if type_ in ("text", "choice"):
            said = F.coalesce(*(F.when(F.length(F.trim(v)) > 0, v) for v in values), F.lit(default))
            if type_ == "text":
                return said
            said = F.lower(said) if name == "status" else said
            return F.when(said.isin(*CHOICES[name]), said).otherwise(default)
        first = F.coalesce(*values)
        if type_ == "time":
            return first.try_cast("timestamp_ntz")
        read = F.when(F.trim(first) == "", F.lit(0.0)).otherwise(F.trim(first).try_cast("double"))
        finite = F.when(F.isnan(read) | (F.abs(read) == float("inf")), F.lit(None)).otherwise(read)
        return F.coalesce(finite, F.lit(default).cast("double"))

    made = {name: field(name, *rule) for name, rule in FIELDS[kind].items()}
    if "id" in made and number is not None:
        made["id"] = F.coalesce(F.nullif(made["id"], F.lit("")), F.concat_ws("-", F.lit({"document": "doc"}.get(kind, kind)), number.cast("string")))
    return F.struct(*(c.alias(name) for name, c in made.items()))
