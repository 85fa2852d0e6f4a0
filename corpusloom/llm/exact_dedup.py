"""Exact dedup over a cuckoo-filter index of live digests.

The flow: every row gets the SHA-256 digest of its text in the JVM; each Arrow batch is pre-aggregated, so that a
group of copies with a third of all rows leaves one row per batch; rows meet by a bucket of about `BUCKET_ROWS` rows, where a
`CuckooIndex` holds the live digests of one bucket at a time; the live entries are joined back to all rows.
A larger doc_id that arrives for a live digest deletes the live entry and is inserted in its place. Buckets are chosen by another hash of the
digest, so that its own bytes are free for the filter's tags and slots. What a bucket stores of a text, and a hit is verified against, is its SHA-256
and length: texts stay where they are.

Defined results: null text counts as empty; equal rows are copies of each other (of repeated doc_ids all stay);
a null doc_id never wins against another one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import partitions, table, text_or_empty
from corpusloom.llm.cuckoo import CuckooIndex

BUCKET_ROWS = 50_000
LIVE = "text_sha256 string, keep_id long, group_size long"
PARTIAL = "text_sha256 string, n_bytes long, top_id long, n long"


def digests(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest and Arrow batch, so that copies shrink before the shuffle."""
    for batch in batches:
        if batch.num_rows:
            got = pa.Table.from_batches([batch]).group_by(["text_sha256", "n_bytes"]).aggregate([("doc_id", "max"), ([], "count_all")])
            yield from got.select(["text_sha256", "n_bytes", "doc_id_max", "count_all"]).rename_columns(["text_sha256", "n_bytes", "top_id", "n"]).to_batches()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket (the last column); the index of one bucket is held at a time."""
    index, current = CuckooIndex(), None

    def flush() -> pa.RecordBatch:
        live = list(index.items())
        return pa.RecordBatch.from_arrays([pa.array([k[:32].hex() for k, _ in live], pa.string()), pa.array([v[0] for _, v in live], pa.int64()), pa.array([v[1] for _, v in live], pa.int64())], ["text_sha256", "keep_id", "group_size"])

    for batch in batches:
        for digest, n_bytes, top, n, bucket in zip(*(batch.column(c).to_pylist() for c in ("text_sha256", "n_bytes", "top_id", "n", "bucket")), strict=True):
            if bucket != current:
                if index.live:
                    yield flush()
                index, current = CuckooIndex(), bucket
            key = bytes.fromhex(digest) + n_bytes.to_bytes(8, "little")
            live = index.get(key)
            if live is None:
                index.insert(key, [top, n])
            elif top is not None and (live[0] is None or top > live[0]):
                index.delete(key)
                index.insert(key, [top, live[1] + n])
            else:
                live[1] += n
    if index.live:
        yield flush()


def live_digests(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest doc_id), group_size."""
    n = partitions(docs.sparkSession)
    buckets = max(n, -(-docs.count() // bucket_rows))
    met = digests(docs).mapInArrow(_combine, PARTIAL).withColumn("bucket", F.pmod(F.xxhash64("text_sha256"), F.lit(buckets)))
    return met.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_index, LIVE)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The join is a sort-merge join, whose hot keys AQE splits; nothing is broadcast.
    """
    live = table(live_digests(docs), "live-digests")  # a plain scan on both sides of the join
    joined = digests(docs).drop("n_bytes").hint("merge").join(live, "text_sha256", "inner")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
