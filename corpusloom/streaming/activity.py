"""Structured Streaming forms: statistics by time window, sessions, dedup of files, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.ingest import Index, folder_chunks
from corpusloom.sources.documents import READERS, stream_files
from corpusloom.sources.shared import shared_path


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's Parquet table of that name (a file or a folder) as a stream with a fixed schema; times as timestamps."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    many = spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(spot).isDirectory()
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if many else f"{name}.parquet")
    rows = source.parquet(path if many else folder)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def window_stats(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Per window and type: number and mean value. Rows later than the watermark are dropped."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "avg_value")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Per user and session: begin, end, events."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def stream_dedup(files: DataFrame, key: str, time: str, late: str = "40 days") -> DataFrame:
    """The first file of each hash within the watermark."""
    return files.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and read what it wrote.

    append writes Parquet; complete and update rewrite a table with the latest state by batch.
    """
    spark = stream.sparkSession
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-checkpoint")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], key: str, path: str, checkpoint: str) -> None:
    """Each micro-batch is transformed and upserted by key into the Parquet table at path; a batch that runs again changes nothing.

    The table is partitioned by batch; a key that comes again is read from its newest batch (`read_ingested`).
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_index(stream: DataFrame, chunks: Callable[[DataFrame], DataFrame], index: Index, checkpoint: str) -> None:
    """Each micro-batch becomes chunks and is brought into the index; a batch that runs again finds nothing changed.

    chunks gives chunk_id, text, chunk_content_hash, metadata_json and file_hash.
    """
    write = lambda batch, _: index.index_chunks(chunks(batch))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_folder(spark: SparkSession, folder: str, index: Index, checkpoint: str, extensions: list[str] | None = None, strategy: str = "sentence_window", min_words: int = 12, files_a_batch: int = 10_000) -> None:
    """The files that have come to a folder since the last call, by micro-batches: read, cleaned, cut into chunks and brought into the index.

    Which files have been read is in the checkpoint. A file with the bytes of an earlier one changes nothing, as chunks go by the file's hash.
    Large text files are read by blocks: none of them has to fit into a cell or a task.
    """
    files = stream_files(spark, folder, extensions or list(READERS), files_a_batch)
    stream_index(files, lambda batch: folder_chunks(batch, f"{index.folder}/work/units", strategy, min_words), index, checkpoint)


def read_ingested(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), "batch").alias("row")).select("row.*").drop("batch")
