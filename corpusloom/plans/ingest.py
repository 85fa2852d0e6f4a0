"""Whole runs: documents to chunks, snapshots, the incremental index, deletion."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunking, tables
from corpusloom.plans.buckets import BucketTables, spot_of
from corpusloom.sources.blocks import BLOCK, LARGE, RANGE, by_blocks, read_blocks, surveyed
from corpusloom.sources.documents import LOADERS, clean_documents, dedup_files, drop_near_empty, file_fingerprint, read_documents_table, read_files, route_by_extension
from corpusloom.sources.shared import CODEC, less, shared_path, shuffles_freed, written

MODEL_KEY = "hashing-tf-256"
Embed = Callable[[DataFrame, str], DataFrame]
Load = Callable[[DataFrame], DataFrame]


def complete_versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions below a path, oldest first."""
    spot, store = spot_of(spark, path)
    if not store.exists(spot):
        return []
    marks = [(s.getPath().getName(), spot_of(spark, f"{s.getPath()}/_SUCCESS")[0]) for s in store.listStatus(spot)]
    done = [(store.getFileStatus(mark).getModificationTime(), name) for name, mark in marks if store.exists(mark)]
    return [name for _, name in sorted(done)]


def embed(rows: DataFrame, column: str, kind: str = "passage", dimension: int = 256) -> DataFrame:
    """Adds embedding: hashed token counts at unit length. Stands where a model is plugged in; the prefix says what is embedded."""
    prefixed = rows.withColumn("__tokens", X.ordered_tokens(F.concat(F.lit(f"{kind}: "), F.col(column))))
    counted = HashingTF(numFeatures=dimension, inputCol="__tokens", outputCol="__tf").transform(prefixed)
    unit = Normalizer(p=2.0, inputCol="__tf", outputCol="__unit").transform(counted)
    return unit.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__tokens", "__tf", "__unit")


def chunks_of(docs: DataFrame, strategy: str = "sentence_window", min_words: int = 12, run: str = "run-1", now: str = "2024-01-01T00:00:00") -> DataFrame:
    """The chunks of a documents table, with lineage."""
    clean = drop_near_empty(clean_documents(read_documents_table(docs)), min_words)
    return chunking.stamp_lineage(chunking.chunk_documents(clean, strategy), run, now)


@dataclass
class Index:
    """Tables of one project below a folder: manifest, vectors, cache (`buckets.py`). A run rewrites only the buckets in which something changed.

    Manifest and vectors are parted by the file's hash, so the buckets of the given files are all that is read; a chunk belongs to one file, as its id is made of
    that file's hash. The cache is parted by content hash and only added to.
    embed: adds the column embedding to rows from the named text column; model_key keeps the vectors of several models apart in the cache.
    """

    spark: SparkSession
    folder: str
    embed: Embed = embed
    model_key: str = MODEL_KEY
    buckets: int = 32

    MANIFEST = "chunk_id string, chunk_content_hash string, metadata_json string, file_hash string"
    VECTORS = "chunk_id string, embedding array<float>"
    SCHEMAS = {"manifest": MANIFEST, "vectors": f"{VECTORS}, file_hash string", "cache": "model_key string, content_hash string, embedding array<float>"}
    KEYS = {"manifest": "file_hash", "vectors": "file_hash", "cache": "content_hash"}

    def tables(self) -> BucketTables:
        """As of the newest commit."""
        return BucketTables(self.spark, self.folder, self.SCHEMAS, self.KEYS, self.buckets)

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows that several tables depend on, written once."""
        return written(rows, f"{self.folder}/work/{name}")

    def _each_once(self, chunks: DataFrame) -> DataFrame:
        """The chunks, each id once: of several rows that of the first content hash. Ids alone are compared; texts are shuffled only if one comes twice."""
        given = self._kept(chunks, "given")
        twice = given.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return given if twice.isEmpty() else self._kept(tables.first_by_key(given, "chunk_id", F.col("chunk_content_hash")), "current")

    def index_chunks(self, chunks: DataFrame, reset: bool = False) -> DataFrame:
        """Bring the index to these chunks; returns the report. chunks: chunk_id, text, chunk_content_hash, metadata_json, file_hash.

        Only the file hashes that the chunks have are compared. No chunks: nothing changes. A second run with the same input writes no table.
        All tables change with one commit: after a run that broke off, the next one finds the same differences again.
        """
        held = self.tables()
        current = self._each_once(chunks.select("chunk_id", "text", "chunk_content_hash", "metadata_json", "file_hash"))
        if reset:
            held.clear("manifest")
            held.clear("vectors")
        here = held.buckets_of("manifest", current)
        manifest = held.written("manifest", here)
        touched = tables.manifest_by_files(manifest, current)
        diff = self._kept(tables.manifest_diff(touched, current), "diff")
        changed = self._kept(current.select("chunk_id", "chunk_content_hash", "file_hash").hint("merge").join(diff.filter(F.col("status").isin("new", "changed")), "chunk_id", "left_semi"), "changed")
        known = held.buckets_of("cache", changed.select(F.col("chunk_content_hash").alias("content_hash")))
        resolved = self._kept(tables.resolve_vectors(changed, held.read("cache", known), self.model_key), "resolved")
        counts = tables.index_report(diff, resolved)
        # texts travel here alone, by content; one that an unchanged chunk has too is the same in normal form
        missing = current.select("chunk_content_hash", "text").hint("merge").join(resolved.filter(~F.col("cached")), "chunk_content_hash", "left_semi")
        made = self.embed(missing.groupBy("chunk_content_hash").agg(F.min("text").alias("text")), "text")
        held.append("cache", made.select(F.lit(self.model_key).alias("model_key"), F.col("chunk_content_hash").alias("content_hash"), "embedding"))

        # of the buckets that were compared, those with a difference; the others keep their files
        moved = current.select("chunk_id", "file_hash").unionByName(touched.select("chunk_id", "file_hash")).hint("merge").join(diff.filter(F.col("status") != "unchanged"), "chunk_id", "left_semi")
        touched_buckets = held.buckets_of("manifest", moved)
        in_them = held.bucket("manifest").isin(touched_buckets)
        cache = held.written("cache", known).filter(F.col("model_key") == self.model_key)
        vectors = changed.select("chunk_id", F.col("chunk_content_hash").alias("content_hash"), "file_hash").hint("merge").join(cache, "content_hash").select("chunk_id", "embedding", "file_hash")
        rest = tables.delete_keys(held.written("vectors", touched_buckets), diff.filter(F.col("status") != "unchanged"), ["chunk_id"])
        held.replace("vectors", rest.unionByName(vectors), touched_buckets)
        rest = held.written("manifest", touched_buckets).hint("merge").join(touched.select("chunk_id"), "chunk_id", "left_anti")
        held.replace("manifest", rest.unionByName(current.filter(in_them).select("chunk_id", "chunk_content_hash", "metadata_json", "file_hash")), touched_buckets)
        report = self.spark.createDataFrame(*_held(counts))
        held.commit()
        work, store = spot_of(self.spark, f"{self.folder}/work")
        store.delete(work, True)  # no lazy result reads it any more
        return report

    def manifest(self) -> DataFrame:
        return self.tables().read("manifest")

    def vectors(self) -> DataFrame:
        return self.tables().read("vectors").drop("file_hash")

    def delete_files(self, files: DataFrame) -> None:
        """The chunks of the listed file hashes go from the vectors and the manifest; the cache stays, as it goes by content."""
        held, gone = self.tables(), files.select("file_hash").distinct()
        here = held.buckets_of("manifest", gone)
        for name in ("vectors", "manifest"):
            held.replace(name, less(held.read(name, here), gone, ["file_hash"]), here)
        held.commit()


@dataclass
class Collections:
    """The indexes of several projects, each in a folder of its own."""

    spark: SparkSession
    folder: str

    def path(self, project: str) -> str:
        """Projects are named by letters, digits, dots, dashes and low lines; another name is an error, as it could lead elsewhere."""
        if not project or project.strip(".") == "" or not all(c.isalnum() or c in "._-" for c in project):
            raise ValueError(f"no name for a project: {project!r}")
        return f"{self.folder}/project_id={project}"

    def create(self, project: str, **options: object) -> Index:
        """The project's index; one that is there already is kept."""
        spot, store = spot_of(self.spark, self.path(project))
        store.mkdirs(spot)
        return Index(self.spark, self.path(project), **options)

    def exists(self, project: str) -> bool:
        spot, store = spot_of(self.spark, self.path(project))
        return store.exists(spot)

    def has_points(self, project: str) -> bool:
        return not Index(self.spark, self.path(project)).vectors().isEmpty()

    def delete(self, project: str) -> bool:
        """False if there was none."""
        spot, store = spot_of(self.spark, self.path(project))
        return store.delete(spot, True)


def write_snapshot(rows: DataFrame, folder: str, run: str) -> DataFrame:
    """The rows of one run, read back. A run that is written again replaces its own snapshot only."""
    path = f"{folder}/snapshots/run={run}"
    settle_latest(rows.sparkSession, folder, run)
    with shuffles_freed(rows):
        rows.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return rows.sparkSession.read.parquet(path)


def write_latest(rows: DataFrame, folder: str, run: str) -> None:
    with shuffles_freed(rows):
        rows.write.mode("overwrite").option("compression", CODEC).parquet(f"{folder}/latest/{run}")


#: In the folder of a latest table whose rows are those of a snapshot (JSON: run; only: the flag of its rows; dropped: columns that it lacks).
SAME = "_snapshot"


def point_latest(spark: SparkSession, folder: str, run: str, only: str | None = None, dropped: tuple[str, ...] = ()) -> None:
    """The run's snapshot, or its rows with a flag, becomes the latest table without being written a second time."""
    spot, store = spot_of(spark, f"{folder}/latest/{run}")
    store.delete(spot, True)
    for name, told in ((SAME, json.dumps({"run": run, "only": only, "dropped": dropped})), ("_SUCCESS", "")):
        out = store.create(spot_of(spark, f"{folder}/latest/{run}/{name}")[0], True)
        out.write(told.encode())
        out.close()


def _pointed(spark: SparkSession, folder: str, name: str) -> dict | None:
    """Which snapshot a latest table is; None if it has rows of its own."""
    path = f"{folder}/latest/{name}/{SAME}"
    spot, store = spot_of(spark, path)
    if not store.exists(spot):
        return None
    stream = store.open(spot)
    told = bytes(stream.readAllBytes()).decode()
    stream.close()
    return json.loads(told)


def settle_latest(spark: SparkSession, folder: str, run: str) -> None:
    """If the latest table is the snapshot of this run, which is about to be replaced or deleted, its rows are written out first."""
    runs = complete_versions(spark, f"{folder}/latest")
    told = _pointed(spark, folder, runs[-1]) if runs else None
    if told and told["run"] == run:
        write_latest(read_latest(spark, folder), folder, f"{runs[-1]}-{uuid.uuid4().hex[:8]}")


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete latest table."""
    runs = complete_versions(spark, f"{folder}/latest")
    if not runs:
        raise FileNotFoundError(f"no complete run below {folder}")
    told = _pointed(spark, folder, runs[-1])
    if told is None:
        return spark.read.parquet(f"{folder}/latest/{runs[-1]}")
    rows = spark.read.parquet(f"{folder}/snapshots/run={told['run']}")
    return (rows.filter(told["only"]) if told["only"] else rows).drop(*told["dropped"])


def write_latest_and_snapshot(chunks: DataFrame, folder: str, run: str) -> None:
    """The run's snapshot, then the latest table in a new version; readers take the newest complete one (`read_latest`)."""
    write_latest(write_snapshot(chunks, folder, run), folder, run)


def load_files(files: DataFrame, loaders: dict[str, Load] = LOADERS) -> tuple[DataFrame, DataFrame]:
    """Pages of files by their loaders, and one row of counts: given, files (read, each content once).

    files: path, content. Skipped are files that no loader takes, and of equal bytes all but the first by path; a file without content
    is no copy of another.
    """
    routed = route_by_extension(files.select("path", "content")).withColumn("file_hash", F.coalesce(file_fingerprint(F.col("content")), F.sha2("path", 256)))
    routed = routed.withColumn("skipped", F.coalesce(~F.col("reader").isin(*loaders), F.lit(True)))
    # copies are told by keys alone, which are written, so that contents aren't shuffled to meet them
    keys = written(routed.select("path", "file_hash", "skipped"), shared_path(files.sparkSession, "keys"))
    read = keys.filter(~F.col("skipped")).select("path", "file_hash").distinct()
    copies = read.join(dedup_files(read), ["file_hash", "path"], "left_anti")
    kept = less(routed.filter(~F.col("skipped")), copies, ["file_hash", "path"])
    pages = None
    for reader, load in loaders.items():
        some = load(kept.filter(F.col("reader") == reader))
        pages = some if pages is None else pages.unionByName(some)
    hashes = keys.agg(F.count(F.lit(1)).alias("given"), F.countDistinct(F.when(~F.col("skipped"), F.col("file_hash"))).alias("files"))
    return pages, hashes


def file_chunks(files: DataFrame, strategy: str = "sentence_window", min_words: int = 12, loaders: dict[str, Load] = LOADERS) -> DataFrame:
    """Files (path, content) to chunks as `Index.index_chunks` takes them. What is skipped is as in `run_pipeline`."""
    pages, _ = load_files(files, loaders)
    raw = pages.filter(F.col("raw_text").isNotNull())
    raw = raw.withColumns({"content_hash": X.content_hash(F.col("raw_text")), "doc_id": X.doc_identity(F.col("file_hash"), F.col("page_num"))})
    chunks = chunking.chunk_documents(drop_near_empty(clean_documents(raw), min_words), strategy)
    return index_rows(chunks)


def folder_chunks(files: DataFrame, scratch: str, strategy: str = "sentence_window", min_words: int = 12, large: int = LARGE, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """Files (path, length), which are read here, to the chunks of `file_chunks`. Text files of `large` bytes or more are read, cleaned and cut by blocks (`sources/blocks.py`), the others whole.

    scratch: a folder for the units of the blocks; the chunks read it.
    """
    spark = files.sparkSession
    told = [(r["path"], r["length"]) for r in route_by_extension(files.select("path", "length")).filter((F.col("reader") == "text") & (F.col("length") >= large)).select("path", "length").collect()]
    told = [(path, length) for path, length in told if by_blocks(path)]
    parted = {path for path, _ in told}
    whole = [r["path"] for r in files.select("path").collect() if r["path"] not in parted]
    chunks = file_chunks(read_files(spark, whole), strategy, min_words)
    if not told:
        return chunks
    found = dedup_files(surveyed(spark, told))
    clean = clean_documents(read_blocks(found, block, span).withColumn("content_hash", F.lit(None).cast("string")), unicode_form=False)
    units = written(chunking.units_of_blocks(clean, strategy), scratch)
    kept = units.groupBy("file_hash").agg(F.sum("word_count").alias("word_count")).filter(F.col("word_count") >= min_words)
    documents = found.select("file_hash", F.col("path").alias("source_path"), F.lit(0).alias("page_num")).join(kept.select("file_hash"), "file_hash", "left_semi")
    documents = documents.withColumn("doc_id", X.doc_identity(F.col("file_hash"), F.col("page_num")))
    return chunks.unionByName(index_rows(chunking.chunk_blocks(units, documents, strategy)))


def index_rows(chunks: DataFrame, told: tuple[str, ...] = ("source_path", "page_num", "strategy")) -> DataFrame:
    meta = F.map_from_arrays(F.array(*map(F.lit, told)), F.array(*(F.col(c).cast("string") for c in told)))
    return chunks.select("chunk_id", "text", "chunk_content_hash", tables.stable_metadata(meta).alias("metadata_json"), "file_hash")


def run_pipeline(files: DataFrame, folder: str, run: str, now: str, strategy: str = "sentence_window", min_words: int = 12, index: Index | None = None, reset: bool = False, loaders: dict[str, Load] = LOADERS) -> DataFrame:
    """Files to clean documents, chunks, snapshots, index and latest tables; one row of counts.

    files: path, content. The counts: files (read without failure), raw_pages, clean_docs, skipped (unsupported, copies, failed, near-empty),
    chunks. Pages are written once and read by all that follows; the latest tables are the snapshots until one of these changes. If indexing fails, the error is raised and the latest tables stay as
    they were; the snapshots of the run are there.
    """
    spark = files.sparkSession
    pages, counts = load_files(files, loaders)
    failed = F.col("raw_text").isNull()
    raw = pages.withColumn("failed", failed).withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
    raw = raw.withColumns({"content_hash": X.content_hash(F.col("raw_text")), "doc_id": X.doc_identity(F.col("file_hash"), F.col("page_num"))})
    clean = stamp(clean_documents(raw), run, now).withColumn("kept", ~F.col("failed") & (F.col("word_count") >= min_words))
    pages = write_snapshot(clean, f"{folder}/pages", run)
    documents = pages.filter("kept").drop("kept", "failed")
    chunks = write_snapshot(chunking.stamp_lineage(chunking.chunk_documents(documents, strategy), run, now), f"{folder}/chunks", run)
    if index is not None:
        index.index_chunks(index_rows(chunks, ("source_path", "page_num", "strategy", "ingestion_id")), reset)
    point_latest(spark, f"{folder}/pages", run, "kept", ("kept", "failed"))
    point_latest(spark, f"{folder}/chunks", run)
    seen = pages.agg(F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("raw_pages"), F.count_if("kept").alias("clean_docs")).crossJoin(counts).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))  # one row each
    skipped = F.col("given") - F.col("files") + F.col("failed") + F.col("raw_pages") - F.col("clean_docs")
    return spark.createDataFrame(*_held(seen.select((F.col("files") - F.col("failed")).alias("files"), "raw_pages", "clean_docs", skipped.alias("skipped"), "chunks")))


def _held(row: DataFrame) -> tuple[list, object]:
    """One row of counts, taken now."""
    return row.collect(), row.schema


def stamp(documents: DataFrame, run: str, now: str) -> DataFrame:
    return documents.withColumns({"ingestion_id": F.lit(run), "ingested_at": F.lit(now), "first_ingested_at": F.lit(now)})


def delete_ingestion(chunks: DataFrame, path: str, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that stay without a path and all below it, and one row of counts; the index, if given, loses the files too.

    Nothing at or below the path: LookupError.
    """
    targets = tables.deletion_targets(chunks, path)
    kept = tables.delete_rows(chunks, targets.select("source_path").distinct(), targets.select("file_hash").distinct())
    counts = targets.agg(F.countDistinct("source_path").alias("paths"), F.countDistinct("file_hash").alias("hashes"), F.count(F.lit(1)).alias("rows_matched"))
    rows, schema = _held(counts)
    if rows[0]["rows_matched"] == 0:
        raise LookupError(f"nothing at or below {path}")
    if index is not None:
        index.delete_files(targets.select("file_hash"))
    return kept, chunks.sparkSession.createDataFrame(rows, schema)
