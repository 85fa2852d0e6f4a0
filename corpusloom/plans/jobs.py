"""Ingestion jobs and all that belongs to one: saved with the id of the job they repeat, deleted with everything they made.

Jobs are a table of their own (`buckets.py`), parted by project. A deletion takes the job's row away last: one that breaks off is run again and goes on, as each of its steps
finds nothing left to do where it was done.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import tables
from corpusloom.plans.buckets import BucketTables, spot_of
from corpusloom.plans.ingest import Index, read_latest, settle_latest, write_latest
from corpusloom.sources.shared import without


@dataclass
class Jobs:
    spark: SparkSession
    folder: str

    SCHEMA = "id string, project_id string, file_type string, input_path string, file_hashes array<string>, source_paths array<string>, ingestion_id string, status string, created_at string, updated_at string"

    def tables(self) -> BucketTables:
        return BucketTables(self.spark, self.folder, {"jobs": self.SCHEMA}, {"jobs": "project_id"}, buckets=8)

    def all(self) -> DataFrame:
        return self.tables().read("jobs")

    def save(self, new: DataFrame) -> None:
        """Jobs by id. One that repeats a job (same project and type, and the same path or a file or source in common) takes the newest such job's id and created_at and replaces it.

        Of several saved rows with one id the newest updated_at counts. new: columns of SCHEMA.
        """
        held = self.tables()
        here = held.buckets_of("jobs", new)
        old = held.read("jobs", here)
        met = tables.match_ingestion_job(new.withColumnRenamed("id", "run_id"), old.withColumnRenamed("id", "job_id"))
        named = new.hint("merge").join(met.select(F.col("run_id").alias("id"), "job_id"), "id", "left").withColumn("id", F.coalesce("job_id", "id")).drop("job_id")
        held.replace("jobs", tables.save_jobs(old, named), here)
        held.commit()

    def related(self, job: dict) -> DataFrame:
        """Other jobs of the project whose input path is below that of the job."""
        below = F.col("input_path").startswith((job["input_path"] or "").rstrip("/") + "/") if job["input_path"] else F.lit(False)
        return self.all().filter((F.col("project_id").eqNullSafe(F.lit(job["project_id"]))) & (F.col("id") != job["id"]) & below)

    def delete(self, job_id: str, folder: str, index: Index | None = None) -> dict[str, int]:
        """Delete a job with its vectors, its rows in the latest pages and chunks below folder, its snapshots and the jobs below its path. Counts of each.

        What belongs to it: rows of its run, at or below its input path, or of its files. An unknown job, or one to which nothing belongs: LookupError. The files that were
        read are not touched.
        """
        found = self.all().filter(F.col("id") == job_id).collect()
        if not found:
            raise LookupError(f"no job {job_id}")
        job = found[0].asDict()
        path = (job["input_path"] or "").rstrip("/")
        mine = F.col("ingestion_id").eqNullSafe(F.lit(job["ingestion_id"])) & F.lit(job["ingestion_id"] is not None)
        if path:
            mine |= (F.col("source_path") == path) | F.col("source_path").startswith(path + "/")
        mine = F.coalesce(mine, F.lit(False))
        latest = {name: read_latest(self.spark, f"{folder}/{name}") for name in ("pages", "chunks") if self._there(f"{folder}/{name}/latest")}
        told = self.spark.createDataFrame([(h, p) for h, p in [*((h, None) for h in job["file_hashes"] or []), *((None, p) for p in job["source_paths"] or [])]], "file_hash string, source_path string")
        targets = told
        for rows in latest.values():
            targets = targets.unionByName(rows.filter(mine).select("file_hash", "source_path"))
        targets = targets.distinct().cache()  # both anti joins and the index read it
        hashes, paths = (targets.filter(F.col(c).isNotNull()).select(c).distinct() for c in ("file_hash", "source_path"))
        counts = {"vectors": 0, "rows": 0, "snapshots": 0, "jobs": 0}
        related = self.related(job)
        if targets.isEmpty() and related.isEmpty():
            raise LookupError(f"nothing belongs to job {job_id}")
        if index is not None:
            counts["vectors"] = index.manifest().hint("merge").join(hashes, "file_hash", "left_semi").count()
            index.delete_files(hashes)
        for name, rows in latest.items():
            # most of it is told row by row; what only shares a path or file with it is found by these keys
            kept = without(without(rows.filter(~mine), paths, "source_path"), hashes, "file_hash")
            gone = rows.count() - kept.count()
            if gone:
                write_latest(kept, f"{folder}/{name}", f"without-{job_id}")
            counts["rows"] += gone
        for name in ("pages", "chunks"):
            settle_latest(self.spark, f"{folder}/{name}", job["ingestion_id"])
            spot, store = spot_of(self.spark, f"{folder}/{name}/snapshots/run={job['ingestion_id']}")
            counts["snapshots"] += int(bool(job["ingestion_id"]) and store.delete(spot, True))
        targets.unpersist()
        held = self.tables()
        gone = related.select("id", "project_id").unionByName(self.all().filter(F.col("id") == job_id).select("id", "project_id"))
        here = held.buckets_of("jobs", gone)
        counts["jobs"] = related.count()
        held.replace("jobs", tables.delete_keys(held.read("jobs", here), gone, ["id"]), here)
        held.commit()
        return counts

    def _there(self, path: str) -> bool:
        spot, store = spot_of(self.spark, path)
        return store.exists(spot)
