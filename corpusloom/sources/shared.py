"""Tables that several steps of a job read: written to the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of keys up to this size is sent to every task; a longer one is joined by sorting.
SMALL_LIST = 500_000
#: How stored tables are compressed: texts, hashes and vectors are written several times over.
CODEC = "zstd"
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: that of spark.checkpoint.dir, or the one given to setCheckpointDir.

    In local mode alone, where they are one process, the warehouse stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(rows: DataFrame) -> Iterator[None]:
    """Shuffle files of what these rows are written from are deleted when the write ends, not when the driver next collects garbage: steps that follow each other need the disk of one."""
    conf = rows.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        yield
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)


def written(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written and read back: whatever depends on them reads them instead of making them again."""
    with shuffles_freed(rows):
        rows.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose key isn't listed; null keys stay. Keys are compared alone: a list of those that rows have is mostly small or empty, and then the rows aren't shuffled."""
    return less(rows, rows.select(column).distinct().join(gone.select(column).distinct(), column, "left_semi"), [column])


def less(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those of the listed keys, which aren't shuffled if the list is small."""
    many = gone.limit(SMALL_LIST + 1).count()
    return rows.join(F.broadcast(gone) if many <= SMALL_LIST else gone.hint("merge"), keys, "left_anti") if many else rows


def only(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is listed, without a shuffle of the rows where the list is small. keys: a written table."""
    listed = keys.select(column).distinct()
    return rows.join(F.broadcast(listed) if listed.count() <= SMALL_LIST else listed.hint("merge"), column, "left_semi")
