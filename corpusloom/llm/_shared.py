"""Small helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in spark.checkpoint.dir, or what was given to setCheckpointDir. Only in local mode, where
    driver and executors are one process, a temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(tables: list[DataFrame]) -> None:
    """Delete written tables that no later read needs."""
    for one in tables:
        spark = one.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in one.inputFiles()}:
            if file.startswith(("file:", "/")) or "://" in file:
                spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spot, True)


#: Rows of a few numbers that one task takes.
ROWS_A_TASK = 100_000


def few_tasks(df: DataFrame, rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """df in no more tasks than so many rows need, but one for each core at least. Small tables of many rounds otherwise cost as many tasks each as a shuffle has partitions."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // a_task)))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join rows that may share a hot key to a table with one row per key.

    The rows of a key are dealt to `salts` tasks by a hash of the column `by`; each row of small is repeated for all of them. Sizes beyond that
    are split by AQE.
    """
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.hint("merge").join(repeated, [*keys, "__salt"], how).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 2_000_000, max_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each part holds at most about max_bytes of text (a longer text stands alone)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (held + n > max_bytes or i - start >= max_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)
