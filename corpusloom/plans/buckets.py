"""Tables parted by hash bucket below one folder, changed bucket by bucket and committed together.

    <folder>/<table>/v<n>/bucket=<k>/*.parquet    the rows that commit n wrote
    <folder>/commits/v<n>                         which folders make up each table after commit n (JSON)

A commit writes the buckets that change into a new folder and then a pointer file, which lists the folders of all buckets: those of the others stay as they are,
file names included. Readers take the newest pointer, so they see all tables of one commit, and a run that breaks off has changed nothing. The work
of a change goes with the buckets that it touches. What no pointer names any more is deleted by `vacuum`.

One writer at a time: a pointer is put in place by renaming, and a commit that finds its number taken fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import CODEC, shuffles_freed

Places = dict[str, dict[str, list[str]]]


def spot_of(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system, whichever scheme it has."""
    spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spot, spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class BucketTables:
    """The tables below a folder. schemas: of each table its columns; keys: of each the column that says in which bucket a row is.

    buckets: set when the folder is first written, then read from it. So many that one of them is a file of reasonable size (about 100 MB).
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, str], buckets: int = 32) -> None:
        self.spark, self.folder, self.schemas, self.keys = spark, folder, schemas, keys
        self.number, told = self._newest()
        self.buckets: int = told.get("buckets", buckets)
        self.places: Places = told.get("places", {name: {} for name in schemas})
        self.pending: Places = {name: dict(held) for name, held in self.places.items()}

    def _commits(self) -> list[int]:
        spot, store = spot_of(self.spark, f"{self.folder}/commits")
        if not store.exists(spot):
            return []
        names = [s.getPath().getName() for s in store.listStatus(spot)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def _newest(self) -> tuple[int, dict]:
        commits = self._commits()
        return (commits[-1], self._pointer(commits[-1])) if commits else (0, {})

    def _pointer(self, number: int) -> dict:
        lines = self.spark.read.text(f"{self.folder}/commits/v{number}", wholetext=True).first()
        return json.loads(lines["value"])

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(F.col(self.keys[table]).cast("string")), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table: str, rows: DataFrame) -> list[int]:
        """In which buckets of a table these rows are (they need its key column); at most as many as there are buckets."""
        return sorted(r["bucket"] for r in rows.select(self.bucket(table).alias("bucket")).distinct().collect())

    def read(self, table: str, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of the table as of the newest commit, or of some buckets alone."""
        return self._read(self.places, table, only)

    def written(self, table: str, only: Iterable[int] | None = None) -> DataFrame:
        """The same with what has been written since and is not committed."""
        return self._read(self.pending, table, only)

    def _read(self, places: Places, table: str, only: Iterable[int] | None) -> DataFrame:
        held = places.get(table, {})
        wanted = held if only is None else map(str, only)
        paths = [f"{self.folder}/{p}" for k in wanted for p in held.get(k, [])]
        reader = self.spark.read.schema(self.schemas[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def clear(self, table: str) -> None:
        """All rows of the table go with the next commit."""
        self.pending[table] = {}

    def replace(self, table: str, rows: DataFrame, touched: Iterable[int]) -> None:
        """These buckets have these rows from the next commit on; a bucket without rows is empty."""
        for k in touched:
            self.pending[table].pop(str(k), None)
        for k, path in self._write(table, rows).items():
            self.pending[table][k] = [path]

    def append(self, table: str, rows: DataFrame, most: int = 16) -> None:
        """Rows are added to their buckets, in files beside the others; a bucket of `most` folders is made one."""
        for k, path in self._write(table, rows).items():
            self.pending[table].setdefault(k, [])
            self.pending[table][k] = [*self.pending[table][k], path]
        full = [k for k, paths in self.pending[table].items() if len(paths) >= most]
        if full:
            self.replace(table, self.written(table, full), full)

    def _write(self, table: str, rows: DataFrame) -> dict[str, str]:
        name = f"{table}/v{self.number + 1}-{uuid.uuid4().hex[:8]}"
        columns = [c.split()[0] for c in self.schemas[table].split(", ")]
        # by bucket, but a large one is dealt to several tasks and files: there are few buckets, and one task each would not end sooner on more machines
        dealt = rows.select(*columns, self.bucket(table).alias("bucket")).hint("rebalance", "bucket")
        with shuffles_freed(rows):
            dealt.write.option("compression", CODEC).partitionBy("bucket").parquet(f"{self.folder}/{name}")
        spot, store = spot_of(self.spark, f"{self.folder}/{name}")
        found = [s.getPath().getName() for s in store.listStatus(spot) if s.isDirectory()]
        return {f.removeprefix("bucket="): f"{name}/{f}" for f in found if f.startswith("bucket=")}

    def commit(self) -> None:
        """Make what was written current, all tables at once."""
        if self.pending == self.places and self.number:
            return
        number = self.number + 1
        done, store = spot_of(self.spark, f"{self.folder}/commits/v{number}")
        draft, _ = spot_of(self.spark, f"{self.folder}/commits/.draft-{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(json.dumps({"buckets": self.buckets, "places": self.pending}).encode())
        out.close()
        if store.exists(done) or not store.rename(draft, done):
            store.delete(draft, False)
            raise RuntimeError(f"{self.folder}: commit {number} was made by another writer")
        self.number, self.places = number, {name: dict(held) for name, held in self.pending.items()}

    def vacuum(self, keep: int = 2) -> int:
        """Delete all that none of the newest `keep` commits names; how many folders went. No other writer or older reader may be at work."""
        commits = self._commits()
        kept = {p for n in commits[-keep:] for held in self._pointer(n)["places"].values() for paths in held.values() for p in paths}
        gone = 0
        for table in self.schemas:
            spot, store = spot_of(self.spark, f"{self.folder}/{table}")
            for version in store.listStatus(spot) if store.exists(spot) else []:
                name = f"{table}/{version.getPath().getName()}"
                for part in store.listStatus(version.getPath()):
                    if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in kept:
                        gone += bool(store.delete(part.getPath(), True))
        for n in commits[:-keep]:
            spot, store = spot_of(self.spark, f"{self.folder}/commits/v{n}")
            store.delete(spot, False)
        return gone
