"""A stored table of unit vectors in cells around centroids, and exact filtered search that scores only the cells which can hold a hit.

    <folder>/points/cell=<c>/*.parquet    chunk_id, vector, and the columns that filters may name
    <folder>/cells                        cell, centroid, radius (largest distance of a point to it), n

A point of a cell is no nearer to a query than the query's distance to the centroid less the radius. So each query first looks at its nearest cells; the distance of the k-th best there
bounds what else can matter, and only cells that may be nearer are scored in the second turn. What is left out can't be among the k, so the result is that of scoring all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.tables import metadata_filter
from corpusloom.sources.shared import shared_path, written

#: Most centroids that are kept; they are sent to all tasks.
MOST_CELLS = 4_096
#: Scores that a task holds at a time.
SCORE_BLOCK = 500_000
#: Slack for rounding, in distances of unit vectors.
SLACK = 1e-6


def tiles(queries: int, points: int) -> Iterator[slice]:
    """Ranges of queries whose scores with so many points are SCORE_BLOCK at most."""
    step = max(1, SCORE_BLOCK // max(1, points))
    return (slice(at, at + step) for at in range(0, queries, step))


class TopK:
    """The k best of each query, fed with blocks of scores; ties go to the smaller id. Holds a few times as many entries as it returns."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 4 * queries * k + 100_000

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a line for each of the queries `which`, a column for each id."""
        if scores.shape[1] > self.k and np.isneginf(self.floor[which]).any():
            # a query's first points: only the k best of them can be among those of all
            self.floor[which] = np.maximum(self.floor[which], np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, c = np.nonzero(scores >= self.floor[which][:, None])
        self.held.append((which[q], ids[c], scores[q, c]))
        self.size += len(q)
        if self.size > self.most:
            self.settle()

    def score(self, which: np.ndarray, matrix: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        """Add the products of the vectors of the queries `which`, which are lines of matrix, with a block of points: never more than SCORE_BLOCK of them at a time."""
        for some in tiles(len(which), len(block)):
            self.add(which[some], ids, matrix[which[some]] @ block.T)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), dtype=bool), q[1:] != q[:-1])))
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
        full = nth == self.k - 1
        self.floor[q[full]] = scores[full]
        keep = nth < self.k
        self.held, self.size = [(q[keep], ids[keep], scores[keep])], int(keep.sum())
        return self.held[0]


class VectorTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str | None = None) -> None:
        """schema: of the points, for a table that may have none."""
        self.spark, self.folder = spark, folder
        reader = spark.read if schema is None else spark.read.schema(schema)
        self.points, self.cells = reader.parquet(f"{folder}/points"), spark.read.parquet(f"{folder}/cells")

    @classmethod
    def build(cls, points: DataFrame, folder: str | None = None, cells: int = 64) -> VectorTable:
        """points: chunk_id, vector (unit length), and columns to filter by. Centroids are points chosen by the hash of their id, `cells` at most."""
        if not 0 < cells <= MOST_CELLS:
            raise ValueError(f"cells must be between 1 and {MOST_CELLS}")
        spark = points.sparkSession
        folder = folder or shared_path(spark, "vectors")
        chosen = points.filter("vector IS NOT NULL").select("vector", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(cells).toArrow()
        centroids = np.array(chosen.column("vector").to_pylist(), dtype=np.float64).reshape(chosen.num_rows, -1 if chosen.num_rows else 1)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gap = _distance(np.array(batch.column("vector").to_pylist(), dtype=np.float64), centroids)
                    best = gap.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(gap[np.arange(len(best)), best])], [*batch.schema.names, "cell", "gap"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
        placed = points.filter("vector IS NOT NULL").mapInArrow(place, f"{kinds}, cell int, gap double")
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/points")
        spark.read.schema(f"{kinds}, gap double, cell int").parquet(f"{folder}/points").groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).join(
            F.broadcast(spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centroids)], "cell int, centroid array<double>")), "cell"
        ).write.mode("overwrite").parquet(f"{folder}/cells")
        return cls(spark, folder, f"{kinds}, gap double, cell int")

    def search(self, queries: DataFrame, k: int, filters: dict[str, object] | None = None, query_batch: int = 5_000) -> DataFrame:
        """query_id, chunk_id, score, rank: the k nearest of the points for which the filters hold. queries: query_id, vector (unit length)."""
        parts = max(1, -(-queries.count() // query_batch))
        told = self.cells.orderBy("cell").toArrow()  # MOST_CELLS at most
        numbers, radius, sizes = (told.column(c).to_numpy() for c in ("cell", "radius", "n"))
        centroids = np.array(told.column("centroid").to_pylist(), dtype=np.float64)
        found = None
        for part in range(parts):
            rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).select("query_id", "vector").toArrow()
            if not rows.num_rows or not len(numbers):
                continue
            matrix = np.array(rows.column("vector").to_pylist(), dtype=np.float64)
            low = np.maximum(_distance(matrix, centroids) - radius[None, :] - SLACK, 0)
            # first the nearest cells that have k points together, then those that may still hold a better one
            order = np.argsort(low, axis=1, kind="stable")
            ahead = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = np.zeros(low.shape, dtype=bool)
            np.put_along_axis(first, order, ahead < k, axis=1)
            one = self._scored(rows, matrix, numbers, first, k, filters)
            worst = {r["query_id"]: r["score"] for r in one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).collect()}  # one row a query
            bound = np.array([np.sqrt(max(0.0, 2 - 2 * worst[q])) if q in worst else np.inf for q in rows.column("query_id").to_pylist()])
            two = self._scored(rows, matrix, numbers, ~first & (low <= bound[:, None] + SLACK), k, filters)
            both = one.unionByName(two)
            found = both if found is None else found.unionByName(both)
        if found is None:
            return self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(self.points.dtypes)['chunk_id']}, score double, rank int")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")  # at most 2k rows a query
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _scored(self, queries: pa.Table, matrix: np.ndarray, numbers: np.ndarray, wanted: np.ndarray, k: int, filters: dict[str, object] | None) -> DataFrame:
        """The k best of each query in the cells that it wants. Only these cells' files are read, and filters are applied before any product."""
        self.scored = int(wanted.sum())  # pairs of query and cell, for those who want to know
        kinds = dict(self.points.dtypes)
        sent = self.spark.sparkContext.broadcast((queries.column("query_id").to_numpy(zero_copy_only=False), matrix, {int(c): np.flatnonzero(wanted[:, j]) for j, c in enumerate(numbers)}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, who = sent.value
            best = TopK(len(ids), k)
            names = np.zeros(0, dtype=np.int64)
            for batch in batches:
                cells = batch.column("cell").to_numpy()
                names = np.array(batch.column("chunk_id").to_pylist())
                block = np.array(batch.column("vector").to_pylist(), dtype=np.float64)
                for c in np.unique(cells).tolist():
                    here = np.flatnonzero(cells == c)
                    if len(who[c]):
                        for at in range(0, len(here), 1000):
                            some = here[at : at + 1000]
                            best.score(who[c], matrix, names[some], block[some])
            q, chunks, scores = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(chunks.tolist(), pa.int64() if kinds["chunk_id"] == "bigint" else pa.string()), pa.array(scores)], ["query_id", "chunk_id", "score"])

        read = self.points.filter(F.col("cell").isin([int(c) for c in numbers[wanted.any(axis=0)]])).filter(metadata_filter(filters or {}))
        kind = "long" if queries.schema.field("query_id").type in (pa.int64(), pa.int32()) else "string"
        made = written(read.select("cell", "chunk_id", "vector").mapInArrow(run, f"query_id {kind}, chunk_id {kinds['chunk_id']}, score double"), shared_path(self.spark, "scored"))
        sent.destroy()
        return made


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors, all pairs."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))
