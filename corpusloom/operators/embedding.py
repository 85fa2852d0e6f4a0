"""Embedding by a model of one's own: loaded once in each worker process, run on batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From texts to an array of one vector each.
Predict = Callable[[list[str]], np.ndarray]

#: The models that this worker process has loaded, by key. Spark keeps its workers from task to task.
_LOADED: dict[str, Predict] = {}


def loaded(key: str, load: Callable[[], Predict]) -> Predict:
    """The model of this worker process: sent functions carry their own globals, this one is imported, so all tasks of a process meet in its table."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


@dataclass(frozen=True)
class Model:
    """load gives the function that embeds; it is called in the workers, not on the driver. The key keeps the vectors of different models, versions and settings apart.

    Use: Index(spark, folder, embed=model.embed, model_key=model.key).
    """

    name: str
    version: str
    load: Callable[[], Predict]
    normalize: bool = True
    batch_rows: int = 64

    @property
    def key(self) -> str:
        return f"{self.name}|{self.version}|normalize_embeddings={self.normalize}"

    def embed(self, rows: DataFrame, column: str, kind: str = "passage") -> DataFrame:
        """Adds embedding. What is embedded is the text behind `passage: ` or `query: `; a null text counts as empty."""
        key, load, size, normalize = self.key, self.load, self.batch_rows, self.normalize
        names = rows.columns
        told = rows.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.concat(F.lit(f"{kind}: "), F.coalesce(column, F.lit(""))).alias("said"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            predict = loaded(key, load)
            for batch in batches:
                if not batch.num_rows:
                    continue
                texts = batch.column("said").to_pylist()
                made = np.concatenate([np.asarray(predict(texts[at : at + size]), dtype=np.float32) for at in range(0, len(texts), size)])
                if normalize:
                    made = made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), np.float32(1e-12))
                offsets = pa.array(np.arange(0, made.size + 1, made.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], [*batch.schema.names[:-1], "embedding"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in told.drop("said").schema)
        return told.mapInArrow(run, f"{kinds}, embedding array<float>").toDF(*names, "embedding")
