"""What the two classifiers share: a bounded labelled sample, and scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import held_out, tidied

#: Labelled rows a classifier is fitted on, at most, whatever the input's size.
SAMPLE_ROWS = 10_000


#: Texts of a batch that are Python strings at a time.
AT_ONCE = 500


def _few(batches):
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(label, text) of up to ``limit`` labelled documents, none of them held out.

    Rows are chosen by a hash of their id. The chosen ids are broadcast: their
    number is bounded by ``limit``. Null labels and null ids are never chosen.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("label", "text")


def sample_matrix(sample: DataFrame, features: Callable[[str], list[float]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, computed on the executors; texts stay there."""

    def run(batches):
        for b in _few(batches):
            rows = [features(t or "") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    got = sample.mapInArrow(tidied(run), "label int, x array<double>").toPandas()
    # Sorted, so that a fit doesn't depend on the order rows arrive in.
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), n)
    order = np.lexsort((*x.T[::-1], got["label"].to_numpy()))
    return x[order], got["label"].to_numpy(dtype=np.float64)[order]


def score_documents(docs: DataFrame, features: Callable[[str], list[float]], predict: Callable[[np.ndarray], np.ndarray], threshold: float, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``keep`` the whole row as a struct ``row``
    in place of doc_id, so that its columns may be called anything."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if keep else F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(own, F.col("text").alias("text"), held_out().alias("held_out"))
    schema = rows.drop("text").schema.add("score", "double").add("predicted", IntegerType())
    at = rows.columns.index("text")

    def run(batches):
        for b in _few(batches):
            texts = b.column(at).to_pylist()
            score = predict(np.array([features(t or "") for t in texts], dtype=np.float64)) if texts else np.empty(0)
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.record_batch([*columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(tidied(run), schema)
