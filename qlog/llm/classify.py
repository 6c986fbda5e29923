"""What both text classifiers share: bounded labelled samples, folds and scoring tables."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qlog.llm.common import fold, release


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most_rows: int, most_chars: int) -> DataFrame:
    """doc_id, text, lang, y of at most ``most_rows`` labelled rows outside the held-out fold.

    The rows with the smallest hash of their id are taken, so the sample does not depend on file
    order; texts over ``most_chars`` characters, null texts and null or unclear labels (an id with
    both values) are left out, copies of a text count once. Both bounds are parameters.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("_y"))
        .where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg(F.min("_y").alias("_y"), F.max("_y").alias("_z"))
        .where("_y = _z")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_rows)
    )
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    # at most most_rows rows of two numbers: small enough to broadcast by construction
    return (
        docs.select("doc_id", "text", lang.cast("string").alias("lang"))
        .where(F.length("text").between(1, most_chars))
        .join(F.broadcast(chosen.select("doc_id", "_y")), "doc_id")
        .groupBy(F.xxhash64("text").alias("_h"), "_y")
        .agg(F.min(F.struct("doc_id", "text", "lang")).alias("d"))
        .select(F.col("d.doc_id").alias("doc_id"), "d.text", "d.lang", F.col("_y").alias("y"))
        .orderBy("doc_id")
        .limit(most_rows)
    )


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """Model that ``fit`` makes of the (bounded) sample, trained in one task; only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            made = pickle.dumps(fit(pa.Table.from_batches(got)))
            got.clear()
            release()
            yield pa.RecordBatch.from_pydict({"model": pa.array([made], pa.binary())})

    row = sample.coalesce(1).mapInArrow(run, "model binary").first()
    if row is None:  # no labelled row at all
        kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "y": pa.int32()}
        return fit(pa.table({n: pa.array([], k) for n, k in kinds.items()}))
    return pickle.loads(row[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam steps on a list of arrays; rows of large tables may be updated alone."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(x) for x in params]
        self.v = [np.zeros_like(x) for x in params]

    def step(self, grads: list) -> None:
        """A gradient is an array, or (rows, array) for some rows of a table."""
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, m, v, g in zip(self.p, self.m, self.v, grads):
            if isinstance(g, tuple):
                rows, g = g
                m[rows] = 0.9 * m[rows] + 0.1 * g
                v[rows] = 0.999 * v[rows] + 0.001 * g * g
                p[rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)
            else:
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * m / (np.sqrt(v) + 1e-8)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature that gives held-back rows the least log loss (grid, then finer grid)."""
    if not len(y) or y.min() == y.max():
        return 1.0
    best = 1.0
    for span in (np.geomspace(0.2, 10, 40), np.linspace(0.9, 1.1, 21)):
        tries = span if len(span) == 40 else best * span
        loss = [-np.mean(np.where(y > 0, np.log(sigmoid(logits / t) + 1e-12), np.log(1 - sigmoid(logits / t) + 1e-12))) for t in tries]
        best = float(tries[int(np.argmin(loss))])
    return best
