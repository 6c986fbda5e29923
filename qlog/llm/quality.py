"""Quality: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every token bucket has a sparse random index vector (drawn from its number). Its word vector is the
sum of the index vectors of its neighbours, over every document of the corpus. A document is the
mean and the spread of its tokens' vectors; a small numpy network reads both, and a temperature
fitted on kept-back rows calibrates its probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.llm.classify import Adam, fit_in_task, sigmoid, temperature, training_sample
from qlog.llm.common import U64, Hasher, fold, mix, spans, text_slices

NONZERO, WINDOW, FAN_IN, PARTS = 4, 2, 64, 16
#: Words are one kind of byte; a run of one punctuation mark is a token of its own.
TOKEN_KINDS = np.array([1 if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 0 if b <= 32 or b == 127 else b for b in range(256)], np.uint8)


def index_vectors(buckets: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    draws = mix(np.arange(buckets * NONZERO, dtype=U64) + U64(0xA5A5))
    return (draws % U64(dims)).astype(np.int64).reshape(buckets, NONZERO), ((draws >> U64(40)) % U64(2)).astype(np.int64).reshape(buckets, NONZERO) * 2 - 1


def token_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = spans(raw, offsets, TOKEN_KINDS)
    return (Hasher(raw).of(start, end) % U64(buckets)).astype(np.int64), first


def add_contexts(total: np.ndarray, tokens: np.ndarray, first: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the index vectors of each token's neighbours (``WINDOW`` on each side, same text) to its row."""
    dims = total.shape[1]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for gap in range(1, WINDOW + 1):
        same = text[gap:] == text[:-gap]
        a, b = tokens[:-gap][same], tokens[gap:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                cell = x * dims + places[y, j]
                up = signs[y, j] > 0
                total += (np.bincount(cell[up], minlength=total.size) - np.bincount(cell[~up], minlength=total.size)).reshape(total.shape)


def context_vectors(docs: DataFrame, buckets: int, dims: int) -> np.ndarray:
    """Context sums of all tokens of all documents: buckets x dims, added up in a tree of fan-in 64.

    A task sends one fixed-size table in ``PARTS`` rows, whatever its input; the last level has
    ``PARTS`` rows, the only ones that reach the driver (buckets * dims * 8 bytes).
    """
    places, signs = index_vectors(buckets, dims)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, any_text = np.zeros((buckets, dims), np.int64), False
        for b in batches:
            for _, _, raw, offsets in text_slices(b.column(0), 4 << 20):
                tokens, first = token_buckets(raw, offsets, buckets)
                if len(tokens):
                    any_text = True
                    add_contexts(total, tokens, first, places, signs)
        if any_text:
            rows = [x.tobytes() for x in total.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "node": pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), "sums": pa.array(rows, pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets * dims // PARTS, np.int64)
        for b in batches:
            for x in b.column(b.schema.get_field_index("sums")):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, node int, sums binary"
    texts = docs.select("text").where(F.length("text") > 0)
    tables, tasks = texts.mapInArrow(task, schema), texts.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN_IN)
        tables = tables.withColumn("node", (F.col("node") / FAN_IN).cast("int")).groupBy("part", "node").applyInArrow(add, schema)
        if tasks <= 1:
            break
    total = np.zeros((PARTS, buckets * dims // PARTS), np.int64)
    for part, _, sums in tables.collect():
        total[part] += np.frombuffer(sums, np.int64)
    return total.reshape(buckets, dims)


@dataclass
class QualityModel:
    vectors: np.ndarray  # buckets x dims, float32
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    heat: float = 1.0

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.mean) / self.scale
        return np.tanh(x @ self.hidden + self.hidden_bias) @ self.out + self.out_bias


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each text, and its log length."""
    buckets, dims = vectors.shape
    parts = []
    for i, j, raw, offsets in text_slices(texts, 1 << 19):
        tokens, first = token_buckets(raw, offsets, buckets)
        n = np.diff(first)
        out = np.zeros((j - i, 2 * dims + 1), np.float32)
        full = n > 0
        if full.any():
            got, at = vectors[tokens], first[:-1][full]
            mean = np.add.reduceat(got, at, axis=0) / n[full, None]
            out[full, :dims] = mean
            out[full, dims:-1] = np.sqrt(np.maximum(np.add.reduceat(got * got, at, axis=0) / n[full, None] - mean * mean, 0))
        out[:, -1] = np.log1p(n)
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, 2 * dims + 1), np.float32)


def fit_network(pooled: np.ndarray, y: np.ndarray, vectors: np.ndarray, units: int = 32, epochs: int = 40, seed: int = 11) -> QualityModel:
    rng = np.random.default_rng(seed)
    width = pooled.shape[1]
    mean = pooled.mean(0) if len(pooled) else np.zeros(width)
    scale = pooled.std(0) + 1e-3 if len(pooled) else np.ones(width)
    base = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    w1, b1 = rng.normal(0, 1 / np.sqrt(width), (width, units)), np.zeros(units)
    w2, b2 = rng.normal(0, 1 / np.sqrt(units), units), np.array([np.log(base / (1 - base))])
    opt, x = Adam([w1, b1, w2, b2], 0.003), (pooled - mean) / scale
    for epoch in range(epochs):
        opt.rate = 0.003 / (1 + epoch / 10)
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            k = order[at : at + 64]
            h = np.tanh(x[k] @ w1 + b1)
            g = (sigmoid(h @ w2 + b2[0]) - y[k]) / len(k)
            gh = np.outer(g, w2) * (1 - h * h)
            opt.step([x[k].T @ gh + 1e-3 * w1, gh.sum(0), h.T @ g + 1e-3 * w2, np.array([g.sum()])])
    return QualityModel(vectors, mean.astype(np.float32), scale.astype(np.float32), w1.astype(np.float32), b1.astype(np.float32), w2.astype(np.float32), float(b2[0]))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, buckets: int = 1 << 14, dims: int = 32, most_rows: int = 8000, most_chars: int = 40_000) -> QualityModel:
    """Word vectors from all documents; network and temperature from a bounded labelled sample.

    ``most_rows`` and ``most_chars`` bound the sample (see ``training_sample``). Vectors are scaled to
    unit length; a bucket without neighbours has the zero vector. A fifth of the sample is kept back
    for the temperature.
    """
    sums = context_vectors(docs, buckets, dims).astype(np.float64)
    vectors = (sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # buckets * dims * 4 bytes

    def fit(sample: pa.Table) -> QualityModel:
        y = sample["y"].to_numpy().astype(np.float64)
        pooled = pool(sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string()), shared.value)
        back = np.arange(len(y)) % 5 == 4
        model = fit_network(pooled[~back], y[~back], shared.value)
        model.heat = temperature(model.logits(pooled[back]).astype(np.float64), y[back])
        return model

    return fit_in_task(training_sample(docs, labels, label, folds, held, most_rows, most_chars), fit)


def score_quality(docs: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """Add the calibrated probability that a text is of good quality.

    Null and empty texts pool to zero and get the network's answer for that. An input column named
    ``score`` is replaced. Rows are kept one for one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by buckets, dims and units
    docs = docs.drop(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = shared.value
                s = sigmoid(m.logits(pool(b.column(b.schema.get_field_index("text")), m.vectors)).astype(np.float64) / m.heat)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_quality(docs, labels)
    return score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
