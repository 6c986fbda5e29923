"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

Words are hashed into rows of an embedding table (the word itself and its first bytes, so that
unseen inflections share a row). Filters of several widths run over the word sequence, each filter
keeps its maximum over the whole text, and a logistic layer reads the maxima. Trained in numpy on a
bounded labelled sample; every whole text is scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.llm.classify import Adam, fit_in_task, sigmoid, temperature, training_sample
from qlog.llm.common import U64, Hasher, fold, spans, text_slices

WIDTHS = (1, 2, 3)
#: ASCII letters, digits and all bytes of other scripts make words.
WORD_BYTES = np.array([1 if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 0 for b in range(256)], np.uint8)


@dataclass
class ToxicityModel:
    """Fitted network. ``thresholds``: decision threshold by language, with ``default`` for others."""

    buckets: int
    prefix_bytes: int
    tables: list[np.ndarray]  # per (width, place): rows of filter responses by bucket
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    heat: float = 1.0
    default: float = 0.3
    thresholds: dict[str, float] = field(default_factory=dict)

    def logits(self, rows: tuple[np.ndarray, np.ndarray], first: np.ndarray) -> np.ndarray:
        """``rows``: bucket of each word and of its prefix; ``first``: index of each text's first word."""
        word, prefix = rows
        texts, size = np.diff(first), len(word)
        total = np.full(len(texts), self.out_bias, np.float64)
        filled = texts > 0
        k, f = 0, len(self.bias[0])
        for width, bias in zip(WIDTHS, self.bias):
            seen = np.zeros((size, f), np.float32)
            for place in range(width):
                t = self.tables[k]
                got = t[word] + t[prefix]
                seen[: size - place] += got[place:] if place else got
                k += 1
            if width > 1:  # a window must end inside its text
                self._cut(seen, first, width)
            best = np.zeros((len(texts), f), np.float32)
            if filled.any():
                best[filled] = np.maximum.reduceat(seen, first[:-1][filled], axis=0)
            best = np.maximum(best + bias, 0)
            total += best @ self.out[(width - 1) * f : width * f]
        return total

    @staticmethod
    def _cut(seen: np.ndarray, first: np.ndarray, width: int) -> None:
        for back in range(1, width):
            at = first[1:] - back
            seen[at[(at >= first[:-1])]] = -1e9


def word_rows(raw: np.ndarray, offsets: np.ndarray, buckets: int, prefix_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = spans(raw, offsets, WORD_BYTES)
    h = Hasher(raw, fold_case=True)
    word = (h.of(start, end) % U64(buckets)).astype(np.int32)
    prefix = (h.of(start, np.minimum(end, start + prefix_bytes)) % U64(buckets)).astype(np.int32) + buckets
    return word, prefix, first


def fit_network(texts: pa.Array, y: np.ndarray, buckets: int = 1 << 15, dims: int = 16, filters: int = 8, prefix_bytes: int = 4, least_texts: int = 4, steps: int = 1500, seed: int = 7) -> ToxicityModel:
    """Train on the given texts, about ``steps`` batches of 32 in 4 to 40 rounds.

    Rows of the table met in fewer than ``least_texts`` texts stay zero.
    """
    rng = np.random.default_rng(seed)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, raw, offsets in text_slices(texts):
        word, prefix, first = word_rows(raw, offsets, buckets, prefix_bytes)
        docs += [(word[a:b], prefix[a:b]) for a, b in zip(first[:-1], first[1:])]
    df = np.zeros(2 * buckets, np.int32)
    for word, prefix in docs:
        df[np.unique(word)] += 1
        df[np.unique(prefix)] += 1
    kept = df >= least_texts
    emb = (rng.normal(0, 0.1, (2 * buckets, dims)) * kept[:, None]).astype(np.float32)
    convs = [rng.normal(0, 0.3, (w * dims, filters)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32)
    base = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
    top = np.array([np.log(base / (1 - base))], np.float32)
    opt = Adam([emb, *convs, *bias, out, top], 0.01)
    epochs = int(np.clip(32 * steps / max(1, len(docs)), 4, 40))
    for epoch in range(epochs):
        opt.rate = 0.02 / (1 + 4 * epoch / epochs)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            sizes = np.array([len(docs[i][0]) for i in batch])
            if not sizes.sum():
                continue
            batch, sizes = batch[sizes > 0], sizes[sizes > 0]
            word = np.concatenate([docs[i][0] for i in batch])
            prefix = np.concatenate([docs[i][1] for i in batch])
            first = np.concatenate([[0], np.cumsum(sizes)])
            x = emb[word] + emb[prefix]
            maxima, places = [], []
            for w, c, b in zip(WIDTHS, convs, bias):
                seen = np.zeros((len(x), filters), np.float32)
                for p in range(w):
                    seen[: len(x) - p] += (x @ c[p * dims : (p + 1) * dims])[p:]
                if w > 1:
                    ToxicityModel._cut(seen, first, w)
                arg = np.stack([a + seen[a:z].argmax(0) for a, z in zip(first[:-1], first[1:])])
                maxima.append(np.maximum(np.take_along_axis(seen, arg, 0) + b, -1e8))
                places.append(arg)
            pooled = np.concatenate(maxima, 1)
            act = np.maximum(pooled, 0)
            g = (sigmoid(act @ out + top[0]) - y[batch]).astype(np.float32) / len(batch)
            g_out, g_top = act.T @ g + 1e-4 * out, np.array([g.sum()], np.float32)
            g_pool = np.outer(g, out) * (pooled > 0)
            g_convs, g_bias, touched, into = [], [], [], []
            for n, (w, c) in enumerate(zip(WIDTHS, convs)):
                gp, arg = g_pool[:, n * filters : (n + 1) * filters], places[n]
                gc = np.zeros_like(c)
                for p in range(w):
                    pos = np.minimum(arg + p, len(x) - 1)
                    on = gp * (arg + p < first[1:, None])
                    gc[p * dims : (p + 1) * dims] = np.einsum("bf,bfd->df", on, x[pos])
                    touched.append(pos.ravel())
                    into.append((on[:, :, None] * c[p * dims : (p + 1) * dims].T[None]).reshape(-1, dims))
                g_convs.append(gc + 1e-4 * c)
                g_bias.append(gp.sum(0))
            pos, gx = np.concatenate(touched), np.concatenate(into)
            rows, back = np.unique(np.concatenate([word[pos], prefix[pos]]), return_inverse=True)
            g_emb = np.zeros((len(rows), dims), np.float32)
            np.add.at(g_emb, back, np.concatenate([gx, gx]))
            live = kept[rows]
            opt.step([(rows[live], g_emb[live] + 1e-4 * emb[rows[live]]), *g_convs, *g_bias, g_out, g_top])
    tables = [emb @ c[p * dims : (p + 1) * dims] for w, c in zip(WIDTHS, convs) for p in range(w)]
    return ToxicityModel(buckets, prefix_bytes, tables, bias, out.astype(np.float64), float(top[0]))


def score_texts(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    parts = []
    for _, _, raw, offsets in text_slices(texts, 1 << 19):
        word, prefix, first = word_rows(raw, offsets, model.buckets, model.prefix_bytes)
        parts.append(model.logits((word, prefix), first))
    return sigmoid(np.concatenate(parts) / model.heat) if parts else np.zeros(0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most_rows: int = 6000, most_chars: int = 40_000) -> ToxicityModel:
    """Fit on at most ``most_rows`` labelled texts outside fold ``held`` (see ``training_sample``).

    A fifth of the sample is kept back from the network to set its temperature and thresholds: for each language
    of ``docs`` the threshold between 0.1 and 0.9 with the best F1 on its kept-back rows (the default
    0.3 where a language has under 20 of them or only one label). Language never enters a score.
    An empty sample gives a model that scores every text 0.5 * its prior.
    """
    return fit_in_task(training_sample(docs, labels, label, folds, held, most_rows, most_chars), fit_sample)


def fit_sample(sample: pa.Table) -> ToxicityModel:
    """Network, temperature and thresholds of one labelled sample (doc_id, text, lang, y)."""
    y = sample["y"].to_numpy().astype(np.float64)
    texts = sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string())
    back = np.arange(len(y)) % 5 == 4
    model = fit_network(texts.filter(pa.array(~back)), y[~back])
    if back.any():
        s = np.clip(score_texts(model, texts.filter(pa.array(back))), 1e-9, 1 - 1e-9)
        logits = np.log(s / (1 - s))
        model.heat = temperature(logits, y[back])
        of = np.array([x or "" for x in sample["lang"].to_pylist()])[back]
        for lang in np.unique(of):
            p, t = sigmoid(logits[of == lang] / model.heat), y[back][of == lang]
            if lang and len(t) >= 20 and 0 < t.sum() < len(t):
                grid = np.arange(0.1, 0.91, 0.05)
                f1 = [2 * ((p >= g) & (t > 0)).sum() / max(1, (p >= g).sum() + t.sum()) for g in grid]
                best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
                model.thresholds[str(lang)] = round(float(grid[best].mean()), 3)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, score: str = "score") -> DataFrame:
    """Add ``score`` (0 to 1) of the whole text and ``rejected`` (score at or above the language's threshold).

    Null and empty texts have no words and get the score of an empty text. A column of the input
    that has one of the new names is replaced. Rows are kept one for one, in no set order.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # its size is fixed by the model's parameters
    docs = docs.drop(score, "rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = score_texts(shared.value, b.column(b.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, score])

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
    limit = F.lit(model.default)
    if "lang" in docs.columns and model.thresholds:
        table = F.create_map(*[F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv])
        limit = F.coalesce(F.try_element_at(table, F.col("lang")), limit)
    return scored.withColumn("rejected", F.col(score) >= limit)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and the language-calibrated decision."""
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected"
    )
