"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation (the norm of what is left after
the mean). Sums over segments of products of means and of deviations bound an inner product from
above, which with the norms is a lower bound of the squared distance. Bounds go from coarse to fine
and drop candidates that cannot reach the k best; survivors are computed exactly, in integers.
Each query first meets a few seeds, the same for all; the score of its k-th best seed goes along as its bound to
the blocks in which queries and candidates meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.llm.common import written

QUERY_BLOCK, LEAST_BLOCKS, BLOCK = 8192, 24, 16384
LEVELS = (4, 16)
#: Rows that bound every query's k-th score, and the components that these hold together at most.
SEEDS, SEED_COMPONENTS = 4096, 1 << 19


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled segment means, then segment deviations; their products bound inner products."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(1, keepdims=True)
        out.append((mean[:, 0] * np.sqrt(part.shape[1]), np.linalg.norm(part - mean, axis=1)))
    return np.concatenate([np.stack([m for m, _ in out], 1), np.stack([d for _, d in out], 1)], 1)


def plain_limit(d: int) -> float:
    """Vectors of ``d`` components below this have inner products that fit a long with room to spare."""
    return float(1 << ((62 - math.ceil(math.log2(max(2, d)))) // 2))


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """Scaled and floored components as Python's integers."""
    return np.array([[math.floor(Fraction(float(c)) * scale) for c in row] for row in x], object).reshape(x.shape)


def block_top(q: np.ndarray, q_own: np.ndarray, least: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query, candidate, score) of each query's k best in a block, ties to the smaller id.

    ``q`` and ``x`` hold whole numbers below ``plain_limit``. ``q_own`` and ``own`` number rows; a query does
    not meet its own row. Of scores under ``least`` (minus infinity: none known) not all are given.
    """
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53
    whole = x if exact else x.astype(np.int64)
    levels = [(segment_statistics(q, s), segment_statistics(x, s)) for s in LEVELS]
    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    least = least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
    rows, cols, scores = [], [], []
    for i in range(0, len(q), 64):
        coarse = levels[0][0][i : i + 64] @ levels[0][1].T + slack[i : i + 64, None]
        for r in range(len(coarse)):
            at, bound = i + r, coarse[r]
            live = np.flatnonzero((bound >= least[at]) & (own != q_own[at]))
            v = q[at].astype(whole.dtype)
            if len(live) > 4 * k:
                seeds = live[np.argpartition(bound[live], -2 * k)[-2 * k :]]
                low = max(least[at], float(np.partition(whole[seeds] @ v, -k)[-k]) * (1 - 1e-12) - 1e-6)
                live = live[bound[live] >= low]
                for fine_q, fine_x in levels[1:]:
                    live = live[fine_x[live] @ fine_q[at] + slack[at] >= low]
            score = np.asarray(whole[live] @ v).astype(np.int64)
            best = np.lexsort((ids[live], -score))[:k]
            rows += [at] * len(best)
            cols += live[best].tolist()
            scores += score[best].tolist()
    return rows, cols, scores


def wide_top(q: np.ndarray, q_own: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, scale: int) -> tuple[list, list, list]:
    """As ``block_top`` for components of any size, one query at a time in Python's integers."""
    rows, cols, scores = [], [], []
    if len(q) and len(x):
        whole = _integers(x, scale)
        for at, v in enumerate(_integers(q, scale)):
            live = np.flatnonzero(own != q_own[at])
            score = whole[live] @ v
            for n in sorted(range(len(live)), key=lambda n: (-score[n], ids[live[n]]))[:k]:
                rows.append(at)
                cols.append(int(live[n]))
                scores.append(int(score[n]))
    return rows, cols, scores


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _scaled(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, and which rows are plain (see ``plain_limit``)."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * x)
    return whole, np.abs(whole).max(1, initial=0) < plain_limit(x.shape[1])


FOUND = "query_id long, query_row long, vec_id long, score long, too_large boolean"


def tile(left: pa.Table, right: pa.Table, k: int, scale: int) -> pa.Table:
    """The k best of a block of candidates for each of a block of queries (FOUND)."""
    out: list[list] = [[] for _ in range(5)]
    if left.num_rows and right.num_rows:
        (q, q_plain), (x, plain) = (_scaled(_matrix(t["embedding"]), scale) for t in (left, right))
        q_ids, q_own, ids, own = (t[c].to_numpy() for t in (left, right) for c in ("vec_id", "row"))
        least = np.array([-np.inf if v is None else float(v) for v in left["least"].to_pylist()])
        raw_q, raw_x = _matrix(left["embedding"]), _matrix(right["embedding"])
        every = np.ones(len(x), bool)
        parts = [(np.flatnonzero(q_plain), np.flatnonzero(plain), True), (np.flatnonzero(q_plain), np.flatnonzero(~plain), False), (np.flatnonzero(~q_plain), np.flatnonzero(every), False)]
        for a, b, fast in parts:
            if len(a) and len(b):
                args = (ids[b], own[b], k)
                r, c, s = block_top(q[a], q_own[a], least[a], x[b], *args) if fast else wide_top(raw_q[a], q_own[a], raw_x[b], *args, scale)
                fits = [abs(v) < 1 << 63 for v in s]
                if any(not f and v > 0 for f, v in zip(fits, s)):
                    n = next(n for n, f in enumerate(fits) if not f and s[n] > 0)
                    raise OverflowError(f"the score of query {q_ids[a[r[n]]]} and vector {ids[b[c[n]]]} does not fit a long")
                cols = [q_ids[a[r]], q_own[a[r]], ids[b[c]], [v if f else None for v, f in zip(s, fits)], [not f for f in fits]]
                for have, more in zip(out, cols):
                    have += list(more)
    return pa.table({n: pa.array(v, pa.bool_() if n == "too_large" else pa.int64()) for n, v in zip(("query_id", "query_row", "vec_id", "score", "too_large"), out)})


def _bounded(queries: DataFrame, seeds: pa.Table, k: int, scale: int) -> DataFrame:
    """``queries`` with least: the score of the k-th best seed, null where there is none."""
    shared = queries.sparkSession.sparkContext.broadcast(seeds)  # SEEDS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {d: shared.value.filter(pa.compute.equal(shared.value["d"], d)) for d in shared.value["d"].unique().to_pylist()}
        by = {d: (*_scaled(_matrix(t["embedding"]), scale), t["row"].to_numpy()) for d, t in by.items()}
        for b in batches:
            t, least = pa.Table.from_batches([b]), [None] * b.num_rows
            sizes = t["d"].to_numpy()
            for d in np.unique(sizes).tolist():
                if d not in by:
                    continue
                x, plain, rows = by[d]
                at = np.flatnonzero(sizes == d)
                q, q_plain = _scaled(_matrix(t["embedding"].take(pa.array(at))), scale)
                own = t["row"].to_numpy()[at]
                for n in np.flatnonzero(q_plain):
                    score = x[plain & (rows != own[n])].astype(np.int64) @ q[n].astype(np.int64)
                    if len(score) >= k:
                        least[at[n]] = int(np.partition(score, -k)[-k])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], [*b.schema.names, "least"])

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("least", T.LongType())]))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    Components become floor(``scale`` * x), of any size. Queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own. Rows whose vector is null, empty, or holds null or
    non-finite components, and rows without an id take no part. Vectors of different length do not meet. Repeated rows are rows
    of their own: they are found as often as they occur, and a repeated query answers once a row.
    A score among the k best that does not fit a long is an error that names its pair. Other columns are
    ignored; an empty table gives no rows.
    """
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(usable, F.lit(False)))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("d")), "vectors")
    asks = F.col("vec_id") % every == 0
    total, asked, longest = rows.agg(F.count("*"), F.count_if(asks), F.max("d")).first()
    seeds = rows.orderBy(F.xxhash64("row"), "row").limit(min(SEEDS, max(2 * k, SEED_COMPONENTS // (longest or 1)))).toArrow()
    blocks, sets = max(LEAST_BLOCKS, -(-total // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    numbers = lambda top: F.sequence(F.lit(0), F.lit(top - 1))
    place = lambda top: F.pmod(F.xxhash64("row"), F.lit(top)).cast("int")
    queries = _bounded(rows.where(asks), seeds, k, scale).withColumn("a", place(sets)).withColumn("b", F.explode(numbers(blocks)))
    candidates = rows.withColumn("b", place(blocks)).withColumn("a", F.explode(numbers(sets)))
    found = queries.groupBy("d", "a", "b").cogroup(candidates.groupBy("d", "a", "b")).applyInArrow(lambda x, y: tile(x, y, k, scale), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc_nulls_last("score"), "vec_id")
    told = F.raise_error(F.concat(F.lit("the score of query "), "query_id", F.lit(" and vector "), "vec_id", F.lit(" does not fit a long"))).cast("long")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("too_large"), told).otherwise(F.col("score")).alias("score"))


DIGEST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
