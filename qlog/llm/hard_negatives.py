"""Hard negatives by slots of scores.

The windows of an anchor's positives overlap, but each ends at an upper limit of its own. The distinct upper limits cut
the scores of an anchor into disjoint slots. Blocks keep the k best negatives of each slot, a merge over blocks keeps the
k best again, and the k best of a window are the k best of its own slot and all slots below it, cut at the window's lower
limit. So every candidate is scored once for an anchor, however many positives the anchor has.

Anchors meet all rows in blocks; nothing but k rows an anchor, slot and block leaves a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.llm.common import written
from qlog.llm.topk import _integers, _matrix, _scaled

ANCHOR_BLOCK, LEAST_BLOCKS, BLOCK = 4096, 24, 32768
#: Anchors whose scores a task holds at once.
STEP = 64
FOUND = "anchor_row long, anchor_id long, slot int, vec_id long, score long"


def score_rows(q: np.ndarray, x: np.ndarray, q_plain: np.ndarray, plain: np.ndarray, raw_q: np.ndarray, raw_x: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of whole numbers, exact: doubles or longs where they hold every sum, else Python's integers."""
    if q_plain.all() and plain.all():
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53
        return (q @ x.T if exact else q.astype(np.int64) @ x.astype(np.int64).T).astype(np.int64)
    return _integers(raw_q, scale) @ _integers(raw_x, scale).T


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; only what reaches the k-th score is sorted."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def slots_of(score: np.ndarray, uppers: np.ndarray) -> np.ndarray:
    """Slot of each score: the number of distinct upper limits (falling) that lie at or above it, less one."""
    return len(uppers) - np.searchsorted(uppers[::-1], score, "left") - 1


def _told(anchor: int, vec: int, score: int) -> int:
    if abs(score) >= 1 << 63:
        raise OverflowError(f"the score of anchor {anchor} and vector {vec} does not fit a long")
    return int(score)


def tile(left: pa.Table, right: pa.Table, k: int, scale: int, slotted: bool) -> pa.Table:
    """The k best of a block of candidates for each anchor, or for each slot of an anchor if ``slotted`` (FOUND).

    Without slots, candidates are the other rows of the anchor's label (the caller groups by it); with slots, the rows of
    all other labels between the anchor's least lower and its highest upper limit.
    """
    out: list[list] = [[] for _ in range(5)]
    if left.num_rows and right.num_rows:
        raw_q, raw_x = _matrix(left["embedding"]), _matrix(right["embedding"])
        (q, q_plain), (x, plain) = _scaled(raw_q, scale), _scaled(raw_x, scale)
        ids, own, labels = (right[c].to_numpy() for c in ("vec_id", "row", "label"))
        q_ids, q_own, q_labels = (left[c].to_numpy() for c in ("vec_id", "row", "label"))
        limits = [(np.array(u, object), low) for u, low in zip(left["uppers"].to_pylist(), left["least"].to_pylist())] if slotted else []
        for i in range(0, len(q), STEP):
            part = slice(i, i + STEP)
            scores = score_rows(q[part], x, q_plain[part], plain, raw_q[part], raw_x, scale)
            for r, score in enumerate(scores):
                at = i + r
                if slotted:
                    uppers, low = limits[at]
                    live = np.flatnonzero((labels != q_labels[at]) & (score <= uppers[0]) & (score >= low))
                    slot = slots_of(score[live], uppers.astype(score.dtype))
                    picks = [(s, live[slot == s]) for s in np.unique(slot).tolist()]
                else:
                    picks = [(0, np.flatnonzero(own != q_own[at]))]
                for s, live in picks:
                    best = live[best_of(score[live], ids[live], k)]
                    out[0] += [q_own[at]] * len(best)
                    out[1] += [q_ids[at]] * len(best)
                    out[2] += [s] * len(best)
                    out[3] += ids[best].tolist()
                    out[4] += [_told(q_ids[at], ids[b], score[b]) for b in best]
    return pa.table([pa.array(v, pa.int32() if n == 2 else pa.int64()) for n, v in enumerate(out)], names=["anchor_row", "anchor_id", "slot", "vec_id", "score"])


def _floor(score: str, num: int, den: int) -> Column:
    """floor(score * num / den) in whole numbers."""
    x = f"(cast({score} as decimal(20,0)) * {num})"
    return F.expr(f"cast(({x} - pmod({x}, {den})) div {den} as long)")


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k first rows of each key by falling score, then by id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, scale: int = 256, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100)
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x), of any size. Anchors are rows whose vec_id is divisible by ``every``; an
    anchor's positives are its ``positives`` first other rows of its label, higher scores first, ties by the smaller
    vec_id. For each of them come the ``k`` first rows of other labels whose score n holds low[0] * p <= low[1] * n and
    high[1] * n <= high[0] * p for the positive's score p. A negative p leaves no window.

    Rows take no part whose label, id or vector is null, or whose vector is empty or holds null or non-finite components.
    Vectors of different length do not meet. Repeated rows are rows of their own: a repeated anchor answers once a row, a
    repeated candidate is found as often as it occurs. A kept score that does not fit a long is an error that names its
    pair. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.coalesce(usable, F.lit(False)))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding", F.size("embedding").alias("d")), "vectors")
    asks = F.col("vec_id") % every == 0
    total, asked = rows.agg(F.count("*"), F.count_if(asks)).first()
    blocks, sets = max(LEAST_BLOCKS, -(-total // BLOCK)), max(1, -(-asked // ANCHOR_BLOCK))
    numbers = lambda top: F.explode(F.sequence(F.lit(0), F.lit(top - 1)))
    place = lambda col, top: F.pmod(F.xxhash64(col), F.lit(top)).cast("int")
    candidates = rows.withColumn("b", place("row", blocks)).withColumn("a", numbers(sets))
    anchors = rows.where(asks).toDF(*rows.columns)  # columns of their own, or the two sides of a cogroup are confused

    keys = ["d", "label", "a", "b"]
    asking = anchors.withColumn("a", place("row", sets)).withColumn("b", numbers(blocks))
    same = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda x, y: tile(x, y, positives, scale, False), FOUND)
    found = _first(same, ["anchor_row"], positives)
    upper, lower = _floor("score", *high), -_floor("-score", *low)
    found = written(found.select("anchor_row", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score"), upper.alias("upper"), lower.alias("lower")), "positives")
    open_ = found.where("lower <= upper")
    limits = open_.groupBy("anchor_row").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("least"))

    keys = ["d", "a", "b"]
    asking = anchors.join(limits, anchors["row"] == limits["anchor_row"]).drop("anchor_row").withColumn("a", place("row", sets)).withColumn("b", numbers(blocks))
    other = asking.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(lambda x, y: tile(x, y, k, scale, True), FOUND)
    slots = _first(other, ["anchor_row", "slot"], k).drop("anchor_id", "rank")
    # Windows of one anchor: positives (at most ``positives``) times slots; both sides are a few rows a key.
    merged = open_.join(slots, "anchor_row").where("score <= upper")
    ranked = _first(merged, ["anchor_row", "place"], k).where("score >= lower")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The contract's labels: where vec_id is divisible by 7, (label + 1) % 10."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


DIGEST_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
         CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.n <> c.n AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
w AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""
