"""Kept totals and the live timeline against recomputation: retractions, repeated batches, compaction, what is read and written."""

import datetime
import os
import random

from pyspark.sql import functions as F

from qlog.streaming import incremental
from qlog.streaming.totals import BucketTotals

T0 = datetime.datetime(2026, 7, 1)
KEYS = ["a", "b"]
SCHEMA = "id long, a string, b string, end_at timestamp_ntz, retracted boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def want(rows):
    left = {}
    for i, a, b, at, gone in rows:
        left.setdefault((i, a, b, at), 0)
        left[i, a, b, at] += -1 if gone else 1
    out = {}
    for (_, a, b, at), n in left.items():
        if n > 0:
            out.setdefault((a, b), []).append(at)
    return sorted(((a or "", b or ""), len(v), min(v), max(v)) for (a, b), v in out.items())


def got(store):
    return sorted(((r["a"] or "", r["b"] or ""), r["record_count"], r["first_at"], r["last_at"]) for r in store.read().collect())


def test_totals_follow_changes(spark, tmp_path):
    rng = random.Random(4)
    store = BucketTotals(spark, str(tmp_path / "s"), KEYS, log=True, buckets=4, most_runs=2)
    past, live = [], []
    for batch in range(5):
        rows = [(batch * 100 + i, rng.choice("xyz"), rng.choice([None, "p"]), T0 + datetime.timedelta(seconds=rng.randrange(500)), False) for i in range(12)]
        gone = [(*r[:4], True) for r in rng.sample(live, min(len(live), 6))]
        if batch == 4:
            rows, gone = [], [(*r[:4], True) for r in live if r[1] == "x"]  # all of these keys go
        past += rows + gone
        live = [r for r in live if (*r[:4], True) not in gone] + rows
        assert store.commit(batch, frame(spark, rows + gone))
        assert not store.commit(batch, frame(spark, rows + gone))
        assert got(store) == want(past)
    named = {r for rs in store.manifest()["runs"].values() for r in rs}
    assert all(len(rs) <= 2 for rs in store.manifest()["runs"].values())
    left = {f"runs/{n}" for n in os.listdir(tmp_path / "s" / "runs")}
    assert named <= left and len(left) <= 2 * len(named) + 4


def test_a_commit_writes_its_own_keys_only(spark, tmp_path):
    store = BucketTotals(spark, str(tmp_path / "s"), KEYS, buckets=8)
    store.commit(0, frame(spark, [(i, f"k{i}", None, T0, False) for i in range(300)]))
    before = set(os.listdir(tmp_path / "s" / "runs"))
    store.commit(1, frame(spark, [(1000, "k7", None, T0, False)]))
    new, = set(os.listdir(tmp_path / "s" / "runs")) - before
    assert spark.read.parquet(str(tmp_path / "s" / "runs" / new)).count() == 1
    assert store.read().where("a = 'k7'").first()["record_count"] == 2 and store.read().count() == 300


def test_hours_close_with_the_watermark(spark, tmp_path):
    rng = random.Random(5)
    schema = "end_at timestamp, timing_type string, outcome string, us long"
    rows = [(T0 + datetime.timedelta(minutes=rng.randrange(600)), rng.choice([None, "request"]), "success", rng.choice([None, 5, rng.randrange(10**6)])) for _ in range(300)]
    rows.sort(key=lambda r: r[0])
    for n in range(3):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.arriving_files(spark, str(tmp_path / "in"), schema, 1)
    incremental.live_timeline(stream, str(tmp_path / "out"), str(tmp_path / "check"), "10 minutes").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("bucket", "timing_type", "outcome").distinct().count() == out.count()
    closed = (rows[-1][0] - datetime.timedelta(minutes=10)).replace(minute=0, second=0)
    past = spark.createDataFrame([r for r in rows if r[0] < closed], schema)
    counts = past.groupBy(F.date_trunc("hour", "end_at").alias("bucket"), "timing_type", "outcome")
    plain = counts.agg(F.count("*").alias("records"), F.max("us").alias("longest_us"), F.percentile(F.col("us") / 1000.0, F.lit(0.95)).alias("p95"))
    key = lambda r: (r["bucket"], r["timing_type"] or "", r["records"], r["longest_us"], round(r["p95"] or -1, 6))
    assert sorted(map(key, out.collect())) == sorted(map(key, plain.collect())) and out.count() > 10
