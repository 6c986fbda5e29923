"""Publication by numbered log entries: checks, rival writers, cleaning by month; digests of frozen input."""

import datetime as dt
import os
import threading

from pyspark.sql import functions as F

from qlog.operators import eligibility, facts
from qlog.operators.builds import Builds, create_if_absent, drop_partitions

NOW = dt.datetime(2026, 7, 15, tzinfo=dt.timezone.utc)


def stats(spark, *rows):
    return spark.createDataFrame(rows, "layer string, included_count long")


def verdict(state):
    return lambda own: own.sparkSession.createDataFrame([("a", "passed"), ("b", state)], "check string, state string")


def test_a_name_is_taken_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda n=n: won.append((n, create_if_absent(spark, f"{tmp_path}/x", f"by {n}")))) for n in range(6)]
    [t.start() for t in threads] and [t.join() for t in threads]
    assert [w for _, w in won].count(True) == 1 and (tmp_path / "x").read_text() == f"by {next(n for n, w in won if w)}"
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]


def test_failed_builds_never_become_current(spark, tmp_path):
    b = Builds(spark, str(tmp_path))
    assert b.attempt("C", "bad", stats(spark, ("overall", 5)), verdict("failed")) == "check_failed" and b.current("C") is None
    assert b.attempt("C", "none", stats(spark, ("overall", 0)), verdict("passed")) == "no_samples" and b.current("C") is None
    assert b.attempt("C", "good", stats(spark, ("overall", 7), ("day", 7)), verdict("passed")) == "published"
    assert b.attempt("C", "bad", stats(spark, ("overall", 9)), verdict("failed")) == "check_failed"
    assert b.attempt("C", "good", stats(spark, ("overall", 1))) == "known"
    assert b.current("C").where("layer = 'overall'").first()["included_count"] == 7
    assert [(e["number"], e["build_id"], e["result"], e["reason"]) for e in b.log("C")] == [(1, "bad", "check_failed", "b"), (2, "none", "no_samples", None), (3, "good", "published", None), (4, "bad", "check_failed", "b")]


def test_of_two_writers_one_publishes(spark, tmp_path):
    b, met = Builds(spark, str(tmp_path)), threading.Barrier(2)

    def together(own):
        met.wait(60)  # both have read the log
        return verdict("passed")(own)

    got = {}
    threads = [threading.Thread(target=lambda n=n: got.update({n: b.attempt("C", n, stats(spark, ("overall", 1)), together)})) for n in ("x", "y")]
    [t.start() for t in threads] and [t.join() for t in threads]
    assert sorted(got.values()) == ["publish_failed", "published"]
    winner = next(n for n, r in got.items() if r == "published")
    assert [(e["number"], e["result"]) for e in b.log("C")] == [(1, "published"), (2, "publish_failed")] and b.log("C")[0]["build_id"] == winner


def test_cleaning_by_month(spark, tmp_path):
    b = Builds(spark, str(tmp_path))
    month = lambda n: NOW - dt.timedelta(days=30 * n)
    for n, scope in ((9, "C"), (8, "C"), (1, "C"), (9, "D")):
        b.attempt(scope, f"{scope}{n}", stats(spark, ("overall", n)), at=month(n))
    kept = {e["folder"]: os.path.getmtime(f"{tmp_path}/{e['folder']}") for e in b.log("C")[2:] + b.log("D")}
    assert b.clean(["C", "D"], 3, NOW) == ["C9", "C8"]  # D9 is old, but current
    assert {f: os.path.getmtime(f"{tmp_path}/{f}") for f in kept} == kept and not any(os.path.exists(f"{tmp_path}/{e['folder']}") for e in b.log("C")[:2])
    assert b.current("C").first()["included_count"] == 1 and b.current("D").first()["included_count"] == 9
    assert [c["build_id"] for c in b.cleaned()] == ["C9", "C8"] and b.clean(["C", "D"], 3, NOW) == []


def test_expired_partitions_go_as_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).select("id", (F.col("id") % 2).alias("year"), (F.col("id") % 4).alias("month")).repartition(1).write.partitionBy("year", "month").parquet(path)
    stays = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "month=2" not in d}
    left = drop_partitions(spark, path, ["year", "month"], spark.createDataFrame([(0, 2), (0, 2), (1, 7)], "year int, month int"))
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(40) if i % 4 != 2]
    assert {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "_cleaned" not in d} == stays
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/_cleaned").select("year", "month").collect()) == [(0, 2), (1, 7)]


def test_publication_checks_decide(spark, tmp_path):
    rows = [(layer, "g", 3, 1, 1.0, 2.0, 3.0, 4.0) for layer in ("overall", "day", "week", "weekday", "hour")]
    own = spark.createDataFrame(rows, "layer string, k string, included_count long, excluded_count long, min_ms double, p50_ms double, p95_ms double, max_ms double")
    required = lambda n: spark.createDataFrame([("g", n, 1)], "k string, included long, excluded long")
    no_files, rules = spark.createDataFrame([], "path string"), spark.createDataFrame([("r",)], "rule string")
    checks = lambda n: lambda s: facts.publication_checks(s, required(n), ["k"], no_files, rules)
    b = Builds(spark, str(tmp_path))
    assert b.attempt("C", "x", own, checks(4)) == "check_failed" and b.log("C")[0]["reason"] == "counts_consistent"
    assert b.attempt("C", "x", own, checks(3)) == "published"


def test_digests_of_frozen_input(spark):
    rows = [(f"f{i}", "a", "succeeded") for i in range(300)]
    frozen = lambda r: eligibility.freeze_input(spark.createDataFrame(r, "file_id string, analysis_id string, state string"))
    old, same = frozen(rows), frozen(list(reversed(rows)) + [("g", "a", "failed")])
    other = frozen([(f, "b" if f == "f7" else a, s) for f, a, s in rows])
    digest = lambda df: {r[0] for r in df.select("digest").collect()}
    assert digest(old) == digest(same) and len(digest(old)) == 1 and digest(old) != digest(other)
    assert eligibility.changed_buckets(old, same).count() == 0
    assert [r[0] for r in eligibility.changed_buckets(old, other).collect()] == [old.where("file_id = 'f7'").first()["bucket"]]
