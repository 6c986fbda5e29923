"""Eligibility, facts, search, diagnostics and incremental rules on small literal tables."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from qlog.operators import eligibility, facts, search
from qlog.plans import registry
from qlog.streaming import incremental

T0 = datetime.datetime(2026, 1, 5)


@pytest.mark.parametrize("cats, kind", [(["SET"], "pure"), (["SET", "SELECT"], "mixed"), (["SELECT"], "none"), ([], "unknown"), (None, "unknown"), (["END", "START TRANSACTION"], "pure"), (["ANALYSE"], "pure")])
def test_categories(spark, cats, kind):
    assert spark.createDataFrame([(cats,)], "c array<string>").select(eligibility.classify_categories(F.col("c")).alias("k")).first()["k"] == kind


def test_interval_overlap(spark):
    h = lambda n: T0 + datetime.timedelta(hours=n)
    rules = spark.createDataFrame([("C", "R", h(2), h(4)), ("C", "S", h(3), h(100)), ("D", "T", h(0), h(9))], "scope_id string, rule_id string, starts timestamp_ntz, ends timestamp_ntz")
    occ = spark.createDataFrame([(1, "C", h(1), h(2)), (2, "C", h(1), h(3)), (3, "C", h(2), h(2)), (4, "C", h(4), h(4)), (5, "C", h(50), h(70)), (6, "E", h(2), h(3)), (7, "C", None, h(3))], "i long, scope_id string, start_at timestamp_ntz, end_at timestamp_ntz")
    got = {r["i"]: r["interval_rules"] for r in eligibility.exclusion_rules(occ, rules, ["i"]).collect()}
    assert got == {1: [], 2: ["R"], 3: ["R"], 4: ["S"], 5: ["S"], 6: [], 7: []}


def test_null_identity_is_a_value(spark):
    rows = spark.createDataFrame([("f", "s", None, "u"), ("f", "s", None, "u"), ("f", "s", "", "u")], "fingerprint string, scope_id string, database string, execution_user string")
    keys = rows.withColumn("identity_key", facts.identity_key()).select("identity_key").distinct().count()
    assert keys == 2


@pytest.mark.parametrize("seed", range(3))
def test_incremental_equals_recompute(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice(["x", None]), T0 + datetime.timedelta(seconds=rng.randrange(50))) for _ in range(60)]
    schema, keys = "a string, b string, end_at timestamp_ntz", ["a", "b"]
    old = spark.createDataFrame(rows[:40], schema)
    new = spark.createDataFrame(rng.sample(rows, 45), schema)
    removed, added = incremental.refresh_facts(old, new)
    assert sorted(map(str, incremental.apply_facts(old, removed, added).collect())) == sorted(map(str, new.collect()))
    got = incremental.merge_totals(incremental.recompute_totals(old, keys), new, removed, added, keys)
    want = incremental.recompute_totals(new, keys)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_history_pages_are_disjoint_and_whole(spark):
    rows = spark.createDataFrame([(T0 + datetime.timedelta(seconds=i // 3), "A", i) for i in range(25)], "end_at timestamp_ntz, analysis_id string, occurrence_id long")
    seen, cursor = [], None
    while True:
        page = sorted(search.history(rows, cursor, 7).collect(), key=lambda r: r["n"])
        seen += [r["occurrence_id"] for r in page]
        if not page[0]["more"]:
            break
        cursor = (page[-1]["end_at"], page[-1]["analysis_id"], page[-1]["occurrence_id"])
    assert sorted(seen) == list(range(25)) and len(seen) == 25


def test_failed_identity_appears_in_ranking(spark):
    rows = [("F", "C", None, "U", "request", 5, "success"), ("F", "C", None, "U", None, None, "failed"), ("G", "C", "D", "U", None, None, "failed")]
    df = spark.createDataFrame(rows, "fingerprint string, scope_id string, database string, execution_user string, timing_type string, us long, outcome string")
    got = {(r["fingerprint"], r["timing_type"]): (r["records"], r["not_success"], r["total_us"]) for r in search.ranking(df, "total_us", 10).collect()}
    assert got == {("F", "request"): (2, 1, 5), ("G", None): (1, 1, None)}


def test_every_query_has_a_doc_and_most_a_twin():
    q, s = registry.queries(), registry.oracle_sql()
    assert all(f.__doc__ for f in q.values())
    assert set(s) <= set(q) and len(s) >= len(q) - 4


def test_nul_bytes_wherever_they_stand(spark):
    from qlog.operators import diagnostics

    rows = [("C", "1", b"p\na\0", 1), ("C", "2", b"\0", 1), ("C", "3", b"p\n p\x10\x01", 1), ("C", "4", b"ab\0cd", 1), ("C", "5", b"\xff", 1), ("C", "6", b"", 1), ("C", "7", None, 1)]
    got = diagnostics.encoding_audit(spark.createDataFrame(rows, "scope_id string, input_id string, content binary, n long")).first()
    assert (got["inputs"], got["occurrences"]) == (4, 4)


def test_text_search_pages(spark):
    import datetime
    import random

    rng = random.Random(3)
    texts = [(f"s{i}", f"F{i // 3}" if i % 20 else None, "select a" if i % 4 else "other") for i in range(200)]
    at = datetime.datetime(2026, 1, 1)
    cells = [(f"s{i}", f"C{rng.randrange(2)}", "D", "U", rng.randrange(5), at + datetime.timedelta(hours=rng.randrange(30))) for i in range(0, 200, 2) for _ in range(2)]
    found = search.text_search(
        spark.createDataFrame(texts, "sql_id string, fingerprint string, search_text string"),
        spark.createDataFrame(cells, "sql_id string, scope_id string, database string, execution_user string, records long, last_at timestamp_ntz"), ["select"], 6,
    )
    got = {r["fingerprint"]: (r["records"], r["last_at"], r["matched_texts"], r["total"], r["by_count"], r["by_recency"]) for r in found.collect()}
    groups = {}
    for s, f, t in texts:
        if t.startswith("select"):
            groups.setdefault(f, []).append(s)
    rows = {f: (sum(c[4] for c in cells if c[0] in ids), max([c[5] for c in cells if c[0] in ids], default=None), len(ids)) for f, ids in groups.items()}
    first = lambda f: (f is not None, f or "")
    count = sorted(rows, key=lambda f: (-rows[f][0], first(f)))
    late = sorted(rows, key=lambda f: (rows[f][1] is None, -(rows[f][1] - at).total_seconds() if rows[f][1] else 0, first(f)))
    want = {f: (*rows[f], len(rows), count.index(f) + 1, late.index(f) + 1) for f in rows if count.index(f) < 6 or late.index(f) < 6}
    assert got == want and len(want) > 6


def test_builds_are_seen_whole_or_not_at_all(spark, tmp_path):
    from qlog.operators.facts import Builds

    b = Builds(spark, str(tmp_path))
    stats = lambda *rows: spark.createDataFrame(rows, "layer string, n long")
    assert b.current("C1") is None
    assert b.publish("C1", "b1", stats(("day", 1), ("week", 2))) and not b.publish("C1", "b1", stats(("day", 9)))
    stats(("day", 7)).write.partitionBy("layer").parquet(f"{tmp_path}/builds/b2")  # left by a build that failed
    assert sorted((r["layer"], r["n"]) for r in b.current("C1").collect()) == [("day", 1), ("week", 2)]
    assert b.publish("C1", "b2", stats(("day", 3))) and b.publish("C2", "b3", stats(("day", 4)))
    assert [(r["layer"], r["n"]) for r in b.current("C1").collect()] == [("day", 3)] and b.current("C3") is None
