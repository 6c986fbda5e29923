"""Pages and ranges from clustered files equal those over all facts, and open few files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from qlog.operators import search
from qlog.operators.layout import ClusteredFacts

SCHEMA = "occurrence_id long, analysis_id string, fingerprint string, scope_id string, end_at timestamp_ntz, body string"
BEGIN = datetime(2024, 1, 1)


def made(rng, n, first=0):
    """A third of the rows of one key; null keys, null ends, many equal ends."""
    rows = []
    for i in range(first, first + n):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", "d", "", None])
        end = None if rng.random() < 0.02 else BEGIN + timedelta(minutes=rng.randrange(3000))
        rows.append((i, rng.choice(["A0", "A1"]), key, rng.choice(["C1", "C2", None]), end, "x" * 20))
    return rows


def order(r):
    return tuple((v is not None, v) for v in (r[4], r[1], r[0]))


def pages(facts, key, limit, where=None):
    cursor, out = None, []
    while True:
        got = sorted(facts.page({"fingerprint": key}, cursor, limit, where).collect(), key=lambda r: r["n"])
        out += [r["occurrence_id"] for r in got]
        assert len(got) <= limit
        if not got or not got[0]["more"]:
            return out
        cursor = (got[-1]["end_at"], got[-1]["analysis_id"], got[-1]["occurrence_id"])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = made(random.Random(5), 3000)
    facts = ClusteredFacts(spark, str(tmp_path_factory.mktemp("facts")), ["fingerprint"], buckets=4, rows_per_file=50)
    for batch in range(2):
        facts.add(batch, spark.createDataFrame(rows[batch::2], SCHEMA))
    return facts, rows


def test_nothing_stored(spark, tmp_path):
    facts = ClusteredFacts(spark, str(tmp_path / "none"), ["fingerprint"])
    with pytest.raises(ValueError, match="no batch"):
        facts.read()
    facts.add(0, spark.createDataFrame([], SCHEMA))
    assert facts.page({"fingerprint": "a"}, None, 5).count() == 0 == facts.of_key({"fingerprint": None}).count()


@pytest.mark.parametrize("key", ["b", None, "", "absent"])
def test_pages_equal_the_sorted_rows(store, key):
    facts, rows = store
    want = [r[0] for r in sorted((r for r in rows if r[2] == key), key=order, reverse=True)]
    assert pages(facts, key, 120) == want


def test_filtered_page(store):
    facts, rows = store
    want = [r[0] for r in sorted((r for r in rows if r[2] == "hot" and r[3] == "C2"), key=order, reverse=True)]
    got = facts.page({"fingerprint": "hot"}, None, 40, F.col("scope_id") == "C2").orderBy("n").collect()
    assert [r["occurrence_id"] for r in got] == want[:40] and got[0]["more"]


def test_a_page_opens_the_newest_files_only(store):
    facts, rows = store
    every = facts.zones().count()
    hot = facts.page_files({"fingerprint": "hot"}, None, 20)
    assert len(hot) <= 3 < every / 10
    middle = (BEGIN + timedelta(minutes=1500), "A1", 0)
    later = facts.page_files({"fingerprint": "hot"}, middle, 20)
    assert len(later) <= 8 and not set(later) & set(hot)  # files newer than the cursor are not opened
    own = [r for r in rows if r[2] == "hot" and r[4] is not None and order(r) < order((0, "A1", 0, 0, middle[0]))]
    want = sorted(own, key=order, reverse=True)[:20]
    assert [r["occurrence_id"] for r in facts.page({"fingerprint": "hot"}, middle, 20).orderBy("n").collect()] == [r[0] for r in want]


def test_ranges_read_one_bucket(spark, store):
    facts, rows = store
    start, end = (F.lit(BEGIN + timedelta(minutes=m)).cast("timestamp_ntz") for m in (600, 1200))
    found = facts.of_key({"fingerprint": "hot"}, start, end)
    want = sorted(r[0] for r in rows if r[2] == "hot" and r[4] and BEGIN + timedelta(minutes=600) <= r[4] < BEGIN + timedelta(minutes=1200))
    assert sorted(r["occurrence_id"] for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters:")[1].split("]")[0] and "EqualTo(_key" in plan and "GreaterThanOrEqual(end_at" in plan
    assert len(facts.zones().where("low_key = high_key").select("file").distinct().collect()) > 5  # the frequent key is spread


def test_repeated_batches_compaction_and_writers(spark, tmp_path):
    rng = random.Random(8)
    facts = ClusteredFacts(spark, str(tmp_path / "facts"), ["fingerprint", "scope_id"], buckets=2, rows_per_file=40)
    first, second, third = made(rng, 200), made(rng, 150, 200), made(rng, 100, 350)
    facts.add(0, spark.createDataFrame(third, SCHEMA))
    facts.add(0, spark.createDataFrame(first, SCHEMA))  # the batch is repeated with other rows
    facts.add(1, spark.createDataFrame(second, SCHEMA))
    ids = lambda: sorted(r[0] for r in facts.read().select("occurrence_id").collect())
    assert ids() == list(range(350))
    facts.compact()
    assert ids() == list(range(350)) and len(set(facts.manifest()["runs"].values())) == 1
    got = facts.page({"fingerprint": "hot", "scope_id": None}, None, 500)
    want = [r[0] for r in sorted((r for r in first + second if r[2] == "hot" and r[3] is None), key=order, reverse=True)]
    assert [r["occurrence_id"] for r in got.orderBy("n").collect()] == want
    same = search.history(spark.createDataFrame([r for r in first + second if r[2] == "hot" and r[3] is None], SCHEMA), None, 500)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))
    # another writer takes the next number first
    late, run = ClusteredFacts(spark, facts.path, facts.keys, 2, 40), facts._write(spark.createDataFrame(third, SCHEMA))
    late.add(2, spark.createDataFrame(third[:10], SCHEMA))
    facts._publish(spark.createDataFrame(third, SCHEMA).schema.jsonValue(), lambda runs: runs | {"3": run})
    assert len(ids()) == 350 + 10 + 100
