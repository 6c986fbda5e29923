"""Search by trigram index equals the scan, batch after batch, and reads only the buckets it needs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qlog.operators.textindex import TextIndex, grams

ALPHABET = "abé日 x'"


def made(rng, n, first=0):
    return [(f"t{first + i}", "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 3, 10, 60]))), f"f{i % 3}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "sql_id string, search_text string, fingerprint string")


def test_grams(spark):
    df = spark.createDataFrame([("",), ("ab",), ("abab",), ("日éa",), (None,)], "t string")
    assert [r[0] and sorted(r[0]) for r in df.select(grams(F.col("t"))).collect()] == [[], [], ["aba", "bab"], ["日éa"], None]


@pytest.mark.parametrize("common", [0.2, 1.0])
def test_index_equals_scan(spark, tmp_path, common):
    rng = random.Random(2)
    first, second = made(rng, 120), made(rng, 60, 120)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=8, common=common)
    assert index.search(["abc"]).count() == 0  # nothing is indexed yet
    index.add(0, frame(spark, second))
    index.add(0, frame(spark, first))  # the batch is repeated with other rows
    rows = list(first)
    for k in range(2):
        for terms in [["ab"], ["abé"], ["é日 x", "a"], ["ab'", "x", "bé"], ["zzz"], ["a", "zzz"], [rows[5][1][:12] or "q"], ["日日日"], []]:
            got = sorted(tuple(r) for r in index.search(terms).select("sql_id", "search_text", "fingerprint").collect())
            assert got == sorted(r for r in rows if all(t in r[1] for t in terms)), terms
        if not k:
            index.add(1, frame(spark, second))
            rows += second


def test_only_the_buckets_of_the_trigrams_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), buckets=32, common=1.0)
    index.add(0, frame(spark, made(random.Random(3), 300)))
    chosen = index.plan(["abé日"])
    plan = index.candidates(chosen)._jdf.queryExecution().executedPlan().toString()
    assert len(chosen) <= 2 and "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket#").replace("\n", " ") or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert index.plan(["ab"]) is None and index.plan(["ab", "zzz"]) == ["zzz"]


def test_postings_are_lists_of_runs_of_texts(spark, tmp_path, monkeypatch):
    """A frequent trigram is a row a run of texts, not one a text; lists hold every text once, also over several runs and planes of Unicode."""
    from qlog.operators import textindex

    monkeypatch.setattr(textindex, "MOST_CHARS", 500)
    rng = random.Random(4)
    rows = made(rng, 200) + [("u1", "\U0001f600\U0001f600\U0001f600\U0001f600ab", "f"), ("u2", None, "f"), ("u3", "\x00\x00\x00\x00", "f")]
    got, seen = [], 0
    for n in (1, 30, 203):
        ids, texts = pa.array([r[0] for r in rows[:n]]), pa.array([(r[1] or "").encode() for r in rows[:n]])
        lists = [r for b in textindex._post(iter([pa.RecordBatch.from_arrays([ids, texts], ["sql_id", "text"])])) for r in b.to_pylist()]
        got = sorted((r["gram"], i) for r in lists for i in r["ids"])
        assert all(r["n"] == len(r["ids"]) for r in lists)
        assert got == sorted((g, r[0]) for r in rows[:n] for g in {(r[1] or "")[k : k + 3] for k in range(len(r[1] or "") - 2)})
        seen = len(lists)
    assert seen < 0.8 * len(got)
    index = TextIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(0, frame(spark, rows))
    assert sorted((r["gram"], r["sql_id"]) for r in index.postings().collect()) == got
    assert index._runs().count() < len(got)
