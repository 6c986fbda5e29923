"""Stages of the pipeline on small tables, each against what it must keep."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.packcheck import check_pieces, whole_ids
from tests.llm.test_llm import brute_components, brute_contamination, near_copies, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("sf"), random.Random(5)
    bench = [(i, words(rng, 20)) for i in range(5)]
    texts = near_copies(rng, 20) + [words(rng, 15) + " " + bench[k % 5][1] for k in range(10)] + ["mail me at a.b@c.example.org or 10.1.2.3"]
    for i in range(200):
        t = words(rng, 40).split()
        if i % 4 == 0:
            t.insert(rng.randrange(40), rng.choice(["vile", "awful"]))
        texts.append(" ".join(t))
    first = len(texts) - 200
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(first + i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), texts, bench, first


def test_stages(spark, tables):
    path, texts, bench, first = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], path).cache())
        assert kept[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] for r in k.collect()) for k in kept]
    gone = set(ids[0]) - set(ids[1])
    assert {first + i for i in range(0, 200, 4)} <= gone and len(gone) <= 55
    want = [ids[1][i] for i, _, c in brute_components([texts[i] for i in ids[1]]) if c == i]
    assert ids[2] == want
    hits = {d for d, *_, bad in brute_contamination([(i, texts[i]) for i in ids[2]], bench) if bad}
    assert hits and ids[3] == [i for i in ids[2] if i not in hits]
    assert ids[4] == ids[3]
    last = {r["doc_id"]: r for r in kept[4].collect()}
    assert not any("a.b@c" in (r["text"] or "") or "10.1.2.3" in (r["text"] or "") for r in last.values())
    assert all(r["n_chars"] == len(r["text"]) for r in last.values() if r["text"] is not None)
    rows = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, kept[4], path).collect()]
    order = sorted(last)
    check_pieces(rows, dict(zip(order, whole_ids([last[i]["text"] or "" for i in order]))))


def test_near_duplicates_with_reused_ids(spark):
    rows = [(1, "a b c d e"), (5, "A b c d e"), (5, "some other clean text"), (5, "some other clean text"), (7, "x y z"), (None, "a b c d e")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("1", "a b c d e"), ("5", "some other clean text"), ("7", "x y z"), ("None", "a b c d e")]


def test_run_and_empty(spark, tables, tmp_path):
    path = tables[0]
    assert corpus_pipeline.run(spark, path).agg(F.count_distinct("doc_id")).first()[0] > 50
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_under_one_id(spark):
    rng = random.Random(6)
    long = words(rng, 60)
    rows = [(3, long), (3, long + " more"), (7, long), (8, "apart from all"), (8, "apart from all others"), (3, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    linked = [t for i, t in kept if t.startswith(long)]
    assert len(linked) == 1 and kept == sorted([(3, linked[0]), (3, "a text of its own"), (8, "apart from all"), (8, "apart from all others")])
