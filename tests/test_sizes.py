"""Tasks of these queries hold as many rows at every size of the tables: more rows make more partitions and files."""

import os

from qlog.operators import tables
from qlog.plans import q_operations, q_records

SF = "/root/testdata/sf0.001"


def test_parts(spark):
    assert [tables.parts(spark.range(n), 10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]


def test_days_of_runs_meet_in_bounded_partitions(spark, monkeypatch):
    before = sorted(map(tuple, q_operations.operations_cluster_status(spark, SF).collect()))
    monkeypatch.setattr(q_operations, "ROWS", 300)
    days = q_operations._days(spark, SF)
    assert len(days.inputFiles()) >= 10  # 6,000 line items in 20 partitions, four by the session's setting
    assert sorted(map(tuple, q_operations.operations_cluster_status(spark, SF).collect())) == before


def test_log_files_have_bounded_records(spark, monkeypatch):
    monkeypatch.setattr(q_records, "FILE_RECORDS", 100)
    names = [n for n in os.listdir(q_records._files(spark, SF).removeprefix("file:")) if n.endswith(".csv")]
    assert len(names) > 4


def test_manifest_counts_in_bounded_partitions(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(tables, "parts", lambda df, rows: asked.append(rows) or 7)
    got = q_records.source_manifest(spark, SF)
    assert asked == [500_000] and "hashpartitioning(name" in got._jdf.queryExecution().executedPlan().toString().replace("#", "")
