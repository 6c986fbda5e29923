"""Tokens, JSON records and reason conditions on edge cases."""

import base64

from pyspark.sql import functions as F

from qlog.functions import exchange
from qlog.operators import search

NAMES = ["scope_id", "database", "execution_user"]
TEXTS = ["", "a", "ab", "abc", "SELECT 'ß' -- 中\U0001f600", "\x00\n\t\"\\", "?>~" * 50, None]


def test_tokens_are_unpadded_base64url_and_come_back(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").withColumn("k", exchange.encode_token(F.col("t")))
    rows = df.withColumn("back", exchange.decode_token(F.col("k"))).orderBy("i").collect()
    for r in rows:
        assert r.k == (None if r.t is None else base64.urlsafe_b64encode(r.t.encode()).decode().rstrip("="))
        assert r.back == r.t


def test_broken_tokens_are_null(spark):
    df = spark.createDataFrame([("a",), ("*bc*",), ("_w",), ("äbc",)], "k string")  # a wrong length, foreign letters, a lone 0xFF, no ASCII
    assert [r.b for r in df.select(exchange.decode_token(F.col("k")).alias("b")).collect()] == [None] * 4


def test_identity_tokens_match_null_with_null_only(spark):
    people = [("C1", "D1", "U1"), ("C1", None, "U1"), ("C1", "", "U1"), ("C1", "null", "U1"), ("C\"1", "D,1", None)]
    records = spark.createDataFrame([(*p, i) for i, p in enumerate(people)], "scope_id string, database string, execution_user string, id int")
    tokens = records.select(exchange.identity_token(*[F.col(n) for n in NAMES]).alias("token"))
    found = search.token_records(records, tokens.unionByName(tokens), NAMES)
    assert sorted(r.id for r in found.collect()) == [0, 1, 2, 3, 4]
    assert {r.token: r.id for r in found.collect()}[base64.urlsafe_b64encode(b'["C1", null, "U1"]').decode().rstrip("=")] == 1
    none = spark.createDataFrame([("",), (None,), ("WyJDMSJd",), ("e30",)], "token string")  # empty, null, one part only, an object
    assert search.token_records(records, none, NAMES).count() == 0


def test_kinds_of_json(spark):
    kinds = {'{"a":1}': "object", "[]": "array", '"x"': "string", "1": "number", "-2.5": "number", "1e300": "number", "true": "boolean", "null": "null", "{": None, "": None}
    df = spark.createDataFrame([(t,) for t in kinds] + [(None,)], "t string").withColumn("k", exchange.json_kind(F.col("t")))
    assert {r.t: r.k for r in df.collect()} == kinds | {None: None}


def test_json_records(spark):
    asked = [(1, '[{"a":"x","b":"y"},{"a":"x","b":"z"}]'), (2, "[]"), (3, '{"a":"x","b":"y"}'), (4, '[{"a":"x"}]'), (5, "[1]"), (6, None), (7, "nonsense"), (8, "[" + ",".join(['{"a":"x","b":"y"}'] * 1001) + "]")]
    rows = exchange.json_records(spark.createDataFrame(asked, "id int, asked string"), "asked", ["a", "b"]).collect()
    assert sorted((r.id, r.place, r.a, r.b) for r in rows if r.error is None) == [(1, 1, "x", "y"), (1, 2, "x", "z")]
    assert sorted(r.id for r in rows if r.error == "invalid_records") == [3, 4, 5, 6, 7, 8]


def test_reason_faults(spark):
    rows = [(1, None, {"v": "why"}, False), (2, None, {"v": ""}, True), (3, None, {}, True), (4, None, None, True), (5, 1.0, {}, False), (6, 1.0, {"v": "why"}, True), (7, 1.0, None, False)]
    df = spark.createDataFrame(rows, "id int, v double, reasons map<string,string>, fault boolean")
    got = df.select("fault", exchange.reason_faults(F.col("v"), F.col("reasons"), "v").alias("f")).collect()
    assert all(r.f == r.fault for r in got)
