"""Edge rows of log interpretation, pairing, files and lexical work."""

import datetime

import pytest
from pyspark.sql import functions as F

from qlog.functions import lexical, records
from qlog.functions import text as tx
from qlog.operators import pairing
from qlog.sources import logs


@pytest.mark.parametrize(
    "message, us",
    [("duration: 0 ms", 0), ("duration: 1200000.001 ms", 1200000001), ("DURATION: 1.5 ms  parse", 1500), ("duration: 1.0005 ms", None), ("duration: 1.0000 ms", 1000), ("duration: -1 ms", None), ("duration: NaN ms", None), ("x duration: 1 ms", None), (None, None), ("duration: 1 msec", None)],
)
def test_duration(spark, message, us):
    assert spark.createDataFrame([(message,)], "m string").select(records.parse_duration(F.col("m")).alias("us")).first()["us"] == us


@pytest.mark.parametrize(
    "text, utc",
    [("2026-07-23 00:10:00.000001 CST", datetime.datetime(2026, 7, 22, 16, 10, 0, 1)), ("2026-07-23 00:10:00+02:00", datetime.datetime(2026, 7, 22, 22, 10)), ("2026-07-23T00:10:00Z", datetime.datetime(2026, 7, 23, 0, 10)), ("2026-07-23 00:10:00", None), ("2026-13-23 00:10:00 CST", None), ("", None), (None, None)],
)
def test_log_time(spark, text, utc):
    assert spark.createDataFrame([(text,)], "t string").select(records.parse_log_time(F.col("t")).alias("t")).first()["t"] == utc


def pair(spark, rows):
    schema = "file_id string, session string, record_no long, kind string, sql string, at timestamp_ntz, fetch boolean"
    at = datetime.datetime(2026, 1, 1)
    df = spark.createDataFrame([("f", s, n, k, q, at + datetime.timedelta(seconds=t), f) for s, n, k, q, t, f in rows], schema)
    return {r["record_no"]: (r["pairing"], r["start_record"]) for r in pairing.pair_executes(df).collect()}


def test_pairing(spark):
    got = pair(
        spark,
        [
            ("a", 1, "start", "q", 0, False), ("a", 2, "finish", "q", 1, None), ("a", 3, "finish", "q", 2, None),
            ("a", 4, "start", "q", 3, True), ("b", 5, "boundary", None, 3, None), ("a", 6, "finish", "q", 4, None),
            ("b", 7, "start", "q", 4, False), ("b", 8, "start", "q", 5, False), ("b", 9, "finish", "q", 6, None),
            ("c", 10, "start", "q", 6, False), ("c", 11, "finish", "r", 7, None), ("c", 12, "start", "q", 9, False), ("c", 13, "finish", "q", 8, None),
            ("c", 14, "start", "q", 9, False), ("c", 15, "boundary", None, 9, None), ("c", 16, "finish", "q", 10, None), (None, 17, "finish", "q", 10, None),
        ],
    )
    assert got == {
        2: ("execute_first", 1), 3: ("execute_start_missing", None), 6: ("execute_fetch", 4), 9: ("execute_start_ambiguous", None), 11: ("execute_context_mismatch", None),
        13: ("execute_order_invalid", None), 16: ("execute_start_missing", None), 17: ("session_identity_missing", None),
    }


def test_csv_width_and_positions(spark, tmp_path):
    row = ",".join(f'"{c}"' for c in ["2026-07-23 00:10:00 CST"] + ["x"] * 17 + ["duration: 1 ms"] + ["x"] * 5 + ["a\nb""", "x", "x", "postgres.c", "1946", "x"])
    (tmp_path / "good.csv").write_bytes((row + "\n" + row + "\n").encode())
    (tmp_path / "bad.csv").write_bytes((row + "\n1,2\n").encode())
    rows = logs.read_log_csv(spark, str(tmp_path))
    assert {(r["path"].rsplit("/", 1)[1], r["valid"]) for r in rows.collect()} == {("good.csv", True), ("bad.csv", False)}
    pos = {(r["path"].rsplit("/", 1)[1], r["record_no"]): (r["line_start"], r["line_end"]) for r in logs.record_positions(spark, str(tmp_path)).collect()}
    assert pos["good.csv", 1] == (1, 2) and pos["good.csv", 2] == (3, 4) and pos["bad.csv", 2] == (3, 3)


@pytest.mark.parametrize(
    "text, categories, issue",
    [
        ("SELECT 1; -- x;\n/* ; */ select ';' ;", ["SELECT", "SELECT"], None), ("START TRANSACTION; COMMIT", ["START TRANSACTION", "COMMIT"], None), ("select $a$ ; $a$", ["SELECT"], None),
        ("select 'open", [], "unterminated_string"), ("select /* x", [], "unterminated_comment"), ('select "x', [], "unterminated_quote"), ("select (1", [], "unbalanced_brackets"), ("", [], None),
    ],
)
def test_statements(text, categories, issue):
    got = lexical.statements(text)
    assert (got[0], got[2]) == (categories, issue)


def test_fingerprint_ignores_literals():
    a = lexical.folded("SELECT * FROM T WHERE x = 'a''b' AND y IN (1, 2,3) ;")[0]
    assert a == lexical.folded("select  *\nfrom t where X = $1 and y in (7,8, 9)")[0]
    assert a != lexical.folded("select * from t where x = 1 and y in (7)")[0]
    assert a != lexical.folded('select * from "T" where x = 1 and y in (7,8,9)')[0]


def test_shared_head_tail(spark):
    df = spark.createDataFrame([("g", "abcXdef"), ("g", "abcYYdef"), ("h", "same"), ("h", "same"), ("i", "aaa"), ("i", "aa")], "g string, text string")
    got = {r["g"]: (r["head"], r["tail"]) for r in tx.shared_head_tail(df, ["g"]).collect()}
    assert got == {"g": (3, 3), "h": (4, 0), "i": (2, 0)}


def test_long_fields_and_odd_bytes(spark, tmp_path):
    row = ["2026-07-23 00:10:00 CST", *["x"] * 29]
    long, odd = list(row), list(row)
    long[24] = "SELECT '" + "y" * 200_000 + "'\n;"
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in (row, long, odd)) + "\n"
    (tmp_path / "a.csv").write_bytes(text.encode().replace(b'"x"\n', b'"\xff"\n', 1))
    got = sorted(logs.record_positions(spark, str(tmp_path)).collect(), key=lambda r: r["record_no"])
    assert [(r["line_start"], r["line_end"], r["readable"], len(r["fields"])) for r in got] == [(1, 1, False, 30), (2, 3, True, 30), (4, 4, True, 30)]
    assert got[1]["fields"][24] == long[24]
