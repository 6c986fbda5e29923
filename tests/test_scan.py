"""Split-parallel scan of quoted CSV against a sequential strict reader, whatever the ranges are."""

import csv
import hashlib
import io
import random

import pytest

from qlog.sources import logs, scan


def strict(body):
    """Records of a sequential reader with their lines, and the error that ends it."""
    text = io.TextIOWrapper(io.BytesIO(body), "utf-8", "surrogateescape", newline="")
    reader, before, out = csv.reader(text, strict=True), 0, []
    try:
        for n, row in enumerate(reader, 1):
            out.append((n, before + 1, reader.line_num, [f.encode("utf-8", "surrogateescape") for f in row]))
            before = reader.line_num
    except csv.Error:
        return out, "csv_boundary"
    return out, None


def read(spark, path, **more):
    rows = scan.scan(spark, str(path), **more)
    rows = rows.selectExpr("regexp_extract(path, '([^/]+)$', 1) AS name", "record_no", "line_start", "line_end", "transform(fields, f -> cast(f AS binary)) AS fields", "readable", "error")
    return sorted(rows.collect(), key=lambda r: (r["name"], r["record_no"]))


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "8")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(rng, n):
    parts = [b"a", b"\n", b"\r", b"\r\n", b",", b'""', b"\xff", b"\x00", "é".encode(), b" "]
    field = lambda: b'"' + b"".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40]))) + b'"'
    plain = lambda: rng.choice([b"", b"x", b'it"s', b"12", b" y "])
    return b"".join(b",".join(rng.choice([field, plain])() for _ in range(4)) + rng.choice([b"\n", b"\r\n", b"\r"]) for _ in range(n))


@pytest.mark.parametrize("most_ranges", [scan.MOST_RANGES, 0])
def test_ranges_against_a_sequential_reader(spark, tmp_path, small_ranges, most_ranges):
    rng, files = random.Random(4), {}
    for n in range(4):
        files[f"f{n}.csv"] = made(rng, 40)
    files["open.csv"] = made(rng, 10) + b'1,"never\nends,' + made(rng, 20).replace(b'"', b"")
    files["junk.csv"] = made(rng, 10) + b'1,"a"b,3\n' + made(rng, 10)
    files["long.csv"] = b'1,"' + b"x\n" * 300 + b'",3,4\n5,6,7,8'
    files["blank.csv"] = b"a,b,c,d\n\n1,2,3,4\n"
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = read(spark, tmp_path, most_ranges=most_ranges)
    for name, body in files.items():
        want, error = strict(body)
        own = [r for r in got if r["name"] == name]
        good = [(r["record_no"], r["line_start"], r["line_end"], [bytes(f) for f in r["fields"]]) for r in own if r["error"] is None]
        assert good == want, name
        assert {r["error"] for r in own} - {None} == ({error} - {None}), name
        assert all(r["readable"] == (b"\xff" not in b"".join(bytes(f) for f in r["fields"])) for r in own if r["error"] is None)


def test_state_behind_a_line():
    for line, after in [(b"a,b\n", (0, 1)), (b'"a\n', (1, 2)), (b'a","b"\n', (0, 0)), (b'"a"",\n', (1, 2)), (b'"\r\n', (1, 0)), (b'it"s,1\n', (0, 2)), (b'",""\n', (1, 0)), (b'"a"b\n', (2, 2))]:
        assert (scan.line_end(line, scan.OUT), scan.line_end(line, scan.IN)) == after, line


def test_whole_files_fail(spark, tmp_path):
    row = ",".join(["2026-07-23 00:10:00 CST"] + ["x"] * 29) + "\n"
    for name, body in {"good": row * 3, "columns": row + "1,2\n" + row, "boundary": row + '"open\n' + row, "both": row + '1,2\n"open\n'}.items():
        (tmp_path / f"{name}.csv").write_text(body)
    got = {(r["path"].rsplit("/", 1)[1], r["valid"], r["reason"]) for r in logs.read_log_csv(spark, str(tmp_path)).collect()}
    assert got == {("good.csv", True, None), ("columns.csv", False, "csv_columns"), ("boundary.csv", False, "csv_boundary"), ("both.csv", False, "csv_columns")}


def test_digests(spark, tmp_path, small_ranges):
    files = {"a": b"x\n" * 100, "b": b"no line feed", "c": b"\n\n", "d": b"", "e": b"\xef\xbb\xbfwith a mark\n\xff", "f": bytes(range(256)) * 5}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["byte_count"]) for r in scan.digests(spark, str(tmp_path)).collect()}
    assert got == {n: (hashlib.sha256(b).hexdigest(), len(b)) for n, b in files.items()}
