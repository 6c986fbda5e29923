"""Interpretation of log records: duration, time, site, timing, outcome, session, problems, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qlog.functions import calendar as cal

# Source lines that log a duration, and what was timed there.
TIMING_OF_LINE = {1946: "request", 2219: "parse", 2224: "parse", 2603: "bind", 2608: "bind", 2843: "execute"}
START_LINE, FINISH_LINE = 2764, 2843
LABELS = {
    "timing": {"request": "Simple request", "parse": "Parse", "bind": "Bind", "execute_first": "Execute, first", "execute_fetch": "Execute, fetch", "unknown": "Unknown"},
    "outcome": {"success": "Succeeded", "failed": "Failed", "cancelled": "Cancelled", "timed_out": "Timed out", "unknown": "Unknown"},
}
CODES = {"timing": ["unknown", "request", "parse", "bind", "execute_first", "execute_fetch"], "outcome": ["unknown", "success", "failed", "cancelled", "timed_out"]}


def parse_duration(message: Column) -> Column:
    """PRJ-01: whole microseconds of a leading ``duration: N ms``; null for anything else or finer values."""
    digits = F.regexp_extract(message, r"(?i)^duration:\s*([0-9]+(?:\.[0-9]+)?)\s+ms\b", 1)
    us = digits.try_cast("decimal(38,18)") * 1000
    return F.when(us == F.floor(us), us.cast("long"))


def parse_log_time(text: Column) -> Column:
    """PRJ-02: UTC instant (zone-less) of an ISO time with `` CST`` (UTC+8) or an explicit offset; null for others."""
    t = F.regexp_replace(text, r" CST$", "+08:00")
    parts = r"^(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d(?:\.\d{1,6})?) ?(?:(Z)|([+-])(\d\d):?(\d\d)?)$"
    at = F.concat_ws(" ", F.regexp_extract(t, parts, 1), F.regexp_extract(t, parts, 2)).try_cast("timestamp_ntz")
    sign = F.when(F.regexp_extract(t, parts, 4) == "-", -1).otherwise(1)
    number = lambda k: F.coalesce(F.regexp_extract(t, parts, k).try_cast("int"), F.lit(0))
    return F.when(t.rlike(parts), at - F.make_dt_interval(F.lit(0), sign * number(5), sign * number(6), F.lit(0)))


def estimated_start(end: Column, us: Column) -> Column:
    """PRJ-03."""
    return cal.back(end, us)


def source_site(file: Column, line: Column) -> Column:
    """PRJ-04: ``name:line`` of a C source location, else ``other``."""
    name = F.regexp_extract(file, r"([^/\\]+)$", 1)
    ok = name.rlike(r"^[A-Za-z0-9_]+\.(c|cpp|h|y|l)$") & line.rlike(r"^[0-9]+$")
    return F.when(F.coalesce(ok, F.lit(False)), F.concat_ws(":", name, line)).otherwise("other")


def timing_type(line: Column) -> Column:
    """PRJ-05: what a line times; execute needs pairing, other lines are null."""
    table = F.create_map(*[F.lit(x) for kv in TIMING_OF_LINE.items() for x in kv])
    return F.try_element_at(table, line.cast("int"))


def outcome(us: Column, level: Column, node: Column, sql: Column, state: Column, message: Column) -> Column:
    """PRJ-06."""
    cancelled = state == "57014"
    return (
        F.when(us.isNotNull(), "success")
        .when(cancelled & F.contains(message, F.lit("statement timeout")), "timed_out")
        .when(cancelled & F.contains(message, F.lit("user request")), "cancelled")
        .when((level == "ERROR") & (node == "seg-1") & (F.length(sql) > 0), "failed")
        .otherwise("unknown")
    )


def session_key(start: Column, pid: Column, session: Column, database: Column, user: Column) -> Column:
    """PRJ-07: the five parts as one struct if none is empty and the start is a time."""
    parts = {"start": start, "pid": pid, "session": session, "database": database, "user": user}
    full = parse_log_time(start).isNotNull()
    for c in parts.values():
        full = full & F.coalesce(F.length(c) > 0, F.lit(False))
    return F.when(full, F.struct(*[c.alias(n) for n, c in parts.items()]))


def value_reasons(end: Column, us: Column, start: Column) -> Column:
    """PRJ-08: why values are unknown."""
    why = F.lit("unknown_from_evidence")
    return F.map_filter(F.create_map(F.lit("end_at"), F.when(end.isNull(), why), F.lit("duration_ms"), F.when(us.isNull(), why), F.lit("estimated_start_at"), F.when(start.isNull(), why)), lambda k, v: v.isNotNull())


def record_problems(df: DataFrame) -> DataFrame:
    """PRJ-09: one row a problem of a record, with an id that depends on the record and the problem only."""
    problems = F.array_compact(
        F.array(
            F.when(~F.col("readable"), "invalid_encoding"),
            F.when(F.col("us").isNotNull() & (F.coalesce(F.length("sql"), F.lit(0)) == 0), "sql_missing"),
            F.when(F.col("us").isNotNull() & F.col("timing_type").isNull(), "timing_out_of_scope"),
            F.when((F.col("level") == "ERROR") & (F.col("outcome") == "unknown"), "error_without_execution"),
            F.when(F.col("end_at").isNull(), "end_unknown"),
            F.when(F.col("us").isNull() & (F.col("outcome") == "unknown"), "duration_unknown"),
            F.when(F.col("database").isNull() | F.col("execution_user").isNull(), "identity_missing"),
        )
    )
    rows = df.select("file_id", "record_no", F.explode(problems).alias("code"))
    return rows.withColumn("problem_id", F.sha2(F.to_json(F.array(F.col("file_id"), F.col("record_no").cast("string"), F.col("code"))), 256))


def import_counts(df: DataFrame) -> DataFrame:
    """PRJ-10: (file_id, metric, n): records, durations with and without text, sites, outcomes, timings."""
    metric = F.array_compact(
        F.array(
            F.lit("records"),
            F.when(F.col("us").isNotNull(), F.when(F.length("sql") > 0, "duration_with_sql").otherwise("duration_without_sql")),
            F.concat(F.lit("site:"), "site"),
            F.concat(F.lit("outcome:"), "outcome"),
            F.concat(F.lit("timing:"), "timing_type"),
        )
    )
    return df.select("file_id", F.explode(metric).alias("metric")).groupBy("file_id", "metric").agg(F.count("*").alias("n"))


def request_shape(categories: Column) -> Column:
    """PRJ-11."""
    n = F.coalesce(F.size(categories), F.lit(0))
    return F.when(n > 1, "batch").when(n == 1, "single").otherwise("unknown")


def sql_state(text: Column, readable: Column, issue: Column) -> Column:
    """PRJ-12: complete, missing, incomplete, invalid_encoding or uncertain."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "missing")
        .when(~readable, "invalid_encoding")
        .when(issue.isin("unterminated_string", "unterminated_comment", "unterminated_quote", "unterminated_dollar"), "incomplete")
        .when(issue.isNotNull(), "uncertain")
        .otherwise("complete")
    )


def encode(kind: str, value: Column) -> Column:
    """PRJ-15: small code of a value; unknown values and null are 0."""
    return (F.greatest(F.array_position(F.lit(CODES[kind]), F.coalesce(value, F.lit("unknown"))), F.lit(1)) - 1).cast("int")


def decode(kind: str, code: Column) -> Column:
    """PRJ-15: value of a code; code 0 is null."""
    return F.nullif(F.element_at(F.lit(CODES[kind]), code + 1), F.lit("unknown"))


def label(kind: str, code: Column) -> Column:
    """PRJ-16: display text of a code; unknown codes stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS[kind].items() for x in kv]), code), code)
