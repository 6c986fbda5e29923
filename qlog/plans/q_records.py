"""Queries of log reading, interpretation, pairing, lexical work and text functions, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.functions import lexical, records
from qlog.functions import text as tx
from qlog.operators import pairing, tables
from qlog.plans import base
from qlog.sources import logs

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def shared(spark) -> str:
    """A new folder below the application's own in the cluster's shared one."""
    return f"{base.store(spark)}/{uuid.uuid4().hex}"


def log_records(spark, d):
    """Log records that events stand for: one file for each of four groups of users."""
    e = base.table(spark, d, "events")
    i, u, k = F.col("event_id"), F.col("user_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.col("event_type")
    stamp = lambda t: F.concat(F.date_format(t + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" CST"))
    took = F.concat(F.lit("duration: "), F.format_string("%.2f", "value"), F.lit(" ms"))
    message = F.when((kind != "error") & (k % 29 == 0), "duration: 1.00005 ms").when(kind != "error", took).when(u % 3 == 0, "canceling statement due to user request").when(u % 3 == 1, "canceling statement due to statement timeout").otherwise("division by zero")
    line = F.when(kind == "click", "1946").when(kind == "signup", "2219").when(kind == "view", "2843").when(kind == "purchase", "2608").otherwise("77")
    filled = {
        "log_at": F.when(i % 53 != 0, stamp(F.col("ts").cast("timestamp_ntz"))).otherwise("not a time"), "execution_user": F.concat(F.lit("U"), (u % 10).cast("string")), "database": F.when(k % 25 != 0, F.concat(F.lit("D"), (k % 5).cast("string"))).otherwise(""),
        "pid": F.concat(F.lit("p"), u.cast("string")), "session_start": F.lit("2024-01-01 00:00:00 CST"), "session_id": F.concat(F.lit("con"), u.cast("string")), "node": F.lit("seg-1"), "level": F.when(kind == "error", "ERROR").otherwise("LOG"),
        "sqlstate": F.when((kind == "error") & (u % 3 < 2), "57014").when(kind == "error", "22012").otherwise("00000"), "message": message, "sql": F.when(i % 41 != 0, F.concat(F.lit("SELECT "), k.cast("string"), F.lit(",\n'a;b'"))).otherwise(""), "file": F.lit("/src/postgres.c"), "line": line,
    }
    return e.select(F.concat(F.lit("L"), (u % 4).cast("string")).alias("file_id"), i.alias("record_no"), *[filled.get(c, F.lit("")).alias(c) for c in logs.COLUMNS])


def interpreted(rows):
    us = records.parse_duration(F.col("message"))
    end = records.parse_log_time(F.col("log_at"))
    out = rows.withColumn("us", us).withColumn("end_at", end).withColumn("start_at", records.estimated_start(end, us)).withColumn("site", records.source_site(F.col("file"), F.col("line")))
    out = out.withColumn("timing_type", records.timing_type(F.col("line"))).withColumn("outcome", records.outcome(F.col("us"), F.col("level"), F.col("node"), F.col("sql"), F.col("sqlstate"), F.col("message")))
    out = out.withColumn("session", records.session_key(F.col("session_start"), F.col("pid"), F.col("session_id"), F.col("database"), F.col("execution_user")))
    return out.withColumn("database", F.nullif("database", F.lit(""))).withColumn("readable", F.lit(True))


LG = """lg AS (SELECT 'L' || (user_id % 4) AS file_id, event_id AS record_no, *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
it AS (SELECT *, CASE WHEN event_type <> 'error' AND k % 29 <> 0 THEN CAST(round(value * 1000) AS BIGINT) END AS us, CASE WHEN event_id % 53 <> 0 THEN epoch_us(ts) END AS end_us,
  CASE event_type WHEN 'click' THEN 'request' WHEN 'signup' THEN 'parse' WHEN 'view' THEN 'execute' WHEN 'purchase' THEN 'bind' END AS timing_type,
  'postgres.c:' || CASE event_type WHEN 'click' THEN '1946' WHEN 'signup' THEN '2219' WHEN 'view' THEN '2843' WHEN 'purchase' THEN '2608' ELSE '77' END AS site, event_id % 41 <> 0 AS has_sql FROM lg),
io AS (SELECT *, CASE WHEN us IS NOT NULL THEN 'success' WHEN event_type = 'error' AND user_id % 3 = 1 THEN 'timed_out' WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'cancelled'
  WHEN event_type = 'error' AND has_sql THEN 'failed' ELSE 'unknown' END AS outcome FROM it)"""


@query("records_interpret", f"WITH {LG} SELECT record_no, us, end_us, end_us - us AS start_us, site, timing_type, outcome, k % 25 <> 0 AS has_session FROM io")
def records_interpret(spark, d):
    """PRJ-01..07."""
    return interpreted(log_records(spark, d)).select("record_no", "us", cal.micros(F.col("end_at")).alias("end_us"), cal.micros(F.col("start_at")).alias("start_us"), "site", "timing_type", "outcome", F.col("session").isNotNull().alias("has_session"))


@query(
    "records_value_reasons",
    f"WITH {LG} SELECT record_no, unnest(list_filter([CASE WHEN end_us IS NULL THEN 'end_at' END, CASE WHEN us IS NULL THEN 'duration_ms' END, CASE WHEN end_us IS NULL OR us IS NULL THEN 'estimated_start_at' END], lambda c: c IS NOT NULL)) AS name, 'unknown_from_evidence' AS reason FROM io",
)
def records_value_reasons(spark, d):
    """PRJ-08."""
    rows = interpreted(log_records(spark, d))
    return rows.select("record_no", F.explode(records.value_reasons(F.col("end_at"), F.col("us"), F.col("start_at"))).alias("name", "reason"))


@query(
    "records_problems",
    f"""WITH {LG}, pr AS (SELECT file_id, record_no, unnest(list_filter([CASE WHEN us IS NOT NULL AND NOT has_sql THEN 'sql_missing' END, CASE WHEN us IS NOT NULL AND timing_type IS NULL THEN 'timing_out_of_scope' END,
 CASE WHEN event_type = 'error' AND outcome = 'unknown' THEN 'error_without_execution' END, CASE WHEN end_us IS NULL THEN 'end_unknown' END, CASE WHEN us IS NULL AND outcome = 'unknown' THEN 'duration_unknown' END,
 CASE WHEN k % 25 = 0 THEN 'identity_missing' END], lambda c: c IS NOT NULL)) AS code FROM io)
SELECT file_id, record_no, code, sha256('["' || file_id || '","' || record_no || '","' || code || '"]') AS problem_id FROM pr""",
)
def records_problems(spark, d):
    """PRJ-09."""
    return records.record_problems(interpreted(log_records(spark, d)))


@query(
    "records_import_counts",
    f"""WITH {LG}, m AS (SELECT file_id, unnest(list_filter(['records', CASE WHEN us IS NOT NULL AND has_sql THEN 'duration_with_sql' WHEN us IS NOT NULL THEN 'duration_without_sql' END, 'site:' || site, 'outcome:' || outcome, 'timing:' || timing_type], lambda c: c IS NOT NULL)) AS metric FROM io)
SELECT file_id, metric, count(*) AS n FROM m GROUP BY ALL""",
)
def records_import_counts(spark, d):
    """PRJ-10."""
    return records.import_counts(interpreted(log_records(spark, d)))


@query(
    "records_codes",
    f"""WITH {LG} SELECT record_no, CAST(CASE timing_type WHEN 'request' THEN 1 WHEN 'parse' THEN 2 WHEN 'bind' THEN 3 ELSE 0 END AS BIGINT) AS code, CASE WHEN timing_type IN ('request', 'parse', 'bind') THEN timing_type END AS decoded,
CASE outcome WHEN 'success' THEN 'Succeeded' WHEN 'failed' THEN 'Failed' WHEN 'cancelled' THEN 'Cancelled' WHEN 'timed_out' THEN 'Timed out' ELSE 'Unknown' END AS label FROM io""",
)
def records_codes(spark, d):
    """PRJ-15, 16."""
    rows = interpreted(log_records(spark, d)).withColumn("code", records.encode("timing", F.col("timing_type")))
    return rows.select("record_no", F.col("code").cast("long").alias("code"), records.decode("timing", F.col("code")).alias("decoded"), records.label("outcome", F.col("outcome")).alias("label"))


@query(
    "records_evidence",
    f"""WITH {LG} SELECT record_no, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + CAST(has_sql AS INTEGER) END + 10 + CAST(k % 25 <> 0 AS INTEGER) AS BIGINT) AS kept FROM io""",
)
def records_evidence(spark, d):
    """SRC-08: entries of the evidence map; message and text only on records with a duration's message."""
    out = logs.project_evidence(log_records(spark, d), F.col("message").startswith("duration"), F.lit(True))
    return out.select("record_no", F.size("observed").cast("long").alias("kept"))


@query(
    "pairing_sessions",
    """WITH b AS (SELECT 'L0' AS file_id, CASE WHEN user_id % 50 <> 0 THEN 'u' || user_id END AS session, event_id AS record_no, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'finish' ELSE 'boundary' END AS kind,
 'S' || (CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 3) AS sql, ts, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 2 = 0 AS fe FROM events WHERE event_type IN ('click', 'view', 'error')),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(sql) OVER w AS ps, lag(ts) OVER w AS pt, lag(fe) OVER w AS pf, lag(record_no) OVER w AS pr, lag(kind, 2) OVER w AS ppk FROM b WHERE session IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY record_no)),
v AS (SELECT *, CASE WHEN pk IS NULL OR pk <> 'start' THEN 'execute_start_missing' WHEN ppk = 'start' THEN 'execute_start_ambiguous' WHEN ps IS DISTINCT FROM sql THEN 'execute_context_mismatch' WHEN pt > ts THEN 'execute_order_invalid' WHEN pf THEN 'execute_fetch' ELSE 'execute_first' END AS pairing FROM l WHERE kind = 'finish')
SELECT session, record_no, pairing, CASE WHEN pairing IN ('execute_first', 'execute_fetch') THEN pr END AS start_record FROM v UNION ALL SELECT session, record_no, 'session_identity_missing', NULL FROM b WHERE session IS NULL AND kind = 'finish'""",
)
def pairing_sessions(spark, d):
    """STF-01: clicks start, views finish, errors interrupt."""
    e = base.table(spark, d, "events").where("event_type in ('click', 'view', 'error')")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "finish").otherwise("boundary")
    session = F.when(F.col("user_id") % 50 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    rows = e.select(F.lit("L0").alias("file_id"), session.alias("session"), F.col("event_id").alias("record_no"), kind.alias("kind"), F.concat(F.lit("S"), (k % 3).cast("string")).alias("sql"), F.col("ts").alias("at"), (k % 2 == 0).alias("fetch"))
    return pairing.pair_executes(rows).select("session", "record_no", "pairing", "start_record")


# --- reading files ---------------------------------------------------------------------------------


#: Records of one log file, as servers begin a new one at a size: its hash is one task.
FILE_RECORDS = 200_000


def _files(spark, d):
    """The log records as CSV files of about ``FILE_RECORDS`` records in the shared folder, four at least."""
    path = shared(spark) + "/logs"
    log_records(spark, d).select(*logs.COLUMNS).repartition(max(4, tables.parts(base.table(spark, d, "events"), FILE_RECORDS)), "pid").write.option("escape", '"').option("emptyValue", "").option("quoteAll", True).csv(path)
    return path


@query("source_read_csv", "SELECT count(*) AS records, true AS valid, count(DISTINCT user_id % 10) AS users, count(*) FILTER (event_id % 41 <> 0) AS with_sql FROM events")
def source_read_csv(spark, d):
    """SRC-01, 09: written, then read strictly."""
    rows = logs.read_log_csv(spark, _files(spark, d))
    return rows.agg(F.count("*").alias("records"), F.bool_and("valid").alias("valid"), F.count_distinct("execution_user").alias("users"), F.count_if(F.contains("sql", F.lit("\n"))).alias("with_sql"))


@query("source_positions", "SELECT count(*) AS records, count(*) + count(*) FILTER (event_id % 41 <> 0) AS lines, true AS readable, CAST(30 AS BIGINT) AS width FROM events")
def source_positions(spark, d):
    """SRC-02: each text spans two lines."""
    rows = logs.record_positions(spark, _files(spark, d))
    return rows.agg(F.count("*").alias("records"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("lines"), F.bool_and("readable").alias("readable"), F.max(F.size("fields")).cast("long").alias("width"))


@query("source_file_stats", "SELECT count(*) AS records, epoch_us(min(ts) FILTER (event_id % 53 <> 0)) AS first_us, epoch_us(max(ts) FILTER (event_id % 53 <> 0)) AS last_us FROM events")
def source_file_stats(spark, d):
    """SRC-03, 15: file facts, then the range over all files."""
    path = _files(spark, d)
    stats = logs.file_stats(spark, path, logs.read_log_csv(spark, path)).withColumn("scope_id", F.lit("C"))
    out = logs.data_time_range(stats).crossJoin(stats.agg(F.sum("records").alias("records")))
    return out.select("records", cal.micros(F.col("first_at")).alias("first_us"), cal.micros(F.col("last_at")).alias("last_us"))


#: Documents as files: content is the text, the origin the source and length.
DF = """fl AS (SELECT 'S' || (doc_id % 3) AS source_id, sha256(text) AS sha256, source || '/' || n_chars AS origin_key, doc_id FROM documents),
im AS (SELECT source_id, sha256, origin_key, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS state FROM fl WHERE doc_id % 2 = 0)"""


def _doc_files(spark, d):
    t = base.table(spark, d, "documents")
    fl = t.select(F.concat(F.lit("S"), (F.col("doc_id") % 3).cast("string")).alias("source_id"), F.sha2("text", 256).alias("sha256"), F.concat_ws("/", "source", "n_chars").alias("origin_key"), "doc_id")
    return fl, fl.where("doc_id % 2 = 0").withColumn("state", F.when(F.col("doc_id") % 7 == 0, "failed").otherwise("succeeded"))


@query("source_known_content", f"WITH {DF} SELECT doc_id, NOT EXISTS (SELECT 1 FROM im WHERE im.source_id = fl.source_id AND im.sha256 = fl.sha256 AND im.state = 'succeeded') AS to_import FROM fl")
def source_known_content(spark, d):
    """SRC-04."""
    fl, im = _doc_files(spark, d)
    return logs.skip_known_content(fl, im).select("doc_id", "to_import")


@query("source_origin_changes", f"WITH {DF} SELECT DISTINCT fl.source_id, fl.origin_key, fl.sha256, im.sha256 AS old_sha256 FROM fl JOIN im USING (source_id, origin_key) WHERE fl.sha256 <> im.sha256")
def source_origin_changes(spark, d):
    """SRC-05."""
    fl, im = _doc_files(spark, d)
    return logs.origin_changes(fl, im.select("source_id", "origin_key", "sha256"))


@query(
    "source_edge_overlaps",
    """WITH r AS (SELECT role AS source_id, conv_id AS file_id, turn AS record_no, text AS body FROM conversations), b AS (SELECT 's' AS source_id, file_id, record_no, body, source_id AS session FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY record_no) AS n, row_number() OVER (PARTITION BY file_id ORDER BY record_no DESC) AS m FROM b), e AS (SELECT * FROM n WHERE n <= 32 OR m <= 32),
p AS (SELECT *, lead(body) OVER w AS b2, lead(record_no) OVER w AS r2, lead(session) OVER w AS s2 FROM e WINDOW w AS (PARTITION BY file_id ORDER BY record_no)),
q AS (SELECT file_id, body || chr(10) || b2 AS pair FROM p WHERE s2 IS NOT NULL AND r2 = record_no + 1)
SELECT DISTINCT CAST(x.file_id AS BIGINT) AS file_id, CAST(y.file_id AS BIGINT) AS other_id FROM q x JOIN q y USING (pair) WHERE x.file_id < y.file_id""",
)
def source_edge_overlaps(spark, d):
    """SRC-06: conversations as files; a turn's number stands for its time."""
    rows = base.table(spark, d, "conversations").select(F.lit("s").alias("source_id"), F.col("conv_id").alias("file_id"), F.col("turn").alias("record_no"), F.col("role").alias("session"), F.col("turn").alias("log_at"), F.col("text").alias("body"))
    return logs.edge_overlaps(rows).select(F.col("file_id").cast("long"), F.col("other_id").cast("long"))


@query(
    "source_batches",
    """WITH o AS (SELECT o_custkey % 40 AS batch_id, o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS state FROM orders),
nw AS (SELECT batch_id, path, CASE WHEN path % 3001 = 0 THEN 'conflict' WHEN batch_id % 4 = 0 THEN 'succeeded' ELSE state END AS state FROM o WHERE NOT (batch_id % 5 = 0 AND path % 1000 = 1)),
g AS (SELECT batch_id, count(*) AS removed FROM o WHERE state = 'succeeded' AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.batch_id = o.batch_id AND nw.path = o.path) GROUP BY batch_id),
s AS (SELECT batch_id, bool_or(state = 'conflict') AS bad, bool_and(state IN ('succeeded', 'duplicate_skipped')) AS good FROM nw GROUP BY batch_id)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CASE WHEN coalesce(removed, 0) > 0 OR bad THEN 'conflict' WHEN good THEN 'complete' ELSE 'failed' END AS state, coalesce(removed, 0) AS removed FROM s FULL JOIN g USING (batch_id)""",
)
def source_batches(spark, d):
    """SRC-07: orders as files of batches."""
    o = base.table(spark, d, "orders").select((F.col("o_custkey") % 40).cast("long").alias("batch_id"), F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("state"))
    new = o.where(~((F.col("batch_id") % 5 == 0) & (F.col("path") % 1000 == 1))).withColumn("state", F.when(F.col("path") % 3001 == 0, "conflict").when(F.col("batch_id") % 4 == 0, "succeeded").otherwise(F.col("state")))
    return logs.reconcile_batch(o, new)


#: Orders as received files: the day in the name is the order's, markers for all days but those of even dates without urgent orders.
@query(
    "source_inbox",
    """WITH f AS (SELECT 'S' || (o_custkey % 2) AS source_id, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS files FROM orders GROUP BY ALL),
m AS (SELECT DISTINCT 'S' || (o_custkey % 2) AS source_id, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS day FROM orders WHERE o_orderpriority LIKE '1%'),
j AS (SELECT source_id, day, coalesce(files, 0) AS files, CASE WHEN m.day IS NOT NULL AND day >= '1998-01-01' THEN 'marker_not_before_today' WHEN m.day IS NULL THEN 'files_without_marker' WHEN f.day IS NULL THEN 'marker_without_files' END AS problem FROM f FULL JOIN m USING (source_id, day))
SELECT source_id, day, files, problem, CASE WHEN day < '1993-01-01' THEN 'imported' WHEN problem IS NULL THEN 'pending' ELSE 'waiting' END AS work FROM j""",
)
def source_inbox(spark, d):
    """SRC-10."""
    o = base.table(spark, d, "orders")
    source, day = F.concat(F.lit("S"), (F.col("o_custkey") % 2).cast("string")), F.col("o_orderdate").cast("date")
    files = o.select(source.alias("source_id"), F.concat(F.lit("gpdb-"), day.cast("string"), F.lit("_000000.csv."), F.col("o_orderkey").cast("string")).alias("name"))
    marks = o.where("o_orderpriority like '1%'").select(source.alias("source_id"), F.concat(F.date_add(day, 1).cast("string"), F.lit(".complete")).alias("name"))
    listing = files.unionByName(marks)
    states = o.select(source.alias("source_id"), day.cast("string").alias("day")).union(o.select(source, F.date_add(day, 1).cast("string"))).distinct().where("day < '1993-01-01'").withColumn("state", F.lit("complete"))
    return logs.day_inbox(listing, states, "1998-01-01")


@query(
    "source_verify_push",
    """WITH a AS (SELECT 'gpdb-' || strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey AS name, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT name, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 13 = 0 THEN 'extra' WHEN o_orderkey % 17 = 0 THEN 'size_mismatch' ELSE 'day_outside_range' END AS failure FROM a
WHERE o_orderkey % 143 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR day < '1993-01-01' OR day >= '1998-01-01')""",
)
def source_verify_push(spark, d):
    """SRC-11, 12."""
    o, k = base.table(spark, d, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("gpdb-"), F.col("o_orderdate").cast("date").cast("string"), F.lit("_"), k.cast("string"))
    sent = o.where(k % 13 != 0).select(name.alias("name"), F.lit(5).alias("size"))
    got = o.where(k % 11 != 0).select(name.alias("name"), F.when(k % 17 == 0, 6).otherwise(5).alias("size"))
    return logs.verify_push(sent, got, "1993-01-01", "1998-01-01")


@query(
    "source_changed_day",
    """SELECT 'f' || c_custkey AS name, CASE WHEN c_custkey % 7 = 0 THEN 'missing' WHEN c_custkey % 5 = 0 THEN 'extra' ELSE 'different' END AS change FROM customer WHERE c_custkey % 35 <> 0 AND (c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0)""",
)
def source_changed_day(spark, d):
    """SRC-12."""
    c, k = base.table(spark, d, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("f"), k.cast("string")).alias("name")
    return logs.changed_day(c.where(k % 5 != 0).select(name, F.lit("a").alias("sha256")), c.where(k % 7 != 0).select(name, F.when(k % 3 == 0, "b").otherwise("a").alias("sha256")))


@query(
    "source_manifest",
    """WITH s AS (SELECT 'f' || l_suppkey AS name, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS name_day, count(*) AS found, l_suppkey FROM lineitem WHERE l_suppkey % 9 <> 0 GROUP BY l_suppkey),
o AS (SELECT 'f' || l_suppkey AS name, count(*) + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS known FROM lineitem WHERE l_suppkey % 3 = 0 OR l_suppkey % 4 = 0 GROUP BY l_suppkey)
SELECT name, CASE WHEN found IS NULL THEN 'historical_file_missing' WHEN known IS NULL THEN 'new' WHEN known <> found THEN 'historical_file_differs' ELSE 'unchanged' END AS state, coalesce(known, found) AS records, CASE WHEN found IS NOT NULL THEN false END AS day_mismatch FROM o FULL JOIN s USING (name)""",
)
def source_manifest(spark, d):
    """SRC-13: line items of a supplier as a file named by its last day."""
    li, k = base.table(spark, d, "lineitem"), F.col("l_suppkey")
    name, day = F.concat(F.lit("f"), k.cast("string")), F.col("l_shipdate").cast("date")
    # partitions of as many rows at every size; the last day, its join and the counts all stay in them
    rows = li.where(k % 9 != 0).select(name.alias("name"), day.alias("day")).repartition(tables.parts(li, 500_000), "name")
    last = rows.groupBy("name").agg(F.max("day").alias("name_day"))
    old = li.where((k % 3 == 0) | (k % 4 == 0)).groupBy(name.alias("name"), k).agg(F.count("*").alias("n")).select("name", (F.col("n") + F.when(k % 4 == 0, 1).otherwise(0)).alias("records"))
    return logs.extend_manifest(old, rows.join(last, "name")).drop("by_day")


@query(
    "source_sample",
    """WITH r AS (SELECT lang AS scope_id, source AS file_id, doc_id AS record_no, n_chars AS c FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, dense_rank() OVER (PARTITION BY scope_id ORDER BY file_id) AS f, row_number() OVER (PARTITION BY file_id ORDER BY record_no) AS n, sum(c) OVER (PARTITION BY file_id ORDER BY record_no ROWS UNBOUNDED PRECEDING) AS b FROM r)
SELECT scope_id, file_id, record_no FROM x WHERE f <= 3 AND n <= 20 AND b <= 40000""",
)
def source_sample(spark, d):
    """SRC-14: the sample is the feature: 20 records, 40,000 characters, of three files."""
    rows = base.texts(spark, d).select(F.col("lang").alias("scope_id"), F.col("source").alias("file_id"), F.col("doc_id").alias("record_no"), F.col("text").alias("body"))
    return logs.sample_prefix(rows, 3, 20, 40_000).select("scope_id", "file_id", "record_no")


# --- SQL texts -------------------------------------------------------------------------------------


def sql_texts(spark, d):
    """A SQL text an event, five kinds; views end in a comment, errors in an open string."""
    e, i, u = base.table(spark, d, "events"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.concat(F.lit("SELECT a, b FROM t WHERE id = "), i, F.lit(" AND name = 'u"), u, F.lit("'")))
        .when(kind == "view", F.concat(F.lit("select A, lower(B)\nfrom T where id in ("), i, F.lit(", "), u, F.lit(", 3); -- note "), i))
        .when(kind == "purchase", F.concat(F.lit("BEGIN; UPDATE t SET v = "), u, F.lit(" WHERE id = "), i, F.lit("; COMMIT")))
        .when(kind == "signup", F.concat(F.lit("INSERT INTO t VALUES ("), i, F.lit(", 'x''y;', $1, now(), s.f(1, 2))")))
        .otherwise(F.concat(F.lit("SELECT 'open "), i))
    )
    return e.select(i.alias("sql_id"), "event_type", text.alias("text"))


#: The texts of ``sql_texts`` and their tokens, cut by another engine's patterns.
TEXTS = r"""tx AS (SELECT event_id, event_type, user_id, CASE event_type WHEN 'click' THEN 'SELECT a, b FROM t WHERE id = ' || event_id || ' AND name = ''u' || user_id || ''''
  WHEN 'view' THEN 'select A, lower(B)' || chr(10) || 'from T where id in (' || event_id || ', ' || user_id || ', 3); -- note ' || event_id
  WHEN 'purchase' THEN 'BEGIN; UPDATE t SET v = ' || user_id || ' WHERE id = ' || event_id || '; COMMIT' WHEN 'signup' THEN 'INSERT INTO t VALUES (' || event_id || ', ''x''''y;'', $1, now(), s.f(1, 2))'
  ELSE 'SELECT ''open ' || event_id END AS text FROM events),
tk AS (SELECT *, list_filter(regexp_extract_all(text, '--[^\n]*|''(?:[^'']|'''')*''|\$[0-9]+|[0-9]+(?:\.[0-9]+)?|[A-Za-z_][A-Za-z0-9_$]*|::|<>|!=|<=|>=|\|\||[^\sA-Za-z0-9_]'), lambda t: t NOT LIKE '--%') AS k FROM tx)"""


@query(
    "lexical_statements",
    """SELECT event_type, CASE event_type WHEN 'purchase' THEN 'BEGIN,UPDATE,COMMIT' WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN '' ELSE 'SELECT' END AS categories, CASE WHEN event_type = 'error' THEN 'unterminated_string' END AS issue,
CASE event_type WHEN 'purchase' THEN 'batch' WHEN 'error' THEN 'unknown' ELSE 'single' END AS shape, CASE WHEN event_type = 'error' THEN 'incomplete' ELSE 'complete' END AS sql_state, count(*) AS n FROM events GROUP BY ALL""",
)
def lexical_statements(spark, d):
    """TXT-08, PRJ-11, 12."""
    texts = sql_texts(spark, d)
    out = lexical.lexical_statements(texts).join(texts, "sql_id")
    out = out.withColumn("shape", records.request_shape(F.col("categories"))).withColumn("sql_state", records.sql_state(F.col("text"), F.lit(True), F.col("issue")))
    return out.groupBy("event_type", F.array_join("categories", ",").alias("categories"), "issue", "shape", "sql_state").agg(F.count("*").alias("n"))


@query(
    "lexical_fingerprints",
    """SELECT event_type, CASE WHEN event_type = 'error' THEN 'normalization_failed' ELSE 'reliable' END AS state, CASE WHEN event_type = 'error' THEN 'unterminated_string' END AS reason, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS BIGINT) AS fingerprints, count(*) AS texts FROM events GROUP BY event_type""",
)
def lexical_fingerprints(spark, d):
    """TXT-10, 11: texts of a kind differ only in literals, so each kind has one fingerprint."""
    texts = sql_texts(spark, d)
    out = lexical.token_fingerprints(texts).join(texts.select("sql_id", "event_type"), "sql_id")
    return out.groupBy("event_type", "state", "reason").agg(F.count_distinct("value").alias("fingerprints"), F.count("*").alias("texts"))


@query("lexical_approximate", "SELECT 'available' AS state, count(*) AS texts, count(*) AS identities, CAST(0 AS BIGINT) AS replacements FROM events WHERE event_type = 'error'")
def lexical_approximate(spark, d):
    """TXT-12: open strings have no reliable fingerprint; nothing in them is compared, so each stays its own."""
    texts = sql_texts(spark, d)
    out = lexical.approximate_fingerprints(texts, lexical.token_fingerprints(texts))
    return out.groupBy("state").agg(F.count("*").alias("texts"), F.count_distinct("value").alias("identities"), F.sum("replacements").alias("replacements"))


@query(
    "lexical_calls",
    """SELECT * FROM (SELECT 'lower' AS name, CAST(1 AS BIGINT) AS arity, 'R1' AS rule_id, 'matched' AS reason, count(*) AS n FROM events WHERE event_type = 'view' UNION ALL SELECT 'now', 0, NULL, 'disabled', count(*) FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'f', 2, NULL, 'unknown_arity', count(*) FROM events WHERE event_type = 'signup') WHERE n > 0""",
)
def lexical_calls(spark, d):
    """TXT-15."""
    rules = spark.createDataFrame([("R1", "pg", "lower", 1, 1, True), ("R2", "pg", "now", 0, 0, False), ("R3", "s", "f", 3, None, True)], "rule_id string, schema string, name string, least int, most int, enabled boolean")
    return lexical.call_usage(sql_texts(spark, d), rules).groupBy("name", F.col("arity").cast("long").alias("arity"), "rule_id", "reason").agg(F.count("*").alias("n"))


@query(
    "lexical_signatures",
    "SELECT event_type, CASE event_type WHEN 'click' THEN 'SELECT A ,' WHEN 'view' THEN 'SELECT A ,' WHEN 'purchase' THEN 'BEGIN ; UPDATE' WHEN 'signup' THEN 'INSERT INTO T' ELSE 'SELECT' END AS head, count(*) AS n FROM events GROUP BY event_type",
)
def lexical_signatures(spark, d):
    """TXT-16."""
    texts = sql_texts(spark, d)
    return lexical.failure_signatures(texts).join(texts.select("sql_id", "event_type"), "sql_id").groupBy("event_type", "head").agg(F.count("*").alias("n"))


@query(
    "lexical_split",
    f"""WITH {TEXTS} SELECT CAST(event_id AS VARCHAR) AS sql_id, CAST(unnest([1, 2, 3]) AS BIGINT) AS n, unnest(['BEGIN', 'UPDATE t SET v = ' || user_id || ' WHERE id = ' || event_id, 'COMMIT']) AS piece FROM events WHERE event_type = 'purchase'
UNION ALL SELECT CAST(event_id AS VARCHAR), 1, text FROM tx WHERE event_type NOT IN ('purchase', 'error')""",
)
def lexical_split(spark, d):
    """TXT-18."""
    return lexical.split_statements(sql_texts(spark, d)).withColumn("n", F.col("n").cast("long"))


@query(
    "lexical_census",
    f"""WITH {LG}, q AS (SELECT site, record_no, has_sql FROM io), r AS (SELECT 'sql' AS field, site, 'records' AS label, record_no FROM q UNION ALL SELECT 'sql', site, CASE WHEN has_sql THEN 'category:SELECT' ELSE 'empty' END, record_no FROM q
UNION ALL SELECT 'internal_sql', site, 'records', record_no FROM q UNION ALL SELECT 'internal_sql', site, 'empty', record_no FROM q) SELECT field, site, label, count(*) AS n FROM r GROUP BY ALL""",
)
def lexical_census(spark, d):
    """TXT-13."""
    rows = log_records(spark, d).withColumn("site", records.source_site(F.col("file"), F.col("line")))
    return lexical.statement_census(rows, ["sql", "internal_sql"]).select("field", "site", "label", "n")


@query("lexical_candidates", f"WITH {LG} SELECT file_id, record_no, CASE WHEN has_sql THEN 'sql' ELSE 'message' END AS field FROM io UNION ALL SELECT file_id, record_no, 'message' FROM io WHERE has_sql")
def lexical_candidates(spark, d):
    """TXT-14: the message stands for an inline text."""
    return lexical.text_candidates(log_records(spark, d), ["sql", "message", "internal_sql"]).select("file_id", "record_no", "field")


@query(
    "lexical_fingerprint_values",
    rf"""WITH {TEXTS}, fo AS (SELECT *, array_to_string(list_transform(k, lambda t: CASE WHEN (t LIKE '''%' AND length(t) > 1) OR regexp_matches(t, '^\$?[0-9]') THEN '?' ELSE lower(t) END), ' ') AS f FROM tk)
SELECT CAST(event_id AS VARCHAR) AS sql_id, CASE WHEN list_contains(k, '''') THEN 'normalization_failed' ELSE 'reliable' END AS state,
CASE WHEN NOT list_contains(k, '''') THEN 'lexical-1:' || sha256(regexp_replace(regexp_replace(f, ' ;$', ''), 'in \( \?(?: , \?){{1,9}} \)', 'in ( ?[2-10] )', 'g')) END AS value FROM fo""",
)
def lexical_fingerprint_values(spark, d):
    """TXT-10, 11: the fingerprint of every text."""
    return lexical.token_fingerprints(sql_texts(spark, d)).select("sql_id", "state", "value")


@query(
    "lexical_statement_values",
    f"""WITH {TEXTS} SELECT CAST(event_id AS VARCHAR) AS sql_id, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'purchase' THEN array_to_string(list_transform(string_split(text, '; '), lambda t: split_part(t, ' ', 1)), ',') ELSE upper(split_part(text, ' ', 1)) END AS categories,
CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'purchase' THEN '0,' || (strpos(text, 'UPDATE') - 1) || ',' || (strpos(text, 'COMMIT') - 1) ELSE '0' END AS starts FROM tx""",
)
def lexical_statement_values(spark, d):
    """TXT-08: categories and starts of every text's statements."""
    out = lexical.lexical_statements(sql_texts(spark, d))
    return out.select("sql_id", F.array_join("categories", ",").alias("categories"), F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


#: Readable tokens of each kind of text, written out, with a bar between them; what follows is the open comment.
APPROX = """CASE event_type
  WHEN 'click' THEN 'select|a|,|b|from|t|where|id|=|<value>|and|name|=|''u' || user_id || ''''
  WHEN 'view' THEN 'select|a|,|lower|(|b|)|from|t|where|id|in|(|<value>|,|<value>|,|<value>|)|;'
  WHEN 'purchase' THEN 'begin|;|update|t|set|v|=|<value>|where|id|=|<value>|;|commit'
  WHEN 'signup' THEN 'insert|into|t|values|(|' || event_id || '|,|''x''''y;''|,|$1|,|now|(|)|,|s|.|f|(|1|,|2|)|)' ELSE 'select' END"""


@query(
    "lexical_approximate_values",
    f"""SELECT CAST(event_id AS VARCHAR) AS sql_id, 'available' AS state,
  'approx:' || sha256(replace({APPROX}, '|', chr(31)) || chr(30) || CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN '''open ' || event_id || chr(10) ELSE '' END || '/* open') AS value,
  CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END AS BIGINT) AS replacements FROM events""",
)
def lexical_approximate_values(spark, d):
    """TXT-12: all texts, made unreliable by an open comment; a value right before it stays, as it may go on."""
    texts = sql_texts(spark, d).withColumn("text", F.concat("text", F.lit("\n/* open")))
    return lexical.approximate_fingerprints(texts, lexical.token_fingerprints(texts)).select("sql_id", "state", "value", "replacements")


#: Words that give a text each of the features, by the event's number; the last has only part of one.
FEATURED = ["PARTITION BY", "EXTERNAL TABLE", "DISTRIBUTED BY", "OVER", "RECURSIVE", "COPY", "DO", "PARTITION x BY"]


@query(
    "lexical_signature_features",
    """SELECT CAST(event_id AS VARCHAR) AS sql_id, CASE event_id % 8 WHEN 0 THEN 'partition_ddl' WHEN 1 THEN 'external_table' WHEN 2 THEN 'distributed' WHEN 3 THEN 'window'
WHEN 4 THEN 'recursive' WHEN 5 THEN 'copy' WHEN 6 THEN 'do_block' ELSE '' END || CASE WHEN event_id % 3 = 0 AND event_id % 8 IN (5, 7) THEN '' WHEN event_id % 3 = 0 AND event_id % 8 = 6 THEN '' WHEN event_id % 3 = 0 THEN ',' ELSE '' END
|| CASE WHEN event_id % 3 = 0 AND event_id % 8 NOT IN (5, 6) THEN 'copy' ELSE '' END AS features FROM events""",
)
def lexical_signature_features(spark, d):
    """TXT-16: every label, alone and with a second one; words inside strings and comments give none."""
    i = F.col("sql_id").cast("long")
    words = F.element_at(F.array(*[F.lit(w.lower()) for w in FEATURED]), (i % 8 + 1).cast("int"))
    second = F.when((i % 3 == 0) & (i % 8 != 6), " copy").otherwise("")
    texts = sql_texts(spark, d).select("sql_id", F.concat(F.lit("x 'DO' /* COPY */ "), words, second, F.lit(" y")).alias("text"))
    return lexical.failure_signatures(texts).select("sql_id", F.array_join("features", ",").alias("features"))


@query(
    "lexical_call_values",
    rf"""WITH {TEXTS}, c AS (SELECT event_id, unnest(regexp_extract_all(text, '[A-Za-z_.]+\([^()]*\)')) AS c FROM tx WHERE event_type <> 'error'), p AS (SELECT event_id, regexp_extract(c, '([A-Za-z_]+)\(', 1) AS name, regexp_extract(c, '\((.*)\)', 1) AS args FROM c)
SELECT CAST(event_id AS VARCHAR) AS sql_id, lower(name) AS name, CAST(CASE WHEN args = '' THEN 0 ELSE 1 + length(args) - length(replace(args, ',', '')) END AS BIGINT) AS arity, CASE lower(name) WHEN 'lower' THEN 'R1' END AS rule_id,
CASE lower(name) WHEN 'lower' THEN 'matched' WHEN 'now' THEN 'disabled' WHEN 'f' THEN 'unknown_arity' ELSE 'unknown_name' END AS reason FROM p""",
)
def lexical_call_values(spark, d):
    """TXT-15: every call of every text."""
    rules = spark.createDataFrame([("R1", "pg", "lower", 1, 1, True), ("R2", "pg", "now", 0, 0, False), ("R3", "s", "f", 3, None, True)], "rule_id string, schema string, name string, least int, most int, enabled boolean")
    return lexical.call_usage(sql_texts(spark, d), rules).select("sql_id", "name", F.col("arity").cast("long").alias("arity"), "rule_id", "reason")


@query(
    "lexical_signature_values",
    f"""WITH {TEXTS}, w AS (SELECT event_id, CASE WHEN list_contains(k, '''') THEN k[1 : list_position(k, '''') - 1] ELSE k END AS k FROM tk)
SELECT CAST(event_id AS VARCHAR) AS sql_id, '' AS features, upper(array_to_string(k[1:3], ' ')) AS head, upper(array_to_string(k[greatest(1, len(k) - 2) : len(k)], ' ')) AS tail FROM w""",
)
def lexical_signature_values(spark, d):
    """TXT-16: features, head and tail of every text."""
    return lexical.failure_signatures(sql_texts(spark, d)).select("sql_id", F.array_join("features", ",").alias("features"), "head", "tail")


#: Fields of a log record, as the records of ``log_records`` have them.
FIELDS = f"""{LG}, fl AS (SELECT record_no, CASE WHEN event_id % 53 <> 0 THEN strftime(ts + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S.%f') || ' CST' ELSE 'not a time' END AS log_at, 'U' || (user_id % 10) AS execution_user, CASE WHEN k % 25 <> 0 THEN 'D' || (k % 5) ELSE '' END AS database,
  'p' || user_id AS pid, 'con' || user_id AS session_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'LOG' END AS level, CASE WHEN event_type = 'error' AND user_id % 3 < 2 THEN '57014' WHEN event_type = 'error' THEN '22012' ELSE '00000' END AS sqlstate,
  CASE WHEN event_type <> 'error' AND k % 29 = 0 THEN 'duration: 1.00005 ms' WHEN event_type <> 'error' THEN 'duration: ' || printf('%.2f', value) || ' ms' WHEN user_id % 3 = 0 THEN 'canceling statement due to user request'
       WHEN user_id % 3 = 1 THEN 'canceling statement due to statement timeout' ELSE 'division by zero' END AS message,
  CASE WHEN event_id % 41 <> 0 THEN 'SELECT ' || k || ',' || chr(10) || '''a;b''' ELSE '' END AS sql, CASE event_type WHEN 'click' THEN '1946' WHEN 'signup' THEN '2219' WHEN 'view' THEN '2843' WHEN 'purchase' THEN '2608' ELSE '77' END AS line FROM io)"""
KEPT_NAMES = ["log_at", "execution_user", "database", "pid", "session_id", "level", "sqlstate", "line"]


@query(
    "records_evidence_values",
    f"""WITH {FIELDS}, e AS (SELECT record_no, unnest([{", ".join(f"{{'name': '{c}', 'value': {c}}}" for c in KEPT_NAMES)},
 {{'name': 'message', 'value': CASE WHEN message LIKE 'duration%' THEN message END}}, {{'name': 'sql', 'value': CASE WHEN message LIKE 'duration%' THEN sql END}}]) AS p FROM fl)
SELECT record_no, p.name AS name, p.value AS value FROM e WHERE length(p.value) > 0""",
)
def records_evidence_values(spark, d):
    """SRC-08: every entry of the evidence map but the constant ones."""
    out = logs.project_evidence(log_records(spark, d), F.col("message").startswith("duration"), F.lit(True))
    return out.select("record_no", F.explode("observed").alias("name", "value")).where(F.col("name").isin([*KEPT_NAMES, "message", "sql"]))


@query("source_position_values", f"WITH {FIELDS} SELECT sha256(concat_ws('|', log_at, execution_user, database, pid, session_id, level, sqlstate, message, sql, line)) AS fields, CASE WHEN sql <> '' THEN 2 ELSE 1 END AS lines FROM fl")
def source_position_values(spark, d):
    """SRC-02: the fields and lines of every record; its number depends on how the records fell into files."""
    rows = logs.record_positions(spark, _files(spark, d))
    at = [F.get("fields", F.lit(logs.COLUMNS.index(c))) for c in ("log_at", "execution_user", "database", "pid", "session_id", "level", "sqlstate", "message", "sql", "line")]
    return rows.select(F.sha2(F.concat_ws("|", *at), 256).alias("fields"), (F.col("line_end") - F.col("line_start") + 1).cast("int").alias("lines"))


# --- text functions --------------------------------------------------------------------------------


@query("text_dedup", "SELECT sha256(text) AS sql_id, count(*) AS records, length(text) AS length FROM documents WHERE text IS NOT NULL GROUP BY text")
def text_dedup(spark, d):
    """TXT-01."""
    return tx.dedup_texts(base.table(spark, d, "documents")).select("sql_id", "records", F.length("text").cast("long").alias("length"))


@query(
    "text_terms",
    """WITH f AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda t: t <> '') AS t FROM conversations WHERE text IS NOT NULL)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(len(t) AS BIGINT) AS terms, sha256(array_to_string(t, ' ')) AS digest, CASE WHEN len(t) = 0 THEN 'empty_search_input' WHEN len(t) > 20 THEN 'too_many_search_terms' END AS error FROM f""",
)
def text_terms(spark, d):
    """TXT-02, 03."""
    rows = base.table(spark, d, "conversations").where("text is not null").withColumn("t", tx.search_terms(F.col("text")))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.size("t").cast("long").alias("terms"), F.sha2(F.array_join("t", " "), 256).alias("digest"), tx.terms_error(F.col("t")).alias("error"))


@query(
    "text_head_tail",
    """WITH g AS (SELECT substr(text, 1, 5) AS g, text FROM documents WHERE text IS NOT NULL), e AS (SELECT g, count(DISTINCT text) AS texts, min(text) AS a, max(text) AS z, min(reverse(text)) AS ra, max(reverse(text)) AS rz, min(length(text)) AS s FROM g GROUP BY g),
h AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(z)) + 1), lambda i: left(a, i) = left(z, i))) AS head, list_max(list_filter(range(0, least(length(ra), length(rz)) + 1), lambda i: left(ra, i) = left(rz, i))) AS tail FROM e WHERE texts > 1)
SELECT g AS "group", texts, CAST(head AS BIGINT) AS head, CAST(least(tail, s - head) AS BIGINT) AS tail FROM h""",
)
def text_head_tail(spark, d):
    """TXT-06."""
    rows = base.texts(spark, d).withColumn("group", F.left("text", F.lit(5)))
    return tx.shared_head_tail(rows, ["group"]).where("texts > 1").select("group", "texts", F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail"))


@query("text_differing", "SELECT doc_id, CASE WHEN length(text) - 5 > 160 THEN substr(text, 4, 100) || ' ... ' || right(left(text, length(text) - 2), 50) ELSE substr(text, 4, length(text) - 5) END AS part FROM documents WHERE length(text) > 5")
def text_differing(spark, d):
    """TXT-07: the first three and the last two characters count as shared."""
    return base.texts(spark, d).where(F.length("text") > 5).select("doc_id", tx.differing_part(F.col("text"), F.lit(3), F.lit(2)).alias("part"))


@query("text_same_modulo_breaks", "SELECT sha256(replace(text, chr(10), chr(13) || chr(10))) AS wanted, min(CAST(doc_id AS VARCHAR)) AS sql_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def text_same_modulo_breaks(spark, d):
    """TXT-17: every text with CR LF is looked up among the stored ones."""
    t = base.texts(spark, d).select(F.col("doc_id").cast("string").alias("sql_id"), "text")
    wanted = t.select(F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text")).distinct()
    return tx.same_text_modulo_breaks(t, wanted).select(F.sha2("wanted", 256).alias("wanted"), "sql_id")


@query("text_private_hash", "SELECT doc_id, sha256(source) AS source_hash, CASE WHEN n_chars <= 1 THEN '1' WHEN n_chars <= 10 THEN '2-10' WHEN n_chars <= 100 THEN '11-100' ELSE '>100' END AS size_class FROM documents")
def text_private_hash(spark, d):
    """TXT-11, 19."""
    return base.table(spark, d, "documents").select("doc_id", tx.private_hash(F.col("source")).alias("source_hash"), tx.in_list_bucket(F.col("n_chars")).alias("size_class"))
