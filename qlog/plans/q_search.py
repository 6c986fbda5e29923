"""Queries of the search and view layer, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.functions import exchange
from qlog.functions import text as tx
from qlog.operators import baseline, search
from qlog.plans import base
from qlog.plans.base import EXEC, KEYS, STATS
from qlog.plans.q_baseline import SUFFICIENT

Q, SQL = {}, {}
KEYS_SQL = ", ".join(KEYS)


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


IDENT = ["fingerprint", "scope_id", "database", "execution_user"]
IDENT_SQL = ", ".join(IDENT)


def _facts(spark, d):
    return base.executions(spark, d).where("fingerprint is not null")


def _marked(spark, d):
    return baseline.sufficiency(base.build(spark, d))


X = f"{EXEC}, q AS (SELECT * FROM x WHERE fingerprint IS NOT NULL)"


@query(
    "search_query_facts",
    f"WITH {X} SELECT occurrence_id, sql_id, timing_type, CASE WHEN timing_type IS NOT NULL THEN us END AS us, CASE WHEN timing_type IS NOT NULL THEN epoch_us(start_at) END AS start_us FROM q WHERE scope_id = 'C1' AND database = 'D2' AND end_at >= TIMESTAMP '2024-01-05' AND end_at < TIMESTAMP '2024-01-20'",
)
def search_query_facts(spark, d):
    """QRY-01..03, PRJ-13, 14."""
    t = lambda x: F.expr(f"TIMESTAMP_NTZ'{x}'")
    out = search.query_facts(_facts(spark, d), t("2024-01-05 00:00:00"), t("2024-01-20 00:00:00"), scope_id="C1", database="D2")
    return out.select("occurrence_id", "sql_id", "timing_type", "us", cal.micros(F.col("start_at")).alias("start_us"))


@query("search_exact_identity", f"WITH {X} SELECT occurrence_id FROM q WHERE database IS NULL AND execution_user = 'U5' AND timing_type IN ('request', 'parse')")
def search_exact_identity(spark, d):
    """PRJ-13 in exact mode: a null filter matches null."""
    return search.query_facts(_facts(spark, d), timings=["request", "parse"], exact=True, database=None, execution_user="U5").select("occurrence_id")


_HITS = f"""{STATS}, q AS (SELECT * FROM x WHERE fingerprint IS NOT NULL),
bs AS (SELECT DISTINCT 'F1' AS fingerprint, scope_id, database FROM st WHERE layer = 'overall' AND included_count > 0),
h AS (SELECT fingerprint, scope_id, database, execution_user, count(*) AS records, min(end_at) AS first_at, max(end_at) AS last_at, coalesce(array_to_string(list_sort(list(DISTINCT timing_type) FILTER (timing_type IS NOT NULL)), ','), '') AS timings,
  bool_or(timing_type IS NULL) AS has_unknown FROM q GROUP BY ALL)"""


def _hits(spark, d):
    """Baselines here are by cluster and database; those with samples count for fingerprint F1 and all users."""
    users = _facts(spark, d).select("execution_user").distinct()
    stats = base.build(spark, d).select("scope_id", "database", "layer", "included_count").withColumn("fingerprint", F.lit("F1")).crossJoin(F.broadcast(users))  # ten users
    return search.hits(_facts(spark, d), stats)


@query("search_hits", f"WITH {_HITS} SELECT h.*, EXISTS (SELECT 1 FROM bs WHERE bs.fingerprint = h.fingerprint AND bs.scope_id = h.scope_id AND bs.database = h.database) AS has_baseline FROM (SELECT * EXCLUDE (first_at, last_at), epoch_us(first_at) AS first_us, epoch_us(last_at) AS last_us FROM h) h")
def search_hits(spark, d):
    """QRY-05, 18, JOI-04, 05."""
    return _hits(spark, d).select(*IDENT, "records", F.array_join("timings", ",").alias("timings"), "has_unknown", "has_baseline", cal.micros(F.col("first_at")).alias("first_us"), cal.micros(F.col("last_at")).alias("last_us"))


@query(
    "search_exact",
    f"""WITH {_HITS}, w AS (SELECT 'F' || g AS fingerprint FROM range(0, 25) t(g)), sn AS (SELECT fingerprint, sum(records) AS records, bool_or(fingerprint = 'F1' AND database IS NOT NULL) AS b FROM h GROUP BY fingerprint)
SELECT fingerprint, CASE WHEN fingerprint = 'F13' THEN 'unreliable_fingerprint' WHEN records IS NULL THEN 'not_seen' WHEN b THEN 'has_baseline' ELSE 'records_without_baseline' END AS state, CAST(coalesce(records, 0) AS BIGINT) AS records FROM w LEFT JOIN sn USING (fingerprint)""",
)
def search_exact(spark, d):
    """QRY-13."""
    wanted = base.table(spark, d, "nation").select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("fingerprint"))
    fps = base.executions(spark, d).select("fingerprint").distinct().where("fingerprint = 'F13'").select(F.col("fingerprint").alias("value"), F.lit("normalization_failed").alias("state"))
    return search.exact_search(_hits(spark, d), fps, wanted)


#: Documents as texts: a text's structure is its first three characters, folded.
DOCS = """tt AS (SELECT CAST(doc_id AS VARCHAR) AS sql_id, text, translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11), '') AS search_text,
  lang AS scope_id, source AS database, n_chars, doc_id FROM documents WHERE text IS NOT NULL),
tx AS (SELECT *, substr(search_text, 1, 3) AS fingerprint FROM tt)"""


def _texts(spark, d):
    t = base.texts(spark, d).select(F.col("doc_id").cast("string").alias("sql_id"), "text", tx.search_fold(F.col("text")).alias("search_text"), F.col("lang").alias("scope_id"), F.col("source").alias("database"), "n_chars", "doc_id")
    return t.withColumn("fingerprint", F.left("search_text", F.lit(3)))


def index(spark, d):
    """The stored trigram index of the texts."""
    return base.text_index(spark, d, lambda: _texts(spark, d).select("sql_id", "fingerprint", "search_text"))


TERMS = ["the", "on"]
_MATCH = " AND ".join(f"contains(search_text, '{t}')" for t in TERMS)


@query(
    "search_text",
    f"""WITH {DOCS}, m AS (SELECT * FROM tx WHERE {_MATCH}),
p AS (SELECT fingerprint, scope_id, database, sum(n_chars) AS r, max(doc_id) AS l FROM m GROUP BY ALL),
g AS (SELECT fingerprint, sum(r) AS records, max(l) AS last_id, count(*) AS identities, array_to_string(list_sort(list(DISTINCT scope_id)), ',') AS scopes, min({{'a': -r, 's': scope_id, 'd': database}}) AS top FROM p GROUP BY fingerprint),
e AS (SELECT fingerprint, min(sql_id) AS example_sql_id, count(DISTINCT sql_id) AS matched_texts FROM m GROUP BY fingerprint),
k AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY records DESC, fingerprint) AS by_count, row_number() OVER (ORDER BY last_id DESC, fingerprint) AS by_recency FROM g JOIN e USING (fingerprint))
SELECT fingerprint, example_sql_id, matched_texts, CAST(records AS BIGINT) AS records, last_id, scopes, identities, top.s || '/' || top.d AS top_identity, total, by_count, by_recency FROM k WHERE by_count <= 20 OR by_recency <= 20""",
)
def search_text(spark, d):
    """QRY-06, 07, 29, TXT-02, 03, 05: characters stand for records, ids for times; texts are found by the stored index."""
    t = _texts(spark, d)
    cells = t.select("sql_id", "scope_id", "database", F.lit(None).cast("string").alias("execution_user"), F.col("n_chars").alias("records"), F.col("doc_id").alias("last_at"))
    out = search.text_search(index(spark, d), cells, TERMS, 20)
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("fingerprint", "example_sql_id", "matched_texts", "records", F.col("last_at").alias("last_id"), F.array_join("scopes", ",").alias("scopes"), "identities", F.concat_ws("/", "top.scope_id", "top.database").alias("top_identity"), long("total"), long("by_count"), long("by_recency"))


RARE = ["ing", "tion", "he"]


@query("search_text_hits", f"WITH {DOCS} SELECT sql_id, fingerprint FROM tx WHERE " + " AND ".join(f"contains(search_text, '{t}')" for t in RARE))
def search_text_hits(spark, d):
    """TXT-05 by the index alone: texts that hold two longer terms and one that is too short for a trigram."""
    return index(spark, d).search(RARE).select("sql_id", "fingerprint")


@query("search_catalog", f"WITH {DOCS} SELECT fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY sql_id) AS n, sql_id, {_MATCH} AS hit, substr(text, 1, 180) AS example, length(text) AS length FROM tx")
def search_catalog(spark, d):
    """QRY-41."""
    out = search.catalog(_texts(spark, d), TERMS)
    return out.withColumn("n", F.col("n").cast("long")).withColumn("length", F.col("length").cast("long"))


@query(
    "search_time_bounds",
    f"WITH {X} SELECT scope_id, epoch_us(max(end_at)) + 1 - 7 * 86400000000 AS start_us, epoch_us(max(end_at)) + 1 AS end_us FROM q GROUP BY scope_id",
)
def search_time_bounds(spark, d):
    """QRY-09."""
    out = search.time_bounds(_facts(spark, d), ["scope_id"])
    return out.select("scope_id", cal.micros(F.col("range_start")).alias("start_us"), cal.micros(F.col("range_end")).alias("end_us"))


@query(
    "search_timeline",
    f"""WITH {X} SELECT timing_type, epoch_us(date_trunc('hour', end_at + INTERVAL 8 HOURS)) AS bucket_us, count(*) AS records, count(us) AS known, round(quantile_cont(us / 1000.0, 0.5), 6) AS p50, round(quantile_cont(us / 1000.0, 0.95), 6) AS p95,
max(us) / 1000.0 AS longest, count(*) FILTER (outcome = 'success') AS success FROM q GROUP BY ALL""",
)
def search_timeline(spark, d):
    """QRY-10."""
    out = search.timeline(_facts(spark, d), "hour")
    return out.select("timing_type", cal.micros(F.col("bucket")).alias("bucket_us"), "records", "known", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "longest", F.coalesce(F.try_element_at("statuses", F.lit("success")), F.lit(0)).alias("success"))


@query(
    "search_history_page",
    f"""WITH {X}, p AS (SELECT * FROM q WHERE (end_at, analysis_id, occurrence_id) < (TIMESTAMP '2024-01-20 00:00:00', 'A1', 0) ORDER BY end_at DESC, analysis_id DESC, occurrence_id DESC LIMIT 200)
SELECT occurrence_id, row_number() OVER (ORDER BY end_at DESC, analysis_id DESC, occurrence_id DESC) AS n, true AS more FROM p""",
)
def search_history_page(spark, d):
    """QRY-11."""
    import datetime

    out = search.history(_facts(spark, d), (datetime.datetime(2024, 1, 20), "A1", 0), 200)
    return out.select("occurrence_id", F.col("n").cast("long").alias("n"), "more")


@query(
    "search_structure_page",
    f"""WITH {X}, p AS (SELECT * FROM q WHERE fingerprint = 'F7' AND database IS NOT NULL AND (end_at, analysis_id, occurrence_id) < (TIMESTAMP '2024-01-20 00:00:00', 'A1', 0)),
o AS (SELECT *, row_number() OVER (ORDER BY end_at DESC, analysis_id DESC, occurrence_id DESC) AS n FROM p)
SELECT occurrence_id, scope_id, sql_id, n, (SELECT count(*) FROM p) > 50 AS more FROM o WHERE n <= 50""",
)
def search_structure_page(spark, d):
    """QRY-11 of one structure: from the newest of its clustered files on, until the page is full."""
    import datetime

    out = base.clustered(spark, d).page({"fingerprint": "F7"}, (datetime.datetime(2024, 1, 20), "A1", 0), 50, F.col("database").isNotNull())
    return out.select("occurrence_id", "scope_id", "sql_id", F.col("n").cast("long").alias("n"), "more")


@query(
    "search_structure_facts",
    f"""WITH {X} SELECT occurrence_id, scope_id, sql_id, timing_type, CASE WHEN timing_type IS NOT NULL THEN us END AS us, outcome FROM q
WHERE fingerprint = 'F3' AND end_at >= TIMESTAMP '2024-01-05' AND end_at < TIMESTAMP '2024-01-20' AND (timing_type = 'request' OR (timing_type IS NULL AND outcome <> 'success'))""",
)
def search_structure_facts(spark, d):
    """QRY-01..03, 19 of one structure: its bucket of the clustered files, row groups by hash and time."""
    t = lambda x: F.expr(f"TIMESTAMP_NTZ'{x}'")
    own = base.clustered(spark, d).of_key({"fingerprint": "F3"}, t("2024-01-05 00:00:00"), t("2024-01-20 00:00:00"))
    return search.query_facts(search.record_facts(own, "request")).select("occurrence_id", "scope_id", "sql_id", "timing_type", "us", "outcome")


@query("search_record_facts", f"WITH {X} SELECT occurrence_id, outcome FROM q WHERE timing_type = 'parse' OR (timing_type IS NULL AND outcome <> 'success')")
def search_record_facts(spark, d):
    """QRY-19."""
    return search.record_facts(_facts(spark, d), "parse").select("occurrence_id", "outcome")


@query(
    "search_timings",
    f"""WITH {X}, o AS (SELECT {IDENT_SQL}, coalesce(timing_type, 'unknown') AS timing, count(*) AS records, count(*) FILTER (outcome = 'success') AS successes FROM q GROUP BY ALL),
w AS (SELECT *, count(*) FILTER (timing <> 'unknown') OVER (PARTITION BY {IDENT_SQL}) AS t FROM o)
SELECT {IDENT_SQL}, timing, records, successes, CAST(list_position(['request', 'parse', 'bind', 'execute_first', 'execute_fetch', 'unknown'], timing) AS BIGINT) AS place FROM w WHERE timing <> 'unknown' OR successes > 0 OR t = 0""",
)
def search_timings(spark, d):
    """QRY-20."""
    return search.timings_of(_facts(spark, d), IDENT).withColumn("place", F.col("place").cast("long"))


@query(
    "search_points",
    f"""WITH {X}, s AS (SELECT *, epoch_us(end_at) // 21600000000 AS slot FROM q WHERE us IS NOT NULL)
SELECT CAST(slot AS BIGINT) AS slot, count(*) AS records, max(us) AS slowest_us, min({{'a': -us, 'b': occurrence_id}}).b AS slowest_id, min(us) AS fastest_us, min({{'a': us, 'b': occurrence_id}}).b AS fastest_id FROM s GROUP BY slot""",
)
def search_points(spark, d):
    """QRY-23."""
    return search.points(_facts(spark, d), 21_600_000)


@query("search_slot_counts", f"WITH {X} SELECT CAST(epoch_us(end_at) // 3600000000 AS BIGINT) AS slot, outcome, count(*) AS records FROM q GROUP BY ALL")
def search_slot_counts(spark, d):
    """QRY-24."""
    return search.slot_counts(_facts(spark, d), 3_600_000)


_FLAGS = f"{SUFFICIENT}, fl AS (SELECT {KEYS_SQL}, p50_ms, p95_ms, p99_ms, included_count >= basic_count AND covered AS b, included_count >= p95_count AND covered AS m95, included_count >= p99_count AND covered AS m99 FROM sf WHERE layer = 'overall')"
_ON = "x.scope_id = fl.scope_id AND x.database IS NOT DISTINCT FROM fl.database AND x.timing_type IS NOT DISTINCT FROM fl.timing_type"


@query(
    "search_compare",
    f"""WITH {_FLAGS}, j AS (SELECT x.scope_id, x.database, x.timing_type, x.us / 1000.0 AS ms, unnest([{{'r': 'p50', 'v': CASE WHEN b THEN p50_ms END, 'e': 0.5}}, {{'r': 'p95', 'v': CASE WHEN m95 THEN p95_ms END, 'e': 0.05}}, {{'r': 'p99', 'v': CASE WHEN m99 THEN p99_ms END, 'e': 0.01}}]) AS s
 FROM x LEFT JOIN fl ON {_ON} WHERE x.us IS NOT NULL)
SELECT {KEYS_SQL}, s.r AS reference, count(*) AS records, round(any_value(s.v), 6) AS value, CASE WHEN any_value(s.v) IS NOT NULL THEN count(*) FILTER (ms > s.v) END AS above,
CASE WHEN any_value(s.v) IS NOT NULL THEN round(count(*) FILTER (ms > s.v) / count(*), 4) END AS share, CAST(s.e AS DOUBLE) AS expected, CASE WHEN any_value(s.v) IS NULL THEN 'insufficient_samples' END AS note FROM j GROUP BY {KEYS_SQL}, s.r, s.e""",
)
def search_compare(spark, d):
    """QRY-25."""
    return search.compare(base.executions(spark, d), _marked(spark, d), KEYS).withColumn("value", F.round("value", 6))


@query(
    "search_executions",
    f"""WITH {_FLAGS}, f AS (SELECT * FROM x WHERE outcome = 'success' AND us >= 1000), p AS (SELECT * FROM f ORDER BY us DESC NULLS LAST, occurrence_id LIMIT 300)
SELECT occurrence_id, x.us, (SELECT count(*) FROM f) AS matching, CASE WHEN x.us IS NULL THEN 'unknown' WHEN p50_ms IS NULL THEN 'no_baseline' WHEN NOT coalesce(b, false) THEN 'insufficient' WHEN m99 AND x.us / 1000.0 > p99_ms THEN 'above_p99'
 WHEN m95 AND x.us / 1000.0 > p95_ms THEN 'above_p95' WHEN x.us / 1000.0 > p50_ms THEN 'above_p50' ELSE 'not_above' END AS class FROM p x LEFT JOIN fl ON {_ON}""",
)
def search_executions(spark, d):
    """QRY-27, JOI-10."""
    return search.executions(base.executions(spark, d), _marked(spark, d), KEYS, ["success"], 1000, None, 300).select("occurrence_id", "us", "matching", "class")


@query(
    "search_texts_of_structure",
    f"""WITH {_FLAGS}, j AS (SELECT x.fingerprint, x.sql_id, x.us / 1000.0 AS ms, CASE WHEN m95 THEN p95_ms END AS ref FROM x LEFT JOIN fl ON {_ON} WHERE x.fingerprint IS NOT NULL),
o AS (SELECT fingerprint, sql_id, count(*) AS executions, quantile_cont(ms, 0.5) AS median_ms, max(ms) AS slowest_ms, count(*) FILTER (ms > ref) AS above, count(*) FILTER (ms IS NOT NULL AND ref IS NOT NULL) AS comparable, sql_id LIKE '%7' AS hit FROM j GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY fingerprint) AS total_texts, row_number() OVER (PARTITION BY fingerprint ORDER BY hit DESC, executions DESC, sql_id) AS place FROM o)
SELECT fingerprint, sql_id, executions, round(median_ms, 6) AS median_ms, slowest_ms, above, comparable, hit, round(CASE WHEN comparable > 0 THEN above / comparable END, 4) AS above_share, total_texts, place, 'text of ' || sql_id AS text FROM w WHERE place <= 3""",
)
def search_texts_of_structure(spark, d):
    """QRY-26, 28."""
    own = _facts(spark, d)
    ids = own.select("sql_id").distinct()
    texts = ids.withColumn("text", F.concat(F.lit("text of "), "sql_id"))
    out = search.texts_of_structure(own, texts, _marked(spark, d), ids.where("sql_id like '%7'"), KEYS, 3)
    return out.withColumn("median_ms", F.round("median_ms", 6)).withColumn("total_texts", F.col("total_texts").cast("long")).withColumn("place", F.col("place").cast("long"))


@query(
    "search_ranking",
    f"""WITH {X}, t AS (SELECT {IDENT_SQL}, timing_type, count(*) AS n, sum(us) AS total_us, max(us) AS slowest_us, count(*) FILTER (outcome <> 'success') AS bad FROM q WHERE timing_type IS NOT NULL GROUP BY ALL),
f AS (SELECT {IDENT_SQL}, count(*) AS untimed FROM q WHERE timing_type IS NULL AND outcome <> 'success' GROUP BY ALL),
r AS (SELECT t.*, coalesce(untimed, 0) AS untimed FROM t LEFT JOIN f ON t.fingerprint = f.fingerprint AND t.scope_id = f.scope_id AND t.database IS NOT DISTINCT FROM f.database AND t.execution_user = f.execution_user
  UNION ALL SELECT f.fingerprint, f.scope_id, f.database, f.execution_user, NULL, NULL, NULL, NULL, NULL, untimed FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.fingerprint = f.fingerprint AND t.scope_id = f.scope_id AND t.database IS NOT DISTINCT FROM f.database AND t.execution_user = f.execution_user))
SELECT {IDENT_SQL}, timing_type, coalesce(n, 0) + untimed AS records, CAST(total_us AS BIGINT) AS total_us, round(total_us / n, 6) AS mean_us, slowest_us, coalesce(bad, 0) + untimed AS not_success, count(*) OVER () AS total_rows
FROM r ORDER BY total_us DESC NULLS LAST, fingerprint, scope_id, database NULLS FIRST, execution_user, timing_type LIMIT 500""",
)
def search_ranking(spark, d):
    """QRY-31."""
    out = search.ranking(_facts(spark, d), "total_us", 500)
    return out.withColumn("mean_us", F.round("mean_us", 6)).withColumn("total_rows", F.col("total_rows").cast("long"))


@query(
    "search_baseline_ranking",
    f"""WITH {STATS}, l AS (SELECT {KEYS_SQL}, epoch_us(max(end_at)) AS last_us FROM x GROUP BY ALL)
SELECT st.scope_id, st.database, st.timing_type, round(p95_ms, 6) AS p95_ms, included_count, round(mean_ms, 6) AS mean_ms, last_us FROM st LEFT JOIN l ON st.scope_id = l.scope_id AND st.database IS NOT DISTINCT FROM l.database AND st.timing_type IS NOT DISTINCT FROM l.timing_type
WHERE layer = 'overall' AND included_count >= 10 ORDER BY st.p95_ms DESC NULLS LAST, st.scope_id, st.database, st.timing_type LIMIT 25""",
)
def search_baseline_ranking(spark, d):
    """QRY-32, 33."""
    last = base.executions(spark, d).groupBy(*KEYS).agg(cal.micros(F.max("end_at")).alias("last_us"))
    out = search.baseline_ranking(base.build(spark, d), "p95_ms", 10, 25, last)
    return out.select(*KEYS, F.round("p95_ms", 6).alias("p95_ms"), "included_count", F.round("mean_ms", 6).alias("mean_ms"), "last_us")


@query("search_pattern", f"WITH {STATS} SELECT {KEYS_SQL}, CAST(bucket_number AS BIGINT) AS hour, included_count, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms FROM st WHERE layer = 'hour' AND included_count > 0")
def search_pattern(spark, d):
    """QRY-35."""
    return search.pattern(base.build(spark, d), "hour").select(*KEYS, F.col("bucket_number").cast("long").alias("hour"), "included_count", F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@query(
    "search_exclusion_breakdown",
    f"""WITH {STATS}, c AS (SELECT {KEYS_SQL}, unnest(list_distinct(codes)) AS reason FROM s WHERE NOT included), n AS (SELECT {KEYS_SQL}, reason, count(*) AS count FROM c GROUP BY ALL)
SELECT o.scope_id, o.database, o.timing_type, coalesce(reason, '-') AS reason, coalesce(count, 0) AS count FROM (SELECT * FROM st WHERE layer = 'overall') o LEFT JOIN n USING ({KEYS_SQL})""",
)
def search_exclusion_breakdown(spark, d):
    """QRY-36."""
    return search.exclusion_breakdown(base.build(spark, d), KEYS)


@query(
    "search_metric_pivot",
    f"""WITH {STATS}, m AS (SELECT scope_id, database, timing_type, unnest([{", ".join(f"{{'m': '{m}', 'v': CAST({m} AS DOUBLE)}}" for m in baseline.METRICS)}]) AS p FROM st WHERE layer = 'overall')
SELECT scope_id, database, p.m AS metric, """
    + ", ".join(f"round(max(p.v) FILTER (timing_type = '{t}'), 6) AS {t}" for t in baseline.TIMINGS)
    + " FROM m GROUP BY scope_id, database, p.m",
)
def search_metric_pivot(spark, d):
    """QRY-37."""
    out = search.metric_pivot(base.build(spark, d), ["scope_id", "database"])
    return out.select("scope_id", "database", "metric", *[F.round(t, 6).alias(t) for t in baseline.TIMINGS])


@query(
    "search_missing_timings",
    f"""WITH {STATS}, h AS (SELECT scope_id, database, list(DISTINCT timing_type) AS t FROM st WHERE layer = 'overall' AND included_count > 0 GROUP BY ALL)
SELECT scope_id, database, array_to_string(list_sort(list_filter(['request', 'parse', 'bind', 'execute_first', 'execute_fetch'], lambda c: NOT list_contains(t, c))), ', ') AS missing FROM h""",
)
def search_missing_timings(spark, d):
    """QRY-38."""
    return search.missing_timings(base.build(spark, d), ["scope_id", "database"])


@query(
    "search_all_timings",
    f"""WITH {STATS}, g AS (SELECT DISTINCT scope_id, database FROM st)
SELECT g.scope_id, g.database, t.timing_type, coalesce(included_count, 0) AS included_count, CASE WHEN coalesce(included_count, 0) > 0 THEN 'has_samples' ELSE 'no_samples' END AS sample_state, round(p50_ms, 6) AS p50_ms
FROM g CROSS JOIN (VALUES ('request'), ('parse'), ('bind'), ('execute_first'), ('execute_fetch')) t(timing_type) LEFT JOIN (SELECT * FROM st WHERE layer = 'overall') s ON s.scope_id = g.scope_id AND s.database = g.database AND s.timing_type = t.timing_type""",
)
def search_all_timings(spark, d):
    """QRY-15, 16."""
    stats = base.build(spark, d)
    return search.all_timings(stats, stats, ["scope_id", "database"]).select("scope_id", "database", "timing_type", "included_count", "sample_state", F.round("p50_ms", 6).alias("p50_ms"))


@query("search_baseline_document")
def search_baseline_document(spark, d):
    """QRY-17: JSON documents; no SQL twin because writers of JSON differ in spelling numbers."""
    stats = base.build(spark, d)
    return search.baseline_document(search.all_timings(stats, stats, ["scope_id", "database"]), ["scope_id", "database"])


@query(
    "search_baseline_text",
    f"""WITH {STATS}, g AS (SELECT DISTINCT scope_id, database FROM st),
a AS (SELECT g.scope_id, g.database, t.timing_type, coalesce(included_count, 0) AS n, p50_ms, p95_ms FROM g CROSS JOIN (VALUES ('request'), ('parse'), ('bind'), ('execute_first'), ('execute_fetch')) t(timing_type)
  LEFT JOIN (SELECT * FROM st WHERE layer = 'overall') s ON s.scope_id = g.scope_id AND s.database = g.database AND s.timing_type = t.timing_type)
SELECT scope_id, database, string_agg(timing_type || ' ' || CASE WHEN n > 0 THEN 'has_samples ' ELSE 'no_samples ' END || n || ' ' || coalesce(CAST(CAST(round(p50_ms * 100000) AS BIGINT) AS VARCHAR), '-') || ' ' || coalesce(CAST(CAST(round(p95_ms * 100000) AS BIGINT) AS VARCHAR), '-'), ';' ORDER BY timing_type) AS document
FROM a GROUP BY scope_id, database""",
)
def search_baseline_text(spark, d):
    """QRY-17 as plain text: the five timings of a group, percentiles in hundredths of microseconds."""
    stats = base.build(spark, d)
    rows = search.all_timings(stats, stats, ["scope_id", "database"])
    whole = lambda c: F.coalesce(F.round(F.col(c) * 100_000).cast("long").cast("string"), F.lit("-"))
    one = F.concat_ws(" ", "timing_type", "sample_state", F.col("included_count").cast("string"), whole("p50_ms"), whole("p95_ms"))
    return rows.groupBy("scope_id", "database").agg(F.array_join(F.array_sort(F.collect_list(one)), ";").alias("document"))


@query(
    "search_filter_options",
    f"""WITH {EXEC}, o AS (SELECT DISTINCT 'cluster' AS kind, scope_id AS name FROM x UNION SELECT 'database', database FROM x UNION SELECT 'user', execution_user FROM x)
SELECT * FROM o WHERE name IS NOT NULL UNION ALL SELECT DISTINCT kind, '*' FROM o""",
)
def search_filter_options(spark, d):
    """QRY-39."""
    return search.filter_options(base.executions(spark, d))


@query(
    "search_facts_by_text",
    f"""WITH {EXEC}, t AS (SELECT DISTINCT sql_id FROM x), o AS (SELECT sql_id, outcome, count(*) AS records, max(end_at) AS l FROM x WHERE database = 'D1' GROUP BY ALL)
SELECT sql_id, outcome, coalesce(records, 0) AS records, epoch_us(l) AS last_us FROM t LEFT JOIN o USING (sql_id)""",
)
def search_facts_by_text(spark, d):
    """QRY-42."""
    occ = base.executions(spark, d)
    return search.facts_by_text(occ.select("sql_id"), occ.where("database = 'D1'")).select("sql_id", "outcome", "records", cal.micros(F.col("last_at")).alias("last_us"))


@query(
    "search_observations",
    f"""WITH {EXEC}, s AS (SELECT scope_id, 'approx:' || sql_id AS approx_value, us FROM x WHERE fingerprint IS NULL AND us IS NOT NULL) SELECT scope_id, approx_value, count(*) AS included_count, round(quantile_cont(us, 0.5) / 1000.0, 6) AS p50_ms FROM s WHERE approx_value = 'approx:S11' GROUP BY ALL""",
)
def search_observations(spark, d):
    """QRY-12: overall observation rows of one approximate value."""
    rows = base.executions(spark, d).where("fingerprint is null and us is not null").select("scope_id", F.concat(F.lit("approx:"), "sql_id").alias("approx_value"), "start_at", "us", F.lit(True).alias("included"), F.array().cast("array<string>").alias("codes"))
    stats = baseline.statistics(rows, ["scope_id", "approx_value"], *base.window_dates())
    return search.identity_filter(stats.where("layer = 'overall'"), approx_value="approx:S11").select("scope_id", "approx_value", "included_count", F.round("p50_ms", 6).alias("p50_ms"))


#: A token of an identity in DuckDB: base64url of its JSON array, without padding.
TOKEN = """rtrim(translate(to_base64(encode('[' || concat_ws(', ', coalesce(CAST(to_json(scope_id) AS VARCHAR), 'null'), coalesce(CAST(to_json(database) AS VARCHAR), 'null'), coalesce(CAST(to_json(execution_user) AS VARCHAR), 'null')) || ']')), '+/', '-_'), '=')"""


@query(
    "search_identity_tokens",
    f"""WITH {X}, i AS (SELECT scope_id, database, execution_user, count(*) AS records FROM q GROUP BY ALL)
SELECT {TOKEN} AS token, scope_id, database, execution_user, records FROM i""",
)
def search_identity_tokens(spark, d):
    """QRY-18, 19: every identity's token, and the records that the token alone finds again."""
    facts, names = _facts(spark, d), ["scope_id", "database", "execution_user"]
    tokens = facts.select(*names).distinct().select(exchange.identity_token(*[F.col(n) for n in names]).alias("token"))
    return search.token_records(facts, tokens, names).groupBy("token", *names).agg(F.count("*").alias("records"))


@query(
    "search_text_tokens",
    """SELECT doc_id, md5(rtrim(translate(replace(to_base64(encode(text)), chr(10), ''), '+/', '-_'), '=')) AS token_md5, CAST(length(text) AS BIGINT) AS n_chars, true AS same
FROM documents WHERE text IS NOT NULL""",
)
def search_text_tokens(spark, d):
    """QRY-28: whole texts as tokens and back."""
    docs = base.table(spark, d, "documents").where("text is not null").withColumn("token", exchange.encode_token(F.col("text")))
    back = exchange.decode_token(F.col("token"))
    return docs.select("doc_id", F.md5("token").alias("token_md5"), F.length(back).cast("long").alias("n_chars"), F.coalesce(back == F.col("text"), F.lit(False)).alias("same"))
