"""Queries of diagnostics, run monitoring, batch selection and incremental upkeep, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.functions import exchange, lexical, records
from qlog.operators import baseline, diagnostics, eligibility, tables
from qlog.plans import base
from qlog.plans.base import EXEC, KEYS, STATS
from qlog.plans.q_records import LG, interpreted, log_records, shared, sql_texts
from qlog.streaming import incremental, totals

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: Two fingerprints of a document: folded first 4 and first 2 characters; the latter merges. Every 9th old and 11th new one is refused.
BOTH = """bo AS (SELECT doc_id AS input_id, CASE WHEN doc_id % 9 <> 0 THEN lower(substr(text, 1, 4)) END AS old_fp, CASE WHEN doc_id % 11 <> 0 THEN lower(substr(text, 1, 2)) END AS new_fp, n_chars AS n, lang, substr(text, 1, 1) AS s1 FROM documents WHERE text IS NOT NULL)"""


def _both(spark, d):
    t, i = base.texts(spark, d), F.col("doc_id")
    return t.select(i.alias("input_id"), F.when(i % 9 != 0, F.lower(F.left("text", F.lit(4)))).alias("old_fp"), F.when(i % 11 != 0, F.lower(F.left("text", F.lit(2)))).alias("new_fp"), F.col("n_chars").alias("n"), "lang", F.left("text", F.lit(1)).alias("s1"))


@query(
    "diagnostics_input_census",
    """WITH p AS (SELECT lang AS scope_id, source AS field, sha256(text) AS input_id, CASE WHEN doc_id % 9 = 0 THEN 'refused' ELSE 'reliable' END AS state, count(*) AS n, max(length(text)) AS l FROM documents WHERE text IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id, field, state ORDER BY input_id) AS k FROM p)
SELECT scope_id, field, state, count(*) AS inputs, CAST(sum(n) AS BIGINT) AS occurrences, CAST(max(l) AS BIGINT) AS longest, array_to_string(list_sort(list(input_id) FILTER (k <= 5)), ',') AS examples FROM r GROUP BY ALL""",
)
def diagnostics_input_census(spark, d):
    """DIA-01."""
    rows = base.texts(spark, d).select(F.col("lang").alias("scope_id"), F.col("source").alias("field"), F.sha2("text", 256).alias("input_id"), F.lit(1).alias("n"), F.when(F.col("doc_id") % 9 == 0, "refused").otherwise("reliable").alias("state"), "text")
    return diagnostics.input_census(rows).withColumn("longest", F.col("longest").cast("long"))


@query(
    "diagnostics_daily_census",
    """WITH r AS (SELECT lang AS scope_id, source AS day, sha256(text) AS input_id, octet_length(encode(text)) AS b FROM documents WHERE text IS NOT NULL)
SELECT scope_id, day, count(*) AS occurrences, count(DISTINCT input_id) AS inputs, count(DISTINCT CASE WHEN b = 1023 THEN input_id END) AS cut_inputs FROM r GROUP BY GROUPING SETS ((scope_id), (scope_id, day))""",
)
def diagnostics_daily_census(spark, d):
    """DIA-02: sources stand for days."""
    return diagnostics.daily_census(base.texts(spark, d).select(F.col("lang").alias("scope_id"), F.col("source").alias("day"), F.sha2("text", 256).alias("input_id"), F.lit(1).cast("long").alias("n"), F.octet_length("text").alias("bytes")))


@query(
    "diagnostics_failure_groups",
    f"""WITH {BOTH}, f AS (SELECT b.*, CASE WHEN lang = 'en' THEN 'partition_ddl' ELSE 'copy' END AS features, s1 AS reason FROM bo b WHERE new_fp IS NULL)
SELECT reason, features, CAST(floor(log2(greatest(n, 1))) AS BIGINT) AS log2_bytes, count(DISTINCT input_id) AS inputs, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (old_fp IS NOT NULL) AS regressed FROM f GROUP BY ALL""",
)
def diagnostics_failure_groups(spark, d):
    """DIA-03."""
    b = _both(spark, d)
    results = b.select("input_id", "n", F.col("n").alias("bytes"), F.when(F.col("new_fp").isNull(), "refused").otherwise("reliable").alias("state"), F.col("s1").alias("reason"), F.when(F.col("lang") == "en", "partition_ddl").otherwise("copy").alias("features"))
    return diagnostics.failure_groups(results, b.select("input_id", F.when(F.col("old_fp").isNull(), "refused").otherwise("reliable").alias("state")))


@query(
    "diagnostics_partitions",
    f"""WITH {BOTH}, ok AS (SELECT * FROM bo WHERE old_fp IS NOT NULL AND new_fp IS NOT NULL), m AS (SELECT new_fp, count(DISTINCT input_id) AS i, sum(n) AS o FROM ok GROUP BY new_fp HAVING count(DISTINCT old_fp) > 1), s AS (SELECT old_fp FROM ok GROUP BY old_fp HAVING count(DISTINCT new_fp) > 1)
SELECT 'merged_groups' AS measure, count(*) AS n FROM m UNION ALL SELECT 'merged_inputs', CAST(coalesce(sum(i), 0) AS BIGINT) FROM m UNION ALL SELECT 'merged_occurrences', CAST(coalesce(sum(o), 0) AS BIGINT) FROM m UNION ALL SELECT 'split_groups', count(*) FROM s
UNION ALL SELECT 'reliable_old', count(old_fp) FROM bo UNION ALL SELECT 'reliable_new', count(new_fp) FROM bo
UNION ALL SELECT 'transition:' || CASE WHEN old_fp IS NULL THEN 'refused' ELSE 'reliable' END || '>' || CASE WHEN new_fp IS NULL THEN 'refused' ELSE 'reliable' END, count(*) FROM bo GROUP BY 1""",
)
def diagnostics_partitions(spark, d):
    """DIA-04."""
    return diagnostics.compare_partitions(_both(spark, d))


@query(
    "diagnostics_merge_categories",
    f"""WITH {BOTH}, m AS (SELECT new_fp, count(DISTINCT lang) AS a, count(DISTINCT s1) AS b FROM bo WHERE old_fp IS NOT NULL AND new_fp IS NOT NULL GROUP BY new_fp HAVING count(DISTINCT old_fp) > 1)
SELECT CASE WHEN a = 1 THEN 'lang' WHEN b = 1 THEN 's1' ELSE 'other' END AS category, count(*) AS groups FROM m GROUP BY 1""",
)
def diagnostics_merge_categories(spark, d):
    """DIA-05: language and first character stand for the stages."""
    return diagnostics.merge_categories(_both(spark, d), ["lang", "s1"])


@query(
    "diagnostics_replay",
    f"""WITH {BOTH} SELECT CASE WHEN old_fp IS NOT NULL AND new_fp IS NOT NULL THEN CASE WHEN old_fp = new_fp THEN 'same_structure' ELSE 'changed_structure' END WHEN old_fp IS NOT NULL THEN 'regressed_state' WHEN new_fp IS NOT NULL THEN 'repaired' WHEN lang = 'en' THEN 'same_failure' ELSE 'changed_failure_reason' END AS outcome, count(*) AS inputs FROM bo GROUP BY 1""",
)
def diagnostics_replay(spark, d):
    """DIA-12."""
    state = lambda c: F.when(F.col(c).isNull(), "refused").otherwise("reliable")
    return diagnostics.replay_outcome(_both(spark, d).select("old_fp", "new_fp", state("old_fp").alias("old_state"), state("new_fp").alias("new_state"), F.lit("r").alias("old_reason"), F.when(F.col("lang") == "en", "r").otherwise("s").alias("new_reason")))


def _samples(spark, d):
    rows = base.executions(spark, d).withColumn("day", cal.day(F.col("end_at"))).withColumn("site", F.lit("postgres.c:1946"))
    rows = rows.withColumn("sql", F.col("sql_id")).withColumn("inline_sql", F.lit(None).cast("string")).withColumn("internal_sql", F.lit(None).cast("string"))
    return rows


SM = f"{EXEC}, sm AS (SELECT sql_id AS text, scope_id, sha256(database) AS database_hash, sha256(execution_user) AS user_hash, 'postgres.c:1946' AS site, CAST(end_at + INTERVAL 8 HOURS AS DATE) AS day, us / 1000.0 AS ms, fingerprint FROM x WHERE us IS NOT NULL)"


@query("diagnostics_duration_samples", f"WITH {SM} SELECT text, scope_id, database_hash, user_hash, site, CAST(day AS VARCHAR) AS day, count(*) AS n, round(sum(ms), 3) AS ms FROM sm GROUP BY ALL")
def diagnostics_duration_samples(spark, d):
    """DIA-06, TXT-19."""
    return diagnostics.duration_samples(_samples(spark, d)).groupBy("text", "scope_id", "database_hash", "user_hash", "site", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("ms"), 3).alias("ms"))


def _schemes(spark, d):
    rows = _samples(spark, d).where("us is not null").withColumn("ms", F.col("us") / 1000.0)
    both = F.array(F.struct(F.lit("fingerprint").alias("scheme"), F.col("fingerprint").alias("fp")), F.struct(F.lit("text").alias("scheme"), F.col("sql_id").alias("fp")))
    return rows.select("scope_id", "database", "sql_id", "day", "ms", F.explode(both).alias("s")).select("scope_id", "database", "sql_id", "day", "ms", "s.*")


SC = f"{SM}, sc AS (SELECT 'fingerprint' AS scheme, fingerprint AS fp, text AS sql_id, scope_id, database_hash, day, ms FROM sm UNION ALL SELECT 'text', text, text, scope_id, database_hash, day, ms FROM sm)"


@query(
    "diagnostics_threshold_coverage",
    f"""WITH {SC}, t AS (SELECT scheme, count(*) AS all_samples, count(fp) AS with_fp FROM sc GROUP BY scheme), g AS (SELECT scheme, scope_id, database_hash, fp, count(*) AS n, count(DISTINCT day) AS days FROM sc WHERE fp IS NOT NULL GROUP BY ALL),
e AS (SELECT scheme, least, count(*) FILTER (n >= least AND days >= 7) AS groups, coalesce(sum(n) FILTER (n >= least AND days >= 7), 0) AS samples FROM g, (VALUES (10), (30), (200)) l(least) GROUP BY ALL)
SELECT scheme, CAST(least AS BIGINT) AS least, groups, CAST(samples AS BIGINT) AS samples, all_samples, with_fp, round(samples / all_samples, 6) AS share_all, round(samples / with_fp, 6) AS share_fp FROM e JOIN t USING (scheme)""",
)
def diagnostics_threshold_coverage(spark, d):
    """DIA-07, 10."""
    return diagnostics.threshold_groups(_schemes(spark, d), ["scope_id", "database"], [10, 30, 200]).withColumn("least", F.col("least").cast("long"))


@query(
    "diagnostics_median_ratios",
    f"""WITH {SC}, m AS (SELECT fp, sql_id, count(*) AS n, quantile_cont(ms, 0.5) AS m FROM sc WHERE scheme = 'fingerprint' AND fp IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), g AS (SELECT fp, sum(n) AS n, max(m) AS hi, min(m) AS lo FROM m GROUP BY fp HAVING count(*) >= 2),
r AS (SELECT *, CASE WHEN hi = 0 AND lo = 0 THEN 1.0 WHEN lo <> 0 THEN hi / lo END AS q FROM g)
SELECT CASE WHEN q <= 2 THEN '<=2' WHEN q <= 5 THEN '2-5' WHEN q <= 10 THEN '5-10' ELSE '>10' END AS ratio, count(*) AS groups, CAST(sum(n) AS BIGINT) AS samples FROM r GROUP BY 1""",
)
def diagnostics_median_ratios(spark, d):
    """DIA-08, 09: raw texts are the subgroups."""
    return diagnostics.median_ratios(_schemes(spark, d).where("scheme = 'fingerprint'"), "sql_id")


@query(
    "diagnostics_encoding",
    "SELECT lang AS scope_id, count(*) AS inputs, count(*) AS occurrences, least(count(*), 128) AS sampled FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL GROUP BY lang",
)
def diagnostics_encoding(spark, d):
    """DIA-11: a byte that UTF-8 does not know follows every tenth text."""
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    return diagnostics.encoding_audit(base.texts(spark, d).select(F.col("lang").alias("scope_id"), F.col("doc_id").alias("input_id"), broken.alias("content"), F.lit(1).alias("n")))


@query("diagnostics_shapes", "SELECT min(CAST(event_id AS VARCHAR)) AS sql_id, count(*) AS texts FROM events WHERE event_type IN ('view', 'purchase', 'signup') GROUP BY event_type")
def diagnostics_shapes(spark, d):
    """DIA-13: shapes of clicks are known, those of open strings are not looked at."""
    texts = sql_texts(spark, d).where("event_type <> 'error'")
    shapes = lexical.token_shapes(texts)
    known = lexical.token_shapes(texts.where("event_type = 'click'")).select("shape").distinct()
    return diagnostics.new_shapes(shapes, known).select("sql_id", "texts")


@query("diagnostics_stable_ids", "SELECT o_orderkey AS id, o_custkey || ':' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS stable_id FROM orders")
def diagnostics_stable_ids(spark, d):
    """DIA-14."""
    return diagnostics.stable_ids(base.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select(F.col("o_orderkey").alias("id"), "stable_id")


@query(
    "diagnostics_sample_groups",
    f"""WITH {STATS}, o AS (SELECT scope_id || '/' || database || '/' || timing_type AS group_id, included_count, excluded_count FROM st WHERE layer = 'overall')
SELECT group_id FROM (SELECT group_id FROM o ORDER BY md5('seed-47' || group_id), group_id LIMIT 10) UNION SELECT group_id FROM (SELECT group_id FROM o ORDER BY included_count DESC, group_id LIMIT 1)
UNION SELECT group_id FROM (SELECT group_id FROM o WHERE included_count = 1 ORDER BY group_id LIMIT 1) UNION SELECT group_id FROM (SELECT group_id FROM o WHERE excluded_count > 0 ORDER BY group_id LIMIT 1)""",
)
def diagnostics_sample_groups(spark, d):
    """DIA-15: the sample is the feature."""
    stats = base.statistics(spark, d).withColumn("group_id", F.concat_ws("/", "scope_id", "database", "timing_type"))
    return diagnostics.sample_groups(stats, "seed-47", 10)


@query(
    "diagnostics_representatives",
    f"""WITH {EXEC}, o AS (SELECT scope_id, database, execution_user, count(*) AS events, count(DISTINCT sql_id) AS texts, max(us) AS slowest, max(end_at) AS l FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY events DESC, database NULLS FIRST, execution_user) AS a, row_number() OVER (PARTITION BY scope_id ORDER BY texts DESC, database NULLS FIRST, execution_user) AS b,
 row_number() OVER (PARTITION BY scope_id ORDER BY slowest DESC NULLS LAST, database NULLS FIRST, execution_user) AS c, row_number() OVER (PARTITION BY scope_id ORDER BY l DESC, database NULLS FIRST, execution_user) AS e FROM o)
SELECT scope_id, database, execution_user, events, texts, slowest, array_to_string(list_filter([CASE WHEN a = 1 THEN 'events' END, CASE WHEN b = 1 THEN 'texts' END, CASE WHEN c = 1 THEN 'slowest' END, CASE WHEN e = 1 THEN 'last_at' END], lambda x: x IS NOT NULL), ',') AS first_by FROM r WHERE least(a, b, c, e) = 1""",
)
def diagnostics_representatives(spark, d):
    """DIA-16."""
    return diagnostics.representative_identities(base.executions(spark, d), ["scope_id", "database", "execution_user"])


# --- runs ------------------------------------------------------------------------------------------

#: Line items that one task joins and adds up.
ROWS = 500_000

#: Orders as runs of clusters: customers modulo 20 are clusters, ship dates of their items the days.
RUNS = """ru AS (SELECT 'C' || (o_custkey % 20) AS scope_id, o_orderkey AS run_id, o_orderdate AS t, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'P' THEN 'skipped' ELSE 'succeeded' END AS state FROM orders),
dx AS (SELECT scope_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, run_id, max(t) AS t, CASE WHEN max(l_tax) > 0.06 THEN 'failed' ELSE 'imported' END AS day_state, CAST(sum(l_quantity) AS BIGINT) AS records, max(l_discount) AS disc FROM ru JOIN lineitem ON l_orderkey = run_id GROUP BY scope_id, day, run_id),
pb AS (SELECT run_id, scope_id, day, 'import_failed' AS code FROM dx WHERE day_state = 'failed' UNION ALL SELECT run_id, scope_id, day, 'file_nonconforming' FROM dx WHERE disc >= 0.1),
nw AS (SELECT scope_id, day, max({'a': t, 'b': run_id}).b AS run_id FROM dx GROUP BY scope_id, day),
la AS (SELECT scope_id, max({'a': t, 'b': run_id, 's': state}).s AS state, max({'a': t, 'b': run_id}).b AS run_id, max(t) FILTER (state = 'succeeded') AS ok FROM ru GROUP BY scope_id),
op AS (SELECT pb.scope_id, pb.day, pb.code FROM pb JOIN nw USING (scope_id, day, run_id) UNION ALL SELECT scope_id, NULL, 'cluster_skipped' FROM la WHERE state = 'skipped' UNION ALL SELECT scope_id, NULL, 'run_not_finished' FROM la WHERE state = 'running'
  UNION ALL SELECT scope_id, NULL, 'no_recent_success' FROM la WHERE ok IS NULL OR ok < TIMESTAMP '1998-08-01 00:00:00' - INTERVAL 7 DAY)"""


def _runs(spark, d):
    o = base.table(spark, d, "orders")
    st = F.col("o_orderstatus")
    return o.select(F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("scope_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.when(st == "F", "running").when(st == "P", "skipped").otherwise("succeeded").alias("state"))


def _days(spark, d):
    """Days of runs, written once: a query reads them several times. Line items and runs meet in partitions of as many rows at every size."""
    li = base.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").cast("date").alias("day"), "l_tax", "l_quantity", "l_discount")
    n = tables.parts(li, ROWS)
    met = li.repartition(n, "run_id").join(_runs(spark, d).select("run_id", "scope_id", "at").repartition(n, "run_id"), "run_id")
    out = met.groupBy("run_id", "scope_id", "day").agg(F.max("at").alias("at"), F.max("l_tax").alias("tax"), F.sum("l_quantity").cast("long").alias("records"), F.max("l_discount").alias("disc"))
    out = out.select("scope_id", F.col("day").cast("string").alias("day"), "run_id", "at", "tax", "records", "disc")
    return tables.written(out.withColumn("day_state", F.when(F.col("tax") > 0.06, "failed").otherwise("imported")), "days")


def _problems(days):
    one = lambda when, code: days.where(when).select("run_id", "scope_id", "day", F.lit(code).alias("code"))
    return one("day_state = 'failed'", "import_failed").unionByName(one("disc >= 0.1", "file_nonconforming"))


def _open(spark, d, days):
    return diagnostics.open_problems(days, _problems(days), _runs(spark, d), F.expr("TIMESTAMP_NTZ'1998-08-01 00:00:00'"), 7)


@query("operations_runs", f"WITH {RUNS} SELECT run_id, CASE WHEN state = 'running' AND run_id % 3 <> 0 THEN 'unfinished' ELSE state END AS shown_state FROM ru")
def operations_runs(spark, d):
    """OPS-01: every third run has a heartbeat."""
    r = _runs(spark, d)
    return diagnostics.runs(r, r.where("run_id % 3 = 0").select("run_id")).select("run_id", "shown_state")


@query("operations_open_problems", f"WITH {RUNS} SELECT scope_id, day, code, count(*) AS n FROM op GROUP BY ALL")
def operations_open_problems(spark, d):
    """OPS-02."""
    return _open(spark, d, _days(spark, d)).groupBy("scope_id", "day", "code").agg(F.count("*").alias("n"))


@query("operations_cluster_status", f"WITH {RUNS} SELECT scope_id, n.newest_day, 'B' || la.run_id AS build_id, coalesce(p.n, 0) AS problems FROM (SELECT scope_id, max(day) AS newest_day FROM dx GROUP BY scope_id) n LEFT JOIN la USING (scope_id) LEFT JOIN (SELECT scope_id, count(*) AS n FROM op GROUP BY scope_id) p USING (scope_id)")
def operations_cluster_status(spark, d):
    """OPS-03: the newest run stands for the current build."""
    current = _runs(spark, d).groupBy("scope_id").agg(F.concat(F.lit("B"), F.max_by("run_id", F.struct("at", "run_id")).cast("string")).alias("build_id"))
    days = _days(spark, d)
    return diagnostics.cluster_status(days, current, _open(spark, d, days))


@query(
    "operations_recent_runs",
    f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY t DESC, run_id DESC) AS n FROM ru), g AS (SELECT run_id, scope_id, list_sort(list(day) FILTER (day_state = 'imported')) AS a, list_sort(list(day) FILTER (day_state = 'failed')) AS f, CAST(sum(records) AS BIGINT) AS records FROM dx GROUP BY ALL)
SELECT r.scope_id, r.run_id, n, CASE WHEN records IS NOT NULL THEN coalesce(array_to_string(a, ','), '') END AS imported_days, CASE WHEN records IS NOT NULL THEN coalesce(array_to_string(f, ','), '') END AS failed_days, records FROM r LEFT JOIN g USING (run_id, scope_id) WHERE n <= 5""",
)
def operations_recent_runs(spark, d):
    """OPS-04."""
    out = diagnostics.recent_runs(_runs(spark, d), _days(spark, d), 5)
    return out.select("scope_id", "run_id", F.col("n").cast("long").alias("n"), F.array_join("imported_days", ",").alias("imported_days"), F.array_join("failed_days", ",").alias("failed_days"), "records")


@query("operations_last_run", f"WITH {RUNS} SELECT max({{'a': t, 'b': run_id}}).b AS run_id, max({{'a': t, 'b': run_id, 's': state}}).s AS state, epoch_us(max(t) FILTER (state = 'succeeded')) AS success_us FROM ru")
def operations_last_run(spark, d):
    """OPS-05."""
    return diagnostics.last_run(_runs(spark, d)).select("run_id", "state", cal.micros(F.col("last_success")).alias("success_us"))


@query("operations_status")
def operations_status(spark, d):
    """OPS-08: JSON documents; no SQL twin because writers of JSON differ."""
    current = _runs(spark, d).groupBy("scope_id").agg(F.max("run_id").alias("build_id"))
    days = _days(spark, d)
    problems = _open(spark, d, days)
    return diagnostics.status_document(diagnostics.cluster_status(days, current, problems), problems)


@query("operations_isolation", f"WITH {RUNS} SELECT code, count(*) AS records FROM pb WHERE run_id % 2 = 0 GROUP BY code")
def operations_isolation(spark, d):
    """STF-07: runs with even numbers are the version's files."""
    p = _problems(_days(spark, d)).withColumn("file_id", F.col("run_id")).withColumn("records", F.lit(1))
    return diagnostics.isolation_counts(p, _runs(spark, d).where("run_id % 2 = 0").select(F.col("run_id").alias("file_id")))


# --- batches and rules -----------------------------------------------------------------------------


@query(
    "eligibility_batches",
    """WITH f AS (SELECT o_custkey AS batch_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS l FROM orders)
SELECT c_custkey AS batch_id, false AS fallback FROM customer WHERE c_custkey % 4 <> 0 AND EXISTS (SELECT 1 FROM f WHERE f.batch_id = c_custkey AND state = 'succeeded' AND (l IS NULL OR l >= TIMESTAMP '1997-06-01'))""",
)
def eligibility_batches(spark, d):
    """ELI-01: customers are batches, their orders files."""
    batches = base.table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), F.when(F.col("c_custkey") % 4 == 0, "failed").otherwise("complete").alias("state"))
    files = base.table(spark, d, "orders").select(F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("state"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("last_log_at"))
    return eligibility.select_batches(batches, files, F.expr("TIMESTAMP_NTZ'1997-06-01 00:00:00'")).select("batch_id", "fallback")


@query(
    "eligibility_frozen_input",
    """WITH f AS (SELECT 'f' || (event_id % 500) AS file_id, 'A' || CASE WHEN event_id % 500 = 7 THEN event_id % 2000 ELSE event_id % 500 END AS analysis_id FROM events), o AS (SELECT file_id, count(DISTINCT analysis_id) AS interpretations, min(analysis_id) AS analysis_id FROM f GROUP BY file_id),
b AS (SELECT substr(sha256(file_id), 1, 3) AS bucket, sha256(array_to_string(list_sort(list(file_id || ':' || analysis_id)), ',')) AS bucket_digest FROM o GROUP BY 1)
SELECT file_id, interpretations, analysis_id, interpretations = 1 AS valid, bucket, bucket_digest, (SELECT sha256(array_to_string(list_sort(list(bucket || ':' || bucket_digest)), ',')) FROM b) AS digest FROM o JOIN b ON bucket = substr(sha256(file_id), 1, 3)""",
)
def eligibility_frozen_input(spark, d):
    """ELI-02."""
    return eligibility.freeze_input(_input_files(spark, d))


def _input_files(spark, d):
    i = F.col("event_id")
    return base.table(spark, d, "events").select(F.concat(F.lit("f"), (i % 500).cast("string")).alias("file_id"), F.concat(F.lit("A"), F.when(i % 500 == 7, i % 2000).otherwise(i % 500).cast("string")).alias("analysis_id"), F.lit("succeeded").alias("state"))


@query("eligibility_changed_input", "SELECT DISTINCT substr(sha256('f' || (event_id % 500)), 1, 3) AS bucket FROM events WHERE event_id % 500 IN (3, 44, 123)")
def eligibility_changed_input(spark, d):
    """ELI-02: where two manifests differ: one file is gone, two have another interpretation."""
    old = _input_files(spark, d)
    new = old.where("file_id <> 'f3'").withColumn("analysis_id", F.when(F.col("file_id").isin("f44", "f123"), "B").otherwise(F.col("analysis_id")))
    return eligibility.changed_buckets(eligibility.freeze_input(old), eligibility.freeze_input(new))


@query(
    "eligibility_text_rules",
    """SELECT CAST(event_id AS VARCHAR) AS sql_id, CASE event_type WHEN 'purchase' THEN 'mixed' WHEN 'error' THEN 'unknown' ELSE 'none' END AS category_kind, CASE WHEN event_type = 'signup' THEN 'T1,T2' ELSE '' END AS template_ids FROM events WHERE event_id % 5 <> 0""",
)
def eligibility_text_rules(spark, d):
    """ELI-04: every fifth text is known; the event type stands for the fingerprint."""
    texts = sql_texts(spark, d)
    cut = lexical.lexical_statements(texts).join(texts.select("sql_id", F.col("event_type").alias("fingerprint")), "sql_id")
    cached = texts.where(F.col("sql_id").cast("long") % 5 == 0)
    templates = spark.createDataFrame([("signup", "T2"), ("signup", "T1")], "fingerprint string, template_id string")
    return eligibility.text_rules(cut, cached, templates).select("sql_id", "category_kind", F.array_join("template_ids", ",").alias("template_ids"))


# --- incremental -----------------------------------------------------------------------------------

TOTAL_KEYS = ["scope_id", "database", "timing_type"]
TOTALS_SQL = f"WITH {EXEC} SELECT scope_id, database, timing_type, count(*) AS record_count, epoch_us(min(end_at)) AS first_us, epoch_us(max(end_at)) AS last_us FROM x WHERE occurrence_id % 10 <> 3 GROUP BY ALL"


def _totals(df):
    return df.select(*TOTAL_KEYS, "record_count", cal.micros(F.col("first_at")).alias("first_us"), cal.micros(F.col("last_at")).alias("last_us"))


@query("incremental_totals", TOTALS_SQL)
def incremental_totals(spark, d):
    """STF-03, 04: totals of the first two thirds, then a change that adds the rest and takes every tenth away."""
    occ = base.executions(spark, d).select("occurrence_id", *TOTAL_KEYS, "end_at")
    old = occ.where("occurrence_id % 3 <> 0")
    new = occ.where("occurrence_id % 10 <> 3")
    removed, added = incremental.refresh_facts(old, new)
    return _totals(incremental.merge_totals(incremental.recompute_totals(old, TOTAL_KEYS), incremental.apply_facts(old, removed, added), removed, added, TOTAL_KEYS))


@query("incremental_changes", "SELECT event_id AS occurrence_id FROM events WHERE event_id % 4 <> 0")
def incremental_changes(spark, d):
    """STF-02: every row comes twice, every fourth was processed."""
    rows = base.executions(spark, d).select("occurrence_id")
    return incremental.capture_changes(rows.unionByName(rows), rows.where("occurrence_id % 4 = 0"), ["occurrence_id"])


def _stream(spark, d):
    """The executions in eight Parquet files of the shared folder, as a stream of two files a batch."""
    path = shared(spark)
    rows = base.executions(spark, d).withColumn("end_at", F.col("end_at").cast("timestamp")).withColumn("start_at", F.col("start_at").cast("timestamp"))
    rows.repartitionByRange(8, "end_at", "occurrence_id").write.parquet(f"{path}/in")
    return incremental.arriving_files(spark, f"{path}/in", rows.schema.simpleString()[7:-1].replace(":", " "), 2), path


@query("stream_totals", TOTALS_SQL.replace("WHERE occurrence_id % 10 <> 3 ", ""))
def stream_totals(spark, d):
    """STF-02..04, 06 as a stream: equal to a recomputation."""
    stream, path = _stream(spark, d)
    store = totals.BucketTotals(spark, f"{path}/totals", TOTAL_KEYS, most_runs=2)
    incremental.keep_totals(stream, store, f"{path}/check").awaitTermination()
    out = store.read()
    return _totals(out.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz")))


@query("stream_retractions", TOTALS_SQL)
def stream_retractions(spark, d):
    """STF-02..04: all executions come, then every tenth is retracted; totals follow, their first and last times too."""
    path = shared(spark)
    rows = base.executions(spark, d).select("occurrence_id", *TOTAL_KEYS, F.col("end_at").cast("timestamp").alias("end_at"))
    for part in (rows.withColumn("retracted", F.lit(False)), rows.where("occurrence_id % 10 = 3").withColumn("retracted", F.lit(True))):
        part.repartition(4, "occurrence_id").write.mode("append").parquet(f"{path}/in")
    stream = incremental.arriving_files(spark, f"{path}/in", "occurrence_id long, scope_id string, database string, timing_type string, end_at timestamp, retracted boolean", 4)
    store = totals.BucketTotals(spark, f"{path}/totals", TOTAL_KEYS, log=True)
    incremental.keep_totals(stream, store, f"{path}/check").awaitTermination()
    out = store.read()
    return _totals(out.withColumn("first_at", F.col("first_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz")))


@query("stream_timeline", f"WITH {EXEC} SELECT epoch_us(date_trunc('hour', end_at)) AS bucket_us, timing_type, outcome, count(*) AS records, max(us) AS longest_us, round(quantile_cont(us / 1000.0, 0.95), 6) AS p95 FROM x GROUP BY ALL")
def stream_timeline(spark, d):
    """STF-05: files may come out of order of time; the lateness allowed covers all of them, and one event far behind closes all hours."""
    stream, path = _stream(spark, d)
    last = spark.read.parquet(f"{path}/in").orderBy(F.desc("end_at")).limit(1)
    last.withColumn("end_at", F.col("end_at") + F.expr("INTERVAL 1 YEAR")).write.mode("append").parquet(f"{path}/in")
    incremental.live_timeline(stream, f"{path}/out", f"{path}/check", "60 days").awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.select(cal.micros(F.col("bucket").cast("timestamp_ntz")).alias("bucket_us"), "timing_type", "outcome", "records", "longest_us", F.round("p95", 6).alias("p95"))


@query("stream_files", "SELECT count(*) AS records, count(DISTINCT event_id) AS executions FROM events")
def stream_files(spark, d):
    """STF-06: all arriving files are taken once, also when the stream is started again."""
    stream, path = _stream(spark, d)
    for _ in range(2):
        incremental.run_to_end(stream, f"{path}/out", f"{path}/check")
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("records"), F.count_distinct("occurrence_id").alias("executions"))


@query("baseline_row_hashes")
def baseline_row_hashes(spark, d):
    """SRC-16: hash of every statistic row; hashes cover Spark's own JSON, so there is no SQL twin."""
    return baseline.row_hashes(base.statistics(spark, d), [])


#: Requests of decisions: one JSON array of orders a customer; every seventh is no array, every eleventh has a record without a key.
_ASKED = """o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)"""


@query(
    "eligibility_requested",
    f"""WITH {_ASKED} SELECT o_custkey AS request_id, CAST(place AS INTEGER) AS place, 'A' || (o_orderkey % 3) AS analysis_id, CAST(o_orderkey AS VARCHAR) AS occurrence_id, NULL AS error FROM o WHERE o_custkey % 7 <> 0 AND o_custkey % 11 <> 0
UNION ALL SELECT DISTINCT o_custkey, NULL, NULL, NULL, 'invalid_records' FROM o WHERE o_custkey % 7 = 0 OR o_custkey % 11 = 0""",
)
def eligibility_requested(spark, d):
    """ELI-13: records asked for as JSON."""
    o = base.table(spark, d, "orders")
    key = F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderkey").cast("string"))
    one = F.struct(F.concat(F.lit("A"), (F.col("o_orderkey") % 3).cast("string")).alias("analysis_id"), key.alias("occurrence_id"))
    asked = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("r")))).alias("l"))
    listed = F.to_json(F.col("l.r"))
    asked = asked.select(F.col("o_custkey").alias("request_id"), F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit('{"records":'), listed, F.lit("}"))).otherwise(listed).alias("asked"))
    return exchange.json_records(asked, "asked", ["analysis_id", "occurrence_id"])


@query(
    "operations_status_values",
    f"""WITH {RUNS}, n AS (SELECT scope_id, max(day) AS newest_day FROM dx GROUP BY scope_id), p AS (SELECT scope_id, count(*) AS problems FROM op GROUP BY scope_id)
SELECT scope_id, 'object' AS kind, newest_day, coalesce(problems, 0) AS problems, code, CASE WHEN code IS NOT NULL THEN coalesce(day, '') END AS day FROM n LEFT JOIN p USING (scope_id) LEFT JOIN op USING (scope_id)""",
)
def operations_status_values(spark, d):
    """OPS-08: every value of the JSON documents, read back from their text."""
    docs = operations_status(spark, d)
    fields = F.from_json("document", "newest_day string, problems long, problem_list array<struct<code: string, day: string>>")
    read = docs.select("scope_id", exchange.json_kind(F.col("document")).alias("kind"), fields.alias("v"))
    return read.select("scope_id", "kind", "v.newest_day", "v.problems", F.explode_outer("v.problem_list").alias("p")).select("scope_id", "kind", "newest_day", "problems", "p.code", "p.day")


@query(
    "records_reason_checks",
    f"""WITH {LG} SELECT field, count(*) AS records, count(*) FILTER (missing) AS missing, CAST(0 AS BIGINT) AS faults FROM (
SELECT unnest(['end_at', 'duration_ms', 'estimated_start_at']) AS field, unnest([end_us IS NULL, us IS NULL, end_us IS NULL OR us IS NULL]) AS missing FROM io) GROUP BY field""",
)
def records_reason_checks(spark, d):
    """PRJ-08 as a condition: every unknown value has its reason, no known value has one."""
    rows = interpreted(log_records(spark, d)).withColumn("reasons", records.value_reasons(F.col("end_at"), F.col("us"), F.col("start_at")))
    fields = [("end_at", "end_at"), ("duration_ms", "us"), ("estimated_start_at", "start_at")]
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).isNull().alias("missing"), exchange.reason_faults(F.col(c), F.col("reasons"), n).alias("fault")) for n, c in fields])).alias("c"))
    return each.groupBy("c.field").agg(F.count("*").alias("records"), F.count_if("c.missing").alias("missing"), F.count_if("c.fault").alias("faults"))


@query(
    "baseline_reason_checks",
    f"""WITH {STATS}, m AS (SELECT unnest([{", ".join(f"'{m}'" for m in baseline.METRICS)}]) AS metric, unnest([{", ".join(f"{m} IS NULL" for m in baseline.METRICS)}]) AS missing FROM st)
SELECT metric, count(*) AS rows_read, count(*) FILTER (missing) AS missing, CAST(0 AS BIGINT) AS faults FROM m GROUP BY metric""",
)
def baseline_reason_checks(spark, d):
    """AGG-10 as a condition: a metric is null exactly where its reason is told."""
    told = [F.struct(F.lit(m).alias("metric"), F.col(m).isNull().alias("missing"), exchange.reason_faults(F.col(m), F.col("metric_null_reasons"), m).alias("fault")) for m in baseline.METRICS]
    each = base.build(spark, d).select(F.explode(F.array(*told)).alias("c"))
    return each.groupBy("c.metric").agg(F.count("*").alias("rows_read"), F.count_if("c.missing").alias("missing"), F.count_if("c.fault").alias("faults"))


@query(
    "baseline_row_hash_values",
    f"""WITH {STATS}, t AS (SELECT {", ".join(f"coalesce(CAST({k} AS VARCHAR), '-') AS {k}" for k in [*KEYS, "layer", "bucket_date", "bucket_number"])}, CAST(included_count AS VARCHAR) AS included_count, coalesce(CAST(CAST(round(min_ms * 1000) AS BIGINT) AS VARCHAR), '-') AS min_us, coalesce(CAST(CAST(round(max_ms * 1000) AS BIGINT) AS VARCHAR), '-') AS max_us FROM st)
SELECT sha256(CAST(to_json(t) AS VARCHAR)) AS row_hash FROM t""",
)
def baseline_row_hash_values(spark, d):
    """SRC-16: row hashes over a text form that other engines write alike: keys, bucket, samples, extremes in microseconds."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    us = lambda c: text(F.round(F.col(c) * 1000).cast("long"))
    cols = [text(F.col(k)).alias(k) for k in [*KEYS, "layer", "bucket_date", "bucket_number"]]
    return baseline.row_hashes(base.build(spark, d).select(*cols, text(F.col("included_count")).alias("included_count"), us("min_ms").alias("min_us"), us("max_ms").alias("max_us")), [])
