"""Queries of execution facts, audits, publication and retention, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.operators import builds, facts
from qlog.plans import base
from qlog.plans.base import DECISIONS, EXEC, KEYS, STATS

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: A text's structure: S<k> has fingerprint F<k mod 20>; every 17th text has none that is reliable.
FP = "fp AS (SELECT DISTINCT sql_id, 'lexical-1' AS rule_id, CASE WHEN CAST(substr(sql_id, 2) AS INTEGER) % 17 = 0 THEN 'unsupported_syntax' ELSE 'reliable' END AS state, 'F' || (CAST(substr(sql_id, 2) AS INTEGER) % 20) AS value FROM x)"
REC = f"{EXEC}, {FP}, rec AS (SELECT f.rule_id, f.value AS fingerprint, x.* EXCLUDE (fingerprint) FROM x JOIN fp f USING (sql_id) WHERE f.state = 'reliable')"


def fingerprints(spark, d):
    k = F.substring("sql_id", 2, 9).cast("int")
    ids = base.executions(spark, d).select("sql_id").distinct()
    return ids.select("sql_id", F.lit("lexical-1").alias("rule_id"), F.when(k % 17 == 0, "unsupported_syntax").otherwise("reliable").alias("state"), F.concat(F.lit("F"), (k % 20).cast("string")).alias("value"))


def records(spark, d):
    return facts.query_records(base.executions(spark, d), facts.membership(fingerprints(spark, d)))


IDENT = "fingerprint, scope_id, database, execution_user"


@query("facts_records", f"WITH {REC} SELECT occurrence_id, rule_id, {IDENT}, sql_id, epoch_us(end_at) AS end_us, us, timing_type, outcome, unit, request_shape FROM rec")
def facts_records(spark, d):
    """FCT-01, 03."""
    return records(spark, d).select("occurrence_id", "rule_id", *facts.IDENTITY, "sql_id", cal.micros(F.col("end_at")).alias("end_us"), "us", "timing_type", "outcome", "unit", "request_shape")


@query("facts_structures", f"WITH {EXEC}, {FP} SELECT rule_id, value AS fingerprint, count(*) AS text_count, min(sql_id) AS example_sql_id FROM fp WHERE state = 'reliable' GROUP BY ALL")
def facts_structures(spark, d):
    """FCT-02."""
    return facts.structures(facts.membership(fingerprints(spark, d)))


@query("facts_identities", f"WITH {REC} SELECT DISTINCT rule_id, {IDENT} FROM rec")
def facts_identities(spark, d):
    """FCT-04: nulls are parts of an identity like any value."""
    return facts.identities(records(spark, d)).drop("identity_key")


@query(
    "facts_identity_totals",
    f"WITH {REC} SELECT {IDENT}, timing_type, count(*) AS record_count, count(*) FILTER (outcome = 'success') AS success_count, epoch_us(min(end_at)) AS first_us, epoch_us(max(end_at)) AS last_us FROM rec GROUP BY ALL",
)
def facts_identity_totals(spark, d):
    """FCT-05."""
    own = records(spark, d)
    out = facts.identity_totals(own).join(facts.identities(own), ["rule_id", "identity_key"])
    return out.select(*facts.IDENTITY, "timing_type", "record_count", "success_count", cal.micros(F.col("first_at")).alias("first_us"), cal.micros(F.col("last_at")).alias("last_us"))


@query("facts_text_totals", f"WITH {REC} SELECT sql_id, {IDENT}, count(*) AS record_count, epoch_us(min(end_at)) AS first_us, epoch_us(max(end_at)) AS last_us FROM rec GROUP BY ALL")
def facts_text_totals(spark, d):
    """FCT-06."""
    own = records(spark, d)
    out = facts.text_totals(own).join(facts.identities(own), ["rule_id", "identity_key"])
    return out.select("sql_id", *facts.IDENTITY, "record_count", cal.micros(F.col("first_at")).alias("first_us"), cal.micros(F.col("last_at")).alias("last_us"))


@query(
    "facts_name_counts",
    f"WITH {EXEC} SELECT analysis_id, 'database' AS kind, database AS name, count(*) AS n FROM x WHERE database IS NOT NULL GROUP BY ALL UNION ALL SELECT analysis_id, 'user', execution_user, count(*) FROM x WHERE execution_user IS NOT NULL GROUP BY ALL",
)
def facts_name_counts(spark, d):
    """FCT-07."""
    return facts.name_counts(base.executions(spark, d))


@query(
    "facts_progress",
    f"WITH {EXEC}, {FP} SELECT rule_id, (SELECT count(DISTINCT sql_id) FROM x) AS text_count, count(*) AS fingerprint_count, (SELECT count(DISTINCT sql_id) FROM x) - count(*) AS missing FROM fp WHERE state = 'reliable' GROUP BY rule_id",
)
def facts_progress(spark, d):
    """FCT-08."""
    return facts.fingerprint_progress(base.executions(spark, d).select("sql_id"), fingerprints(spark, d).where("state = 'reliable'"))


@query(
    "facts_audit",
    "SELECT unnest(['text_keys', 'memberships', 'structures', 'identities', 'records', 'identity_totals', 'text_totals', 'dangling']) AS \"case\", CAST(0 AS BIGINT) AS n",
)
def facts_audit(spark, d):
    """FCT-09: every derived table against its definition, written another way; all differences must be zero."""
    occ, fps = base.executions(spark, d), fingerprints(spark, d)
    own = records(spark, d)
    good = fps.where("state = 'reliable'").select("sql_id", "value")
    plain = occ.drop("fingerprint").join(good, "sql_id")
    who = ["value", "scope_id", "database", "execution_user"]
    as_id = lambda df: df.select(F.col("fingerprint").alias("value"), *who[1:])
    total = plain.groupBy(*who, "timing_type").agg(F.count("*").alias("n"))
    kept = facts.identity_totals(own).join(facts.identities(own), ["rule_id", "identity_key"]).select(F.col("fingerprint").alias("value"), *who[1:], "timing_type", F.col("record_count").alias("n"))
    texts = facts.text_totals(own).groupBy("sql_id").agg(F.sum("record_count").alias("n"))
    cases = {
        "text_keys": (occ.select("sql_id").distinct(), fps.select("sql_id")),
        "memberships": (good, facts.membership(fps).select("sql_id", F.col("fingerprint").alias("value"))),
        "structures": (good.groupBy("value").agg(F.count("*").alias("n")), facts.structures(facts.membership(fps)).select(F.col("fingerprint").alias("value"), F.col("text_count").alias("n"))),
        "identities": (plain.select(*who).distinct(), as_id(facts.identities(own))),
        "records": (plain.select("occurrence_id", "us"), own.select("occurrence_id", "us")),
        "identity_totals": (total, kept),
        "text_totals": (plain.groupBy("sql_id").agg(F.count("*").alias("n")), texts),
        "dangling": (own.select("identity_key").distinct(), facts.identities(own).select("identity_key")),
    }
    return facts.audit(cases)


@query(
    "publication_checks",
    f"""WITH {STATS}, a AS (SELECT {", ".join(KEYS)}, layer, sum(included_count) AS i, sum(excluded_count) AS e FROM st GROUP BY ALL)
SELECT unnest(['batch_complete', 'rules_consistent', 'results_complete', 'results_saved', 'counts_consistent', 'values_consistent']) AS "check",
unnest(['failed', 'passed', 'passed', 'passed', 'passed', 'passed']) AS state, unnest(['input_file_not_succeeded', NULL, NULL, NULL, NULL, NULL]) AS reason,
unnest([(SELECT count(*) FROM nation WHERE n_regionkey = 0), 0, 0, 0, 0, 0]) AS failures""",
)
def publication_checks(spark, d):
    """FCT-10: a build with all its groups, where the files of region 0 did not succeed."""
    decided = base.samples(spark, d)
    required = decided.groupBy(*KEYS).agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
    files = base.table(spark, d, "nation").where("n_regionkey = 0")
    rules = decided.select(F.lit(base.RULE).alias("rule"))
    return facts.publication_checks(base.statistics(spark, d), required, KEYS, files, rules)


#: Publication log: one build an order of the first 12 customers' months; results by order status.
LOG = """pl AS (SELECT 'C' || (o_custkey % 3) AS scope_id, 'B' || o_orderkey AS build_id, o_orderdate AS stamp,
  CASE o_orderstatus WHEN 'F' THEN 'check_failed' WHEN 'P' THEN 'no_samples' ELSE 'published' END AS result, year(o_orderdate) AS year, month(o_orderdate) AS month, CAST(round(o_totalprice) AS BIGINT) AS bytes, o_orderpriority FROM orders),
cl AS (SELECT DISTINCT build_id FROM pl WHERE o_orderpriority LIKE '1%'),
cu AS (SELECT scope_id, max_by(build_id, {'a': stamp, 'b': build_id}) AS build_id, max(stamp) AS published_at FROM pl WHERE result = 'published' GROUP BY scope_id)"""


def _log(spark, d):
    o = base.table(spark, d, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 3).cast("string")).alias("scope_id"), F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("build_id"), at.alias("at"),
        F.when(F.col("o_orderstatus") == "F", "check_failed").when(F.col("o_orderstatus") == "P", "no_samples").otherwise("published").alias("result"),
        F.year(at).cast("long").alias("year"), F.month(at).cast("long").alias("month"), F.round("o_totalprice").cast("long").alias("bytes"), "o_orderpriority",
    )


def _cleaned(spark, d):
    return _log(spark, d).where("o_orderpriority like '1%'").select("build_id")


@query("publication_current", f"WITH {LOG} SELECT scope_id, build_id, epoch_us(published_at) AS at_us FROM cu")
def publication_current(spark, d):
    """FCT-11, JOI-09."""
    return facts.current_versions(_log(spark, d)).select("scope_id", "build_id", cal.micros(F.col("published_at")).alias("at_us"))


@query(
    "publication_history",
    f"""WITH {LOG}, h AS (SELECT pl.*, row_number() OVER (PARTITION BY pl.scope_id ORDER BY stamp DESC, pl.build_id DESC) AS n, cu.build_id AS cur FROM pl LEFT JOIN cu USING (scope_id))
SELECT scope_id, build_id, n, result, coalesce(build_id = cur, false) AND result = 'published' AS is_current, build_id IN (SELECT build_id FROM cl) AS cleaned,
CASE WHEN result <> 'published' THEN 'published_version_not_found' WHEN build_id IN (SELECT build_id FROM cl) THEN 'results_cleaned' END AS unusable FROM h WHERE n <= 50""",
)
def publication_history(spark, d):
    """FCT-12, QRY-04, 21, JOI-06."""
    return facts.version_history(_log(spark, d), _cleaned(spark, d), 50).select("scope_id", "build_id", F.col("n").cast("long").alias("n"), "result", "is_current", "cleaned", "unusable")


_PREVIEW = f"""WITH {LOG}, p AS (SELECT pl.scope_id, year, month, count(*) FILTER (result = 'published') AS published, count(*) FILTER (result <> 'published') AS unpublished, CAST(sum(bytes) AS BIGINT) AS bytes,
  count(*) FILTER (pl.build_id IN (SELECT build_id FROM cu)) AS k, count(*) FILTER (pl.build_id NOT IN (SELECT build_id FROM cl)) AS lft FROM pl GROUP BY ALL),
pv AS (SELECT scope_id, year, month, published, unpublished, bytes, CASE WHEN lft = 0 THEN 'cleaned' WHEN k > 0 THEN 'protected' WHEN 2000 * 12 + 1 - (year * 12 + month) > 30 THEN 'expired' ELSE 'retained' END AS state FROM p)"""


def _preview(spark, d):
    return facts.retention_preview(_log(spark, d), _log(spark, d), _cleaned(spark, d), 30, (2000, 1))


@query("retention_preview", f"{_PREVIEW} SELECT * FROM pv")
def retention_preview(spark, d):
    """FCT-13."""
    return _preview(spark, d)


@query("retention_drop", f"{_PREVIEW} SELECT pl.scope_id, build_id FROM pl JOIN pv USING (scope_id, year, month) WHERE pv.state <> 'expired'")
def retention_drop(spark, d):
    """FCT-14."""
    return facts.drop_expired(_log(spark, d), _preview(spark, d)).select("scope_id", "build_id")


@query("retention_partitions", f"{_PREVIEW} SELECT pl.scope_id, build_id FROM pl JOIN pv USING (scope_id, year, month) WHERE pv.state <> 'expired'")
def retention_partitions(spark, d):
    """FCT-14 on a table partitioned by cluster and month: expired partitions go as folders, the rest is not touched."""
    path, by = f"{base.store(spark)}/{uuid.uuid4().hex}/months", ["scope_id", "year", "month"]
    _log(spark, d).repartition(*by).write.partitionBy(*by).parquet(path)
    return builds.drop_partitions(spark, path, by, _preview(spark, d).where("state = 'expired'")).select("scope_id", "build_id")


@query(
    "import_breakdown",
    """WITH dy AS (SELECT 'C' || (l_suppkey % 3) AS scope_id, CAST(l_shipdate AS DATE) AS day, l_orderkey AS run_id, CAST(sum(l_quantity) AS BIGINT) AS seconds FROM lineitem GROUP BY ALL),
r AS (SELECT o_orderkey AS run_id, CAST(round(o_totalprice) AS BIGINT) AS stage_seconds FROM orders), s AS (SELECT run_id, sum(seconds) AS ds FROM dy GROUP BY run_id)
SELECT scope_id, CAST(day AS VARCHAR) AS day, CAST(run_id AS BIGINT) AS run_id, seconds, row_number() OVER (PARTITION BY scope_id, day ORDER BY run_id) AS attempt, CAST(stage_seconds - ds AS BIGINT) AS other_seconds
FROM dy LEFT JOIN r USING (run_id) LEFT JOIN s USING (run_id)""",
)
def import_breakdown(spark, d):
    """FCT-15: orders stand for runs, ship dates for imported days."""
    li = base.table(spark, d, "lineitem")
    days = li.groupBy(F.concat(F.lit("C"), (F.col("l_suppkey") % 3).cast("string")).alias("scope_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_orderkey").cast("long").alias("run_id")).agg(F.sum("l_quantity").cast("long").alias("seconds"))
    runs = base.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("run_id"), F.round("o_totalprice").cast("long").alias("stage_seconds"))
    return facts.import_breakdown(runs, days).select("scope_id", base.day_text("day"), "run_id", "seconds", F.col("attempt").cast("long").alias("attempt"), "other_seconds")


@query(
    "import_reconcile",
    f"""WITH {EXEC}, a AS (SELECT analysis_id AS file_id, outcome AS metric, count(*) AS stored FROM x GROUP BY ALL), b AS (SELECT analysis_id AS file_id, outcome AS metric, count(*) AS rescanned FROM x WHERE sql_state <> 'missing' GROUP BY ALL)
SELECT file_id, metric, stored, rescanned FROM a FULL JOIN b USING (file_id, metric) WHERE stored IS DISTINCT FROM rescanned""",
)
def import_reconcile(spark, d):
    """FCT-16, JOI-07: a store against a rescan that lost the records without text."""
    occ = base.executions(spark, d)
    count = lambda df: df.groupBy(F.col("analysis_id").alias("file_id"), F.col("outcome").alias("metric")).agg(F.count("*").alias("n"))
    return facts.reconcile(count(occ), count(occ.where("sql_state <> 'missing'")))


@query(
    "publication_result",
    f"""WITH {DECISIONS} SELECT CAST(0 AS BIGINT) AS failed, count(*) FILTER (state = 'included') AS samples, CASE WHEN count(*) FILTER (state = 'included') = 0 THEN 'no_samples' ELSE 'published' END AS result FROM d WHERE count_scope = 'group'""",
)
def publication_result(spark, d):
    """FCT-11: the row that a checked build appends to the log."""
    decided = base.samples(spark, d)
    required = decided.groupBy(*KEYS).agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
    stats = base.statistics(spark, d)
    none = base.table(spark, d, "nation").where("n_nationkey < 0")
    checks = facts.publication_checks(stats, required, KEYS, none, decided.select(F.lit(base.RULE).alias("rule")))
    return facts.publication_result(checks, stats).select("failed", "samples", "result")
