"""Executions, texts and decisions derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.operators import baseline, eligibility
from qlog.operators.builds import Builds
from qlog.operators.facts import publication_checks
from qlog.operators.layout import ClusteredFacts
from qlog.operators.tables import hadoop, store, written
from qlog.operators.textindex import TextIndex

WINDOW = ("2024-01-06", "2024-01-26")  # local dates, half-open
RULE = "lexical-1"
INTERVALS = [("C0", "X1", "2024-01-10 02:00:00", "2024-01-10 08:00:00"), ("C0", "X2", "2024-01-10 06:00:00", "2024-01-11 20:00:00"), ("C2", "X3", "2024-01-15 00:00:00", "2024-01-16 00:00:00")]
TEMPLATES = [{"id": "T1", "fingerprint": "F3"}, {"id": "T2", "fingerprint": "F5", "scope_id": "C1", "database": "D0"}, {"id": "T3", "fingerprint": "F5", "execution_user": "U4"}]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One execution an event: identity, text, timing, outcome, end, duration and estimated start."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("end_at"), "user_id", "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind = lambda *pairs: F.create_map(*[F.lit(x) for x in pairs])[F.col("event_type")]
    us = F.when(F.col("event_type") != "error", F.round(F.col("value") * 1000).cast("long"))
    state = F.when(i % 41 == 0, "missing").when(i % 43 == 0, "uncertain").otherwise("complete")
    text = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    out = e.select(
        i.alias("occurrence_id"), text("A", i % 2).alias("analysis_id"), text("C", u % 3).alias("scope_id"), F.when(k % 25 != 0, text("D", k % 5)).alias("database"), text("U", u % 10).alias("execution_user"),
        text("S", k).alias("sql_id"), F.when((state == "complete") & (i % 47 != 0), text("F", k % 20)).alias("fingerprint"), state.alias("sql_state"),
        kind("click", "request", "view", "execute_first", "purchase", "execute_fetch", "signup", "parse").alias("timing_type"),
        F.when(F.col("event_type") != "error", "success").when(u % 2 == 0, "failed").otherwise("cancelled").alias("outcome"),
        F.when(i % 37 == 0, "unreliable").otherwise("reliable").alias("association_state"), F.lit("statement").alias("unit"), F.when(k % 7 == 0, "batch").otherwise("single").alias("request_shape"), "end_at", us.alias("us"),
    )
    return out.withColumn("start_at", cal.back(F.col("end_at"), F.col("us")))


EXEC = """
ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
ex AS (
  SELECT event_id AS occurrence_id, 'A' || (event_id % 2) AS analysis_id, 'C' || (user_id % 3) AS scope_id,
         CASE WHEN k % 25 <> 0 THEN 'D' || (k % 5) END AS database, 'U' || (user_id % 10) AS execution_user, 'S' || k AS sql_id,
         CASE WHEN event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 <> 0 THEN 'F' || (k % 20) END AS fingerprint,
         CASE WHEN event_id % 41 = 0 THEN 'missing' WHEN event_id % 43 = 0 THEN 'uncertain' ELSE 'complete' END AS sql_state,
         CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'execute_first' WHEN 'purchase' THEN 'execute_fetch' WHEN 'signup' THEN 'parse' END AS timing_type,
         CASE WHEN event_type <> 'error' THEN 'success' WHEN user_id % 2 = 0 THEN 'failed' ELSE 'cancelled' END AS outcome,
         CASE WHEN event_id % 37 = 0 THEN 'unreliable' ELSE 'reliable' END AS association_state, 'statement' AS unit,
         CASE WHEN k % 7 = 0 THEN 'batch' ELSE 'single' END AS request_shape, ts AS end_at,
         CASE WHEN event_type <> 'error' THEN CAST(round(value * 1000) AS BIGINT) END AS us
  FROM ev),
x AS (SELECT *, end_at - to_microseconds(us) AS start_at FROM ex)
"""


def _ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def window_bounds() -> tuple[Column, Column]:
    """The window's instants."""
    return tuple(F.expr(f"TIMESTAMP_NTZ'{d} 00:00:00' - {cal.LOCAL}") for d in WINDOW)


def window_dates() -> tuple[Column, Column]:
    return tuple(F.expr(f"DATE'{d}'") for d in WINDOW)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = executions(spark, sf_dir)
    f = F.col("fingerprint")
    categories = F.when(f == "F7", F.array(F.lit("SET"), F.lit("SELECT"))).when(f == "F8", F.array(F.lit("START TRANSACTION"), F.lit("END"))).when(f == "F9", F.array().cast("array<string>")).otherwise(F.array(F.lit("SELECT")))
    occ = occ.withColumn("category_kind", eligibility.classify_categories(categories))
    rules = spark.createDataFrame(INTERVALS, "scope_id string, rule_id string, a string, b string").select("scope_id", "rule_id", F.col("a").cast("timestamp_ntz").alias("starts"), F.col("b").cast("timestamp_ntz").alias("ends"))
    occ = eligibility.template_rules(occ, TEMPLATES, ["occurrence_id"])
    occ = eligibility.exclusion_rules(occ, rules, ["occurrence_id"])
    return eligibility.decide(occ, *window_bounds())


DECISIONS = (
    EXEC
    + f""",
iv(scope_id, rule_id, starts, ends) AS (VALUES {", ".join(f"('{s}', '{r}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for s, r, a, b in INTERVALS)}),
hit AS (
  SELECT occurrence_id, list_sort(list(rule_id)) AS interval_rules FROM x JOIN iv USING (scope_id)
  WHERE CASE WHEN us = 0 THEN start_at >= starts AND start_at < ends ELSE start_at < ends AND end_at > starts END GROUP BY occurrence_id),
r AS (
  SELECT x.*, coalesce(interval_rules, []) AS interval_rules,
    CASE WHEN fingerprint = 'F7' THEN 'mixed' WHEN fingerprint = 'F8' THEN 'pure' WHEN fingerprint = 'F9' THEN 'unknown' ELSE 'none' END AS category_kind,
    list_filter([CASE WHEN fingerprint = 'F3' THEN 'T1' END, CASE WHEN fingerprint = 'F5' AND scope_id = 'C1' AND database = 'D0' THEN 'T2' END,
                 CASE WHEN fingerprint = 'F5' AND execution_user = 'U4' THEN 'T3' END], lambda c: c IS NOT NULL) AS template_ids,
    coalesce(fingerprint = 'F5' AND ((scope_id = 'C1' AND database IS NULL) OR execution_user IS NULL), false) AS template_unknown,
    start_at >= TIMESTAMP '{WINDOW[0]} 00:00:00' - INTERVAL 8 HOURS AND start_at < TIMESTAMP '{WINDOW[1]} 00:00:00' - INTERVAL 8 HOURS AS in_window
  FROM x LEFT JOIN hit USING (occurrence_id)),
rc AS (
  SELECT *, list_filter([
    CASE WHEN outcome <> 'success' THEN 'outcome_' || outcome END,
    CASE WHEN us IS NULL THEN 'duration_unknown' END,
    CASE WHEN association_state <> 'reliable' THEN 'association_unreliable' END,
    CASE WHEN timing_type IS NULL THEN 'timing_unknown' END,
    CASE WHEN sql_state <> 'complete' THEN 'sql_' || sql_state END,
    CASE WHEN sql_state = 'complete' AND fingerprint IS NULL THEN 'fingerprint_failed' END,
    CASE WHEN database IS NULL OR execution_user IS NULL OR template_unknown THEN 'identity_missing' END,
    CASE WHEN start_at IS NULL THEN 'start_unknown' END,
    CASE WHEN category_kind IN ('pure', 'mixed') THEN 'blacklist_category' END,
    CASE WHEN len(template_ids) > 0 THEN 'blacklist_template' END,
    CASE WHEN len(interval_rules) > 0 THEN 'excluded_interval' END,
    CASE WHEN NOT in_window THEN 'outside_window' END], lambda c: c IS NOT NULL) AS reason_codes
  FROM r),
dd AS (
  SELECT *,
    CASE WHEN in_window IS NOT DISTINCT FROM false THEN 'outside_window'
         WHEN list_has_any(reason_codes, ['outcome_failed', 'outcome_cancelled', 'outcome_timed_out', 'blacklist_category', 'blacklist_template', 'excluded_interval']) THEN 'excluded'
         WHEN len(reason_codes) > 0 THEN 'unresolved' ELSE 'included' END AS state,
    CASE WHEN database IS NOT NULL AND execution_user IS NOT NULL AND fingerprint IS NOT NULL AND timing_type IS NOT NULL AND association_state = 'reliable'
         THEN 'G:' || sha256('["' || scope_id || '","' || database || '","' || execution_user || '","' || fingerprint || '","' || timing_type || '"]') END AS group_id
  FROM rc),
d AS (SELECT *, CASE WHEN in_window IS NOT DISTINCT FROM false THEN 'none' WHEN group_id IS NOT NULL AND start_at IS NOT NULL THEN 'group' ELSE 'batch' END AS count_scope FROM dd)
"""
)

KEYS = ["scope_id", "database", "timing_type"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the build: decided executions that count for a group."""
    d = decisions(spark, sf_dir).where("count_scope = 'group'")
    return d.select(*KEYS, "start_at", "us", (F.col("state") == "included").alias("included"), F.col("reason_codes").alias("codes"))


SAMPLES = (
    DECISIONS
    + """,
s AS (SELECT scope_id, database, timing_type, start_at, start_at + INTERVAL 8 HOURS AS l, us, us / 1000.0 AS ms, state = 'included' AS included, reason_codes AS codes FROM d WHERE count_scope = 'group'),
lay AS (
  SELECT *, 'overall' AS layer, NULL::DATE AS bucket_date, NULL::INTEGER AS bucket_number FROM s
  UNION ALL SELECT *, 'day', CAST(l AS DATE), NULL FROM s
  UNION ALL SELECT *, 'week', CAST(date_trunc('week', l) AS DATE), NULL FROM s
  UNION ALL SELECT *, 'weekday', NULL, CAST(isodow(l) AS INTEGER) FROM s
  UNION ALL SELECT *, 'hour', NULL, CAST(hour(l) AS INTEGER) FROM s)
"""
)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All buckets of the build. Its counts by hour are written first, as counts, metrics and exclusions each read them."""
    path = f"{store(spark)}/{uuid.uuid4().hex}/hours"
    baseline.by_hour(samples(spark, sf_dir), KEYS).write.parquet(path)
    return baseline.statistics(spark.read.parquet(path), KEYS, *window_dates())


def _state(spark: SparkSession, sf_dir: str, name: str) -> str:
    """What tells a table as it is now from one that has changed."""
    path, fs = hadoop(spark, f"{sf_dir}/{name}.parquet")
    return f"{sf_dir} {fs.getFileStatus(path).getModificationTime()} {fs.getContentSummary(path).getLength()}"


def text_index(spark: SparkSession, sf_dir: str, make) -> TextIndex:
    """The trigram index over the documents as they are now; the first reader of an application has it made."""
    path = f"{store(spark)}/texts-{hashlib.sha256(_state(spark, sf_dir, 'documents').encode()).hexdigest()[:16]}"
    index, (done, fs) = TextIndex(spark, path), hadoop(spark, f"{path}/done")
    if not fs.exists(done):
        index.add(0, make())
        fs.create(done).close()
    return index


def clustered(spark: SparkSession, sf_dir: str) -> ClusteredFacts:
    """Facts with a fingerprint, clustered by it, over the events as they are now; the first reader of an application stores them."""
    path = f"{store(spark)}/facts-{hashlib.sha256(_state(spark, sf_dir, 'events').encode()).hexdigest()[:16]}"
    facts = ClusteredFacts(spark, path, ["fingerprint"])
    if not facts.manifest()["runs"]:
        facts.add(0, executions(spark, sf_dir).where("fingerprint is not null"))
    return facts


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published build over the tables as they are now; the first reader of an application makes and publishes it."""
    scope = _state(spark, sf_dir, "events")
    builds = Builds(spark, f"{store(spark)}/builds")
    found = builds.current(scope)
    if found is None:
        decided = written(samples(spark, sf_dir), "samples")
        required = decided.groupBy(*KEYS).agg(F.count_if("included").alias("included"), F.count_if(~F.col("included")).alias("excluded"))
        no_files = spark.createDataFrame([], "path string")
        checks = lambda stats: publication_checks(stats, required, KEYS, no_files, spark.range(1).select(F.lit(RULE).alias("rule")))
        builds.attempt(scope, uuid.uuid4().hex, baseline.statistics(decided, KEYS, *window_dates()), checks)
        found = builds.current(scope)
    if found is None:
        raise ValueError(f"no build of {scope} could be published: {builds.log(scope)}")
    return found


STATS = (
    SAMPLES
    + """,
agg AS (
  SELECT scope_id, database, timing_type, layer, bucket_date, bucket_number,
    count(*) FILTER (included) AS included_count, count(*) FILTER (NOT included) AS excluded_count,
    min(us) FILTER (included) / 1000.0 AS min_ms, max(us) FILTER (included) / 1000.0 AS max_ms,
    sum(us) FILTER (included) / count(*) FILTER (included) / 1000.0 AS mean_ms,
    quantile_cont(us, 0.25) FILTER (included) / 1000.0 AS p25_ms, quantile_cont(us, 0.5) FILTER (included) / 1000.0 AS p50_ms,
    quantile_cont(us, 0.75) FILTER (included) / 1000.0 AS p75_ms, quantile_cont(us, 0.9) FILTER (included) / 1000.0 AS p90_ms,
    quantile_cont(us, 0.95) FILTER (included) / 1000.0 AS p95_ms, quantile_cont(us, 0.99) FILTER (included) / 1000.0 AS p99_ms,
    stddev_pop(us) FILTER (included) / 1000.0 AS stddev_ms, (quantile_cont(us, 0.75) FILTER (included) - quantile_cont(us, 0.25) FILTER (included)) / 1000.0 AS iqr_ms, mad(CAST(us AS DOUBLE)) FILTER (included) / 1000.0 AS mad_ms,
    quantile_cont(ln(1 + ms), 0.5) FILTER (included) AS log_median, mad(ln(1 + ms)) FILTER (included) AS log_mad,
    list_sort(list(DISTINCT CAST(l AS DATE)) FILTER (included)) AS active_dates,
    list_sort(list(DISTINCT CAST(date_trunc('week', l) AS DATE)) FILTER (included)) AS active_weeks,
    min(start_at) FILTER (included) AS first_sample_at, max(start_at) FILTER (included) AS last_sample_at
  FROM lay GROUP BY ALL),
st AS (
  SELECT *, CASE WHEN mean_ms <> 0 THEN stddev_ms / mean_ms END AS cv,
    CASE WHEN p50_ms <> 0 THEN p95_ms / p50_ms END AS p95_p50, CASE WHEN p50_ms <> 0 THEN p99_ms / p50_ms END AS p99_p50
  FROM agg)
"""
)


def day_text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as SQL texts: language stands for the cluster, source for the database."""
    return table(spark, sf_dir, "documents").where("text is not null")
