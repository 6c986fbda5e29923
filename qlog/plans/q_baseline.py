"""Queries of baselines and eligibility, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.operators import baseline, eligibility
from qlog.plans import base
from qlog.plans.base import DECISIONS, KEYS, SAMPLES, STATS

Q, SQL = {}, {}
BUCKET_SQL = "layer, CAST(bucket_date AS VARCHAR) AS bucket_date, CAST(bucket_number AS BIGINT) AS bucket_number"
KEYS_SQL = ", ".join(KEYS)


def bucket() -> list:
    return ["layer", F.col("bucket_date").cast("string").alias("bucket_date"), F.col("bucket_number").cast("long").alias("bucket_number")]


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


METRIC_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in baseline.METRICS)


@query("baseline_layers", f"WITH {STATS} SELECT {KEYS_SQL}, {BUCKET_SQL}, included_count, excluded_count, {METRIC_SQL} FROM st")
def baseline_layers(spark, d):
    """AGG-01..09, 11: five layers, seventeen metrics."""
    return base.statistics(spark, d).select(*KEYS, *bucket(), "included_count", "excluded_count", *[F.round(m, 6).alias(m) for m in baseline.METRICS])


@query(
    "baseline_metrics_lineitem",
    """WITH s AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS us FROM lineitem),
lay AS (SELECT *, 'overall' AS layer, NULL::DATE AS b FROM s UNION ALL SELECT *, 'week', CAST(date_trunc('week', day) AS DATE) FROM s)
SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, layer, CAST(b AS VARCHAR) AS bucket_date, count(*) AS n, round(quantile_cont(us, 0.5) / 1000.0, 6) AS p50_ms,
round(quantile_cont(us, 0.95) / 1000.0, 6) AS p95_ms, round(mad(CAST(us AS DOUBLE)) / 1000.0, 6) AS mad_ms, round(stddev_pop(us) / 1000.0, 5) AS stddev_ms FROM lay GROUP BY l_suppkey, layer, b""",
)
def baseline_metrics_lineitem(spark, d):
    """AGG at larger volume: prices of line items by supplier as durations, overall and by week."""
    rows = base.table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("us"))
    none = F.lit(None)
    layers = F.array(
        F.struct(F.lit("overall").alias("layer"), none.cast("date").alias("bucket_date"), none.cast("int").alias("bucket_number")),
        F.struct(F.lit("week").alias("layer"), F.date_sub("day", F.weekday("day")).alias("bucket_date"), none.cast("int").alias("bucket_number")),
    )
    layered = rows.select("l_suppkey", "us", F.lit(True).alias("included"), F.explode(layers).alias("b")).select("l_suppkey", "us", "included", "b.*")
    n = layered.groupBy("l_suppkey", "layer", "bucket_date", "bucket_number").agg(F.count("*").alias("n"))
    m = baseline.metrics(layered, ["l_suppkey"])
    out = baseline.null_safe(n, m, ["l_suppkey", "layer", "bucket_date", "bucket_number"])
    return out.select(F.col("l_suppkey").cast("long"), "layer", base.day_text("bucket_date"), "n", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "mad_ms")], F.round("stddev_ms", 5).alias("stddev_ms"))


@query(
    "baseline_null_reasons",
    f"""WITH {STATS}, m AS (SELECT {KEYS_SQL}, layer, bucket_date, bucket_number, included_count, unnest([{", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in baseline.METRICS)}]) AS metric FROM st)
SELECT {KEYS_SQL}, {BUCKET_SQL}, metric, CASE WHEN included_count = 0 THEN 'no_samples' ELSE 'zero_denominator' END AS reason FROM m WHERE metric IS NOT NULL""",
)
def baseline_null_reasons(spark, d):
    """AGG-10."""
    return base.build(spark, d).select(*KEYS, *bucket(), F.explode("metric_null_reasons").alias("metric", "reason"))


@query(
    "baseline_exclusions",
    f"""WITH {SAMPLES}, c AS (SELECT {KEYS_SQL}, layer, bucket_date, bucket_number, unnest(list_distinct(codes)) AS code FROM lay WHERE NOT included)
SELECT {KEYS_SQL}, {BUCKET_SQL}, code, count(*) AS n FROM c GROUP BY ALL""",
)
def baseline_exclusions(spark, d):
    """AGG-12, QRY-36 source."""
    return base.build(spark, d).select(*KEYS, *bucket(), F.explode("exclusions_by_reason").alias("code", "n"))


@query(
    "baseline_activity",
    f"""WITH {STATS} SELECT {KEYS_SQL}, {BUCKET_SQL}, coalesce(array_to_string(active_dates, ','), '') AS active_dates, coalesce(array_to_string(active_weeks, ','), '') AS active_weeks,
epoch_us(first_sample_at) AS first_us, epoch_us(last_sample_at) AS last_us,
CAST(greatest(coalesce(bucket_date, DATE '{base.WINDOW[0]}'), DATE '{base.WINDOW[0]}') AS VARCHAR) AS range_start,
CAST(least(CASE layer WHEN 'day' THEN bucket_date + 1 WHEN 'week' THEN bucket_date + 7 ELSE DATE '{base.WINDOW[1]}' END, DATE '{base.WINDOW[1]}') AS VARCHAR) AS range_end,
layer = 'week' AND (bucket_date < DATE '{base.WINDOW[0]}' OR bucket_date + 7 > DATE '{base.WINDOW[1]}') AS partial_week FROM st""",
)
def baseline_activity(spark, d):
    """AGG-13..15."""
    return base.build(spark, d).select(
        *KEYS, *bucket(), F.array_join(F.col("active_dates").cast("array<string>"), ",").alias("active_dates"), F.array_join(F.col("active_weeks").cast("array<string>"), ",").alias("active_weeks"),
        cal.micros(F.col("first_sample_at")).alias("first_us"), cal.micros(F.col("last_sample_at")).alias("last_us"), base.day_text("range_start"), base.day_text("range_end"), "partial_week",
    )


_EXPECTED = f"""ek AS (SELECT 'overall' AS layer, 'all' AS bucket UNION ALL
  SELECT 'day', CAST(CAST(g AS DATE) AS VARCHAR) FROM generate_series(TIMESTAMP '{base.WINDOW[0]}', TIMESTAMP '{base.WINDOW[1]}' - INTERVAL 1 DAY, INTERVAL 1 DAY) t(g) UNION ALL
  SELECT 'week', CAST(CAST(g AS DATE) AS VARCHAR) FROM generate_series(date_trunc('week', TIMESTAMP '{base.WINDOW[0]}'), TIMESTAMP '{base.WINDOW[1]}' - INTERVAL 1 DAY, INTERVAL 7 DAY) t(g) UNION ALL
  SELECT 'weekday', CAST(g AS VARCHAR) FROM range(1, 8) t(g) UNION ALL SELECT 'hour', CAST(g AS VARCHAR) FROM range(0, 24) t(g))"""


@query(
    "baseline_coverage",
    f"""WITH {STATS}, {_EXPECTED}, g AS (SELECT DISTINCT {KEYS_SQL} FROM st),
o AS (SELECT {KEYS_SQL}, layer, coalesce(CAST(bucket_date AS VARCHAR), CAST(bucket_number AS VARCHAR), 'all') AS bucket, true AS there FROM st)
SELECT {KEYS_SQL}, layer, count(there) AS computed_keys, coalesce(array_to_string(list_sort(list(bucket) FILTER (there IS NULL)), ','), '') AS empty_keys
FROM g CROSS JOIN ek LEFT JOIN o USING ({KEYS_SQL}, layer, bucket) GROUP BY {KEYS_SQL}, layer""",
)
def baseline_coverage(spark, d):
    """AGG-16, JOI-08."""
    return baseline.coverage(base.build(spark, d), KEYS, *base.window_dates()).select(*KEYS, "layer", "computed_keys", F.array_join("empty_keys", ",").alias("empty_keys"))


@query(
    "baseline_timing_coverage",
    f"""WITH {STATS} SELECT t.timing_type, CAST(coalesce(sum(included_count), 0) AS BIGINT) AS included_count, CAST(coalesce(sum(excluded_count), 0) AS BIGINT) AS excluded_count
FROM (VALUES ('request'), ('parse'), ('bind'), ('execute_first'), ('execute_fetch')) t(timing_type) LEFT JOIN (SELECT * FROM st WHERE layer = 'overall') s USING (timing_type) GROUP BY t.timing_type""",
)
def baseline_timing_coverage(spark, d):
    """AGG-17."""
    return baseline.timing_coverage(base.build(spark, d))


@query("baseline_layer_counts", f"WITH {STATS} SELECT layer, count(*) AS rows, count(DISTINCT scope_id || '/' || database || '/' || timing_type) AS groups FROM st GROUP BY layer")
def baseline_layer_counts(spark, d):
    """AGG-18."""
    return baseline.layer_counts(base.build(spark, d), KEYS)


_TH = ", ".join(f"('{a}', {b}, {c}, {e}, {'NULL' if f is None else repr(f)}, {g})" for a, b, c, e, f, g in baseline.THRESHOLDS)
SUFFICIENT = (
    STATS
    + f""", th(layer, basic_count, p95_count, p99_count, covers, coverage_min) AS (VALUES {_TH}),
su AS (SELECT *, CASE covers WHEN 'active_days' THEN coalesce(len(active_dates), 0) WHEN 'active_weeks' THEN coalesce(len(active_weeks), 0) END AS have FROM st JOIN th USING (layer)),
sf AS (SELECT *, covers IS NULL OR have >= coverage_min AS covered FROM su)
"""
)


@query(
    "baseline_sufficiency",
    f"""WITH {SUFFICIENT} SELECT {KEYS_SQL}, {BUCKET_SQL}, """
    + ", ".join(
        f"included_count >= {n}_count AND covered AS {n}_met, array_to_string(list_filter([CASE WHEN included_count < {n}_count THEN 'sample_count' END, CASE WHEN NOT covered THEN covers END], lambda c: c IS NOT NULL), ',') AS {n}_reasons"
        for n in ("basic", "p95", "p99")
    )
    + ", CAST(have AS BIGINT) AS actual_coverage FROM sf",
)
def baseline_sufficiency(spark, d):
    """AGG-19, 20."""
    out = baseline.sufficiency(base.build(spark, d))
    cols = [c for n in ("basic", "p95", "p99") for c in (F.col(f"{n}.met").alias(f"{n}_met"), F.array_join(f"{n}.reasons", ",").alias(f"{n}_reasons"))]
    return out.select(*KEYS, *bucket(), *cols, F.col("basic.actual_coverage").alias("actual_coverage"))


@query(
    "eligibility_decisions",
    f"""WITH {DECISIONS} SELECT occurrence_id, in_window, array_to_string(reason_codes, ',') AS reason_codes, state, count_scope, group_id, array_to_string(template_ids, ',') AS template_ids,
array_to_string(interval_rules, ',') AS interval_rules, category_kind FROM d""",
)
def eligibility_decisions(spark, d):
    """ELI-05..09, JOI-01..03, TXT-09."""
    return base.decisions(spark, d).select(
        "occurrence_id", "in_window", F.array_join("reason_codes", ",").alias("reason_codes"), "state", "count_scope", "group_id", F.array_join("template_ids", ",").alias("template_ids"), F.array_join("interval_rules", ",").alias("interval_rules"), "category_kind"
    )


@query(
    "eligibility_details",
    f"""WITH {DECISIONS}, e AS (SELECT occurrence_id, unnest(reason_codes) AS code, template_ids, interval_rules, category_kind, outcome FROM d)
SELECT occurrence_id, code, CASE code WHEN 'blacklist_template' THEN array_to_string(template_ids, ',') WHEN 'excluded_interval' THEN array_to_string(interval_rules, ',') WHEN 'blacklist_category' THEN category_kind END AS evidence FROM e""",
)
def eligibility_details(spark, d):
    """ELI-10, first part."""
    return base.decisions(spark, d).select("occurrence_id", F.explode("reasons_detail").alias("x")).select("occurrence_id", "x.code", "x.evidence")


@query(
    "eligibility_rule_evaluations",
    f"""WITH {DECISIONS}, v AS (SELECT unnest([
 {{'rule': 'outcome', 'verdict': CASE WHEN outcome <> 'success' THEN 'matched' ELSE 'not_matched' END}},
 {{'rule': 'duration', 'verdict': CASE WHEN us IS NULL THEN 'matched' ELSE 'not_matched' END}},
 {{'rule': 'association', 'verdict': CASE WHEN association_state <> 'reliable' THEN 'matched' ELSE 'not_matched' END}},
 {{'rule': 'sql', 'verdict': CASE WHEN sql_state <> 'complete' THEN 'matched' ELSE 'not_matched' END}},
 {{'rule': 'category', 'verdict': CASE WHEN category_kind IN ('pure', 'mixed') THEN 'matched' WHEN category_kind <> 'unknown' THEN 'not_matched' ELSE 'not_evaluated' END}},
 {{'rule': 'template', 'verdict': CASE WHEN len(template_ids) > 0 THEN 'matched' WHEN fingerprint IS NOT NULL AND NOT template_unknown THEN 'not_matched' ELSE 'not_evaluated' END}},
 {{'rule': 'interval', 'verdict': CASE WHEN len(interval_rules) > 0 THEN 'matched' WHEN start_at IS NOT NULL THEN 'not_matched' ELSE 'not_evaluated' END}},
 {{'rule': 'window', 'verdict': CASE WHEN NOT in_window THEN 'matched' WHEN start_at IS NOT NULL THEN 'not_matched' ELSE 'not_evaluated' END}}]) AS s FROM d)
SELECT s.rule AS rule, s.verdict AS verdict, count(*) AS n FROM v GROUP BY ALL""",
)
def eligibility_rule_evaluations(spark, d):
    """ELI-10, second part, counted."""
    return base.decisions(spark, d).select(F.explode("rule_evaluations").alias("rule", "verdict")).groupBy("rule", "verdict").agg(F.count("*").alias("n"))


@query(
    "eligibility_summary",
    f"""WITH {DECISIONS}
SELECT 'state' AS label, state AS a, NULL::VARCHAR AS b, count(*) AS n FROM d GROUP BY ALL UNION ALL
SELECT 'timing', timing_type, state, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'scope', scope_id, state, count(*) FROM d GROUP BY ALL UNION ALL
SELECT 'reason', c, NULL, count(*) FROM (SELECT unnest(reason_codes) AS c FROM d) GROUP BY ALL UNION ALL
SELECT 'category', category_kind, NULL, count(*) FROM d GROUP BY ALL UNION ALL
SELECT 'template', c, NULL, count(*) FROM (SELECT unnest(template_ids) AS c FROM d) GROUP BY ALL UNION ALL
SELECT 'interval', c, NULL, count(*) FROM (SELECT unnest(interval_rules) AS c FROM d) GROUP BY ALL""",
)
def eligibility_summary(spark, d):
    """ELI-11, AGG-25."""
    return eligibility.decision_summary(base.decisions(spark, d))


@query(
    "eligibility_group_reasons",
    f"""WITH {DECISIONS}, gr AS (SELECT group_id, timing_type, state, unnest(list_concat([NULL::VARCHAR], reason_codes)) AS reason FROM d)
SELECT group_id, timing_type, state, reason, count(*) AS n FROM gr GROUP BY ALL""",
)
def eligibility_group_reasons(spark, d):
    """ELI-12."""
    return eligibility.group_reason_summary(base.decisions(spark, d))


@query(
    "eligibility_page",
    f"""WITH {DECISIONS}, w AS (SELECT c_custkey AS occurrence_id FROM customer)
SELECT CAST(w.occurrence_id AS BIGINT) AS occurrence_id, CASE WHEN d.state IS NOT NULL THEN d.state WHEN x.occurrence_id IS NULL THEN 'not_in_version_input' ELSE 'decision_unavailable' END AS answer
FROM w LEFT JOIN x USING (occurrence_id) LEFT JOIN (SELECT * FROM d WHERE in_window) d USING (occurrence_id)""",
)
def eligibility_page(spark, d):
    """ELI-13: keys are the customers' numbers; only decisions inside the window are at hand."""
    wanted = base.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("occurrence_id"))
    decisions = base.decisions(spark, d).where("in_window")
    return eligibility.decide_page(wanted, decisions, base.executions(spark, d), ["occurrence_id"]).select("occurrence_id", "answer")


_OBS = (
    DECISIONS
    + """, ap AS (SELECT DISTINCT sql_id, 'approx:' || sql_id AS approx_value FROM x WHERE CAST(substr(sql_id, 2) AS INTEGER) % 3 <> 0),
ob AS (SELECT d.*, approx_value, CASE WHEN in_window IS NOT DISTINCT FROM false THEN 'outside_window' WHEN list_contains(reason_codes, 'sql_missing') THEN 'sql_missing'
  WHEN approx_value IS NULL THEN 'approximate_unavailable' WHEN list_contains(reason_codes, 'identity_missing') THEN 'identity_missing' WHEN start_at IS NULL THEN 'start_unknown' ELSE 'group' END AS observation_scope,
  list_filter(reason_codes, lambda c: c NOT IN ('sql_missing', 'sql_incomplete', 'sql_invalid_encoding', 'sql_uncertain', 'fingerprint_failed')) AS others
  FROM d LEFT JOIN ap USING (sql_id) WHERE list_has_any(reason_codes, ['sql_missing', 'sql_incomplete', 'sql_invalid_encoding', 'sql_uncertain', 'fingerprint_failed']))
"""
)


def _observations(spark, d):
    occ = base.executions(spark, d)
    approx = occ.select("sql_id").distinct().where(F.substring("sql_id", 2, 9).cast("int") % 3 != 0).withColumn("approx_value", F.concat(F.lit("approx:"), "sql_id"))
    return eligibility.observation_candidates(base.decisions(spark, d), approx)


@query("observation_candidates", f"WITH {_OBS} SELECT occurrence_id, observation_scope, observation_scope = 'group' AND len(others) = 0 AS observed, approx_value FROM ob")
def observation_candidates(spark, d):
    """AGG-21."""
    return _observations(spark, d).select("occurrence_id", "observation_scope", "observed", "approx_value")


@query("observation_summary", f"WITH {_OBS} SELECT observation_scope, count(DISTINCT occurrence_id) AS executions, count(*) FILTER (observation_scope = 'group' AND len(others) = 0) AS observed FROM ob GROUP BY ALL")
def observation_summary(spark, d):
    """AGG-23."""
    return eligibility.observation_summary(_observations(spark, d))


@query(
    "observation_statistics",
    f"""WITH {_OBS}, s AS (SELECT approx_value, us, observation_scope = 'group' AND len(others) = 0 AS included, start_at + INTERVAL 8 HOURS AS l FROM ob WHERE observation_scope = 'group'),
lay AS (SELECT *, 'overall' AS layer, NULL AS bucket_number FROM s UNION ALL SELECT *, 'weekday', isodow(l) FROM s)
SELECT approx_value, layer, CAST(bucket_number AS BIGINT) AS bucket_number, count(*) FILTER (included) AS included_count, count(*) FILTER (NOT included) AS excluded_count,
round(quantile_cont(us, 0.5) FILTER (included) / 1000.0, 6) AS p50_ms, round(max(us) FILTER (included) / 1000.0, 6) AS max_ms FROM lay GROUP BY approx_value, layer, bucket_number""",
)
def observation_statistics(spark, d):
    """AGG-22: the same layers and metrics on approximate identities, apart from formal groups."""
    rows = _observations(spark, d).where("observation_scope = 'group'").select("approx_value", "start_at", "us", F.col("observed").alias("included"), F.col("reason_codes").alias("codes"))
    out = baseline.statistics(rows, ["approx_value"], *base.window_dates()).where("layer in ('overall', 'weekday')")
    return out.select("approx_value", "layer", F.col("bucket_number").cast("long").alias("bucket_number"), "included_count", "excluded_count", F.round("p50_ms", 6).alias("p50_ms"), F.round("max_ms", 6).alias("max_ms"))


@query(
    "baseline_new_groups",
    f"""WITH {DECISIONS}, f AS (SELECT group_id, min({{'a': analysis_id, 'o': occurrence_id}}) AS m FROM d WHERE group_id IS NOT NULL GROUP BY group_id)
SELECT group_id, m.a AS analysis_id, m.o AS occurrence_id FROM f WHERE group_id NOT IN (SELECT group_id FROM d WHERE group_id IS NOT NULL AND scope_id = 'C1')""",
)
def baseline_new_groups(spark, d):
    """AGG-24: groups of cluster C1 are known already."""
    decided = base.decisions(spark, d)
    return baseline.new_groups(decided, decided.where("scope_id = 'C1' and group_id is not null").select("group_id").distinct())


@query(
    "baseline_run_comparison",
    f"""WITH {STATS}, p AS (SELECT unnest([{", ".join(f"{{'metric': '{m}', 'x': CAST({m} AS DOUBLE), 'drift': {m} IS NOT NULL AND layer = 'hour'}}" for m in ("log_median", "log_mad"))}]) AS s FROM st)
SELECT s.metric AS metric, CAST(0 AS BIGINT) AS only_actual, CAST(0 AS BIGINT) AS only_expected, CAST(0 AS BIGINT) AS null_mismatches, count(*) FILTER (s.drift) AS exceeding FROM p GROUP BY s.metric""",
)
def baseline_run_comparison(spark, d):
    """AGG-26, JOI-11, SRC-16: a run against one whose hour layer drifted by 0.001."""
    stats = base.build(spark, d).select(*KEYS, *baseline.BUCKET, "log_median", "log_mad")
    drift = F.when(F.col("layer") == "hour", F.lit(0.001)).otherwise(F.lit(0.0))
    other = stats.withColumn("log_median", F.col("log_median") + drift).withColumn("log_mad", F.col("log_mad") + drift)
    return baseline.compare_runs(stats, other, [*KEYS, *baseline.BUCKET], ["log_median", "log_mad"]).drop("largest")
