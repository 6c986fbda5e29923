"""Execution facts and totals, publication checks, versions and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.operators.baseline import null_safe
from qlog.operators.builds import Builds  # noqa: F401

IDENTITY = ["fingerprint", "scope_id", "database", "execution_user"]


def identity_key(cols: list[str] = IDENTITY) -> Column:
    """Key of an identity whose parts may be null: a hash of the parts and of which are null."""
    return F.xxhash64(F.concat_ws("", *[F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c), F.lit("")), F.lit("\u0001")) for c in cols]))


def membership(fingerprints: DataFrame) -> DataFrame:
    """FCT-03: text to structure, reliable fingerprints only."""
    return fingerprints.where("state = 'reliable'").select("rule_id", "sql_id", F.col("value").alias("fingerprint"))


def structures(members: DataFrame) -> DataFrame:
    """FCT-02: number of texts and the smallest text id of each fingerprint."""
    return members.groupBy("rule_id", "fingerprint").agg(F.count_distinct("sql_id").alias("text_count"), F.min("sql_id").alias("example_sql_id"))


def query_records(occ: DataFrame, members: DataFrame) -> DataFrame:
    """FCT-01: one narrow row an execution and rule, with its identity key."""
    own = occ.drop("fingerprint").join(members, "sql_id")
    return own.withColumn("identity_key", identity_key()).select(
        "rule_id", "identity_key", *IDENTITY, "sql_id", "analysis_id", "occurrence_id", "end_at", "start_at", "us", "timing_type", "outcome", "unit", "request_shape"
    )


def identities(records: DataFrame) -> DataFrame:
    """FCT-04: distinct identities; null parts stay null."""
    return records.select("rule_id", "identity_key", *IDENTITY).distinct()


def identity_totals(records: DataFrame) -> DataFrame:
    """FCT-05."""
    return records.groupBy("rule_id", "identity_key", "timing_type").agg(
        F.count("*").alias("record_count"), F.count_if(F.col("outcome") == "success").alias("success_count"), F.min("end_at").alias("first_at"), F.max("end_at").alias("last_at")
    )


def text_totals(records: DataFrame) -> DataFrame:
    """FCT-06."""
    return records.groupBy("rule_id", "sql_id", "identity_key").agg(F.count("*").alias("record_count"), F.min("end_at").alias("first_at"), F.max("end_at").alias("last_at"))


def name_counts(occ: DataFrame) -> DataFrame:
    """FCT-07: rows by database name and by user name."""
    names = occ.select("analysis_id", F.explode(F.array(F.struct(F.lit("database").alias("kind"), F.col("database").alias("name")), F.struct(F.lit("user").alias("kind"), F.col("execution_user").alias("name")))).alias("x"))
    return names.select("analysis_id", "x.*").where("name is not null").groupBy("analysis_id", "kind", "name").agg(F.count("*").alias("n"))


def fingerprint_progress(texts: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """FCT-08: texts, texts with a fingerprint and texts without, for each rule."""
    total = texts.agg(F.count_distinct("sql_id").alias("text_count"))
    own = fingerprints.groupBy("rule_id").agg(F.count_distinct("sql_id").alias("fingerprint_count"))
    return own.crossJoin(F.broadcast(total)).withColumn("missing", F.col("text_count") - F.col("fingerprint_count"))


def audit(cases: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """FCT-09: per case how many rows are in only one of (expected, actual), repeats counted."""
    parts = []
    for name, (expected, actual) in cases.items():
        tagged = expected.withColumn("_d", F.lit(1)).unionByName(actual.withColumn("_d", F.lit(-1)))
        parts.append(tagged.groupBy(*expected.columns).agg(F.sum("_d").alias("_d")).agg(F.coalesce(F.sum(F.abs("_d")), F.lit(0)).alias("n")).select(F.lit(name).alias("case"), "n"))
    return reduce(DataFrame.unionByName, parts)


def publication_checks(stats: DataFrame, required: DataFrame, keys: list[str], files_open: DataFrame, rules: DataFrame) -> DataFrame:
    """FCT-10: six checks of a build, each passed or failed with a reason.

    ``required``: groups (keys, included, excluded) that the decisions ask for; ``files_open``: input files
    that did not succeed; ``rules``: rule versions in use (one is right).
    """
    per = stats.groupBy(*keys, "layer").agg(F.sum("included_count").alias("i"), F.sum("excluded_count").alias("e"))
    spread = per.groupBy(*keys).agg(F.max("i").alias("i_hi"), F.min("i").alias("i_lo"), F.max("e").alias("e_hi"), F.min("e").alias("e_lo"), F.count("*").alias("layers"))
    groups = null_safe(required.withColumn("_want", F.lit(1)), spread, keys)
    extra = null_safe(spread.select(*keys), required.select(*keys).withColumn("_want", F.lit(1)), keys).where("_want is null")
    sane = (F.col("included_count") >= 0) & (F.col("excluded_count") >= 0) & F.coalesce((F.col("min_ms") <= F.col("p50_ms")) & (F.col("p50_ms") <= F.col("p95_ms")) & (F.col("p95_ms") <= F.col("max_ms")), F.col("included_count") == 0)
    bad = lambda df: df.agg(F.count("*").alias("n"))
    checks = [
        ("batch_complete", bad(files_open), "input_file_not_succeeded"),
        ("rules_consistent", rules.distinct().agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n")), "several_rule_versions"),
        ("results_complete", bad(groups.where("layers is null")), "group_missing"),
        ("results_saved", bad(extra), "group_not_required"),
        ("counts_consistent", bad(groups.where("layers is not null and (layers <> 5 or i_hi <> i_lo or e_hi <> e_lo or i_hi <> included or e_hi <> excluded)")), "layer_sums_differ"),
        ("values_consistent", bad(stats.where(~F.coalesce(sane, F.lit(False)))), "metric_order"),
    ]
    parts = [df.select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "passed").otherwise("failed").alias("state"), F.when(F.col("n") > 0, reason).alias("reason"), F.col("n").cast("long").alias("failures")) for name, df, reason in checks]
    return reduce(DataFrame.unionByName, parts)


def publication_result(checks: DataFrame, stats: DataFrame) -> DataFrame:
    """FCT-11: published, no_samples or check_failed; the row to append to the publication log."""
    failed = checks.agg(F.count_if(F.col("state") == "failed").alias("failed"))
    samples = stats.where("layer = 'overall'").agg(F.coalesce(F.sum("included_count"), F.lit(0)).alias("samples"))
    return failed.crossJoin(F.broadcast(samples)).withColumn("result", F.when(F.col("failed") > 0, "check_failed").when(F.col("samples") == 0, "no_samples").otherwise("published"))


def current_versions(log: DataFrame) -> DataFrame:
    """FCT-11: the newest published build of each cluster."""
    return log.where("result = 'published'").groupBy("scope_id").agg(F.max_by("build_id", F.struct("at", "build_id")).alias("build_id"), F.max("at").alias("published_at"))


def version_history(log: DataFrame, cleaned: DataFrame, limit: int) -> DataFrame:
    """FCT-12, QRY-04: the last ``limit`` results of each cluster, newest first, which one is current, which are cleaned, which a reader may use."""
    current = current_versions(log).select("scope_id", F.col("build_id").alias("_current"))
    rows = log.join(current, "scope_id", "left").join(cleaned.select("build_id").distinct().withColumn("_c", F.lit(True)), "build_id", "left")
    rows = rows.withColumn("is_current", F.coalesce(F.col("build_id") == F.col("_current"), F.lit(False)) & (F.col("result") == "published")).withColumn("cleaned", F.coalesce("_c", F.lit(False)))
    rows = rows.withColumn("unusable", F.when(F.col("result") != "published", "published_version_not_found").when(F.col("cleaned"), "results_cleaned"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("at"), F.desc("build_id"))))
    return rows.where(F.col("n") <= limit).drop("_current", "_c")


def retention_preview(builds: DataFrame, log: DataFrame, cleaned: DataFrame, months: int, now: tuple[int, int]) -> DataFrame:
    """FCT-13: each month of each cluster: cleaned, protected (holds the current build), expired or retained; builds and bytes."""
    current = current_versions(log).select(F.col("build_id").alias("_cur"))
    pub = log.where("result = 'published'").select("build_id").distinct().withColumn("_p", F.lit(1))
    gone = cleaned.select("build_id").distinct().withColumn("_g", F.lit(1))
    rows = builds.join(pub, "build_id", "left").join(gone, "build_id", "left").join(current, F.col("build_id") == F.col("_cur"), "left")
    by = rows.groupBy("scope_id", "year", "month").agg(
        F.count("_p").alias("published"), F.count_if(F.col("_p").isNull()).alias("unpublished"), F.sum("bytes").alias("bytes"), F.count("_cur").alias("_k"), F.count_if(F.col("_g").isNull()).alias("_left")
    )
    age = (now[0] * 12 + now[1]) - (F.col("year") * 12 + F.col("month"))
    state = F.when(F.col("_left") == 0, "cleaned").when(F.col("_k") > 0, "protected").when(age > months, "expired").otherwise("retained")
    return by.withColumn("state", state).drop("_k", "_left")


def drop_expired(stats: DataFrame, preview: DataFrame) -> DataFrame:
    """FCT-14: statistics without those of expired months."""
    expired = preview.where("state = 'expired'").select("scope_id", "year", "month")
    return stats.join(expired, ["scope_id", "year", "month"], "left_anti")


def import_breakdown(runs: DataFrame, days: DataFrame) -> DataFrame:
    """FCT-15: attempts of each day numbered, and a run's stage seconds that no day accounts for."""
    numbered = days.withColumn("attempt", F.row_number().over(Window.partitionBy("scope_id", "day").orderBy("run_id")))
    spent = days.groupBy("run_id").agg(F.sum("seconds").alias("day_seconds"))
    return numbered.join(runs.select("run_id", "stage_seconds"), "run_id", "left").join(spent, "run_id", "left").withColumn("other_seconds", F.col("stage_seconds") - F.col("day_seconds"))


def reconcile(stored: DataFrame, rescanned: DataFrame) -> DataFrame:
    """FCT-16: (file_id, metric) whose counts differ between store and rescan, with both values."""
    a, b = stored.withColumnRenamed("n", "stored"), rescanned.withColumnRenamed("n", "rescanned")
    return a.join(b, ["file_id", "metric"], "full_outer").where(~F.col("stored").eqNullSafe(F.col("rescanned")))


