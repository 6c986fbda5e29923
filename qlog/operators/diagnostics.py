"""Quality and version diagnostics, and run monitoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.operators.baseline import null_safe
from qlog.operators.order import first_rows, numbered


def input_census(rows: DataFrame) -> DataFrame:
    """DIA-01: per cluster, field and state: distinct inputs, occurrences, longest text, up to five examples.

    ``rows``: scope_id, field, input_id, n (occurrences), state, text.
    """
    per = rows.groupBy("scope_id", "field", "input_id", "state").agg(F.sum("n").alias("n"), F.max(F.length("text")).alias("longest"))
    by = ["scope_id", "field", "state"]
    sums = per.groupBy(*by).agg(F.count("*").alias("inputs"), F.sum("n").alias("occurrences"), F.max("longest").alias("longest"))
    few = first_rows(per.select(*by, "input_id"), by, ["input_id"], 5, "place")
    return null_safe(sums, few.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("input_id")), ",").alias("examples")), by)


def daily_census(rows: DataFrame, cut_bytes: int = 1023) -> DataFrame:
    """DIA-02: per cluster, and per cluster and day: occurrences, distinct inputs, cut texts. ``rows``: scope_id, day, input_id, n, bytes."""
    rows.createOrReplaceTempView("_daily_census")
    return rows.sparkSession.sql(
        f"""SELECT scope_id, day, sum(n) AS occurrences, count(DISTINCT input_id) AS inputs, count(DISTINCT CASE WHEN bytes = {int(cut_bytes)} THEN input_id END) AS cut_inputs
        FROM _daily_census GROUP BY GROUPING SETS ((scope_id), (scope_id, day))"""
    )


def failure_groups(results: DataFrame, old: DataFrame) -> DataFrame:
    """DIA-03: failures by reason and features: inputs, occurrences, how many were fine before, byte-length class of each."""
    was = old.where("state = 'reliable'").select("input_id").distinct().withColumn("_ok", F.lit(1))
    size = F.floor(F.log2(F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    return results.where("state <> 'reliable'").join(was, "input_id", "left").groupBy("reason", "features", size.alias("log2_bytes")).agg(F.count_distinct("input_id").alias("inputs"), F.sum("n").alias("occurrences"), F.count("_ok").alias("regressed"))


def compare_partitions(both: DataFrame) -> DataFrame:
    """DIA-04: (measure, n): merged and split groups, reliable inputs of either version, inputs in merged groups, state changes.

    ``both``: input_id, old_fp, new_fp (null: not reliable), n (occurrences).
    """
    merged = both.where("new_fp is not null and old_fp is not null").groupBy("new_fp").agg(F.count_distinct("old_fp").alias("k"), F.count_distinct("input_id").alias("inputs"), F.sum("n").alias("occ")).where("k > 1")
    split = both.where("new_fp is not null and old_fp is not null").groupBy("old_fp").agg(F.count_distinct("new_fp").alias("k")).where("k > 1")
    state = lambda c: F.when(F.col(c).isNull(), "refused").otherwise("reliable")
    moves = both.groupBy(F.concat(F.lit("transition:"), state("old_fp"), F.lit(">"), state("new_fp")).alias("measure")).agg(F.count("*").alias("n"))
    one = lambda df, name, agg: df.agg(F.coalesce(agg, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = [
        one(merged, "merged_groups", F.count("*")), one(merged, "merged_inputs", F.sum("inputs")), one(merged, "merged_occurrences", F.sum("occ")), one(split, "split_groups", F.count("*")),
        one(both, "reliable_old", F.count("old_fp")), one(both, "reliable_new", F.count("new_fp")), moves,
    ]
    return reduce(DataFrame.unionByName, parts)


def merge_categories(both: DataFrame, stages: list[str]) -> DataFrame:
    """DIA-05: merged groups by the first stage fingerprint (in order) that alone explains the merge."""
    merged = both.where("new_fp is not null and old_fp is not null").groupBy("new_fp").agg(F.count_distinct("old_fp").alias("k"), *[F.count_distinct(s).alias(f"_{s}") for s in stages]).where("k > 1")
    label: Column = F.lit("other")
    for s in reversed(stages):
        label = F.when(F.col(f"_{s}") == 1, s).otherwise(label)
    return merged.groupBy(label.alias("category")).agg(F.count("*").alias("groups"))


def replay_outcome(both: DataFrame) -> DataFrame:
    """DIA-12: inputs by what a second run made of them."""
    o, n = F.col("old_state") == "reliable", F.col("new_state") == "reliable"
    what = (
        F.when(o & n, F.when(F.col("old_fp") == F.col("new_fp"), "same_structure").otherwise("changed_structure"))
        .when(o, "regressed_state")
        .when(n, "repaired")
        .when(F.col("old_state") != F.col("new_state"), "changed_failure_state")
        .when(F.col("old_reason").eqNullSafe(F.col("new_reason")), "same_failure")
        .otherwise("changed_failure_reason")
    )
    return both.groupBy(what.alias("outcome")).agg(F.count("*").alias("inputs"))


def duration_samples(records: DataFrame) -> DataFrame:
    """DIA-06: one row a duration: text (first of the three fields that is filled), cluster, hashed names, site, day, ms."""
    text = F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("sql", "inline_sql", "internal_sql")])
    return records.where("us is not null").select(text.alias("text"), "scope_id", F.sha2("database", 256).alias("database_hash"), F.sha2("execution_user", 256).alias("user_hash"), "site", "day", (F.col("us") / 1000.0).alias("ms"))


def threshold_groups(samples: DataFrame, keys: list[str], limits: list[int], least_days: int = 7) -> DataFrame:
    """DIA-07, DIA-10: per scheme and limit: groups and samples with at least so many samples and days, and their share of all samples."""
    total = samples.groupBy("scheme").agg(F.count("*").alias("all_samples"), F.count("fp").alias("with_fp"))
    groups = samples.where("fp is not null").groupBy("scheme", *keys, "fp").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))
    each = groups.select("scheme", "n", "days", F.explode(F.lit(limits)).alias("least"))
    ok = (F.col("n") >= F.col("least")) & (F.col("days") >= least_days)
    out = each.groupBy("scheme", "least").agg(F.count_if(ok).alias("groups"), F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("samples")).join(F.broadcast(total), "scheme")  # a row a scheme
    return out.withColumn("share_all", F.round(F.try_divide("samples", "all_samples"), 6)).withColumn("share_fp", F.round(F.try_divide("samples", "with_fp"), 6))


def median_ratios(samples: DataFrame, sub: str, least: int = 5) -> DataFrame:
    """DIA-08, DIA-09: groups with at least two subgroups of ``least`` samples by the ratio of their largest to their smallest median."""
    values = samples.where("fp is not null").groupBy("fp", sub, "ms").agg(F.count("*").alias("k"))  # a frequent group shrinks before its median
    med = values.groupBy("fp", sub).agg(F.sum("k").alias("n"), F.percentile("ms", F.lit(0.5), F.col("k")).alias("m")).where(F.col("n") >= least)
    groups = med.groupBy("fp").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("m").alias("hi"), F.min("m").alias("lo")).where("k >= 2")
    ratio = F.when((F.col("hi") == 0) & (F.col("lo") == 0), F.lit(1.0)).otherwise(F.try_divide("hi", "lo"))
    bucket = F.when(ratio <= 2, "<=2").when(ratio <= 5, "2-5").when(ratio <= 10, "5-10").otherwise(">10")
    return groups.groupBy(bucket.alias("ratio")).agg(F.count("*").alias("groups"), F.sum("n").alias("samples"))


def encoding_audit(texts: DataFrame, every: int = 128) -> DataFrame:
    """DIA-11: texts that are no valid UTF-8 or hold NUL, by cluster, and an even sample of about ``every`` of them. ``texts``: scope_id, input_id, content (binary), n."""
    bad = texts.where(~F.is_valid_utf8(F.col("content").cast("string")) | F.contains("content", F.lit(b"\0")))
    rows = numbered(bad.select("scope_id", "input_id", "n"), ["scope_id"], ["input_id"])
    # the first of each of ``every`` runs of equal length, the longer ones first
    size, longer = F.floor(F.col("total") / every), F.col("total") % every
    edge = longer * (size + 1)
    first = F.when(F.col("place") < edge, F.col("place") % (size + 1) == 0).otherwise((F.col("place") - edge) % F.greatest(size, F.lit(1)) == 0)
    return rows.withColumn("sampled", first).groupBy("scope_id").agg(F.count("*").alias("inputs"), F.sum("n").alias("occurrences"), F.count_if("sampled").alias("sampled"))


def new_shapes(shapes: DataFrame, known: DataFrame) -> DataFrame:
    """DIA-13: the first text of every shape that is not known."""
    return shapes.join(known.select("shape"), "shape", "left_anti").groupBy("shape").agg(F.min("sql_id").alias("sql_id"), F.count("*").alias("texts"))


def stable_ids(rows: DataFrame, owner: list[str], order: list[str], id_: str) -> DataFrame:
    """DIA-14: a run-independent key: the row's number within its owner."""
    n = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
    return rows.select(id_, F.concat_ws(":", *[F.col(c).cast("string") for c in owner], n.cast("string")).alias("stable_id"))


def sample_groups(stats: DataFrame, seed: str, n: int) -> DataFrame:
    """DIA-15: ``n`` groups in hash order, the largest, a single-sample one and one with exclusions."""
    overall = stats.where("layer = 'overall'").select("group_id", "included_count", "excluded_count")
    top = lambda df, *order: df.orderBy(*order, "group_id").limit(1).select("group_id")
    picked = overall.orderBy(F.md5(F.concat(F.lit(seed), "group_id")), "group_id").limit(n).select("group_id")
    return picked.union(top(overall, F.desc("included_count"))).union(top(overall.where("included_count = 1"))).union(top(overall.where("excluded_count > 0"))).distinct()


def representative_identities(records: DataFrame, by: list[str]) -> DataFrame:
    """DIA-16: per cluster the first identity by events, by texts, by slowest and by recency."""
    own = records.groupBy(*by).agg(F.count("*").alias("events"), F.count_distinct("sql_id").alias("texts"), F.max("us").alias("slowest"), F.max("end_at").alias("last_at"))
    orders = {"events": F.desc("events"), "texts": F.desc("texts"), "slowest": F.desc_nulls_last("slowest"), "last_at": F.desc("last_at")}
    for name, o in orders.items():
        own = own.withColumn(f"_{name}", F.row_number().over(Window.partitionBy("scope_id").orderBy(o, *by)))
    why = F.array_compact(F.array(*[F.when(F.col(f"_{n}") == 1, n) for n in orders]))
    return own.where(F.least(*[F.col(f"_{n}") for n in orders]) == 1).select(*by, "events", "texts", "slowest", F.array_join(why, ",").alias("first_by"))


# --- runs, problems, freshness -------------------------------------------------------------------


def runs(all_runs: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """OPS-01: state of runs; one that says running without an owner is unfinished."""
    alive = heartbeats.select("run_id").distinct().withColumn("_a", F.lit(True))
    out = all_runs.join(alive, "run_id", "left")
    return out.withColumn("shown_state", F.when((F.col("state") == "running") & F.col("_a").isNull(), "unfinished").otherwise(F.col("state"))).drop("_a")


def open_problems(examined: DataFrame, problems: DataFrame, cluster_runs: DataFrame, now: Column, quiet_days: int) -> DataFrame:
    """OPS-02: per day the problems of the newest run that examined it, and clusters whose newest run was skipped, did not finish or has no recent success.

    ``examined``: scope_id, day, run_id, at; ``problems``: run_id, scope_id, day, code; ``cluster_runs``: scope_id, run_id, at, state.
    """
    newest = examined.groupBy("scope_id", "day").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))
    by_day = problems.join(newest, ["scope_id", "day", "run_id"]).select("scope_id", "day", "code")
    last = cluster_runs.groupBy("scope_id").agg(F.max_by("state", F.struct("at", "run_id")).alias("state"), F.max(F.when(F.col("state") == "succeeded", F.col("at"))).alias("ok"))
    none = F.lit(None).cast("string")
    skipped = last.where("state = 'skipped'").select("scope_id", none.alias("day"), F.lit("cluster_skipped").alias("code"))
    open_ = last.where("state = 'running'").select("scope_id", none.alias("day"), F.lit("run_not_finished").alias("code"))
    quiet = last.where(F.col("ok").isNull() | (F.col("ok") < now - F.make_dt_interval(F.lit(quiet_days)))).select("scope_id", none.alias("day"), F.lit("no_recent_success").alias("code"))
    return by_day.unionByName(skipped).unionByName(open_).unionByName(quiet)


def cluster_status(days: DataFrame, current: DataFrame, problems: DataFrame) -> DataFrame:
    """OPS-03: newest imported day, current build and publish time, open problems of each cluster."""
    own = days.groupBy("scope_id").agg(F.max("day").alias("newest_day"))
    n = problems.groupBy("scope_id").agg(F.count("*").alias("problems"))
    return own.join(current, "scope_id", "left").join(n, "scope_id", "left").withColumn("problems", F.coalesce("problems", F.lit(0)))


def recent_runs(cluster_runs: DataFrame, days: DataFrame, limit: int) -> DataFrame:
    """OPS-04: newest runs of each cluster with their imported and failed days and sums."""
    n = F.row_number().over(Window.partitionBy("scope_id").orderBy(F.desc("at"), F.desc("run_id")))
    top = cluster_runs.withColumn("n", n).where(F.col("n") <= limit)
    ok = lambda s: F.array_sort(F.collect_list(F.when(F.col("day_state") == s, F.col("day"))))
    few = days.join(F.broadcast(top.select("run_id", "scope_id")), ["run_id", "scope_id"], "left_semi")  # ``limit`` runs a cluster
    own = few.groupBy("run_id", "scope_id").agg(ok("imported").alias("imported_days"), ok("failed").alias("failed_days"), F.sum("records").alias("records"))
    return top.join(own, ["run_id", "scope_id"], "left")


def last_run(cluster_runs: DataFrame) -> DataFrame:
    """OPS-05: newest run, its state, and the last success."""
    return cluster_runs.agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"), F.max_by("state", F.struct("at", "run_id")).alias("state"), F.max(F.when(F.col("state") == "succeeded", F.col("at"))).alias("last_success"))


def status_document(status: DataFrame, problems: DataFrame) -> DataFrame:
    """OPS-08: one JSON document a cluster: its status with nested problems."""
    nested = problems.groupBy("scope_id").agg(F.array_sort(F.collect_list(F.struct("code", F.coalesce("day", F.lit("")).alias("day")))).alias("problem_list"))
    out = status.join(nested, "scope_id", "left")
    return out.select("scope_id", F.to_json(F.struct("newest_day", "problems", "problem_list")).alias("document"))


def isolation_counts(problems: DataFrame, inputs: DataFrame) -> DataFrame:
    """STF-07: isolated records by code in the current version's files."""
    return problems.join(inputs.select("file_id").distinct(), "file_id", "left_semi").groupBy("code").agg(F.sum("records").alias("records"))
