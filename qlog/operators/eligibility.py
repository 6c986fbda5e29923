"""Training eligibility: every execution gets a state and ordered reason codes, as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qlog.functions import calendar as cal

CATEGORY_ALIASES = {"END": "COMMIT", "START TRANSACTION": "BEGIN", "ANALYSE": "ANALYZE"}
BLACKLIST = ["BEGIN", "COMMIT", "ROLLBACK", "SET", "SHOW", "ANALYZE", "VACUUM"]
#: Reasons that exclude; any other reason leaves an execution unresolved.
EXCLUDING = ["outcome_failed", "outcome_cancelled", "outcome_timed_out", "blacklist_category", "blacklist_template", "excluded_interval"]
SQL_REASONS = ["sql_missing", "sql_incomplete", "sql_invalid_encoding", "sql_uncertain", "fingerprint_failed"]


def classify_categories(categories: Column, blacklist: list[str] = BLACKLIST) -> Column:
    """TXT-09: pure, mixed, none or unknown, after folding aliases; null or empty categories are unknown."""
    folded = F.array_distinct(F.transform(categories, lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORY_ALIASES.items() for x in kv]), c), c)))
    hit = F.array_intersect(folded, F.lit(blacklist))
    rest = F.array_except(folded, F.lit(blacklist))
    return F.when(categories.isNull() | (F.size(categories) == 0), "unknown").when(F.size(hit) == 0, "none").when(F.size(rest) == 0, "pure").otherwise("mixed")


def exclusion_rules(occ: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-02: ``interval_rules``, sorted ids of intervals that an execution overlaps.

    ``intervals``: scope_id, starts, ends, rule_id. A zero duration counts as a point. Interval and
    execution meet through the local days they touch, an equi-join; intervals are expanded by day.
    """
    days = intervals.withColumn("_day", F.explode(F.sequence(cal.day(F.col("starts")), cal.day(F.col("ends")))))
    spread = occ.select(*keys, "scope_id", "start_at", "end_at").where("start_at is not null").withColumn("_day", F.explode(F.sequence(cal.day(F.col("start_at")), cal.day(F.col("end_at")))))
    point = F.col("start_at") == F.col("end_at")
    meets = F.when(point, (F.col("start_at") >= F.col("starts")) & (F.col("start_at") < F.col("ends"))).otherwise((F.col("start_at") < F.col("ends")) & (F.col("end_at") > F.col("starts")))
    hits = spread.join(days, ["scope_id", "_day"]).where(meets).groupBy(*keys).agg(F.array_sort(F.collect_set("rule_id")).alias("interval_rules"))
    return occ.join(hits, keys, "left").withColumn("interval_rules", F.coalesce("interval_rules", F.array().cast("array<string>")))


def template_rules(occ: DataFrame, templates: list[dict], keys: list[str]) -> DataFrame:
    """JOI-03: ``template_ids`` that apply, and ``template_unknown`` where that depends on a null identity.

    A template (id, fingerprint, and optionally scope_id, database, execution_user) applies where all it
    names are equal. Templates are configuration: they become one expression, not a join.
    """
    hit, doubt = [], []
    for t in templates:
        named = [c for c in ("scope_id", "database", "execution_user") if t.get(c) is not None]
        same = F.col("fingerprint") == t["fingerprint"]
        for c in named:
            same = same & (F.col(c) == t[c])
        hit.append(F.when(F.coalesce(same, F.lit(False)), F.lit(t["id"])))
        open_ = F.lit(False)
        wrong = F.lit(False)
        for c in named:
            open_ = open_ | F.col(c).isNull()
            wrong = wrong | F.coalesce(F.col(c) != t[c], F.lit(False))
        doubt.append(F.coalesce(F.col("fingerprint") == t["fingerprint"], F.lit(False)) & open_ & ~wrong)
    unknown = F.lit(False)
    for d in doubt:
        unknown = unknown | d
    ids = F.array_sort(F.array_compact(F.array(*hit))) if hit else F.array().cast("array<string>")
    return occ.withColumn("template_ids", ids).withColumn("template_unknown", unknown)


def decide(occ: DataFrame, window_start: Column, window_end: Column) -> DataFrame:
    """ELI-05..10: in_window, reason_codes, state, count_scope, group_id, details and rule evaluations.

    Needs outcome, us, association_state, timing_type, sql_state, fingerprint, scope_id, database,
    execution_user, start_at, category_kind, template_ids, template_unknown, interval_rules.
    """
    start = F.col("start_at")
    inside = (start >= window_start) & (start < window_end)
    code = lambda when, name: F.when(F.coalesce(when, F.lit(False)), F.lit(name))
    codes = F.array_compact(
        F.array(
            F.when(F.col("outcome") != "success", F.concat(F.lit("outcome_"), "outcome")),
            code(F.col("us").isNull(), "duration_unknown"),
            code(F.col("association_state") != "reliable", "association_unreliable"),
            code(F.col("timing_type").isNull(), "timing_unknown"),
            F.when(F.col("sql_state") != "complete", F.concat(F.lit("sql_"), "sql_state")),
            code((F.col("sql_state") == "complete") & F.col("fingerprint").isNull(), "fingerprint_failed"),
            code(F.col("database").isNull() | F.col("execution_user").isNull() | F.col("template_unknown"), "identity_missing"),
            code(start.isNull(), "start_unknown"),
            code(F.col("category_kind").isin("pure", "mixed"), "blacklist_category"),
            code(F.size("template_ids") > 0, "blacklist_template"),
            code(F.size("interval_rules") > 0, "excluded_interval"),
            code(~inside, "outside_window"),
        )
    )
    out = occ.withColumn("in_window", inside).withColumn("reason_codes", codes)
    state = (
        F.when(F.col("in_window").eqNullSafe(False), "outside_window")
        .when(F.arrays_overlap("reason_codes", F.lit(EXCLUDING)), "excluded")
        .when(F.size("reason_codes") > 0, "unresolved")
        .otherwise("included")
    )
    identity = F.array(*[F.col(c) for c in ("scope_id", "database", "execution_user", "fingerprint", "timing_type")])
    known = F.forall(identity, lambda x: x.isNotNull()) & (F.col("association_state") == "reliable")
    out = out.withColumn("state", state).withColumn("group_id", F.when(known, F.concat(F.lit("G:"), F.sha2(F.to_json(identity), 256))))
    scope = F.when(F.col("in_window").eqNullSafe(False), "none").when(F.col("group_id").isNotNull() & start.isNotNull(), "group").otherwise("batch")
    evidence = lambda c: F.when(c == "blacklist_template", F.array_join("template_ids", ",")).when(c == "excluded_interval", F.array_join("interval_rules", ",")).when(c == "blacklist_category", F.col("category_kind"))
    details = F.transform("reason_codes", lambda c: F.struct(c.alias("code"), evidence(c).alias("evidence")))
    has = lambda c: F.array_contains("reason_codes", c)
    verdict = lambda hit, known: F.when(hit, "matched").when(known, "not_matched").otherwise("not_evaluated")
    rules = F.create_map(
        F.lit("outcome"), verdict(F.col("outcome") != "success", F.col("outcome").isNotNull()),
        F.lit("duration"), verdict(has("duration_unknown"), F.lit(True)),
        F.lit("association"), verdict(has("association_unreliable"), F.col("association_state").isNotNull()),
        F.lit("sql"), verdict(F.col("sql_state") != "complete", F.col("sql_state").isNotNull()),
        F.lit("category"), verdict(has("blacklist_category"), F.col("category_kind") != "unknown"),
        F.lit("template"), verdict(has("blacklist_template"), F.col("fingerprint").isNotNull() & ~F.col("template_unknown")),
        F.lit("interval"), verdict(has("excluded_interval"), start.isNotNull()),
        F.lit("window"), verdict(has("outside_window"), start.isNotNull()),
    )
    return out.withColumn("count_scope", scope).withColumn("reasons_detail", details).withColumn("rule_evaluations", rules)


def decision_summary(decisions: DataFrame) -> DataFrame:
    """ELI-11: counts by state, timing and state, scope and state, reason, category, template, interval: (label, a, b, n)."""

    def count(label: str, a: Column, b: Column, rows: DataFrame = decisions) -> DataFrame:
        return rows.groupBy(a.cast("string").alias("a"), b.cast("string").alias("b")).agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "a", "b", "n")

    none = F.lit(None)
    each = lambda c: decisions.select(F.explode(c).alias("x"))
    parts = [
        count("state", F.col("state"), none),
        count("timing", F.col("timing_type"), F.col("state")),
        count("scope", F.col("scope_id"), F.col("state")),
        count("reason", F.col("x"), none, each("reason_codes")),
        count("category", F.col("category_kind"), none),
        count("template", F.col("x"), none, each("template_ids")),
        count("interval", F.col("x"), none, each("interval_rules")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_reason_summary(decisions: DataFrame) -> DataFrame:
    """ELI-12: per group, timing and state the count (reason null) and one row for each reason."""
    reasons = F.concat(F.array(F.lit(None).cast("string")), "reason_codes")
    return decisions.select("group_id", "timing_type", "state", F.explode(reasons).alias("reason")).groupBy("group_id", "timing_type", "state", "reason").agg(F.count("*").alias("n"))


def decide_page(wanted: DataFrame, decisions: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """ELI-13: decision of each wanted key; not_in_version_input or decision_unavailable where there is none."""
    known = inputs.select(*keys).distinct().withColumn("_in", F.lit(True))
    got = wanted.join(known, keys, "left").join(decisions.select(*keys, "state", "reason_codes"), keys, "left")
    return got.withColumn("answer", F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("_in").isNull(), "not_in_version_input").otherwise("decision_unavailable")).drop("_in")


def select_batches(batches: DataFrame, files: DataFrame, window_start: Column) -> DataFrame:
    """ELI-01: completed batches with a successful file that may reach into the window; all completed ones if there is none (``fallback``)."""
    done = batches.where("state = 'complete'")
    reach = files.where((F.col("state") == "succeeded") & (F.col("last_log_at").isNull() | (F.col("last_log_at") >= window_start))).select("batch_id").distinct().withColumn("_hit", F.lit(1))
    marked = done.join(reach, "batch_id", "left")
    any_hit = marked.agg(F.max("_hit").alias("_any"))
    return marked.crossJoin(F.broadcast(any_hit)).where("_hit = 1 or _any is null").withColumn("fallback", F.col("_any").isNull()).drop("_hit", "_any")


def freeze_input(files: DataFrame, digits: int = 3) -> DataFrame:
    """ELI-02: one row an input file with its interpretation, how many it has, its bucket, the bucket's digest and the manifest's.

    A tree of digests: files fall into buckets by the first hex ``digits`` of their id's hash, a bucket's digest is over
    its files' sorted lines, the manifest's over its buckets' sorted lines. No row lists all ids, and comparing two
    manifests bucket by bucket (``changed_buckets``) tells where they differ.
    """
    one = files.where("state = 'succeeded'").groupBy("file_id").agg(F.count_distinct("analysis_id").alias("interpretations"), F.min("analysis_id").alias("analysis_id"))
    one = one.withColumn("bucket", F.left(F.sha2(F.col("file_id").cast("string"), 256), F.lit(digits)))
    over = lambda *line: F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *line))), ","), 256)
    parts = one.groupBy("bucket").agg(over("file_id", "analysis_id").alias("bucket_digest"))
    root = parts.agg(over("bucket", "bucket_digest").alias("digest"))
    return one.join(parts, "bucket").crossJoin(F.broadcast(root)).withColumn("valid", F.col("interpretations") == 1)


def changed_buckets(old: DataFrame, new: DataFrame) -> DataFrame:
    """ELI-02: buckets of two manifests (``freeze_input``) whose files differ."""
    a, b = old.select("bucket", F.col("bucket_digest").alias("a")).distinct(), new.select("bucket", F.col("bucket_digest").alias("b")).distinct()
    return a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def text_rules(texts: DataFrame, cached: DataFrame, templates: DataFrame) -> DataFrame:
    """ELI-04: category class and matching template ids of texts that the rule version has not seen."""
    fresh = texts.join(cached.select("sql_id"), "sql_id", "left_anti").withColumn("category_kind", classify_categories(F.col("categories")))
    ids = fresh.join(templates.select("fingerprint", "template_id"), "fingerprint").groupBy("sql_id").agg(F.array_sort(F.collect_set("template_id")).alias("template_ids"))
    return fresh.join(ids, "sql_id", "left").withColumn("template_ids", F.coalesce("template_ids", F.array().cast("array<string>")))


def observation_candidates(decisions: DataFrame, approx: DataFrame) -> DataFrame:
    """AGG-21: executions with doubt about their text or fingerprint, their approximate identity and how they count.

    ``approx``: sql_id, approx_value. Scope: outside_window, sql_missing, approximate_unavailable,
    identity_missing, start_unknown or group; ``observed`` if nothing else speaks against the execution.
    """
    doubt = decisions.where(F.arrays_overlap("reason_codes", F.lit(SQL_REASONS))).join(approx, "sql_id", "left")
    others = F.array_except("reason_codes", F.lit(SQL_REASONS))
    scope = (
        F.when(F.col("in_window").eqNullSafe(False), "outside_window")
        .when(F.array_contains("reason_codes", "sql_missing"), "sql_missing")
        .when(F.col("approx_value").isNull(), "approximate_unavailable")
        .when(F.array_contains("reason_codes", "identity_missing"), "identity_missing")
        .when(F.col("start_at").isNull(), "start_unknown")
        .otherwise("group")
    )
    key = F.to_json(F.array("scope_id", "database", "execution_user", "approx_value", "timing_type"))
    return doubt.withColumn("observation_scope", scope).withColumn("observed", (F.col("observation_scope") == "group") & (F.size(others) == 0)).withColumn("observation_group", F.when(F.col("observation_scope") == "group", F.concat(F.lit("OG:"), F.sha2(key, 256))))


def observation_summary(candidates: DataFrame) -> DataFrame:
    """AGG-23: distinct executions of each observation scope."""
    return candidates.groupBy("observation_scope").agg(F.count_distinct("analysis_id", "occurrence_id").alias("executions"), F.count_if("observed").alias("observed"))
