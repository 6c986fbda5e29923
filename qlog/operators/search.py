"""Query operators on facts, texts and baselines: search, history, timelines, comparison, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.functions import exchange
from qlog.functions import text as tx
from qlog.operators.baseline import METRICS, TIMINGS, null_safe
from qlog.operators.tables import written
from qlog.operators.textindex import TextIndex

TIMING_ORDER = [*TIMINGS, "unknown"]


def identity_filter(df: DataFrame, exact: bool = False, **values: object) -> DataFrame:
    """PRJ-13: equality filters that are given; with ``exact`` a given None matches null."""
    for name, v in values.items():
        if exact:
            df = df.where(F.col(name).eqNullSafe(F.lit(v)))
        elif v is not None:
            df = df.where(F.col(name) == v)
    return df


def time_filter(df: DataFrame, start: Column | None, end: Column | None, at: str = "end_at") -> DataFrame:
    """PRJ-14: half-open range."""
    if start is not None:
        df = df.where(F.col(at) >= start)
    return df.where(F.col(at) < end) if end is not None else df


def query_facts(records: DataFrame, start=None, end=None, timings: list[str] | None = None, sql_id: str | None = None, exact: bool = False, **identity: object) -> DataFrame:
    """QRY-01..03: filtered facts; start and duration are hidden where the timing is unknown."""
    out = time_filter(identity_filter(records, exact, **identity), start, end)
    if timings is not None:
        out = out.where(F.col("timing_type").isin(timings))
    if sql_id is not None:
        out = out.where(F.col("sql_id") == sql_id)
    known = F.col("timing_type").isNotNull()
    return out.withColumn("start_at", F.when(known, F.col("start_at"))).withColumn("us", F.when(known, F.col("us")))


def hits(records: DataFrame, stats: DataFrame) -> DataFrame:
    """QRY-05, 18: per identity its records, first and last time, timings, and whether the current build has a baseline."""
    by = ["fingerprint", "scope_id", "database", "execution_user"]
    own = records.groupBy(*by).agg(
        F.count("*").alias("records"), F.min("end_at").alias("first_at"), F.max("end_at").alias("last_at"), F.array_sort(F.collect_set("timing_type")).alias("timings"), F.bool_or(F.col("timing_type").isNull()).alias("has_unknown")
    )
    based = stats.where("layer = 'overall' and included_count > 0").select(*by).distinct().withColumn("has_baseline", F.lit(True))
    return null_safe(own, based, by).withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))


def token_records(records: DataFrame, tokens: DataFrame, names: list[str]) -> DataFrame:
    """QRY-18, 19: records of the identities that tokens name; a null part matches null only, an empty or broken token nothing.

    ``tokens``: token; one row a token and record.
    """
    wanted = tokens.distinct().select("token", exchange.identity_of(F.col("token"), names).alias("_i")).where("_i is not null")
    return null_safe(wanted.select("token", "_i.*"), records, names, "inner")


def exact_search(found: DataFrame, fingerprints: DataFrame, wanted: DataFrame) -> DataFrame:
    """QRY-13: per wanted fingerprint: unreliable_fingerprint, not_seen, has_baseline or records_without_baseline."""
    seen = found.groupBy("fingerprint").agg(F.bool_or("has_baseline").alias("b"), F.sum("records").alias("records"))
    bad = fingerprints.where("state <> 'reliable'").select(F.col("value").alias("fingerprint")).distinct().withColumn("bad", F.lit(True))
    out = wanted.join(seen, "fingerprint", "left").join(bad, "fingerprint", "left")
    state = F.when(F.col("bad"), "unreliable_fingerprint").when(F.col("records").isNull(), "not_seen").when(F.col("b"), "has_baseline").otherwise("records_without_baseline")
    return out.select("fingerprint", state.alias("state"), F.coalesce("records", F.lit(0)).alias("records"))


def text_search(texts: DataFrame | TextIndex, cells: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """QRY-06, 07, 29: structures whose texts hold all terms, with both ranks; rows among the first ``limit`` of either.

    ``texts``: sql_id, fingerprint, search_text, or their trigram index; ``cells``: records and last_at by sql_id and identity.
    """
    found = texts.search(terms) if isinstance(texts, TextIndex) else texts.where(tx.match_all_terms(F.col("search_text"), F.lit(terms)))
    found = written(found.select("sql_id", "fingerprint"), "found")
    got = found.join(cells, "sql_id", "left")
    who = F.struct("scope_id", "database", "execution_user")
    per = got.groupBy("fingerprint", "scope_id", "database", "execution_user").agg(F.sum("records").alias("r"), F.max("last_at").alias("l"))
    ids = found.groupBy("fingerprint").agg(F.min("sql_id").alias("example_sql_id"), F.count_distinct("sql_id").alias("matched_texts"))
    out = per.groupBy("fingerprint").agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("records"),
        F.max("l").alias("last_at"),
        F.array_sort(F.collect_set("scope_id")).alias("scopes"),
        F.array_sort(F.collect_set("database")).alias("databases"),
        F.count_if(F.col("r").isNotNull()).alias("identities"),
        F.min_by(who, F.struct(-F.coalesce("r", F.lit(0)), who)).alias("top"),
    )
    out = null_safe(out, ids, ["fingerprint"])
    late = {"timestamp_ntz": cal.micros, "timestamp": F.unix_micros}.get(dict(out.dtypes)["last_at"], lambda c: c)(F.col("last_at"))
    keys = {"by_count": F.struct(-F.col("records"), "fingerprint"), "by_recency": F.struct(F.col("last_at").isNull(), -late, "fingerprint")}
    keyed = written(out.select("*", *[k.alias(f"_{n}") for n, k in keys.items()]), "structures")  # read for both pages and the counts
    # the page: at most twice ``limit`` rows; only these meet all others, to count those before them
    page = keyed.orderBy("_by_count").limit(limit).unionByName(keyed.orderBy("_by_recency").limit(limit)).dropDuplicates(["_by_count"])
    own = page.select(*[F.col(f"_{n}").alias(f"_own_{n}") for n in keys])
    places = [F.count_if(F.col(f"_{n}") <= F.col(f"_own_{n}")).cast("int").alias(n) for n in keys]
    counts = keyed.select(*[f"_{n}" for n in keys]).crossJoin(F.broadcast(own)).groupBy(*own.columns).agg(*places, F.count("*").alias("total"))
    met = page.join(F.broadcast(counts), [F.col(f"_{n}").eqNullSafe(F.col(f"_own_{n}")) for n in keys])
    return met.drop(*own.columns, *[f"_{n}" for n in keys])


def time_bounds(records: DataFrame, by: list[str]) -> DataFrame:
    """QRY-09: default range of each group: the seven days up to just after its last record."""
    last = records.groupBy(*by).agg(F.max("end_at").alias("last_at"))
    end = F.col("last_at") + F.expr("INTERVAL '0.000001' SECOND")
    return last.select(*by, (end - F.expr("INTERVAL 7 DAYS")).alias("range_start"), end.alias("range_end"))


def timeline(records: DataFrame, unit: str = "hour") -> DataFrame:
    """QRY-10: per timing and local hour or day: records, outcomes, known durations, P50, P95, longest."""
    bucket = F.date_trunc(unit, cal.local(F.col("end_at")))
    base = records.withColumn("bucket", bucket.cast("timestamp_ntz"))
    status = base.groupBy("timing_type", "bucket", "outcome").count().groupBy("timing_type", "bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "count")))).alias("statuses"))
    ms, n = F.col("us") / 1000.0, F.col("n")
    values = base.groupBy("timing_type", "bucket", "us").agg(F.count("*").alias("n"))  # a busy hour shrinks before its percentiles
    own = values.groupBy("timing_type", "bucket").agg(
        F.sum(n).alias("records"), F.coalesce(F.sum(F.when(F.col("us").isNotNull(), n)), F.lit(0)).alias("known"), F.percentile(ms, F.lit(0.5), n).alias("p50"), F.percentile(ms, F.lit(0.95), n).alias("p95"), F.max(ms).alias("longest")
    )
    return null_safe(own, status, ["timing_type", "bucket"])


def history(records: DataFrame, cursor: tuple | None, limit: int) -> DataFrame:
    """QRY-11: a keyset page, newest first: rows after the cursor (end_at, analysis_id, occurrence_id); ``more`` tells of a next page."""
    key = F.struct("end_at", "analysis_id", "occurrence_id")
    if cursor is not None:
        kinds = dict(records.dtypes)
        after = [F.lit(v).cast(kinds[c]) for v, c in zip(cursor, ('end_at', 'analysis_id', 'occurrence_id'))]
        records = records.where(key < F.struct(*after))
    page = records.orderBy(F.desc("end_at"), F.desc("analysis_id"), F.desc("occurrence_id")).limit(limit + 1)
    order = Window.orderBy(F.desc("end_at"), F.desc("analysis_id"), F.desc("occurrence_id"))
    page = page.withColumn("n", F.row_number().over(order)).withColumn("more", F.max("n").over(Window.partitionBy()) > limit)
    return page.where(F.col("n") <= limit)


def record_facts(records: DataFrame, timing: str) -> DataFrame:
    """QRY-19: records of a timing and all untimed failures; of ``unknown`` all untimed ones."""
    t = F.col("timing_type")
    return records.where((t == timing) | (t.isNull() & (F.lit(timing == "unknown") | (F.col("outcome") != "success"))))


def timings_of(records: DataFrame, by: list[str]) -> DataFrame:
    """QRY-20: timings of each identity with counts in fixed order; unknown only for untimed successes or where nothing is timed."""
    own = records.withColumn("timing", F.coalesce("timing_type", F.lit("unknown"))).groupBy(*by, "timing").agg(F.count("*").alias("records"), F.count_if(F.col("outcome") == "success").alias("successes"))
    timed = F.count_if(F.col("timing") != "unknown").over(Window.partitionBy(*by))
    own = own.withColumn("_t", timed).where((F.col("timing") != "unknown") | (F.col("successes") > 0) | (F.col("_t") == 0)).drop("_t")
    return own.withColumn("place", F.array_position(F.lit(TIMING_ORDER), F.col("timing")))


def points(records: DataFrame, step_ms: int) -> DataFrame:
    """QRY-23: per slot of ``step_ms`` the slowest and the fastest record and the number of records."""
    slot = F.floor(cal.micros(F.col("end_at")) / (step_ms * 1000)).cast("long")
    known = records.where("us is not null").withColumn("slot", slot)
    who = F.struct("us", "occurrence_id")
    return known.groupBy("slot").agg(
        F.count("*").alias("records"),
        F.max("us").alias("slowest_us"), F.min_by("occurrence_id", F.struct(-F.col("us"), F.col("occurrence_id"))).alias("slowest_id"),
        F.min("us").alias("fastest_us"), F.min_by("occurrence_id", who).alias("fastest_id"),
    )


def slot_counts(records: DataFrame, step_ms: int) -> DataFrame:
    """QRY-24: records of each slot and outcome."""
    return records.withColumn("slot", F.floor(cal.micros(F.col("end_at")) / (step_ms * 1000)).cast("long")).groupBy("slot", "outcome").agg(F.count("*").alias("records"))


def compare(records: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """QRY-25: executions above the baseline's P50, P95 and P99, only where that value's condition is met."""
    flags = stats.where("layer = 'overall'").select(*by, "p50_ms", "p95_ms", "p99_ms", F.col("basic.met").alias("b"), F.col("p95.met").alias("m95"), F.col("p99.met").alias("m99"))
    joined = null_safe(records.where("us is not null"), flags, by)
    ms = F.col("us") / 1000.0
    refs = F.array(*[F.struct(F.lit(n).alias("reference"), F.when(F.col(f), F.col(c)).alias("value"), F.lit(s).alias("expected")) for n, c, f, s in (("p50", "p50_ms", "b", 0.5), ("p95", "p95_ms", "m95", 0.05), ("p99", "p99_ms", "m99", 0.01))])
    each = joined.select(*by, ms.alias("ms"), F.explode(refs).alias("r")).select(*by, "ms", "r.*")
    out = each.groupBy(*by, "reference", "expected").agg(F.count("*").alias("records"), F.first("value").alias("value"), F.count_if(F.col("ms") > F.col("value")).alias("above"))
    usable = F.col("value").isNotNull()
    return out.select(*by, "reference", "records", "value", F.when(usable, F.col("above")).alias("above"), F.when(usable, F.round(F.col("above") / F.col("records"), 4)).alias("share"), "expected", F.when(~usable, "insufficient_samples").alias("note"))


def comparison_class(ms: Column, p50: Column, p95: Column, p99: Column, basic: Column, ok95: Column, ok99: Column) -> Column:
    """QRY-27: where an execution stands against its baseline."""
    return (
        F.when(ms.isNull(), "unknown")
        .when(p50.isNull(), "no_baseline")
        .when(~basic, "insufficient")
        .when(ok99 & (ms > p99), "above_p99")
        .when(ok95 & (ms > p95), "above_p95")
        .when(ms > p50, "above_p50")
        .otherwise("not_above")
    )


def executions(records: DataFrame, stats: DataFrame, by: list[str], outcomes: list[str] | None, least_us: int | None, most_us: int | None, limit: int) -> DataFrame:
    """QRY-27: the slowest matching executions with their class and how many match."""
    if outcomes is not None:
        records = records.where(F.col("outcome").isin(outcomes))
    if least_us is not None:
        records = records.where(F.col("us") >= least_us)
    if most_us is not None:
        records = records.where(F.col("us") <= most_us)
    total = records.agg(F.count("*").alias("matching"))
    page = records.orderBy(F.desc_nulls_last("us"), "occurrence_id").limit(limit)  # narrow rows first, the baseline after
    flags = stats.where("layer = 'overall'").select(*by, "p50_ms", "p95_ms", "p99_ms", F.col("basic.met").alias("b"), F.col("p95.met").alias("m95"), F.col("p99.met").alias("m99"))
    out = null_safe(page, flags, by).withColumn("class", comparison_class(F.col("us") / 1000.0, F.col("p50_ms"), F.col("p95_ms"), F.col("p99_ms"), F.coalesce("b", F.lit(False)), F.coalesce("m95", F.lit(False)), F.coalesce("m99", F.lit(False))))
    return out.crossJoin(F.broadcast(total))


def texts_of_structure(records: DataFrame, texts: DataFrame, stats: DataFrame, found: DataFrame, by: list[str], limit: int) -> DataFrame:
    """QRY-26: per structure its texts: executions, median, slowest, share above P95, hits of the search first; top ``limit`` by count."""
    flags = stats.where("layer = 'overall'").select(*by, F.when(F.col("p95.met"), F.col("p95_ms")).alias("ref"))
    joined = null_safe(records, flags, by).withColumn("ms", F.col("us") / 1000.0)
    values = joined.groupBy("fingerprint", "sql_id", "ms").agg(F.count("*").alias("n"), F.count_if(F.col("ms") > F.col("ref")).alias("above"), F.count_if(F.col("ms").isNotNull() & F.col("ref").isNotNull()).alias("comparable"))
    own = values.groupBy("fingerprint", "sql_id").agg(
        F.sum("n").alias("executions"), F.percentile("ms", F.lit(0.5), F.col("n")).alias("median_ms"), F.max("ms").alias("slowest_ms"), F.sum("above").alias("above"), F.sum("comparable").alias("comparable")
    )
    own = own.join(found.select("sql_id").distinct().withColumn("hit", F.lit(True)), "sql_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    own = own.withColumn("above_share", F.round(F.try_divide("above", "comparable"), 4)).withColumn("total_texts", F.count("*").over(Window.partitionBy("fingerprint")))
    place = F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.desc("hit"), F.desc("executions"), "sql_id"))
    return own.withColumn("place", place).where(F.col("place") <= limit).join(texts.select("sql_id", "text"), "sql_id", "left")


def ranking(records: DataFrame, order: str, limit: int) -> DataFrame:
    """QRY-31: identities and timings of a range by records, total, mean, slowest or not_success; untimed failures
    count for each timing of their identity, an identity that only fails has one row without timing."""
    by = ["fingerprint", "scope_id", "database", "execution_user"]
    timed = records.where("timing_type is not null").groupBy(*by, "timing_type").agg(F.count("*").alias("n"), F.sum("us").alias("total_us"), F.max("us").alias("slowest_us"), F.count_if(F.col("outcome") != "success").alias("bad"))
    failed = records.where("timing_type is null and outcome <> 'success'").groupBy(*by).agg(F.count("*").alias("untimed"))
    rows = null_safe(timed, failed, by).withColumn("untimed", F.coalesce("untimed", F.lit(0)))
    f = failed.select(*[F.col(c).alias(f"_{c}") for c in by], "untimed")
    only = f.join(timed.select(*by).distinct(), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left_anti").select(*[F.col(f"_{c}").alias(c) for c in by], "untimed")
    rows = rows.unionByName(only, allowMissingColumns=True)
    rows = rows.select(*by, "timing_type", (F.coalesce("n", F.lit(0)) + F.col("untimed")).alias("records"), "total_us", (F.col("total_us") / F.col("n")).alias("mean_us"), "slowest_us", (F.coalesce("bad", F.lit(0)) + F.col("untimed")).alias("not_success"))
    page = rows.orderBy(F.desc_nulls_last(order), *by, F.asc_nulls_last("timing_type")).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total_rows")))).orderBy(F.desc_nulls_last(order), *by, F.asc_nulls_last("timing_type"))


def baseline_ranking(stats: DataFrame, order: str, least_samples: int, limit: int, last_seen: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """QRY-32, 33: overall rows with enough samples in an order; wide columns and the last execution only for the page."""
    keys = by or ["scope_id", "database", "timing_type"]
    narrow = stats.where((F.col("layer") == "overall") & (F.col("included_count") >= least_samples)).select(*keys, order)
    page = narrow.orderBy(F.desc_nulls_last(order), *keys).limit(limit)
    wide = stats.where("layer = 'overall'").drop(order)
    out = null_safe(page, wide, keys)
    return null_safe(out, last_seen, keys) if last_seen is not None else out


def pattern(stats: DataFrame, layer: str) -> DataFrame:
    """QRY-35: P50 and P95 of the buckets of a layer that have samples, in order."""
    return stats.where((F.col("layer") == layer) & (F.col("included_count") > 0)).orderBy("bucket_date", "bucket_number")


def exclusion_breakdown(stats: DataFrame, keys: list[str]) -> DataFrame:
    """QRY-36: reasons and counts of the overall rows; a placeholder row where there are none."""
    return stats.where("layer = 'overall'").select(*keys, F.explode_outer("exclusions_by_reason").alias("reason", "count")).withColumn("reason", F.coalesce("reason", F.lit("-"))).withColumn("count", F.coalesce("count", F.lit(0)))


def metric_pivot(stats: DataFrame, keys: list[str]) -> DataFrame:
    """QRY-37: metrics as rows, the five timings as columns."""
    long = stats.where("layer = 'overall'").select(*keys, "timing_type", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("m"))
    return long.select(*keys, "timing_type", "m.*").groupBy(*keys, "metric").pivot("timing_type", TIMINGS).agg(F.max("value"))


def missing_timings(stats: DataFrame, keys: list[str]) -> DataFrame:
    """QRY-38: per group the timings without included samples, if any."""
    have = stats.where("layer = 'overall' and included_count > 0").groupBy(*keys).agg(F.collect_set("timing_type").alias("t"))
    gone = F.array_sort(F.array_except(F.lit(TIMINGS), F.col("t")))
    return have.select(*keys, F.array_join(gone, ", ").alias("missing")).where("missing <> ''")


def all_timings(stats: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """QRY-15..17: rows of a layer for all five timings of each group, also those without samples."""
    frame = groups.select(*keys).distinct().withColumn("timing_type", F.explode(F.lit(TIMINGS)))
    out = null_safe(frame, stats.where("layer = 'overall'"), [*keys, "timing_type"])
    return out.withColumn("included_count", F.coalesce("included_count", F.lit(0))).withColumn("sample_state", F.when(F.col("included_count") > 0, "has_samples").otherwise("no_samples"))


def baseline_document(rows: DataFrame, keys: list[str]) -> DataFrame:
    """QRY-17: one JSON document a group with its five timings."""
    return rows.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("timing_type", "sample_state", "included_count", F.round("p50_ms", 3).alias("p50_ms"), F.round("p95_ms", 3).alias("p95_ms"))))).alias("document"))


def filter_options(records: DataFrame) -> DataFrame:
    """QRY-39: distinct clusters, databases and users, each list with a row for all."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("cluster", "scope_id"), ("database", "database"), ("user", "execution_user"))])
    own = records.select(F.explode(kinds).alias("x")).select("x.*").where("name is not null").distinct()
    return own.unionByName(own.select("kind").distinct().withColumn("name", F.lit("*")))


def catalog(texts: DataFrame, terms: list[str]) -> DataFrame:
    """QRY-41: numbered texts of each structure with whether the search finds them, 180 characters of each, and its length."""
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy("sql_id"))
    return texts.select("fingerprint", n.alias("n"), "sql_id", tx.match_all_terms(F.col("search_text"), F.lit(terms)).alias("hit"), F.left("text", F.lit(180)).alias("example"), F.length("text").alias("length"))


def facts_by_text(texts: DataFrame, records: DataFrame) -> DataFrame:
    """QRY-42: executions and last time by text and outcome; texts without any have one row with zero."""
    own = records.groupBy("sql_id", "outcome").agg(F.count("*").alias("records"), F.max("end_at").alias("last_at"))
    return texts.select("sql_id").distinct().join(own, "sql_id", "left").withColumn("records", F.coalesce("records", F.lit(0)))
