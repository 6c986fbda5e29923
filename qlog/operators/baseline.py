"""Latency baselines: five calendar layers, seventeen metrics, coverage and sufficiency.

Samples are one row an execution: key columns, ``start_at``, ``us`` (duration in whole microseconds),
``included`` and ``codes`` (reasons against it). They are counted once per group, hour, duration and
reasons; all layers and metrics come from those counts, so a very frequent group shrinks on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.functions import calendar as cal
from qlog.operators.order import between, quantiles
from qlog.operators.tables import written

BUCKET = ["layer", "bucket_date", "bucket_number"]
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
METRICS = ["min_ms", "max_ms", "mean_ms", *[f"{q}_ms" for q in QUANTILES], "stddev_ms", "cv", "mad_ms", "iqr_ms", "log_median", "log_mad", "p95_p50", "p99_p50"]
TIMINGS = ["request", "parse", "bind", "execute_first", "execute_fetch"]
#: Distinct durations of a bucket that one task sorts; larger buckets are spread over tasks.
MOST_VALUES = 500_000
#: Thresholds by layer: samples for basic values, P95 and P99, and what has to be covered.
THRESHOLDS = [("overall", 30, 200, 1000, "active_days", 7), ("day", 30, 200, 1000, None, 0), ("week", 30, 200, 1000, "active_days", 3), ("weekday", 30, 200, 1000, "active_weeks", 4), ("hour", 30, 200, 1000, "active_days", 7)]


def by_hour(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples with a start, counted: ``start_at`` is the hour of their start, ``n`` their number, ``first_at`` and ``last_at`` their first and last start.

    An hour lies in one bucket of each layer, as local time is whole hours away.
    """
    hour = F.date_trunc("hour", "start_at").cast(dict(samples.dtypes)["start_at"])
    counted = samples.where("start_at is not null").groupBy(*keys, hour.alias("hour"), "us", "included", "codes")
    return counted.agg(F.count("*").alias("n"), F.min("start_at").alias("first_at"), F.max("start_at").alias("last_at")).withColumnRenamed("hour", "start_at")


def explode_layers(samples: DataFrame) -> DataFrame:
    """AGG-01: each sample (or count of samples, see ``by_hour``) in its five buckets; samples without a start are in none."""
    return samples.where("start_at is not null").withColumn("_b", F.explode(cal.layer_buckets(F.col("start_at")))).select("*", "_b.*").drop("_b")


def _number(layered: DataFrame) -> Column:
    """Samples that a row stands for."""
    return F.col("n") if "n" in layered.columns else F.lit(1)


def _ms(us: Column) -> Column:
    return us / 1000.0


def metrics(layered: DataFrame, keys: list[str], most: int = MOST_VALUES) -> DataFrame:
    """AGG-02..09: the seventeen metrics of the included samples of each (keys, bucket).

    Percentiles and the two median deviations are exact order statistics. Buckets meet by one shuffle and are sorted inside
    the tasks; those of over ``most`` distinct durations go by range-partitioned values (``order``), so that a bucket may
    hold any number of them.
    """
    by = [*keys, *BUCKET]
    counted = written(layered.where("included and us is not null").groupBy(*by, "us").agg(F.sum(_number(layered)).alias("n")), "counted")
    if counted.count() <= most:
        return _named(_by_bucket(counted, by), by)
    large = written(counted.groupBy(*by).agg(F.count("*").alias("_values")).where(F.col("_values") > most).drop("_values"), "large")
    if large.isEmpty():
        return _named(_by_bucket(counted, by), by)
    parts = [f(null_safe(counted, large, by, how), by) for f, how in ((_by_bucket, "left_anti"), (_by_range, "left_semi"))]
    return _named(parts[0].unionByName(parts[1]), by)


def _logs(us: Column) -> Column:
    return F.log1p(_ms(us))


def _by_bucket(counted: DataFrame, by: list[str]) -> DataFrame:
    """Order statistics and moments of buckets that are sorted by one task each, by duration and by both deviations."""
    whole, n = Window.partitionBy(*by), F.col("n")
    upto = lambda c: F.sum("n").over(whole.orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
    place = lambda f: F.lit(f) * (F.col("_all") - 1)
    held = lambda rank, to: (rank >= F.col(to) - n) & (rank < F.col(to))

    def ranks(f: float, to: str, v: Column, agg) -> Column:
        low, high = [agg(F.max(F.when(held(r(place(f)), to), v))) for r in (F.floor, F.ceil)]
        return F.struct(low.alias("low"), high.alias("high"), agg(F.max(place(f) - F.floor(place(f)))).alias("part"))

    rows = counted.withColumn("_to", upto("us")).withColumns({"_all": F.sum("n").over(whole), "_lo": F.min("us").over(whole)})
    rows = rows.withColumn("_mid", ranks(0.5, "_to", F.col("us"), lambda c: c.over(whole)))
    # A median is a value or lies halfway between two, so twice the deviation from it is whole.
    mid = F.col("_mid")
    twice = mid["low"] + F.when(mid["part"] == 0, mid["low"]).otherwise(mid["high"])
    rows = rows.withColumns({"_mad": F.abs(2 * F.col("us") - twice).cast("double"), "_log": F.abs(_logs(F.col("us")) - between(mid, _logs))})
    rows = rows.withColumn("_mad_to", upto("_mad")).withColumn("_log_to", upto("_log"))
    d, own = (F.col("us") - F.col("_lo")).cast("double"), lambda c: c
    out = rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.sum(F.col("us") * n).alias("total"), F.array(*[ranks(f, "_to", F.col("us"), own) for f in QUANTILES.values()]).alias("ranks"),
        ranks(0.5, "_mad_to", F.col("_mad"), own).alias("_m"), ranks(0.5, "_log_to", F.col("_log"), own).alias("_l"), F.sum(d * n).alias("s1"), F.sum(d * d * n).alias("s2"),
    )
    return out.select(*by, "n", "lo", "hi", "total", "ranks", between(F.get("ranks", F.lit(1)), _logs).alias("log_median"), (between(F.col("_m")) / 2).alias("mad"), between(F.col("_l")).alias("log_mad"), "s1", "s2")


def _by_range(counted: DataFrame, by: list[str]) -> DataFrame:
    """The same of buckets of any size, by range-partitioned values."""
    sums = counted.groupBy(*by).agg(F.sum("n").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.sum(F.col("us") * F.col("n")).alias("total"))
    ranks = quantiles(counted, by, list(QUANTILES.values()), "us").drop("total")
    mid = F.get("ranks", F.lit(1))
    first = written(null_safe(sums, ranks, by, "inner").withColumn("log_median", between(mid, _logs)), "ranks")

    # A median is a value or lies halfway between two, so twice the deviation from it is whole.
    middle = first.select(*by, F.col("lo").alias("_lo"), (mid["low"] + F.when(mid["part"] == 0, mid["low"]).otherwise(mid["high"])).alias("_twice"), F.col("log_median").alias("_log"))
    far = null_safe(counted, middle, by, "inner").withColumn("d", (F.col("us") - F.col("_lo")).cast("double"))
    away = F.array(F.struct(F.lit("mad").alias("of"), F.abs(2 * F.col("us") - F.col("_twice")).cast("double").alias("v")), F.struct(F.lit("log").alias("of"), F.abs(_logs(F.col("us")) - F.col("_log")).alias("v")))
    half = quantiles(far.select(*by, "n", F.explode(away).alias("x")).select(*by, "n", "x.of", "x.v"), [*by, "of"], [0.5])
    own = lambda of: F.max(F.when(F.col("of") == of, between(F.get("ranks", F.lit(0)))))
    half = half.groupBy(*by).agg((own("mad") / 2).alias("mad"), own("log").alias("log_mad"))
    moments = far.groupBy(*by).agg(F.sum(F.col("d") * F.col("n")).alias("s1"), F.sum(F.col("d") * F.col("d") * F.col("n")).alias("s2"))
    return null_safe(null_safe(first, half, by), moments, by)


def _named(both: DataFrame, by: list[str]) -> DataFrame:
    at = {name: _ms(between(F.get("ranks", F.lit(i)))) for i, name in enumerate(QUANTILES)}
    mean = _ms(F.col("total") / F.col("n"))
    spread = _ms(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) * (F.col("s1") / F.col("n")))))
    return both.select(
        *by,
        _ms(F.col("lo")).alias("min_ms"),
        _ms(F.col("hi")).alias("max_ms"),
        mean.alias("mean_ms"),
        *[at[q].alias(f"{q}_ms") for q in QUANTILES],
        spread.alias("stddev_ms"),
        F.try_divide(spread, mean).alias("cv"),
        _ms(F.col("mad")).alias("mad_ms"),
        _ms(between(F.get("ranks", F.lit(2))) - between(F.get("ranks", F.lit(0)))).alias("iqr_ms"),
        "log_median",
        "log_mad",
        F.try_divide(at["p95"], at["p50"]).alias("p95_p50"),
        F.try_divide(at["p99"], at["p50"]).alias("p99_p50"),
    )


def counts(layered: DataFrame, keys: list[str], window_start: Column, window_end: Column) -> DataFrame:
    """AGG-11, 13, 14, 15: counts, active dates and weeks, first and last sample, clipped range of each bucket.

    ``window_start`` and ``window_end`` are local dates; the range is half-open.
    """
    got, n = F.col("included"), _number(layered)
    first, last = ("first_at", "last_at") if "first_at" in layered.columns else ("start_at", "start_at")
    start, end = F.col("bucket_date"), F.when(F.col("layer") == "day", F.date_add("bucket_date", 1)).when(F.col("layer") == "week", F.date_add("bucket_date", 7))
    out = layered.groupBy(*keys, *BUCKET).agg(
        F.coalesce(F.sum(F.when(got, n)), F.lit(0)).cast("long").alias("included_count"),
        F.coalesce(F.sum(F.when(~got, n)), F.lit(0)).cast("long").alias("excluded_count"),
        F.array_sort(F.collect_set(F.when(got, cal.day(F.col("start_at"))))).alias("active_dates"),
        F.array_sort(F.collect_set(F.when(got, cal.monday(F.col("start_at"))))).alias("active_weeks"),
        F.min(F.when(got, F.col(first))).alias("first_sample_at"),
        F.max(F.when(got, F.col(last))).alias("last_sample_at"),
    )
    return out.withColumns(
        {
            "range_start": F.greatest(F.coalesce(start, window_start), window_start),
            "range_end": F.least(F.coalesce(end, window_end), window_end),
            "partial_week": (F.col("layer") == "week") & ((start < window_start) | (F.date_add(start, 7) > window_end)),
        }
    )


def exclusions(layered: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-12: per bucket a map of reason to the number of samples that have it (once a sample)."""
    by = [*keys, *BUCKET]
    each = layered.where("not included").select(*by, _number(layered).alias("n"), F.explode(F.array_distinct("codes")).alias("code")).groupBy(*by, "code").agg(F.sum("n").alias("count"))
    return each.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "count")))).alias("exclusions_by_reason"))


def null_reasons(included: Column) -> Column:
    """AGG-10: map of every null metric to why it is null."""
    why = F.when(included == 0, "no_samples").otherwise("zero_denominator")
    pairs = F.create_map(*[x for m in METRICS for x in (F.lit(m), F.when(F.col(m).isNull(), why))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Join on columns of equal names where null equals null; the left side's columns stay (JOI-04)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in by], *[c for c in right.columns if c not in by])
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by], how).drop(*[f"_r_{k}" for k in by])


def statistics(samples: DataFrame, keys: list[str], window_start: Column, window_end: Column) -> DataFrame:
    """All of a build: counts, exclusions, metrics and null reasons of every bucket that has samples."""
    hours, by = samples if "n" in samples.columns else written(by_hour(samples, keys), "hours"), [*keys, *BUCKET]
    # an hour lies in one bucket of each layer, so durations (and reasons) are added up before layers multiply the rows
    sums = hours.groupBy(*keys, "start_at", "included").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    against = hours.where("not included").groupBy(*keys, "start_at", "included", "codes").agg(F.sum("n").alias("n"))
    out = null_safe(counts(explode_layers(sums), keys, window_start, window_end), metrics(explode_layers(hours.where("included and us is not null").drop("codes", "first_at", "last_at")), keys), by)
    out = null_safe(out, exclusions(explode_layers(against), keys), by)
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumn("exclusions_by_reason", F.coalesce("exclusions_by_reason", empty)).withColumn("metric_null_reasons", null_reasons(F.col("included_count")))


def coverage(stats: DataFrame, keys: list[str], window_start: Column, window_end: Column) -> DataFrame:
    """AGG-16, JOI-08: per group and layer the expected bucket keys, how many have samples and which are empty."""
    last = F.date_sub(window_end, 1)
    days, weeks = F.sequence(window_start, last), F.sequence(F.date_sub(window_start, F.weekday(window_start)), last, F.expr("INTERVAL 7 DAYS"))
    expected = F.concat(
        F.array(F.struct(F.lit("overall").alias("layer"), F.lit("all").alias("bucket"))),
        F.transform(days, lambda d: F.struct(F.lit("day").alias("layer"), d.cast("string").alias("bucket"))),
        F.transform(weeks, lambda d: F.struct(F.lit("week").alias("layer"), d.cast("string").alias("bucket"))),
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.struct(F.lit("weekday").alias("layer"), n.cast("string").alias("bucket"))),
        F.transform(F.sequence(F.lit(0), F.lit(23)), lambda n: F.struct(F.lit("hour").alias("layer"), n.cast("string").alias("bucket"))),
    )
    own = stats.select(*keys, "layer", F.coalesce(F.col("bucket_date").cast("string"), F.col("bucket_number").cast("string"), F.lit("all")).alias("bucket"))
    wanted = stats.select(*keys).distinct().withColumn("_e", F.explode(expected)).select(*keys, "_e.layer", "_e.bucket")
    marked = null_safe(wanted, own.withColumn("there", F.lit(1)), [*keys, "layer", "bucket"])
    return marked.groupBy(*keys, "layer").agg(
        F.count("there").alias("computed_keys"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("bucket")))).alias("empty_keys")
    )


def timing_coverage(stats: DataFrame) -> DataFrame:
    """AGG-17: included and excluded totals of each of the five timings, zero where there are none."""
    spark = stats.sparkSession
    got = stats.where("layer = 'overall'").groupBy("timing_type").agg(F.sum("included_count").alias("i"), F.sum("excluded_count").alias("e"))
    return spark.createDataFrame([(t,) for t in TIMINGS], "timing_type string").join(got, "timing_type", "left").select(
        "timing_type", F.coalesce("i", F.lit(0)).alias("included_count"), F.coalesce("e", F.lit(0)).alias("excluded_count")
    )


def layer_counts(stats: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-18: rows and distinct groups of each layer."""
    return stats.groupBy("layer").agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])).alias("groups"))


def sufficiency(stats: DataFrame, thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """AGG-19, 20: for basic values, P95 and P99 whether the bucket has the samples and the coverage, and why not."""
    table = stats.sparkSession.createDataFrame(thresholds, "layer string, basic_count long, p95_count long, p99_count long, covers string, coverage_min long")
    out = stats.join(F.broadcast(table), "layer", "left")  # five rows
    have = F.when(F.col("covers") == "active_days", F.size("active_dates")).when(F.col("covers") == "active_weeks", F.size("active_weeks")).cast("long")
    covered = F.col("covers").isNull() | (have >= F.col("coverage_min"))
    for name in ("basic", "p95", "p99"):
        enough = F.col("included_count") >= F.col(f"{name}_count")
        reasons = F.array_compact(F.array(F.when(~enough, "sample_count"), F.when(~covered, F.col("covers"))))
        out = out.withColumn(
            name,
            F.struct(
                F.col(f"{name}_count").alias("required_count"), F.col("included_count").alias("actual_count"), F.col("coverage_min").alias("required_coverage"), have.alias("actual_coverage"), (enough & covered).alias("met"), reasons.alias("reasons")
            ),
        )
    return out.drop("basic_count", "p95_count", "p99_count", "covers", "coverage_min")


def new_groups(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """AGG-24: the first occurrence of each group id that is not known yet."""
    first = decisions.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("analysis_id", "occurrence_id")).alias("first"))
    return first.join(known.select("group_id"), "group_id", "left_anti").select("group_id", "first.analysis_id", "first.occurrence_id")


def compare_runs(actual: DataFrame, expected: DataFrame, keys: list[str], metrics: list[str], limit: float = 1e-12) -> DataFrame:
    """AGG-26, JOI-11: rows only in one run, and per metric largest difference, null mismatches and exceedances."""
    a = actual.select(*keys, F.struct(*metrics).alias("a"))
    e = expected.select(*keys, F.struct(*metrics).alias("e"))
    both = a.join(e.select(*[F.col(k).alias(f"_{k}") for k in keys], "e"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full_outer")
    each = both.select("a", "e", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").cast("double").alias("x"), F.col(f"e.{m}").cast("double").alias("y")) for m in metrics])).alias("v"))
    matched = F.col("a").isNotNull() & F.col("e").isNotNull()
    gap = F.abs(F.col("v.x") - F.col("v.y"))
    return each.groupBy("v.metric").agg(
        F.count_if(F.col("e").isNull()).alias("only_actual"),
        F.count_if(F.col("a").isNull()).alias("only_expected"),
        F.max(F.when(matched, gap)).alias("largest"),
        F.count_if(matched & (F.col("v.x").isNull() != F.col("v.y").isNull())).alias("null_mismatches"),
        F.count_if(matched & (gap > limit)).alias("exceeding"),
    )


def row_hashes(stats: DataFrame, drop: list[str]) -> DataFrame:
    """SRC-16: a hash of each row's columns (without ids) for comparing runs."""
    cols = [c for c in stats.columns if c not in drop]
    return stats.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("row_hash"), *[c for c in ("log_median", "log_mad") if c in cols]).orderBy("row_hash")


def ranked_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each group in an order (JOI-09)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
