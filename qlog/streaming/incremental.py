"""Incremental upkeep of facts and totals, live timelines, and daily file arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from qlog.operators.baseline import null_safe
from qlog.operators.order import between, quantiles


def capture_changes(batch: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """STF-02: rows of an append-only batch whose keys were not processed yet, each key once."""
    return batch.dropDuplicates(keys).join(processed.select(*keys), keys, "left_anti")


def refresh_facts(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STF-03: (removed, added) between the old and the new projection of the changed keys, repeats counted."""
    return old.exceptAll(new), new.exceptAll(old)


def apply_facts(facts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """STF-03: facts after the change."""
    return facts.exceptAll(removed).unionByName(added)


def merge_totals(totals: DataFrame, facts: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str], at: str = "end_at") -> DataFrame:
    """STF-04: totals (keys, record_count, first_at, last_at) after a change; ``facts`` are those after it.

    Counts move by the signed change. An extreme is taken from the facts only for keys whose removed
    extreme equals the stored one; elsewhere it is the smaller or larger of stored and added. Totals
    that come to zero go.
    """
    plus = added.groupBy(*keys).agg(F.count("*").alias("p"), F.min(at).alias("p_lo"), F.max(at).alias("p_hi"))
    minus = removed.groupBy(*keys).agg(F.count("*").alias("m"), F.min(at).alias("m_lo"), F.max(at).alias("m_hi"))
    delta = plus.unionByName(minus, allowMissingColumns=True).groupBy(*keys).agg(
        (F.coalesce(F.sum("p"), F.lit(0)) - F.coalesce(F.sum("m"), F.lit(0))).alias("d"), *[F.min(c).alias(c) if c.endswith("lo") else F.max(c).alias(c) for c in ("p_lo", "p_hi", "m_lo", "m_hi")]
    )
    touched = null_safe(delta, totals, keys)
    lost = touched.where("m_lo = first_at or m_hi = last_at").select(*keys)
    again = null_safe(lost, facts.select(*keys, F.col(at).alias("_t")), keys, "inner").groupBy(*keys).agg(F.min("_t").alias("r_lo"), F.max("_t").alias("r_hi"), F.lit(True).alias("redone"))
    touched = null_safe(touched, again, keys)
    new = touched.select(
        *keys,
        (F.coalesce("record_count", F.lit(0)) + F.col("d")).alias("record_count"),
        F.when(F.col("redone"), F.col("r_lo")).otherwise(F.least("first_at", "p_lo")).alias("first_at"),
        F.when(F.col("redone"), F.col("r_hi")).otherwise(F.greatest("last_at", "p_hi")).alias("last_at"),
    )
    mark = delta.select(*keys).withColumn("_touched", F.lit(1))
    kept = null_safe(totals, mark, keys).where("_touched is null").drop("_touched")
    return kept.unionByName(new.where("record_count > 0"))


def recompute_totals(facts: DataFrame, keys: list[str], at: str = "end_at") -> DataFrame:
    """Rebuild mode of STF-04."""
    return facts.groupBy(*keys).agg(F.count("*").alias("record_count"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def keep_totals(stream: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """STF-02..04 as a stream of executions into a ``totals.BucketTotals``; rows with ``retracted`` true take one away that came before."""

    def step(batch: DataFrame, number: int) -> None:
        store.commit(number, batch if "retracted" in batch.columns else batch.withColumn("retracted", F.lit(False)))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TIMELINE = ["bucket", "timing_type", "outcome"]


def hour_counts(stream: DataFrame, late: str = "1 day", at: str = "end_at") -> DataFrame:
    """STF-05, the stateful part: events of an hour counted by timing, outcome and duration.

    State is one small row a distinct duration, spread over all state stores by its whole key. In append mode an hour comes
    out, all at once, when the watermark (``late`` behind the newest event) has passed it, and its state goes.
    """
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "timing_type", "outcome", "us").agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "timing_type", "outcome", "us", "n")


def hour_summary(counts: DataFrame) -> DataFrame:
    """STF-05, the rest: records, longest and P95 of each closed hour, by exact order statistics over its counts."""
    sums = counts.groupBy(*TIMELINE).agg(F.sum("n").alias("records"), F.max("us").alias("longest_us"))
    p95 = quantiles(counts, TIMELINE, [0.95], "us").select(*TIMELINE, (between(F.get("ranks", F.lit(0))) / 1000.0).alias("p95"))
    return null_safe(sums, p95, TIMELINE)


def live_timeline(stream: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """STF-05: hourly records, longest and P95 by timing and outcome of the hours that the watermark closes, one folder a micro-batch."""

    def step(batch: DataFrame, number: int) -> None:
        hour_summary(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hour_counts(stream, late).writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, path: str, schema: str, a_batch: int = 4) -> DataFrame:
    """STF-06: files as they arrive, oldest first, ``a_batch`` at a time; the checkpoint is the set of imported files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).option("latestFirst", False).parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that has arrived to Parquet and stop."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
