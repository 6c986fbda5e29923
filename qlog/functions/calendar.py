"""Calendar helpers. Times are zone-less UTC instants; calendar work is in local time, UTC+8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "INTERVAL 8 HOURS"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
LAYERS = ["overall", "day", "week", "weekday", "hour"]


def local(t: Column) -> Column:
    return t + F.expr(LOCAL)


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), t).cast("long")


def from_micros(us: Column) -> Column:
    """Zone-less timestamp of microseconds since 1970."""
    return F.expr(EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1_000_000)).cast("decimal(18,6)"))


def back(t: Column, us: Column) -> Column:
    """``t`` less ``us`` microseconds, exactly; null if either is."""
    seconds = F.floor(us / 1_000_000)
    rest = us - seconds * 1_000_000
    return t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds.cast("decimal(12,0)") + rest.cast("decimal(12,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def day(t: Column) -> Column:
    return local(t).cast("date")


def monday(t: Column) -> Column:
    return F.date_sub(day(t), F.weekday(day(t)))


def iso_weekday(t: Column) -> Column:
    return (F.weekday(day(t)) + 1).cast("int")


def hour(t: Column) -> Column:
    return F.hour(local(t)).cast("int")


def layer_buckets(t: Column) -> Column:
    """Array of the five (layer, bucket_date, bucket_number) that a time falls into."""

    def one(layer: str, date: Column, number: Column) -> Column:
        return F.struct(F.lit(layer).alias("layer"), date.cast("date").alias("bucket_date"), number.cast("int").alias("bucket_number"))

    none = F.lit(None)
    return F.array(one("overall", none, none), one("day", day(t), none), one("week", monday(t), none), one("weekday", none, iso_weekday(t)), one("hour", none, hour(t)))
