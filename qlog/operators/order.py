"""Exact order statistics of groups of any size.

Rows are range-partitioned by (group, value), so a large group spreads over many partitions. Sums by partition, one small
row a group and partition, tell which partitions hold the ranks that are asked for; only in those are values counted up
one by one. No task holds a whole group, and no group passes a hash map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.operators.tables import written


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[f"_{k}"]) for k in by])


def _position(fraction: float) -> Column:
    return F.lit(fraction) * (F.col("total") - 1)


def quantiles(rows: DataFrame, by: list[str], fractions: list[float], value: str = "v", number: str = "n") -> DataFrame:
    """``by``, ``total`` and ``ranks``: for each fraction the two values (``low``, ``high``) around its rank and how far (``part``) it lies between them.

    A row stands for ``number`` equal values. The rank of a fraction is fraction * (total - 1) from 0, as of a continuous
    percentile. Groups may hold null keys; null values and rows that stand for none count for nothing, and a group without
    values is absent.
    """
    rows = rows.where(F.col(value).isNotNull() & (F.col(number) > 0)).select(*by, F.col(value).alias("_v"), F.col(number).cast("long").alias("_n"))
    parts = written(rows.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "ordered")
    sums = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part")
    sums = sums.withColumn("total", F.sum("_sum").over(Window.partitionBy(*by))).withColumn("_before", F.sum("_sum").over(before) - F.col("_sum"))
    floor = F.array(*[F.floor(_position(f)) for f in fractions])
    ceil = F.array(*[F.ceil(_position(f)) for f in fractions])
    asked = F.exists(F.concat(floor, ceil), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_sum")))
    wanted = sums.where(asked).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_part").alias("_p"), "_before", "total")
    held = parts.join(wanted, (parts["_part"] == wanted["_p"]) & _same(parts, wanted, by))
    upto = F.sum("_n").over(Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_to", F.col("_before") + upto).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda rank: F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))
    picked = [F.struct(at(F.floor(_position(f))).alias("low"), at(F.ceil(_position(f))).alias("high"), F.max(_position(f) - F.floor(_position(f))).alias("part")) for f in fractions]
    return held.groupBy(*by).agg(F.max("total").alias("total"), F.array(*picked).alias("ranks"))


def between(rank: Column, scale=lambda v: v) -> Column:
    """The interpolated value of a rank that ``quantiles`` gave, its two values first put through ``scale``."""
    low, high, part = scale(rank["low"]), scale(rank["high"]), rank["part"]
    return F.when(part == 0, low.cast("double")).otherwise((1 - part) * low + part * high)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, by ``order``) and ``total`` of their group, without a task that holds a group.

    Ties are numbered in any order.
    """
    parts = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sums = parts.groupBy(*by, "_part").agg(F.count("*").alias("_sum"))
    sums = sums.withColumn("total", F.sum("_sum").over(Window.partitionBy(*by))).withColumn("_before", F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_sum"))
    known = sums.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_part").alias("_p"), "_before", "total")
    own = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)) - 1
    joined = parts.withColumn("_own", own).join(known, (parts["_part"] == known["_p"]) & _same(parts, known, by))
    return joined.withColumn("place", F.col("_before") + F.col("_own")).select(*rows.columns, "place", "total")


def first_rows(rows: DataFrame, by: list[str], order: list, n: int, name: str = "n") -> DataFrame:
    """The first ``n`` rows of each group with their number from 1. Each task sends its own first ``n`` of a group at most."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
