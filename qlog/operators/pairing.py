"""Pairing of execute start and finish records within sessions (STF-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_executes(rows: DataFrame) -> DataFrame:
    """Finish rows with ``pairing`` and the start they consumed.

    ``rows``: file_id, session (null: identity missing), record_no, kind (start, finish, boundary), sql,
    at, fetch (on starts). A finish pairs with the row before it in its session if that is an unambiguous
    start with the same text and not later; a start is ambiguous if the row before it is a start as well.
    Every row ends what waited before it, so a start is consumed once.
    """
    w = Window.partitionBy("file_id", "session").orderBy("record_no")
    before = lambda c: F.lag(c).over(w)
    marked = rows.where("session is not null")
    marked = marked.withColumn("ambiguous", (F.col("kind") == "start") & F.coalesce(before("kind") == "start", F.lit(False)))
    state = F.lag(F.struct("kind", "sql", "at", "ambiguous", "fetch", "record_no")).over(w)
    ended = marked.withColumn("p", state).where("kind = 'finish'")
    verdict = (
        F.when(F.col("p").isNull() | (F.col("p.kind") != "start"), "execute_start_missing")
        .when(F.col("p.ambiguous"), "execute_start_ambiguous")
        .when(~F.col("p.sql").eqNullSafe(F.col("sql")), "execute_context_mismatch")
        .when(F.col("p.at") > F.col("at"), "execute_order_invalid")
        .when(F.col("p.fetch"), "execute_fetch")
        .otherwise("execute_first")
    )
    paired = verdict.isin("execute_first", "execute_fetch")
    out = ended.select("file_id", "session", "record_no", verdict.alias("pairing"), F.when(paired, F.col("p.record_no")).alias("start_record"))
    lost = rows.where("session is null and kind = 'finish'").select("file_id", "session", "record_no", F.lit("session_identity_missing").alias("pairing"), F.lit(None).cast("long").alias("start_record"))
    return out.unionByName(lost)
