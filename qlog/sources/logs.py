"""Log files: strict reading, positions, file facts, batches, manifests and intake checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qlog.functions.records import parse_log_time
from qlog.operators.order import first_rows
from qlog.sources import scan

#: Names of the 30 columns; those no operator uses are numbered.
COLUMNS = [
    "log_at", "execution_user", "database", "pid", "c4", "c5", "c6", "session_start", "c8", "session_id", "command", "node", "c12", "c13", "c14", "c15", "level", "sqlstate",
    "message", "detail", "c20", "internal_sql", "c22", "c23", "sql", "c25", "c26", "file", "line", "c29",
]
KEPT = ["log_at", "execution_user", "database", "pid", "session_start", "session_id", "command", "node", "level", "sqlstate", "file", "line"]
KEPT_IF_RELEVANT = ["message", "detail", "internal_sql", "sql"]


def read_log_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-01: 30 text columns, ``path``, ``valid`` and ``reason``: a file is invalid as a whole for its first error.

    ``csv_columns``: a record has not 30 fields; ``csv_boundary``: quoting is broken or never ends. Read in byte ranges
    (``scan``), so one file is many tasks; fields keep their bytes, NUL and undecodable ones included.
    """
    rows = scan.scan(spark, paths, len(COLUMNS))
    bad = rows.where("error is not null").groupBy("path").agg(F.min_by("error", "record_no").alias("reason"))
    whole = rows.where("size(fields) > 0").join(bad, "path", "left").withColumn("valid", F.col("reason").isNull())
    return whole.select(*[F.get("fields", F.lit(n)).alias(c) for n, c in enumerate(COLUMNS)], "path", "valid", "reason")


def record_positions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC-02: path, record_no from 1, first and last physical line of each record, whether it is all UTF-8, and its fields.

    Undecodable bytes stay in the fields; ``readable`` marks them. What follows broken quoting is no record.
    """
    rows = scan.scan(spark, paths)
    return rows.where("error is null").select("path", "record_no", "line_start", "line_end", "readable", "fields")


def file_stats(spark: SparkSession, paths: str | list[str], records: DataFrame) -> DataFrame:
    """SRC-03: content hash, size, first and last log time and number of records of each file."""
    at = parse_log_time(F.col("log_at"))
    own = records.groupBy("path").agg(F.min(at).alias("first_log_at"), F.max(at).alias("last_log_at"), F.count("*").alias("records"))
    return scan.digests(spark, paths).join(own, "path", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def skip_known_content(files: DataFrame, imported: DataFrame) -> DataFrame:
    """SRC-04: ``to_import`` of each file: false if its source has that content already."""
    done = imported.where("state = 'succeeded'").select("source_id", "sha256").distinct().withColumn("_d", F.lit(True))
    return files.join(done, ["source_id", "sha256"], "left").withColumn("to_import", F.col("_d").isNull()).drop("_d")


def origin_changes(files: DataFrame, imported: DataFrame) -> DataFrame:
    """SRC-05: files whose origin was imported with other content."""
    old = imported.select("source_id", "origin_key", F.col("sha256").alias("old_sha256"))
    return files.join(old, ["source_id", "origin_key"]).where("sha256 <> old_sha256").select("source_id", "origin_key", "sha256", "old_sha256").distinct()


def edge_overlaps(records: DataFrame, edge: int = 32) -> DataFrame:
    """SRC-06: pairs of files of a source that share two neighbouring records among their first or last ``edge``.

    ``records``: source_id, file_id, record_no, session (null: invalid), log_at, body.
    """
    w = Window.partitionBy("file_id").orderBy("record_no")
    narrow = records.select("file_id", "record_no")  # bodies join the few edge records
    ends = first_rows(narrow, ["file_id"], ["record_no"], edge).unionByName(first_rows(narrow, ["file_id"], [F.desc("record_no")], edge)).select("file_id", "record_no").distinct()
    rows = records.join(ends, ["file_id", "record_no"], "left_semi")
    nxt = lambda c: F.lead(c).over(w)
    rows = rows.select("source_id", "file_id", "record_no", "session", "log_at", "body", nxt("session").alias("s2"), nxt("log_at").alias("l2"), nxt("body").alias("b2"), nxt("record_no").alias("r2"))
    pairs = rows.where("session is not null and s2 is not null and log_at <> l2 and r2 = record_no + 1").select("source_id", "file_id", F.sha2(F.concat_ws("\n", "body", "b2"), 256).alias("pair"))
    other = pairs.select("source_id", "pair", F.col("file_id").alias("other_id"))
    return pairs.join(other, ["source_id", "pair"]).where("file_id < other_id").select("source_id", "file_id", "other_id").distinct()


def reconcile_batch(old: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-07: state of each batch: conflict if a member of a successful import is gone or any member conflicts, complete if all succeeded or were skipped, else failed."""
    gone = old.where("state = 'succeeded'").select("batch_id", "path").join(new.select("batch_id", "path"), ["batch_id", "path"], "left_anti").groupBy("batch_id").agg(F.count("*").alias("removed"))
    own = new.groupBy("batch_id").agg(F.bool_or(F.col("state") == "conflict").alias("bad"), F.bool_and(F.col("state").isin("succeeded", "duplicate_skipped")).alias("good"))
    out = own.join(gone, "batch_id", "full_outer")
    state = F.when((F.col("removed") > 0) | F.col("bad"), "conflict").when(F.col("good"), "complete").otherwise("failed")
    return out.select("batch_id", state.alias("state"), F.coalesce("removed", F.lit(0)).alias("removed"))


def project_evidence(records: DataFrame, relevant: Column, readable: Column) -> DataFrame:
    """SRC-08: ``observed``, a map of the kept columns (four more on relevant records) that are not empty, and ``decode_state``."""
    pairs = [(c, F.col(c)) for c in KEPT] + [(c, F.when(relevant, F.col(c))) for c in KEPT_IF_RELEVANT]
    kept = F.map_filter(F.create_map(*[x for n, c in pairs for x in (F.lit(n), c)]), lambda k, v: F.coalesce(F.length(v) > 0, F.lit(False)))
    return records.withColumn("observed", kept).withColumn("decode_state", F.when(readable, "decoded").otherwise("invalid_encoding"))


def write_table(df: DataFrame, path: str, by: list[str]) -> None:
    """SRC-09: append to a table partitioned by ``by``; one job, no client buffer."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def day_inbox(listing: DataFrame, states: DataFrame, today: str) -> DataFrame:
    """SRC-10: days of each source with their files, marker, import state and what is wrong.

    ``listing``: source_id, name; log files are named ``gpdb-YYYY-MM-DD_HHMMSS.csv[.n]``, markers ``YYYY-MM-DD.complete``.
    """
    day = F.regexp_extract("name", r"^gpdb-(\d{4}-\d\d-\d\d)_\d{6}\.csv(?:\.\d+)?$", 1)
    mark = F.regexp_extract("name", r"^(\d{4}-\d\d-\d\d)\.complete$", 1)
    files = listing.withColumn("day", day).where("day <> ''").groupBy("source_id", "day").agg(F.count("*").alias("files"))
    marks = listing.withColumn("day", mark).where("day <> ''").select("source_id", "day").distinct().withColumn("marked", F.lit(True))
    out = files.join(marks, ["source_id", "day"], "full_outer").join(states, ["source_id", "day"], "left")
    problem = F.when(F.col("marked") & (F.col("day") >= today), "marker_not_before_today").when(F.col("marked").isNull(), "files_without_marker").when(F.col("files").isNull(), "marker_without_files")
    out = out.withColumn("problem", problem)
    work = F.when(F.col("state") == "complete", "imported").when(F.col("problem").isNull(), "pending").otherwise("waiting")
    return out.select("source_id", "day", F.coalesce("files", F.lit(0)).alias("files"), "problem", work.alias("work"))


def verify_push(manifest: DataFrame, received: DataFrame, first_day: str, today: str) -> DataFrame:
    """SRC-11: names with a failure: missing, size_mismatch, extra or day_outside_range."""
    a, b = manifest.select("name", F.col("size").alias("sent")), received.select("name", F.col("size").alias("got"))
    day = F.regexp_extract("name", r"(\d{4}-\d\d-\d\d)", 1)
    out = a.join(b, "name", "full_outer")
    code = F.when(F.col("got").isNull(), "missing").when(F.col("sent").isNull(), "extra").when(F.col("sent") != F.col("got"), "size_mismatch").when((day < first_day) | (day >= today), "day_outside_range")
    return out.select("name", code.alias("failure")).where("failure is not null")


def changed_day(known: DataFrame, present: DataFrame) -> DataFrame:
    """SRC-12: files of an imported day that are extra, missing or different."""
    a, b = known.select("name", F.col("sha256").alias("a")), present.select("name", F.col("sha256").alias("b"))
    code = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "different")
    return a.join(b, "name", "full_outer").select("name", code.alias("change")).where("change is not null")


def extend_manifest(old: DataFrame, scanned: DataFrame) -> DataFrame:
    """SRC-13: old entries unchanged and new files with records by day, a mark where the name's day has none, and errors where history differs.

    ``old``: name, records; ``scanned``: name, name_day, day (of each record).
    """
    days = scanned.groupBy("name", "name_day", "day").count()
    new = days.groupBy("name", "name_day").agg(F.sum("count").alias("found"), F.max(F.col("day") == F.col("name_day")).alias("named"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "day", "count"))), ",").alias("by_day"))
    out = old.select("name", F.col("records").alias("known")).join(new, "name", "full_outer")
    state = F.when(F.col("found").isNull(), "historical_file_missing").when(F.col("known").isNull(), "new").when(F.col("known") != F.col("found"), "historical_file_differs").otherwise("unchanged")
    return out.select("name", state.alias("state"), F.coalesce("known", "found").alias("records"), "by_day", (~F.col("named")).alias("day_mismatch"))


def sample_prefix(records: DataFrame, files: int, rows: int, most_bytes: int) -> DataFrame:
    """SRC-14: first ``rows`` records, up to ``most_bytes``, of the first ``files`` files of each cluster.

    Records are picked by narrow rows, each task sending its first few of a file; bodies join those that are picked.
    """
    chosen = first_rows(records.select("scope_id", "file_id").distinct(), ["scope_id"], ["file_id"], files).select("scope_id", "file_id")
    few = first_rows(records.select("scope_id", "file_id", "record_no", F.length("body").alias("_size")), ["file_id"], ["record_no"], rows)
    size = F.sum("_size").over(Window.partitionBy("file_id").orderBy("record_no").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("_b", size).where(F.col("_b") <= most_bytes).join(chosen, ["scope_id", "file_id"], "left_semi")
    return records.join(few.select("scope_id", "file_id", "record_no"), ["scope_id", "file_id", "record_no"], "left_semi")


def data_time_range(files: DataFrame) -> DataFrame:
    """SRC-15."""
    return files.groupBy("scope_id").agg(F.min("first_log_at").alias("first_at"), F.max("last_log_at").alias("last_at"), F.count("*").alias("files"))

