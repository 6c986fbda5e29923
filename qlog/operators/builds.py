"""Builds in a shared folder: written whole, checked, published by numbered log entries that only one writer can make, dropped by month."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qlog.operators.tables import hadoop


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A file with ``text``, seen whole or not at all; False if there is one of that name.

    Atomic where the file system renames atomically without overwriting, as HDFS does; local files are linked into place.
    """
    jvm = spark._jvm
    target, fs = hadoop(spark, path)
    made, _ = hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            link = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(link(target), link(made))
        else:
            modes = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, target, modes)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        if fs.exists(made):
            fs.delete(made, False)


class Builds:
    """FCT-11, FCT-14: builds of scopes, one folder a build below its month, partitioned by layer.

    Every attempt to publish ends in a log entry of its scope, numbered without gaps: ``published``, ``no_samples``,
    ``check_failed`` or ``publish_failed``. A number can be taken once, so of two writers that start from one state of
    the log one publishes and the other is told that the state has changed. Readers see the newest published build that
    is not cleaned, or none, never a part of one; a build that failed before its entry is not seen. A build id is
    published once.
    """

    LOG = "number int, scope string, build_id string, result string, reason string, at string, month string, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log_of(self, scope: str) -> str:
        return f"{self.path}/log/{hashlib.sha256(scope.encode()).hexdigest()[:32]}"

    def _files(self, folder: str) -> list[str]:
        path, fs = hadoop(self.spark, folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().endswith(".tmp")) if fs.exists(path) else []

    def _entries(self, folder: str, schema: str) -> list[dict]:
        """Log entries in their order; a log has one row an attempt."""
        names = self._files(folder)
        if not names:
            return []
        rows = self.spark.read.schema(schema).json([f"{folder}/{n}" for n in names])
        return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["number"])

    def log(self, scope: str) -> list[dict]:
        return self._entries(self._log_of(scope), self.LOG)

    def cleaned(self) -> list[dict]:
        return self._entries(f"{self.path}/cleaned", "number int, folder string, build_id string, month string, at string")

    def _append(self, folder: str, number: int, entry: dict) -> bool:
        return create_if_absent(self.spark, f"{folder}/{number:08d}", json.dumps({"number": number} | entry))

    def publish(self, scope: str, build_id: str, stats: DataFrame, checks: Callable[[DataFrame], DataFrame] | None = None, at: datetime | None = None) -> bool:
        """Whether ``stats``, written and checked, became the scope's current build; see ``attempt``."""
        return self.attempt(scope, build_id, stats, checks, at) == "published"

    def attempt(self, scope: str, build_id: str, stats: DataFrame, checks: Callable[[DataFrame], DataFrame] | None = None, at: datetime | None = None) -> str:
        """Write, check and publish; the result that was logged, or ``known`` (not logged) for a build id published before.

        ``checks`` gets the statistics as written and gives rows with ``state`` passed or failed (FCT-10) and, where the
        build may have no samples, ``samples`` in statistics (``included_count``).
        """
        before = self.log(scope)
        if any(e["build_id"] == build_id and e["result"] == "published" for e in before):
            return "known"
        now = (at or datetime.now(timezone.utc)).astimezone(timezone.utc)
        month = f"{now:%Y-%m}"
        folder = f"builds/month={month}/{build_id}-{uuid.uuid4().hex[:8]}"
        stats.write.partitionBy("layer").parquet(f"{self.path}/{folder}")
        result, reason = self._result(folder, checks)
        entry = {"scope": scope, "build_id": build_id, "at": now.isoformat(), "month": month, "folder": folder}
        number = len(before) + 1
        while not self._append(self._log_of(scope), number, entry | {"result": result, "reason": reason}):
            number += 1
            if result == "published":
                result, reason = "publish_failed", "scope_changed"
        return result

    def _result(self, folder: str, checks) -> tuple[str, str | None]:
        if checks is None:
            return "published", None
        own = self.spark.read.parquet(f"{self.path}/{folder}")
        failed = [r["check"] for r in checks(own).where("state = 'failed'").select("check").collect()]  # six checks
        if failed:
            return "check_failed", ",".join(sorted(failed))
        if "included_count" in own.columns and not own.where("layer = 'overall'").agg(F.coalesce(F.sum("included_count"), F.lit(0))).first()[0]:
            return "no_samples", None
        return "published", None

    def current(self, scope: str) -> DataFrame | None:
        """Statistics of the scope's current build; filters on ``layer`` read that layer's files alone."""
        entry = self._current(scope, self.cleaned())
        return None if entry is None else self.spark.read.parquet(f"{self.path}/{entry['folder']}")

    def _current(self, scope: str, cleaned: list[dict]) -> dict | None:
        gone = {c["folder"] for c in cleaned}
        return next((e for e in reversed(self.log(scope)) if e["result"] == "published" and e["folder"] not in gone), None)

    def clean(self, scopes: list[str], months: int, now: datetime) -> list[str]:
        """FCT-14: delete builds over ``months`` months old, but for each scope's current one; build ids that went.

        Each is logged before its folder goes, so that a clean that broke off is finished by the next; nothing that stays
        is read or rewritten.
        """
        cleaned, went = self.cleaned(), []
        gone, number = {c["folder"] for c in cleaned}, len(cleaned)
        for c in cleaned:
            self._delete(c["folder"])
        for scope in scopes:
            current = self._current(scope, cleaned)
            for e in self.log(scope):
                year, month = map(int, e["month"].split("-"))
                if e["folder"] in gone or (current and e["folder"] == current["folder"]) or (now.year - year) * 12 + now.month - month <= months:
                    continue
                number += 1
                while not self._append(f"{self.path}/cleaned", number, {k: e[k] for k in ("folder", "build_id", "month")} | {"at": now.isoformat()}):
                    number += 1
                self._delete(e["folder"])
                went.append(e["build_id"])
        return went

    def _delete(self, folder: str) -> None:
        path, fs = hadoop(self.spark, f"{self.path}/{folder}")
        fs.delete(path, True)


def drop_partitions(spark: SparkSession, path: str, by: list[str], expired: DataFrame) -> DataFrame:
    """FCT-14 for a table partitioned by ``by``: expired partitions are logged below ``_cleaned`` and deleted; what stays.

    ``expired`` holds one row a partition, a few hundred by nature (clusters times months).
    """
    keys = expired.select(*by).distinct()
    keys.write.mode("append").parquet(f"{path}/_cleaned")  # names with an underscore are no part of the table
    for r in keys.toLocalIterator():
        part, fs = hadoop(spark, path + "".join(f"/{k}={r[k]}" for k in by))
        fs.delete(part, True)
    return spark.read.parquet(path)
