"""Totals kept in hash buckets of their keys, merged on read: a commit writes what changed and nothing else."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.operators.baseline import null_safe
from qlog.operators.builds import create_if_absent
from qlog.operators.tables import hadoop
from qlog.streaming.incremental import merge_totals


class BucketTotals:
    """STF-02..04: record_count, first_at and last_at by ``keys``, and with ``log`` the changes they come from.

    A commit reads the buckets of the keys it touches, and writes their new totals as one more run (a total that came to
    zero as a row with no records). A numbered manifest, made only if absent, names each bucket's runs; readers take the
    newest row of a key in these. A bucket with over ``most_runs`` runs is written anew as one, and files that neither
    the newest manifest nor the one before it names are deleted. Changes lie below their bucket, so that a retraction
    reads its own buckets' alone. Micro-batches have rising numbers; a repeated one changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], log: bool = False, buckets: int = 16, most_runs: int = 8, at: str = "end_at"):
        self.spark, self.path, self.keys, self.log, self.buckets, self.most_runs, self.at = spark, path.rstrip("/"), keys, log, buckets, most_runs, at

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in self.keys]), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifest(self) -> dict:
        """number, batch (the last one merged) and the runs of each bucket, oldest first."""
        names = self._manifests()
        if not names:
            return {"number": 0, "batch": -1, "runs": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}").first()[0])

    def _manifests(self) -> list[str]:
        path, fs = hadoop(self.spark, f"{self.path}/manifest")
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().endswith(".tmp")) if fs.exists(path) else []

    def _rows(self, manifest: dict, buckets: list[int] | None, like: DataFrame | None) -> DataFrame:
        """Newest rows of the keys of some buckets, those without records too."""
        runs = [f"{self.path}/{r}/bucket={b}" for b, rs in manifest["runs"].items() if buckets is None or int(b) in buckets for r in rs]
        if not runs:
            if like is None:
                if "schema" not in manifest:
                    raise ValueError("no batch was merged yet")
                return self.spark.createDataFrame([], T.StructType.fromJson(manifest["schema"]))
            return like.limit(0).select(*self.keys, F.lit(0).cast("long").alias("record_count"), F.col(self.at).alias("first_at"), F.col(self.at).alias("last_at"), F.lit(0).cast("long").alias("batch"))
        rows = self.spark.read.parquet(*runs)
        new = F.max_by(F.struct("record_count", "first_at", "last_at", "batch"), "batch").alias("t")
        return rows.groupBy(*self.keys).agg(new).select(*self.keys, "t.*")

    def read(self) -> DataFrame:
        """All totals as of the newest manifest."""
        return self._rows(self.manifest(), None, None).where("record_count > 0").drop("batch")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Merge a micro-batch of rows with ``retracted``; False if it was merged before."""
        manifest = self.manifest()
        if batch <= manifest["batch"]:
            return False
        changes = changes.withColumn("bucket", self.bucket()).persist()
        touched = sorted(r[0] for r in changes.select("bucket").distinct().collect())  # as many as there are buckets at most
        if self.log:  # a repeated batch overwrites its own
            changes.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch}")
        removed, added = (changes.where(F.col("retracted") == r).drop("retracted", "bucket") for r in (True, False))
        own_keys = changes.select(*self.keys).distinct()
        current = null_safe(own_keys, self._rows(manifest, touched, changes).where("record_count > 0").drop("batch"), self.keys, "inner")
        facts = removed.limit(0) if removed.isEmpty() else self._facts(touched, removed)
        new = merge_totals(current, facts, removed, added, self.keys, self.at)
        every = null_safe(own_keys, new, self.keys).withColumn("record_count", F.coalesce("record_count", F.lit(0)).cast("long"))
        run = self._write(every.withColumn("batch", F.lit(batch).cast("long")))
        changes.unpersist()
        runs = {b: list(rs) for b, rs in manifest["runs"].items()}
        for b in touched:
            runs.setdefault(str(b), []).append(run)
        full = [int(b) for b, rs in runs.items() if len(rs) > self.most_runs]
        if full:
            one = self._write(self._rows({"runs": runs}, full, None).where("record_count > 0"))
            runs |= {str(b): [one] if self._exists(f"{one}/bucket={b}") else [] for b in full}  # all totals of a bucket may be gone
        number = manifest["number"] + 1
        if not create_if_absent(self.spark, f"{self.path}/manifest/{number:08d}", json.dumps({"number": number, "batch": batch, "runs": runs, "schema": every.withColumn("batch", F.lit(0).cast("long")).schema.jsonValue()})):
            raise RuntimeError(f"another writer has merged into {self.path}")
        self._forget({r for rs in runs.values() for r in rs} | {r for rs in manifest["runs"].values() for r in rs})
        return True

    def _write(self, rows: DataFrame) -> str:
        name = f"runs/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def _exists(self, name: str) -> bool:
        path, fs = hadoop(self.spark, f"{self.path}/{name}")
        return fs.exists(path)

    def _facts(self, buckets: list[int], removed: DataFrame) -> DataFrame:
        """Rows, of keys that lost some, that came more often than they were retracted; each once."""
        rows = self.spark.read.parquet(f"{self.path}/log").where(F.col("bucket").isin(buckets)).drop("batch", "bucket")
        rows = null_safe(removed.select(*self.keys).distinct(), rows, self.keys, "inner")
        cols = [c for c in rows.columns if c != "retracted"]
        return rows.groupBy(*cols).agg(F.sum(F.when(F.col("retracted"), -1).otherwise(1)).alias("_n")).where("_n > 0").drop("_n")

    def _forget(self, named: set[str]) -> None:
        path, fs = hadoop(self.spark, f"{self.path}/runs")
        for s in fs.listStatus(path):
            if f"runs/{s.getPath().getName()}" not in named:
                fs.delete(s.getPath(), True)
