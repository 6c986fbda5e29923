"""Facts clustered by key and end time, with a zone map of their files: pages and ranges of one key read its own files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.operators.builds import create_if_absent
from qlog.operators.search import history
from qlog.operators.tables import hadoop


class ClusteredFacts:
    """QRY-01..03, 11, 19 from stored facts, one run of files a batch, named by a numbered manifest.

    A run is range-partitioned and sorted by bucket and hash of ``keys`` and then newest first, so a frequent key spreads
    over many files, each of them one range of time, while rare keys share a file. The zone map tells for each file its
    end times, its least and its greatest hash, and the end times of these two, which alone may go on in other files.
    Manifests are made only if absent: of two writers one wins, the other tries again on top of it. A repeated batch
    replaces its own; runs that were replaced are deleted at the change after that, while a run whose writer failed before
    its manifest stays as an unread folder. Null keys are keys like others; rows without an end come last in a page and
    in no range.
    """

    ORDER = ["end_at", "analysis_id", "occurrence_id"]
    SPAN = "struct<low_at:timestamp_ntz,high_at:timestamp_ntz>"
    ZONES = f"bucket int, file string, low_key long, high_key long, first {SPAN}, last {SPAN}, every {SPAN}, rows long"

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, rows_per_file: int = 1_000_000, tries: int = 5):
        self.spark, self.path, self.keys, self.buckets, self.rows_per_file, self.tries = spark, path.rstrip("/"), keys, buckets, rows_per_file, tries

    def _hash(self, values: list[Column]) -> Column:
        return F.xxhash64(*[F.coalesce(v.cast("string"), F.lit("\0")) for v in values])

    def _place(self, key: dict[str, object]) -> tuple[int, int]:
        """Bucket and hash of a key."""
        row = self.spark.range(1).select(self._hash([F.lit(key[k]) for k in self.keys]).alias("h"))
        bucket, h = row.select(F.pmod("h", F.lit(self.buckets)).cast("int"), "h").first()
        return bucket, h

    def manifest(self) -> dict:
        """number, schema and the run of each batch."""
        path, fs = hadoop(self.spark, f"{self.path}/manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().endswith(".tmp")) if fs.exists(path) else []
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}").first()[0]) if names else {"number": 0, "schema": None, "runs": {}}

    def _write(self, facts: DataFrame) -> str:
        """A new run and its zones."""
        name = f"runs/{uuid.uuid4().hex}"
        rows = facts.withColumn("_key", self._hash([F.col(k) for k in self.keys])).withColumn("bucket", F.pmod("_key", F.lit(self.buckets)).cast("int"))
        order = ["bucket", "_key", *[F.desc(c) for c in self.ORDER]]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        dealt.write.option("maxRecordsPerFile", self.rows_per_file).partitionBy("bucket").parquet(f"{self.path}/{name}/facts")
        own = self.spark.read.schema(dealt.schema).parquet(f"{self.path}/{name}/facts")
        by_key = own.select("bucket", "_key", "end_at", F.col("_metadata.file_name").alias("name")).groupBy("bucket", "name", "_key")
        by_key = by_key.agg(F.min("end_at").alias("low_at"), F.max("end_at").alias("high_at"), F.count("*").alias("n"))
        span, every = F.struct("low_at", "high_at"), F.struct(F.min("low_at").alias("low_at"), F.max("high_at").alias("high_at"))
        zones = by_key.groupBy("bucket", "name").agg(
            F.min("_key").alias("low_key"), F.max("_key").alias("high_key"), F.min_by(span, "_key").alias("first"), F.max_by(span, "_key").alias("last"), every.alias("every"), F.sum("n").alias("rows")
        )
        file = F.concat(F.lit(f"{name}/facts/bucket="), F.col("bucket").cast("string"), F.lit("/"), F.col("name"))
        zones = zones.select("bucket", file.alias("file"), "low_key", "high_key", "first", "last", "every", "rows")
        zones.sort("bucket", "low_key").write.parquet(f"{self.path}/{name}/zones")
        return name

    def _publish(self, schema: dict, change) -> None:
        """Put ``change`` of the newest manifest's runs on top of it."""
        for _ in range(self.tries):
            old = self.manifest()
            new = {"number": old["number"] + 1, "schema": schema, "runs": change(old["runs"])}
            if create_if_absent(self.spark, f"{self.path}/manifest/{new['number']:08d}", json.dumps(new)):
                return self._forget({*old["runs"].values(), *new["runs"].values()})
        raise RuntimeError(f"other writers kept changing {self.path}")

    def _forget(self, named: set[str]) -> None:
        """Delete replaced runs that no reader of the last two manifests needs; a run never named may be another writer's at work."""
        path, fs = hadoop(self.spark, f"{self.path}/runs")
        for s in fs.listStatus(path):
            name = f"runs/{s.getPath().getName()}"
            if name not in named and fs.exists(hadoop(self.spark, f"{self.path}/{name}/replaced")[0]):
                fs.delete(s.getPath(), True)
        for name in named - set(self.manifest()["runs"].values()):
            fs.create(hadoop(self.spark, f"{self.path}/{name}/replaced")[0], True).close()

    def add(self, batch: int, facts: DataFrame) -> None:
        """Facts of a batch; of a repeated batch in place of its earlier ones."""
        run = self._write(facts)
        self._publish(facts.schema.jsonValue(), lambda runs: runs | {str(batch): run})

    def compact(self) -> None:
        """All runs as one, so that a key's rows lie together again; a batch added or repeated meanwhile makes this an error."""
        old = self.manifest()
        if len(old["runs"]) < 2:
            return
        run = self._write(self.read())

        def change(runs: dict) -> dict:
            if runs != old["runs"]:
                raise RuntimeError(f"{self.path} has changed during its compaction")
            return dict.fromkeys(runs, run)

        self._publish(old["schema"], change)

    def _schema(self) -> T.StructType:
        found = self.manifest()["schema"]
        if found is None:
            raise ValueError("no batch was added yet")
        return T.StructType.fromJson(found)

    def _stored(self, schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField("_key", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def read(self) -> DataFrame:
        """All facts of the newest manifest."""
        schema, runs = self._schema(), sorted(set(self.manifest()["runs"].values()))
        every = [self.spark.read.schema(self._stored(schema)).parquet(f"{self.path}/{r}/facts") for r in runs]
        return self._one(every).select(*schema.names)

    @staticmethod
    def _one(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def zones(self) -> DataFrame:
        """The zone map: one row a file."""
        return self.spark.read.schema(self.ZONES).parquet(*[f"{self.path}/{r}/zones" for r in sorted(set(self.manifest()["runs"].values()))])

    def of_key(self, key: dict[str, object], start: Column | None = None, end: Column | None = None) -> DataFrame:
        """QRY-01..03, 19: facts of a key in [start, end): its buckets alone, in them row groups by hash and end time."""
        (bucket, h), schema = self._place(key), self._schema()
        parts = []
        for r in sorted(set(self.manifest()["runs"].values())):
            own = self.spark.read.schema(self._stored(schema)).parquet(f"{self.path}/{r}/facts").where((F.col("bucket") == bucket) & (F.col("_key") == h))
            own = own if start is None else own.where(F.col("end_at") >= start)
            parts.append(own if end is None else own.where(F.col("end_at") < end))
        return self._exact(self._one(parts), key).select(*schema.names)

    def _exact(self, rows: DataFrame, key: dict[str, object]) -> DataFrame:
        """Other keys may have the same hash."""
        for k in self.keys:
            rows = rows.where(F.col(k).eqNullSafe(F.lit(key[k])))
        return rows

    def page_files(self, key: dict[str, object], cursor: tuple | None, limit: int, where: Column | None = None) -> list[str]:
        """Files to read for a page: from the newest on until what is left is older than the page's last row.

        Twice as many are opened at each step. The driver holds the end times of a page and the names of files opened.
        """
        bucket, h = self._place(key)
        zones = self.zones().where((F.col("bucket") == bucket) & (F.col("low_key") <= h) & (F.col("high_key") >= h))
        span = F.when(F.col("low_key") == h, F.col("first")).when(F.col("high_key") == h, F.col("last")).otherwise(F.col("every"))
        zones = zones.select("file", span.alias("span")).select("file", "span.*")
        if cursor is not None and cursor[0] is not None:
            zones = zones.where(F.col("low_at").isNull() | (F.col("low_at") <= F.lit(cursor[0]).cast("timestamp_ntz")))
        zones = zones.select("file", "high_at").orderBy(F.desc_nulls_last("high_at"), "file")
        opened: list[str] = []
        ends: list = []  # of the newest limit + 1 matching rows, None where a row has no end
        step = 1
        while True:
            next_ones = zones.offset(len(opened)).limit(step + 1).collect()
            taken = [z["file"] for z in next_ones[:step]]
            if taken:
                rows = self._page_rows(taken, key, h, where).select(*self.ORDER)
                found = self._after(rows, cursor).orderBy(F.desc_nulls_last("end_at")).limit(limit + 1)
                ends = sorted([*ends, *[r["end_at"] for r in found.collect()]], key=lambda t: (t is not None, t), reverse=True)[: limit + 1]
                opened += taken
            if len(next_ones) <= step:
                return opened
            left = next_ones[step]["high_at"]  # the newest end that is not read yet
            if len(ends) > limit and ends[-1] is not None and (left is None or left < ends[-1]):
                return opened
            step *= 2

    def _page_rows(self, files: list[str], key: dict[str, object], h: int, where: Column | None) -> DataFrame:
        stored = T.StructType(self._stored(self._schema()).fields[:-1])
        rows = self.spark.read.schema(stored).parquet(*[f"{self.path}/{f}" for f in files]).where(F.col("_key") == h)
        rows = self._exact(rows, key)
        return rows if where is None else rows.where(where)

    def _after(self, rows: DataFrame, cursor: tuple | None) -> DataFrame:
        if cursor is None:
            return rows
        kinds = dict(rows.dtypes)
        return rows.where(F.struct(*self.ORDER) < F.struct(*[F.lit(v).cast(kinds[c]) for v, c in zip(cursor, self.ORDER)]))

    def page(self, key: dict[str, object], cursor: tuple | None, limit: int, where: Column | None = None) -> DataFrame:
        """QRY-11: a keyset page of one key, newest first, as ``search.history`` gives it over all facts; ``where`` filters the key's rows."""
        schema = self._schema()
        files = self.page_files(key, cursor, limit, where)
        if not files:
            return history(self.spark.createDataFrame([], schema), cursor, limit)
        return history(self._page_rows(files, key, self._place(key)[1], where).select(*schema.names), cursor, limit)
