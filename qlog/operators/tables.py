"""Tables written into the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stores: dict[str, str] = {}


def hadoop(spark: SparkSession, name: str):
    """Hadoop's path of a name and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def store(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared one (a local one only where the session names none); it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _stores:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            named = os.path.join(tempfile.gettempdir(), "checkpoints")
            os.makedirs(named, exist_ok=True)
        _stores[app] = f"{named.rstrip('/')}/qlog-{app}-{uuid.uuid4().hex[:12]}"
        path, fs = hadoop(spark, _stores[app])
        fs.deleteOnExit(path)
    return _stores[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what stands above is computed once, and a lost executor costs a re-read."""
    path = f"{store(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, rows: int) -> int:
    """Partitions of about ``rows`` rows each; of a stored table the count is in its footers."""
    return max(1, -(-df.count() // rows))
