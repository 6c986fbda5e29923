"""Helpers that the training-data operators share: written tables, text slices, token hashes."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def release() -> None:
    """Give memory that is no longer used back to the system; workers live on after a training."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


_ODD = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine), a fresh folder below the
    temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not _own_dir:
        top = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(top, exist_ok=True)
        _own_dir.append(tempfile.mkdtemp(dir=top))
    return _own_dir[0]


_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """Folder of this application below the shared folder; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark).rstrip('/')}/qlog-{app}-{uuid.uuid4().hex[:12]}"
        path, fs = _hadoop(spark, _roots[app])
        fs.deleteOnExit(path)
    return _roots[app]


def _hadoop(spark: SparkSession, name: str):
    """Hadoop's path of a name and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage.

    A lost executor then costs a re-read, not a recomputation of what stands above. The table is
    deleted by ``forget``, or with all others when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._qlog_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path, fs = _hadoop(df.sparkSession, df._qlog_path)
        fs.delete(path, True)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast of a written table if its count is at most ``most_rows``, else the table as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df


#: Documents are large rows: so many a batch keep a Python worker's memory to some tens of MB.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the session then sends Python at most ``ARROW_ROWS`` rows a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(col: str = "text") -> Column:
    """Identity of a text: its SHA-256, null for a null text."""
    return F.sha2(col, 256)


def fold(col: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; null ids fall into no fold (null)."""
    return F.crc32(col.cast("string").cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of about ``most_bytes``; a longer text is its own run.

    Nulls count as empty texts.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens: runs of bytes of one non-zero kind inside one text.

    Returns (start, end) of each token and, per text, the index of its first token (one more at the end).
    """
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    k = kinds[raw]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(k[1:], k[:-1], out=edge[1:n])
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    start, end = bounds[:-1], bounds[1:]
    keep = k[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(start, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first n bytes of a little-endian load, n from 0 to 8.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)
#: Ranges of more bytes are rare and are hashed one by one.
LONG = 64


class Hasher:
    """64-bit hashes and comparisons of byte ranges of one run of texts, eight bytes a step.

    ``fold_case`` folds A-Z. A range's hash depends on its bytes alone, so hashes of different runs compare.
    """

    def __init__(self, raw: np.ndarray, fold_case: bool = False):
        self.bytes = np.zeros(len(raw) + 16, np.uint8)
        self.bytes[: len(raw)] = _LOWER[raw] if fold_case else raw
        self.loads = np.ndarray((len(raw) + 8,), "<u8", self.bytes, strides=(1,))  # the eight bytes from each byte on

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix(size.astype(U64) + U64(_ODD))
        live = np.flatnonzero((size > 0) & (size <= LONG))
        for k in range(0, LONG, 8):
            if not len(live):
                break
            own = self.loads[start[live] + k] & _MASKS[np.minimum(size[live] - k, 8)]
            h[live] = mix((h[live] ^ own) * U64(0xD6E8FEB86659FD93))
            live = live[size[live] > k + 8]
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def equal(self, start: np.ndarray, end: np.ndarray, other: Hasher, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Whether each range equals, byte for byte, the other run's range from ``at`` to ``to``."""
        size = end - start
        same = size == to - at
        live = np.flatnonzero(same & (size > 0) & (size <= LONG))
        for k in range(0, LONG, 8):
            if not len(live):
                break
            ok = (self.loads[start[live] + k] ^ other.loads[at[live] + k]) & _MASKS[np.minimum(size[live] - k, 8)] == 0
            same[live[~ok]] = False
            live = live[ok & (size[live] > k + 8)]
        for i in np.flatnonzero(same & (size > LONG)):
            same[i] = np.array_equal(self.bytes[start[i] : end[i]], other.bytes[at[i] : to[i]])
        return same
