"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A batch is a table of signed per-document counts: inserts add, deletes take away, a revised count takes
the old one away and adds the new; ``changes`` derives it from an old and a new table of counts. Its sums
are written in a folder of their own, then one row in the commit log makes them count. A batch that is
in the log is not applied again; of one that failed half-way, or that two writers commit at the same time,
one attempt counts. Totals are sums over committed batches; ``compact`` adds up old batches into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qlog.llm.common import _root, table, text_key, written
from qlog.llm.tokens import load_tokenizer

KEYS = ["source", "lang", "version"]
#: ``into`` names the batch that a compaction added this one to.
LOG, SUMS = "batch string, attempt string, into string", "source string, lang string, version string, docs long, tokens long"


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, source, lang, tokens and th (identity of the text) of every row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer)
        for b in batches:
            counts: list[int] = []
            for _, _, ends in encode.runs(b.column(4)):
                counts += (ends[1:] - ends[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "th", "tokens"])

    own = docs.select(F.col("doc_id").cast("long"), "source", "lang", text_key().alias("th"), "text")
    return own.mapInArrow(run, "doc_id long, source string, lang string, th string, tokens long")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes that lead from ``old`` to ``new`` (doc_id, KEYS, th, tokens): KEYS, docs, tokens.

    A row of ``old`` alone is deleted, one of ``new`` alone inserted; a document with another count,
    source, language or version is both. Repeated rows count as often as they are there; nulls are values.
    """
    cols = ["doc_id", *KEYS, "th", "tokens"]
    both = old.select(*cols, F.lit(-1).alias("docs")).unionByName(new.select(*cols, F.lit(1).alias("docs")))
    return both.groupBy(*cols).agg(F.sum("docs").alias("docs")).where("docs <> 0").select(*KEYS, "docs", (F.col("docs") * F.col("tokens")).alias("tokens"))


def signed(counts: DataFrame, version: str, sign: int, tokens: str = "tokens") -> DataFrame:
    """Changes: +1 for inserted, -1 for deleted documents, with their tokens under a tokenizer version."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).alias("docs"), (F.lit(sign) * F.col(tokens)).alias("tokens"))


class Rollup:
    """Totals in a folder of a shared store; null sources and languages are groups of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        """One row for each committed batch: its smallest attempt, and the batch it was added to."""
        return self._read("log", LOG).groupBy("batch").agg(F.min("attempt").alias("attempt"), F.max("into").alias("into"))

    def _add(self, sums: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        sums.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SUMS.split(", ")]).write.parquet(f"{self.path}/sums/batch={attempt}")
        return attempt

    def _log(self, rows: list[tuple]) -> None:
        """All rows in one file, so they come to count together."""
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (KEYS, docs, tokens) once under the name ``batch``; False if it was there.

        A retry of the same batch is safe at any point, also beside another writer.
        """
        if not self.log().where(F.col("batch") == batch).isEmpty():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        self._log([(batch, self._add(sums), None)])
        return True

    def totals(self) -> DataFrame:
        """KEYS, docs, tokens over all committed batches; groups that came to nothing are left out."""
        return self._sums(self.log().where("into is null")).where("docs <> 0 or tokens <> 0")

    def _sums(self, batches: DataFrame) -> DataFrame:
        sums = self._read("sums", SUMS + ", batch string").join(batches.select(F.col("attempt").alias("batch")), "batch", "left_semi")
        return sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def compact(self) -> int:
        """Add all committed batches up into one, one compaction at a time; their names stay known. Gives their number."""
        past = [tuple(r) for r in self.log().where("into is null").collect()]  # a row for each batch since the last compaction
        if len(past) > 1:
            name = f"compacted {quote(max(b for b, *_ in past), safe='')} {uuid.uuid4().hex}"
            attempt = self._add(self._sums(self.spark.createDataFrame(past, LOG)))
            self._log([(name, attempt, None), *[(b, a, name) for b, a, _ in past]])
        return len(past)


def maintained_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over ``documents`` after three states of the table, each batch derived from two of them.

    First all rows are there; then the copies of a text are gone (all rows but those of its smallest id;
    null texts are one text, rows without an id stay); then the counts of documents in German are of the
    version that counts the end id as well. Both later batches come a second time, which changes nothing,
    and all are compacted. Repeated rows of one id count as often as they are there. An empty table
    gives no rows; other columns are ignored.
    """
    plain, ended = F.lit("word_bpe_49k"), F.lit("word_bpe_49k+end")
    first = written(count_tokens(table(spark, sf_dir, "documents")).withColumn("version", plain).withColumn("th", F.coalesce("th", F.lit(""))), "counts")
    kept = written(first.groupBy("th").agg(F.min("doc_id").alias("kept")), "kept")
    # written, as a frequent text would else go from the join to one task of the sums
    second = written(first.join(kept, "th").where("doc_id is null or doc_id = kept").drop("kept"), "second")
    german = F.col("lang").eqNullSafe("de")
    third = second.withColumn("version", F.when(german, ended).otherwise(plain)).withColumn("tokens", F.col("tokens") + german.cast("long"))
    rollup = Rollup(spark, f"{_root(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("001-insert", changes(first.where("false"), first))
    for _ in range(2):
        rollup.commit("002-delete", changes(first, second))
        rollup.commit("003-revise", changes(second, third))
    rollup.compact()
    return rollup.totals()
