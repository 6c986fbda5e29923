"""Inverted index of character trigrams over folded texts, kept up batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qlog.functions import text as tx

GRAM = 3
MOST_CHARS = 4_000_000  # characters whose trigrams are sorted at once, a longer text apart


def grams(text: Column) -> Column:
    """Distinct trigrams of a text; none of one under three characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))  # overlapping, by lookahead


def _listed(ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Trigrams of a few texts, each with the ids of the texts that hold it."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    used = np.zeros(int(chars.max(initial=0)) + 1, dtype=bool)
    used[chars] = True
    letters, dense = np.flatnonzero(used), (np.cumsum(used) - 1)[chars]  # characters numbered without gaps
    if len(texts) > 1 and len(letters) ** GRAM * len(texts) >= 1 << 63:  # one text's trigrams always fit a long
        half = len(texts) // 2
        yield from _listed(ids[:half], texts[:half])
        yield from _listed(ids[half:], texts[half:])
        return
    at = np.flatnonzero(own[: 1 - GRAM] == own[GRAM - 1 :])
    code = np.zeros(len(at), dtype=np.int64)
    for n in range(GRAM):
        code = code * len(letters) + dense[at + n]
    pairs = np.sort(code * len(texts) + own[at])
    if len(pairs):
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        code, doc = np.divmod(pairs, len(texts))
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[first, len(pairs)].astype(np.int32)
        of = [letters[code[first] // len(letters) ** n % len(letters)] for n in reversed(range(GRAM))]
        named = pa.array(["".join(map(chr, g)) for g in zip(*[c.tolist() for c in of])], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(doc)))
        yield pa.RecordBatch.from_arrays([named, lists, pa.array(np.diff(ends).astype(np.int64))], ["gram", "ids", "n"])


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ids, n) of (sql_id, text as bytes), by runs of texts of at most ``MOST_CHARS``; bytes that are no UTF-8 are in no term."""
    for b in batches:
        ids, texts = b.columns[0], [t.decode("utf-8", "replace") for t in b.columns[1].to_pylist()]
        first = held = 0
        for n, t in enumerate(texts):
            if held and held + len(t) > MOST_CHARS:
                yield from _listed(ids[first:n], texts[first:n])
                first, held = n, 0
            held += len(t)
        if held >= GRAM:
            yield from _listed(ids[first:], texts[first:])


class TextIndex:
    """Posting rows (gram, the ids of a run of texts) in sorted files by gram bucket, counts by gram, and the texts, one folder a batch each.

    A repeated batch replaces its own. A search reads the buckets of a few rare trigrams of each term, intersects their
    texts and verifies these; what all texts have does not help, so terms whose rarest trigram is in over ``common`` of
    the texts, and terms under three characters, are left to the verification. Without any other term all texts are scanned.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, spread: int = 4, rare: int = 3, common: float = 0.2):
        self.spark, self.path, self.buckets, self.spread, self.rare, self.common = spark, path.rstrip("/"), buckets, spread, rare, common

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.crc32(gram.cast("binary")), F.lit(self.buckets)).cast("int")

    def add(self, batch: int, texts: DataFrame) -> None:
        """``texts``: sql_id, search_text (folded) and any columns that a search gives back; ids are new ones."""
        texts.write.mode("overwrite").parquet(f"{self.path}/texts/batch={batch}")
        own = self.spark.read.parquet(f"{self.path}/texts/batch={batch}")
        kind = dict(own.dtypes)["sql_id"]
        read = own.where("search_text is not null").select("sql_id", F.col("search_text").cast("binary").alias("text"))
        rows = read.mapInArrow(_post, f"gram string, ids array<{kind}>, n long").withColumn("bucket", self._bucket(F.col("gram")))
        # a frequent trigram's runs go to several files
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(self.spread))).sortWithinPartitions("bucket", "gram")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        counts = self._runs(batch).groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch}")

    def _runs(self, batch: int | None = None) -> DataFrame:
        return self._read("postings" if batch is None else f"postings/batch={batch}", "gram string, ids array<string>, n long, bucket int")

    def postings(self, batch: int | None = None) -> DataFrame:
        """A row a trigram and text; filters on ``gram`` and ``bucket`` are met before the lists are opened."""
        return self._runs(batch).select("gram", F.explode("ids").alias("sql_id"), "bucket")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)  # nothing is indexed, or no text has a trigram
        return found

    def texts(self) -> DataFrame:
        return self._read("texts", "sql_id string, search_text string").drop("batch")

    def plan(self, terms: list[str]) -> list[str] | None:
        """Trigrams to intersect, None to scan; a trigram that no text has answers the search alone."""
        by_term = {t: {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in set(terms)}
        wanted = sorted(set().union(*by_term.values()))
        if not wanted:
            return None
        counts = self._read("counts", "bucket int, gram string, n long")
        found = counts.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # as many as the terms have
        known = {r["gram"]: r["n"] for r in found}
        absent = [g for g in wanted if g not in known]
        if absent:
            return absent[:1]
        most = self.common * self.texts().count()
        chosen = [g for own in by_term.values() for g in sorted(own, key=lambda g: (known[g], g))[: self.rare] if known[g] <= most]
        return sorted(set(chosen)) or None

    def candidates(self, chosen: list[str]) -> DataFrame:
        """sql_id of texts that have all the trigrams."""
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in chosen], "g string").select(self._bucket(F.col("g"))).distinct().collect()]
        met = self.postings().where(F.col("bucket").isin(buckets) & F.col("gram").isin(chosen))
        return met.groupBy("sql_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(chosen)).select("sql_id")

    def search(self, terms: list[str]) -> DataFrame:
        """TXT-05: texts that hold all terms as substrings, with their columns."""
        texts, chosen = self.texts(), self.plan(terms)
        if chosen is not None:
            texts = texts.join(self.candidates(chosen), "sql_id", "left_semi")
        return texts.where(tx.match_all_terms(F.col("search_text"), F.lit(terms))) if terms else texts
