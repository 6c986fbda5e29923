"""Training-corpus pipeline: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qlog.llm.common import table, text_key, written
from qlog.llm.decontaminate import remove_contaminated
from qlog.llm.ngram_join import jaccard_components
from qlog.llm.packing import pack
from qlog.llm.pii import pseudonymise
from qlog.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below their language's threshold."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("not rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id, and of several texts under that id the one with the
    smallest hash; all that are linked with nothing.

    Linked are documents with a Jaccard of at least 0.9 of their three-word shingles.
    Rows that repeat an id and its text are one document; rows of one id with different texts are several.
    Rows without an id stay.
    """
    linked = jaccard_components(docs, text_hash=True).where("doc_id is not null").withColumn("_h", F.coalesce("th", F.lit("")))
    same = F.col("doc_id") == F.col("component_id")
    # components whose smallest id stands on several of their texts
    rivals = linked.where(same & F.col("component").isNotNull()).groupBy("component").agg(F.min("_h").alias("_first"), F.max("_h").alias("_last"))
    rivals = written(rivals.where("_first <> _last").select("component", "_first"), "rivals")
    other = linked.join(rivals, "component", "left").withColumn("_copy", ~same | (F.coalesce("_first", "_h") != F.col("_h"))) if not rivals.isEmpty() else linked.withColumn("_copy", ~same)
    marks = other.groupBy("doc_id", "_h").agg(F.max("_copy").alias("_copy"), (F.count("*") > 1).alias("_repeated")).where("_copy or _repeated")
    marks = written(marks, "marks")
    found = docs.withColumn("_h", F.coalesce(text_key(), F.lit(""))).join(marks, ["doc_id", "_h"], "left").where("not coalesce(_copy, false)")
    if marks.where("_repeated").isEmpty():
        return found.select(docs.columns)
    repeated = F.coalesce("_repeated", F.lit(False))
    return found.where(~repeated).unionByName(found.where(repeated).dropDuplicates(["doc_id", "_h"])).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover under a twentieth."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data; ``n_chars`` follows the new text."""
    out = pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return pack(docs)


STAGES: list[tuple[str, Callable]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("packing", pack_documents),
]
#: Trained scores, keyed surrogates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
