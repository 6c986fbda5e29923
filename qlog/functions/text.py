"""Text functions of the search layer: folding, terms, matching, shared and differing parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER, BLANKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\r\f\u000b"
MOST_TERMS = 20


def search_fold(text: Column) -> Column:
    """TXT-02: ASCII capitals lowered, the six ASCII blanks removed."""
    return F.translate(text, UPPER + BLANKS, LOWER)


def search_terms(text: Column, mode: str = "words") -> Column:
    """TXT-03: folded words, or the whole folded input as one passage."""
    if mode == "passage":
        return F.filter(F.array(search_fold(text)), lambda t: t != "")
    return F.filter(F.transform(F.split(text, r"[ \t\n\r\f\x0B]+"), search_fold), lambda t: t != "")


def terms_error(terms: Column, mode: str = "words") -> Column:
    """TXT-03: why an input cannot be searched, or null."""
    many = F.size(terms) > MOST_TERMS if mode == "words" else F.lit(False)
    return F.when(F.size(terms) == 0, "empty_search_input").when(many, "too_many_search_terms")


def match_all_terms(search_text: Column, terms: Column) -> Column:
    """TXT-05: every term is a substring."""
    return F.forall(terms, lambda t: F.contains(search_text, t))


def dedup_texts(records: DataFrame, text: str = "text") -> DataFrame:
    """TXT-01: one row a distinct text: sql_id (hash of its bytes), text, search_text. Equal hashes of unequal texts would be two rows."""
    return records.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("records")).select(F.sha2("text", 256).alias("sql_id"), "text", search_fold(F.col("text")).alias("search_text"), "records")


def shared_head_tail(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """TXT-06: lengths of the longest common prefix and suffix of each group's texts, not overlapping in the shortest.

    The common prefix of a set is that of its smallest and largest member in binary order.
    """
    ends = texts.groupBy(*by).agg(F.min(text).alias("a"), F.max(text).alias("z"), F.min(F.reverse(text)).alias("ra"), F.max(F.reverse(text)).alias("rz"), F.min(F.length(text)).alias("shortest"), F.count_distinct(text).alias("texts"))
    head = common_prefix_length(F.col("a"), F.col("z"))
    tail = common_prefix_length(F.col("ra"), F.col("rz"))
    return ends.select(*by, "texts", head.alias("head"), F.least(tail, F.col("shortest") - head).alias("tail"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """TXT-06: characters that two texts share from the start, by bisection over the length."""
    state = F.named_struct(F.lit("lo"), F.lit(0), F.lit("hi"), F.least(F.length(a), F.length(b)))
    mid = lambda s: ((s["lo"] + s["hi"] + 1) / 2).cast("int")
    step = lambda s, _: F.when(
        F.left(a, mid(s)) == F.left(b, mid(s)), F.named_struct(F.lit("lo"), mid(s), F.lit("hi"), s["hi"])
    ).otherwise(F.named_struct(F.lit("lo"), s["lo"], F.lit("hi"), F.greatest(s["lo"], mid(s) - 1)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), state, step, lambda s: s["lo"])


def differing_part(text: Column, head: Column, tail: Column) -> Column:
    """TXT-07: the part between head and tail; over 160 characters the first 100 and the last 50."""
    part = F.substring(text, head + 1, F.length(text) - head - tail)
    return F.when(F.length(part) > 160, F.concat(F.left(part, F.lit(100)), F.lit(" ... "), F.right(part, F.lit(50)))).otherwise(part)


def unified_breaks(text: Column) -> Column:
    """TXT-17: CR LF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def same_text_modulo_breaks(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """TXT-17: for each wanted text the stored one that equals it up to line breaks, byte-equal ones first."""
    a = wanted.select(F.col("text").alias("wanted"), unified_breaks(F.col("text")).alias("u"))
    b = texts.select("sql_id", "text", unified_breaks(F.col("text")).alias("u"))
    return a.join(b, "u").groupBy("wanted").agg(F.min_by("sql_id", F.struct(F.col("text") != F.col("wanted"), F.col("sql_id"))).alias("sql_id"))


def private_hash(value: Column) -> Column:
    """TXT-19."""
    return F.sha2(value, 256)


def in_list_bucket(n: Column) -> Column:
    """TXT-11: size class of an IN list."""
    return F.when(n <= 1, "1").when(n <= 10, "2-10").when(n <= 100, "11-100").otherwise(">100")
