"""Text forms in which values travel between the engine and its clients: URL-safe tokens, JSON record sets, kinds of JSON."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RECORDS = 1000


def encode_token(text: Column) -> Column:
    """Text as base64url without padding; null stays null, empty stays empty."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decode_token(token: Column) -> Column:
    """Text of a token; null if it is none (foreign letters, a wrong length, no UTF-8)."""
    whole = (F.ceil(F.length(token) / 4) * 4).cast("int")
    padded = F.rpad(F.translate(token, "-_", "+/"), whole, F.lit("="))
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def json_text(value: Column) -> Column:
    """A text as a JSON string, ``null`` for null."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def identity_token(*parts: Column) -> Column:
    """Token of an identity: a JSON array of scope, database and user, of which any may be null."""
    return encode_token(F.concat(F.lit("["), F.concat_ws(", ", *[json_text(p) for p in parts]), F.lit("]")))


def identity_of(token: Column, names: list[str]) -> Column:
    """Struct of an identity token's parts; null for an empty or broken token, so that it matches no identity."""
    parts = F.from_json(decode_token(F.nullif(token, F.lit(""))), "array<string>")
    return F.when(F.size(parts) == len(names), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; SQL null if it is no JSON."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(text)), "^[A-Z]+", 0)
    named = F.when(kind == "VOID", "null").when(kind.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(kind))
    return F.when(kind.isNotNull(), F.coalesce(named, F.lit("number")))


def json_records(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """One row for each record of a JSON array, with text fields and ``place`` from 1.

    A request that is no array, has over 1,000 records or a record without one of the fields gives one row with
    ``error`` invalid_records; an empty array gives no row.
    """
    rows = F.from_json(column, f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    bad = F.coalesce(json_kind(F.col(column)) != "array", F.lit(True)) | rows.isNull() | (F.size(rows) > MOST_RECORDS)
    bad = bad | F.exists(rows, lambda r: reduce(or_, [r[f].isNull() for f in fields], r.isNull()))
    kept = [c for c in df.columns if c != column]
    marked = df.select(*kept, F.coalesce(bad, F.lit(True)).alias("_bad"), rows.alias("_rows"))
    each = marked.where("not _bad").select(*kept, F.posexplode("_rows").alias("place", "r"))
    good = each.select(*kept, (F.col("place") + 1).alias("place"), *[F.col(f"r.{f}").alias(f) for f in fields], F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast("string").alias(f) for f in fields]
    return good.unionByName(marked.where("_bad").select(*kept, F.lit(None).cast("int").alias("place"), *none, F.lit("invalid_records").alias("error")))


def reason_faults(value: Column, reasons: Column, name: str) -> Column:
    """Whether a value and its reason disagree: a null without a reason that is not empty, or a reason beside a value."""
    told = F.coalesce(F.length(reasons[name]) > 0, F.lit(False))
    return F.when(value.isNull(), ~told).otherwise(F.coalesce(F.map_contains_key(reasons, name), F.lit(False)))
