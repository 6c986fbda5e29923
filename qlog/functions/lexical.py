"""Lexical work on SQL texts: statements and categories, token fingerprints, calls, signatures.

These run on distinct texts (see ``dedup_texts``), an Arrow batch at a time; results join back by text id.
A text is cut into tokens by one pattern; anything that stays open makes the text uncertain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = "lexical-1"
TOKEN = re.compile(
    r"""(?P<blank>\s+)|(?P<line>--[^\n]*)|(?P<hint>/\*\+.*?\*/)|(?P<block>/\*.*?\*/)|(?P<open_comment>/\*)
    |(?P<string>[eEbBxX]?'(?:[^'\\]|''|\\.)*')|(?P<open_string>[eEbBxX]?')|(?P<quoted>"(?:[^"]|"")*")|(?P<open_quote>")
    |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)|(?P<param>\$\d+|\?)|(?P<open_dollar>\$)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d][\w$]*)|(?P<op>::|<>|!=|<=|>=|\|\||[-+*/%<>=~^&|!@#:.,;()\[\]{}])|(?P<other>.)""",
    re.S | re.X,
)
OPEN = {"open_comment": "unterminated_comment", "open_string": "unterminated_string", "open_quote": "unterminated_quote", "open_dollar": "unterminated_dollar", "other": "unexpected_character"}
TWO_WORDS = {"START": {"TRANSACTION"}, "CREATE": {"TABLE", "INDEX", "VIEW", "EXTERNAL", "TEMP"}, "ALTER": {"TABLE"}, "DROP": {"TABLE", "INDEX", "VIEW"}, "EXPLAIN": {"ANALYZE"}}
FEATURES = {"partition_ddl": ("PARTITION", "BY"), "external_table": ("EXTERNAL", "TABLE"), "distributed": ("DISTRIBUTED", "BY"), "window": ("OVER",), "recursive": ("RECURSIVE",), "copy": ("COPY",), "do_block": ("DO",)}
NOT_CALLS = {"IN", "VALUES", "AND", "OR", "NOT", "EXISTS", "WHERE", "FROM", "SELECT", "ON", "AS", "BY", "OVER", "USING", "ANY", "ALL", "SOME", "INTO", "THEN", "ELSE", "WHEN", "CASE", "WITH", "TABLE", "SET", "LIMIT", "HAVING", "UNION", "JOIN"}


def tokens(text: str) -> tuple[list[tuple[str, str, int]], str | None]:
    """(kind, text, position) of each token that counts, and the first issue."""
    out, issue = [], None
    for m in TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
        if kind in OPEN:
            return out, OPEN[kind]
        if kind not in ("blank", "line", "block"):
            out.append((kind, m.group(), m.start()))
    return out, issue


def statements(text: str) -> tuple[list[str], list[int], str | None]:
    """TXT-08: category and start of each statement; none with an issue on any doubt."""
    toks, issue = tokens(text)
    if issue:
        return [], [], issue
    depth, parts = 0, [[]]
    for kind, t, at in toks:
        if kind == "op" and t in "([{":
            depth += 1
        elif kind == "op" and t in ")]}":
            depth -= 1
            if depth < 0:
                return [], [], "unbalanced_brackets"
        if kind == "op" and t == ";" and depth == 0:
            parts.append([])
        else:
            parts[-1].append((kind, t, at))
    if depth:
        return [], [], "unbalanced_brackets"
    labels, starts = [], []
    for p in parts:
        words = [(t.upper(), at) for kind, t, at in p if kind != "hint"]
        if not words:
            continue
        first = words[0][0]
        second = words[1][0] if len(words) > 1 else ""
        labels.append(f"{first} {second}" if second in TWO_WORDS.get(first, ()) else first if first[:1].isalpha() else "OTHER")
        starts.append(words[0][1])
    return labels, starts, None


def in_bucket(n: int) -> str:
    """TXT-11."""
    return "1" if n <= 1 else "2-10" if n <= 10 else "11-100" if n <= 100 else ">100"


def folded(text: str) -> tuple[list[str], str | None]:
    """Tokens without literals: words in lower case, literals and parameters as ``?``, literal lists after IN by size class."""
    toks, issue = tokens(text)
    if issue:
        return [], issue
    plain = [t.lower() if kind == "word" else "?" if kind in ("string", "number", "param", "dollar") else t for kind, t, _ in toks]
    out, i = [], 0
    while i < len(plain):
        out.append(plain[i])
        if plain[i] == "in" and i + 1 < len(plain) and plain[i + 1] == "(":
            j = i + 2
            while j < len(plain) and plain[j] in ("?", ",", "-", "+"):
                j += 1
            if j < len(plain) and plain[j] == ")" and j > i + 2:
                out += ["(", f"?[{in_bucket(plain[i + 2 : j].count('?'))}]", ")"]
                i = j
        i += 1
    while out and out[-1] == ";":
        out.pop()
    return out, None


def _mapped(texts: DataFrame, columns: list[tuple[str, pa.DataType]], one, schema: str) -> DataFrame:
    """``one(text)`` for every row of (sql_id, text); null texts give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t) if t is not None else (None,) * len(columns) for t in b.column(1).to_pylist()]
            cols = [pa.array([g[k] for g in got], kind) for k, (_, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["sql_id", *[n for n, _ in columns]])

    return texts.select("sql_id", "text").mapInArrow(run, "sql_id string, " + schema)


def lexical_statements(texts: DataFrame) -> DataFrame:
    """TXT-08: categories, starts of the statements and the issue of each text."""
    kinds = [("categories", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("issue", pa.string())]
    return _mapped(texts, kinds, statements, "categories array<string>, starts array<int>, issue string")


def token_fingerprints(texts: DataFrame) -> DataFrame:
    """TXT-10: state, reason, value: hash of the folded tokens under the rule's name; refused where lexing is uncertain."""

    def one(text: str) -> tuple:
        out, issue = folded(text)
        if issue or not out:
            return "normalization_failed", issue or "empty_text", None
        return "reliable", None, f"{RULE}:" + hashlib.sha256(" ".join(out).encode("utf-8", "surrogatepass")).hexdigest()

    return _mapped(texts, [("state", pa.string()), ("reason", pa.string()), ("value", pa.string())], one, "state string, reason string, value string")


def approximate_fingerprints(texts: DataFrame, reliable: DataFrame) -> DataFrame:
    """TXT-12 over texts without a reliable fingerprint: state, value, replacements."""
    from qlog.functions.approximate import approximate

    refused = texts.join(reliable.where("state = 'reliable'").select("sql_id"), "sql_id", "left_anti")
    return _mapped(refused, [("state", pa.string()), ("value", pa.string()), ("replacements", pa.int64())], approximate, "state string, value string, replacements long")


def calls(text: str) -> list[dict]:
    """Call candidates of a text: schema, name, number of arguments."""
    toks, _ = tokens(text)
    found = []
    for i, (kind, t, _at) in enumerate(toks[:-1]):
        if kind not in ("word", "quoted") or toks[i + 1][1] != "(" or t.upper() in NOT_CALLS:
            continue
        schema = toks[i - 2][1].lower() if i > 1 and toks[i - 1][1] == "." and toks[i - 2][0] in ("word", "quoted") else None
        depth, commas, any_ = 0, 0, False
        for kind2, x, _ in toks[i + 1 :]:
            if x in "([{" and kind2 == "op":
                depth += 1
            elif x in ")]}" and kind2 == "op":
                depth -= 1
                if not depth:
                    break
            elif depth == 1 and x == ",":
                commas += 1
            any_ = any_ or depth > 0 and x not in "("
        found.append({"schema": schema, "name": t.lower(), "arity": commas + 1 if any_ else 0})
    return found


def call_usage(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """TXT-15: calls of each text matched to the dictionary: by name, then by the rule's range of arguments.

    ``dictionary``: rule_id, schema, name, least, most (null: any), enabled. Reasons: matched, disabled,
    unknown_arity (the name is known) and unknown_name.
    """
    kind = pa.list_(pa.struct([("schema", pa.string()), ("name", pa.string()), ("arity", pa.int32())]))
    found = _mapped(texts, [("calls", kind)], lambda t: (calls(t),), "calls array<struct<schema:string,name:string,arity:int>>")
    each = found.select("sql_id", F.posexplode("calls").alias("n", "c")).select("sql_id", "n", "c.*")
    rules = dictionary.withColumnRenamed("schema", "rule_schema")
    met = each.join(rules, "name", "left")
    fits = F.col("rule_id").isNotNull() & (F.col("schema").isNull() | (F.col("schema") == F.col("rule_schema"))) & (F.col("arity") >= F.col("least")) & (F.col("most").isNull() | (F.col("arity") <= F.col("most")))
    by = met.groupBy("sql_id", "n", "name", "arity").agg(F.max(fits & F.col("enabled")).alias("ok"), F.max(fits & ~F.col("enabled")).alias("off"), F.count("rule_id").alias("rules"), F.min(F.when(fits & F.col("enabled"), F.col("rule_id"))).alias("rule_id"))
    reason = F.when(F.col("ok"), "matched").when(F.col("off"), "disabled").when(F.col("rules") > 0, "unknown_arity").otherwise("unknown_name")
    return by.select("sql_id", "n", "name", "arity", "rule_id", reason.alias("reason"))


def signature(text: str) -> tuple[list[str], str, str]:
    """TXT-16: feature labels of a text, its first and last tokens."""
    toks, _ = tokens(text)
    words = [t.upper() for _, t, _ in toks]
    joined = " " + " ".join(words) + " "
    return [name for name, parts in FEATURES.items() if f" {' '.join(parts)} " in joined], " ".join(words[:3]), " ".join(words[-3:])


def failure_signatures(texts: DataFrame) -> DataFrame:
    """TXT-16, DIA-13: features, head and tail of texts."""
    return _mapped(texts, [("features", pa.list_(pa.string())), ("head", pa.string()), ("tail", pa.string())], signature, "features array<string>, head string, tail string")


def token_shapes(texts: DataFrame) -> DataFrame:
    """DIA-13: hash of the kinds of a text's tokens."""

    def one(text: str) -> tuple:
        toks, issue = tokens(text)
        return hashlib.sha256(" ".join(k if k != "op" else t for k, t, _ in toks).encode()).hexdigest(), issue

    return _mapped(texts, [("shape", pa.string()), ("issue", pa.string())], one, "shape string, issue string")


def text_candidates(df: DataFrame, fields: list[str]) -> DataFrame:
    """TXT-14: distinct non-empty texts of one record with the first field that holds each."""
    all_ = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("field"), F.col(f).alias("text")) for k, f in enumerate(fields)])
    filled = F.filter(all_, lambda x: F.coalesce(F.length(x["text"]), F.lit(0)) > 0)
    first = F.filter(filled, lambda x: ~F.exists(filled, lambda y: (y["text"] == x["text"]) & (y["k"] < x["k"])))
    return df.select("file_id", "record_no", F.explode(first).alias("c")).select("file_id", "record_no", "c.field", "c.text")


def split_statements(texts: DataFrame, most: int = 20) -> DataFrame:
    """TXT-18: pieces of multi-statement texts with their numbers from 1."""
    cut = lexical_statements(texts).where(F.size("starts") > 0).join(texts.select("sql_id", "text"), "sql_id")
    ends = F.concat(F.transform(F.slice("starts", 2, 10_000_000), lambda s: s), F.array(F.length("text")))
    pieces = F.zip_with("starts", ends, lambda a, b: F.rtrim(F.regexp_replace(F.substring(F.col("text"), a + 1, b - a), r";\s*$", "")))
    return cut.select("sql_id", F.posexplode(F.slice(pieces, 1, most)).alias("n", "piece")).withColumn("n", F.col("n") + 1)


def statement_census(records: DataFrame, fields: list[str]) -> DataFrame:
    """TXT-13: per field and site: records, empty, with an issue, and counts by category, with the first record of each."""
    long = records.select("file_id", "record_no", "site", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("file_id", "record_no", "site", "x.*")
    keyed = long.withColumn("sql_id", F.sha2("text", 256))
    texts = keyed.where("text is not null").groupBy("sql_id").agg(F.min("text").alias("text"))
    cut = keyed.join(lexical_statements(texts), "sql_id", "left")
    labels = F.concat(
        F.array(F.lit("records")), F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.array(F.lit("empty"))).when(F.col("issue").isNotNull(), F.array(F.concat(F.lit("issue:"), "issue"))).otherwise(F.transform(F.array_distinct("categories"), lambda c: F.concat(F.lit("category:"), c)))
    )
    each = cut.select("field", "site", "file_id", "record_no", F.explode(labels).alias("label"))
    return each.groupBy("field", "site", "label").agg(F.count("*").alias("n"), F.min(F.struct("file_id", "record_no")).alias("first")).select("field", "site", "label", "n", F.col("first.file_id").alias("first_file"), F.col("first.record_no").alias("first_record"))
