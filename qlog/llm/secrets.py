"""Secret scans: a random forest removes false positives among key-like strings.

Candidates are runs of key characters, every value assigned to a credential's name, and passwords in URLs. Features are the candidate's length and
character mix, transitions between character classes, how unlikely its characters follow each other in
the prose around all candidates of the corpus, how much of it dictionary words cover, the document's path and the neighbouring words. A random forest of Spark's own, trained on labelled
findings, scores every candidate. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qlog.llm.common import text_key, written

# Names that credentials are assigned to, paths of test material, frequent word parts.
CREDENTIAL = r"(?i:token|secret|password|passwd|pwd|api_?key|apikey|access_?key|auth(?!or(?!i[sz]))|credential|private_?key|(?<![a-z0-9])pw(?![a-z]))"
_KEY = "[A-Za-z0-9+/_-]"
_SET = r"[\"']?\]?\s{0,4}+(?::=|=>|={1,2}+|:)\s{0,4}+"
#: A credential's name up to the value that is assigned to it.
ASSIGNED = rf"{CREDENTIAL}[A-Za-z0-9_.-]{{0,40}}{_SET}(?:(?i:bearer|basic)\s{{1,4}})?[\"']?+"
#: A URL's user up to the password that follows.
USER = r"://[\w.+-]{1,64}:"
#: A value: up to its closing quote, else up to a blank, a separator or the next parameter of a URL.
_VALUE = r"(?:(?<=\")[^\"\r\n]+(?=\")|(?<=')[^'\r\n]+(?=')|(?:[^\s\"'`,;&<>=]|=(?!\s)|=++(?=\s|$)|&(?![\w.-]+=))+(?<![)\]}.]))"
#: At least 16 key characters, not inside a longer run; a run that an assignment follows is its name and no candidate.
_RUN = (
    rf"(?<!{_KEY})(?={_KEY}{{16}})(?!{_KEY}{{0,80}}?{CREDENTIAL}{_KEY}{{0,40}}{_SET}[\"']?[^\s\"'=])"
    rf"{_KEY}{{16,}}+(?!={{1,2}}(?:{_KEY}|[\"'][^\s\"',;:)\]}}>]))={{0,2}}"
)
CANDIDATE = rf"{ASSIGNED}{_VALUE}|{USER}[^\s/@:\"'<>]{{1,200}}+(?=@)|{_RUN}"
TEST_PATH = r"(?i)test|example|sample|fixture|mock|doc|lock|vendor"
DICTIONARY = "tion|ing|the|and|for|ent|ter|con|pro|est|ver|der|lich|heit|keit|ung|sch|que|ment|eau|aux|mente|cion|dad|ado|list|name|user|data|file|page|index|value|type|code|test|item|time|date|line|text|key|id"
PLACEHOLDER = r"(?i)^(?:pass(?:word)?|x+|0+|1+|example.*|your.*|test.*|changeme.*|(.)\1{7,}.*|none|null|nil|true|false|undefined|\*+|[$%{].*)$"

FEATURES = ["length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "dictionary", "hexadecimal", "surprise", "test_path", "credential", "assigned", "quoted", "left_words", "right_word"]


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, th, place, start, value, left, right, path): every candidate of every text.

    ``place`` numbers the candidates of a text, ``start`` is its first character (from 0), ``left`` and
    ``right`` are the 40 characters around it, ``th`` the identity of the text.
    """
    where = F.col(path) if path in docs.columns else F.lit(None).cast("string")
    found = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    rows = docs.select("doc_id", text_key().alias("th"), "text", where.cast("string").alias("path"), found.alias("m")).where(F.size("m") > 0)
    rows = rows.select("doc_id", "th", "path", "m", F.split("text", CANDIDATE, -1).alias("g"), F.transform("m", lambda x: F.regexp_extract(x, rf"^(?:{ASSIGNED}(?=[^\s=])|{USER})", 0)).alias("names"))
    # a name belongs to the text before its value
    rows = rows.select(
        "doc_id",
        "th",
        "path",
        F.zip_with("m", "names", lambda x, y: F.substring(x, F.length(y) + 1, F.length(x))).alias("v"),
        F.zip_with("g", F.array_append("names", F.lit("")), lambda x, y: F.concat(x, y)).alias("g"),
    )
    def one(v: Column, i: Column) -> Column:
        gap = F.get("g", i)
        left, right = F.right(gap, F.lit(40)), F.left(F.get("g", i + 1), F.lit(40))
        return F.struct(i.alias("place"), v.alias("value"), left.alias("left"), right.alias("right"), (F.length(gap) + F.length(v)).alias("size"))

    # starts are running sums over the candidates of a row; equal rows are told apart by their number
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "th", "path", "row", F.inline(F.transform("v", one)))
    to_here = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.sum("size").over(to_here) - F.length("value")).cast("int")
    return each.withColumn("start", start).select("doc_id", "th", "path", "place", "start", "value", "left", "right")


#: Characters that transitions tell apart: digits, letters of either case, and all others as one.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
SIDES = len(ALPHABET) + 1


def _pairs(text: Column) -> Column:
    """Numbers of the pairs of neighbouring characters of a text."""
    at = F.transform(F.split(F.lower(text), ""), lambda c: F.when(F.length(c) == 1, F.position(c, F.lit(ALPHABET))).otherwise(0))
    return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: a * SIDES + b)


def transitions(found: DataFrame) -> DataFrame:
    """One row: an array with the surprise, in bits, of each character after each other in the prose around all candidates."""
    around = found.select(F.explode(F.flatten(F.transform(F.array("left", "right"), lambda x: F.when(F.length(x) > 1, _pairs(x)).otherwise(F.array().cast("array<int>"))))).alias("pair"))
    counts = around.groupBy("pair").agg(F.count("*").alias("n")).withColumn("first", F.floor(F.col("pair") / SIDES))
    given = counts.groupBy("first").agg(F.sum("n").alias("all"))
    bits = counts.join(given, "first").select("pair", F.round(F.log2((F.col("all") + SIDES) / (F.col("n") + 1)), 6).alias("bits"))
    # SIDES squared rows at most
    known = bits.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("pair", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(SIDES * SIDES - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(math.log2(SIDES))))
    return written(known.select(every.alias("bits")), "transitions")


def with_features(found: DataFrame, prose: DataFrame | None = None) -> DataFrame:
    """Add FEATURES. ``prose``: the one row of ``transitions``, by default of ``found`` itself."""
    prose = transitions(found) if prose is None else prose
    c, flag = F.col("value"), lambda x: F.coalesce(x, F.lit(False)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a"), r"[+/_=-]+", "-")
    pairs = _pairs(c)
    surprise = F.aggregate(pairs, F.lit(0.0), lambda s, k: s + F.get("bits", k)) / F.size(pairs)
    return found.crossJoin(F.broadcast(prose)).withColumns(
        {
            "length": F.length(c).cast("double"),
            "digits": _share(c, "[0-9]"),
            "upper": _share(c, "[A-Z]"),
            "lower": _share(c, "[a-z]"),
            "symbols": _share(c, "[+/_=-]"),
            "transitions": (F.length(classes) - 1) / F.length(c),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
            "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), DICTIONARY, "")) / F.length(c),
            "hexadecimal": flag(F.lower(c).rlike("^[0-9a-f]+$")),
            "surprise": F.when(F.length(c) > 1, surprise).otherwise(0.0),
            "test_path": flag(F.col("path").rlike(TEST_PATH)),
            "credential": flag(F.col("left").rlike(f"{CREDENTIAL}|{USER}$")),
            "assigned": flag(F.col("left").rlike(r"[=:]>?\s*[\"']?$")),
            "quoted": flag(F.col("left").rlike("[\"']$") & F.col("right").rlike("^[\"']")),
            "left_words": F.regexp_count("left", F.lit(r"\p{L}+")).cast("double"),
            "right_word": flag(F.col("right").rlike(r"^[\"']?\s+\p{L}")),
        }
    ).drop("bits")


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels where no reviewed findings are at hand: 1 for a value assigned to a credential's name, unless a placeholder.

    A short word without quotes and digits that follows a blank is prose or code, and phrases are prose.
    """
    named, value = F.col("left").rlike(f"(?:{ASSIGNED}|{USER})$"), F.col("value")
    key = value.rlike(r"[0-9]|^.{16}") | F.col("left").rlike(r"[=:\"']$")
    return found.withColumn("label", (named & key & ~value.rlike(PLACEHOLDER) & ~value.rlike(r"\s")).cast("double"))


def fit_forest(labelled: DataFrame, most_rows: int = 20_000, trees: int = 30, depth: int = 6, seed: int = 3):
    """Random forest on at most ``most_rows`` labelled findings, half of either label (those with the smallest hashes).

    ``labelled``: findings with features and ``label`` (0 or 1). Where only one label is there, gives that label
    in place of a forest, 0.0 where none is.
    """
    order = (F.xxhash64("doc_id", "place", "value"), "doc_id", "place", "value")
    of = lambda y: labelled.where(F.col("label") == y).orderBy(*order).limit(most_rows // 2)
    sample = written(of(0.0).unionByName(of(1.0)).select(*FEATURES, "label"), "findings")  # read several times by the training
    kinds = {r[0] for r in sample.select("label").distinct().collect()}  # two values at most
    if len(kinds) < 2:
        return kinds.pop() if kinds else 0.0
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(sample).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="sqrt").fit(ready)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Findings of all documents with their score: doc_id, th, place, start, value, score, secret.

    ``labelled``: reviewed findings (columns of ``candidates`` and ``label``); without it, weak labels are
    made from the corpus. Null and empty texts have no candidates. Where only one label occurs, all
    findings get it. Repeated rows give repeated findings; an empty table gives none.
    """
    found = written(candidates(docs, path), "candidates")
    prose = transitions(found)
    found = with_features(found, prose)
    model = fit_forest(weak_labels(found) if labelled is None else with_features(labelled, prose))
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(found)
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "th", "place", "start", "value", "score", (F.col("score") >= threshold).alias("secret"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, candidates, secrets, best score and the secrets' places of every document.

    Null and empty texts have none; each of several equal rows has the findings of one of them. Other
    columns than doc_id, text and source are ignored.
    """
    found = scan_secrets(docs).dropDuplicates(["doc_id", "th", "place"])
    by = found.groupBy("doc_id", "th").agg(
        F.count("*").alias("n"),
        F.count_if("secret").alias("k"),
        F.max("score").alias("best"),
        F.array_sort(F.collect_set(F.when(F.col("secret"), F.struct("start", F.sha2("value", 256).alias("digest"))))).alias("found"),
    )
    own = docs.select("doc_id", text_key().alias("th"))
    joined = own.join(by, own.th.eqNullSafe(by.th) & own.doc_id.eqNullSafe(by.doc_id), "left")
    return joined.select(
        own.doc_id, F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce("k", F.lit(0)).cast("long").alias("n_secrets"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("best_score"), "found"
    )
