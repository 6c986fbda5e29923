"""Benchmark decontamination with suffix arrays of the training text.

Documents are taken in shards (runs of a task's rows). Per shard the suffixes that can start a
verbatim match are sorted by their first words; every test suffix, that is every window of a
benchmark item, is found in it by binary search, which gives all its locations. Windows that follow each
other in an item and in a document alike are one verbatim match. ``find_matches`` lists these item by item
with their place in the item and in the document; ``find_classes``, for decisions and counts, names the classes
of items that hold the same windows, so that a passage of many items costs a document no more than one of one item. Suffixes whose first words occur in no window in that order
can match nothing and are left out before sorting, which changes no result. Found windows are compared
byte for byte.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.llm.common import U64, Hasher, mix, small, spans, text_key, text_slices, written

#: Digits, lower- and (folded) upper-case letters and every byte of a character beyond ASCII.
WORD_BYTES = np.array([1 if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0 for b in range(256)], np.uint8)
GRAM, BLOOM = 4, 1 << 22
SHARD_BYTES = 8 << 20

FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()),
    T.StructField("matches", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest_match", T.LongType()),
    T.StructField("verbatim", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("item_start", "start", "words")]]))),
]
#: In place of items and verbatim: the classes of items.
BRIEF = [*FOUND[:4], T.StructField("classes", T.ArrayType(T.LongType())), FOUND[5]]
RUN = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
VERBATIM = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))


@dataclass
class Windows:
    """Windows of one length: sorted distinct keys, and where in which items each stands."""

    length: int
    keys: np.ndarray
    first: np.ndarray  # of each key's places in ``items`` and ``at``
    items: np.ndarray
    at: np.ndarray  # number of the window's first word among all words
    grams: np.ndarray  # bloom table of the windows' first words
    classes: np.ndarray  # of each key: number of the set of items that hold it
    numbers: np.ndarray | None  # key of the window at each word of the block, items one apart, -1 for none; None where no window follows another
    order: np.ndarray | None  # places in ``numbers`` with a window, sorted by the keys from there on


@dataclass
class TestIndex:
    """One block of the benchmark: its words (as sorted hashes and as bytes), item ids, items' first words and windows by length."""

    words: np.ndarray
    seen: np.ndarray
    ids: list[str | None]
    windows: list[Windows]
    item_first: np.ndarray
    raw: np.ndarray  # folded bytes of the block's words
    start: np.ndarray
    end: np.ndarray
    members: list[np.ndarray]  # items of each class


def _gram(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), 0x51ED, U64)
    for k in range(n):
        h = mix(h * U64(31) + ids[at + k].astype(U64))
    return h % U64(BLOOM)


def _keys(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sort keys of the suffixes at ``at``: their first ``n`` word numbers, big-endian."""
    return np.ascontiguousarray(ids[at[:, None] + np.arange(n)], ">u4").view(f"S{4 * n}").ravel()


def build_index(rows: list[tuple], window: int) -> TestIndex:
    """``rows``: (item_id, text). Items without words have no window."""
    texts = pa.array([t or "" for _, t in rows], pa.string())
    words, ends, raws, starts, stops, base = [np.zeros(0, U64)], [0], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, _, raw, offsets in text_slices(texts):
        start, end, first = spans(raw, offsets, WORD_BYTES)
        own = Hasher(raw, fold_case=True)
        words.append(own.of(start, end))
        ends += list(ends[-1] + first[1:])
        raws.append(own.bytes[: len(raw)])
        starts.append(start + base)
        stops.append(end + base)
        base += len(raw)
    vocabulary, ids = np.unique(np.concatenate(words), return_inverse=True)
    ids = ids.astype(np.uint32) + 1
    seen = np.zeros(BLOOM, bool)
    seen[(vocabulary % U64(BLOOM)).astype(np.int64)] = True
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for item, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            n = min(window, b - a)
            at = np.arange(a, b - n + 1)
            by_length.setdefault(n, []).append((at, np.full(len(at), item)))
    found, members, known = [], [], {}
    for n, parts in sorted(by_length.items()):
        at, item = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, back = np.unique(_keys(ids, at, n), return_inverse=True)
        order = np.argsort(back, kind="stable")
        grams = np.zeros(BLOOM, bool)
        grams[_gram(ids, at, min(GRAM, n)).astype(np.int64)] = True
        first, items = np.searchsorted(back[order], np.arange(len(keys) + 1)), item[order]
        classes = np.zeros(len(keys), np.int64)
        for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
            own = np.unique(items[a:b])
            classes[k] = known.setdefault(own.tobytes(), len(members))
            if classes[k] == len(members):
                members.append(own)
        numbers, chains = _chains(at + item, back, max(len(p[0]) for p in parts))
        found.append(Windows(n, keys, first, items, at[order], np.packbits(grams), classes, numbers, chains))
    return TestIndex(vocabulary, np.packbits(seen), [None if i is None else str(i) for i, _ in rows], found, np.array(ends), *(np.concatenate(x) for x in (raws, starts, stops)), members)


def _chains(place: np.ndarray, key: np.ndarray, most: int) -> tuple[np.ndarray | None, np.ndarray | None]:
    """``numbers`` and ``order`` of windows with these keys at these places, at most ``most`` of them in a row: ranks by prefix doubling."""
    if most < 2:
        return None, None
    numbers = np.full(int(place.max()) + 2, -1, np.int32)
    numbers[place] = key
    rank, step = numbers.astype(np.int64), 1
    while step < most:
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        pair = rank[place] * (len(rank) + 1) + after[place] + 1
        rank[place] = np.unique(pair, return_inverse=True)[1]
        step *= 2
    return numbers, place[np.argsort(rank[place], kind="stable")].astype(np.int32)


def _longest(w: Windows, keys: np.ndarray, least: int) -> int:
    """Longest match, in windows, of one item with these windows in a row; ``least`` if none is longer."""
    numbers, order, best = w.numbers, w.order, max(least, 1)
    if numbers is None:
        return best
    for p in range(len(keys)):
        if len(keys) - p <= best:
            break
        low = bisect_left(order, keys[p], key=numbers.__getitem__)
        high = bisect_right(order, keys[p], low, key=numbers.__getitem__)
        depth = 1
        while p + depth < len(keys):  # items in ``order`` from low to high match so far
            if high - low == 1:
                there = numbers[order[low] + depth : order[low] + len(keys) - p]
                same = there == keys[p + depth : p + depth + len(there)]
                depth += len(same) if same.all() else int(same.argmin())
                break
            k, at = keys[p + depth], lambda x, d=depth: numbers[x + d]
            if at(order[low]) != k or at(order[high - 1]) != k:
                low, high = bisect_left(order, k, low, high, key=at), bisect_right(order, k, low, high, key=at)
                if low == high:
                    break
            depth += 1
        best = max(best, depth)
    return best


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], ... first[0] + count[0] - 1, first[1], ..."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def search_shard(index: TestIndex, raw: np.ndarray, offsets: np.ndarray, listed: bool = True) -> tuple[np.ndarray, list[tuple]]:
    """Words of each text of the shard, and (text, n_hit, longest, matches, items, longest_match, verbatim) of texts with matches.

    Not ``listed``: (text, n_hit, longest, matches, classes, longest_match).
    """
    start, end, first = spans(raw, offsets, WORD_BYTES)
    n_words, size = np.diff(first), len(start)
    own = Hasher(raw, fold_case=True)
    h = own.of(start, end)
    ids = np.zeros(size, np.uint32)
    likely = np.flatnonzero(_bit(index.seen, h % U64(BLOOM)))
    if len(index.words) and len(likely):
        at = np.minimum(np.searchsorted(index.words, h[likely]), len(index.words) - 1)
        ids[likely] = np.where(index.words[at] == h[likely], at + 1, 0)
    text_end = np.repeat(first[1:], n_words)
    edge = np.zeros(size + 1, np.int32)
    hits: list[tuple[np.ndarray, ...]] = []  # place, place in the benchmark, item, words; or place, window, its length's number
    briefs: list[Windows] = []
    known, other = ids > 0, Hasher(index.raw) if len(index.raw) else None
    for w in index.windows:
        g = min(GRAM, w.length)
        ok = known[: max(0, size - g + 1)].copy()
        for k in range(1, g):
            ok &= known[k : size - g + 1 + k]
        at = np.flatnonzero(ok)
        at = at[at + w.length <= text_end[at]]
        at = at[_bit(w.grams, _gram(ids, at, g))]
        if not len(at):
            continue
        keys = _keys(ids, at, w.length)
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        keys, at = keys[order], at[order]
        low, high = np.searchsorted(keys, w.keys, "left"), np.searchsorted(keys, w.keys, "right")
        number = np.repeat(np.arange(len(w.keys)), high - low)
        place = at[_expand(low, high - low)]
        there = w.at[w.first[number]]
        same = np.ones(len(place), bool)  # equal hashes of different words are no match
        for k in range(w.length):
            same &= own.equal(start[place + k], end[place + k], other, index.start[there + k], index.end[there + k])
        place, number = place[same], number[same]
        if not len(place):
            continue
        np.add.at(edge, place, 1)
        np.add.at(edge, place + w.length, -1)
        if not listed:
            hits.append((place, number, np.full(len(place), len(briefs))))
            briefs.append(w)
            continue
        count = w.first[number + 1] - w.first[number]
        every = _expand(w.first[number], count)
        hits.append((np.repeat(place, count), w.at[every], w.items[every], np.full(len(every), w.length)))
    if not hits:
        return n_words, []
    hit = np.cumsum(edge[:-1]) > 0
    if not listed:
        return n_words, _brief(briefs, hits, first, hit)
    place, there, item, words = (np.concatenate(x) for x in zip(*hits))
    # windows that follow each other in the text and in the item are one match
    order = np.lexsort((place, there - place, item))
    place, there, item, words = place[order], there[order], item[order], words[order]
    text = np.searchsorted(first, place, "right") - 1
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1) | (there[1:] != there[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.append(begin[1:], len(place)) - begin - 1 + words[begin]
    place, there, item, text = place[begin], there[begin], item[begin], text[begin]
    out = []
    by = np.argsort(text, kind="stable")
    for own_rows in np.split(by, np.flatnonzero(np.diff(text[by])) + 1):
        t = text[own_rows[0]]
        a = first[t]
        runs = _runs(hit[a : first[t + 1]])
        items = sorted({index.ids[i] for i in item[own_rows]} - {None})
        matches = sorted((int(place[k] - a), index.ids[item[k]] or "", int(there[k] - index.item_first[item[k]]), int(length[k]), index.ids[item[k]]) for k in own_rows)
        out.append((int(t), sum(n for _, n in runs), max(n for _, n in runs), runs, items, int(length[own_rows].max()), [(m[4], m[2], m[0], m[3]) for m in matches]))
    return n_words, out


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """Start and words of each run of hit words."""
    ends = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [(int(x), int(y - x)) for x, y in zip(ends[::2], ends[1::2])]


def _brief(lengths: list[Windows], hits: list[tuple[np.ndarray, ...]], first: np.ndarray, hit: np.ndarray) -> list[tuple]:
    """Classes and longest match of each text with hits, without its items one by one."""
    place, number, kind = (np.concatenate(x) for x in zip(*hits))
    text = np.searchsorted(first, place, "right") - 1
    by = np.lexsort((place, kind, text))
    place, number, kind, text = place[by], number[by], kind[by], text[by]
    out = []
    for rows in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1):
        t, longest, classes = text[rows[0]], 0, []
        cut = np.flatnonzero((np.diff(kind[rows]) != 0) | (np.diff(place[rows]) != 1)) + 1
        for chain in np.split(rows, cut):  # windows in a row
            w = lengths[kind[chain[0]]]
            longest = max(longest, _longest(w, number[chain], longest - w.length + 1) + w.length - 1)
            classes.append(w.classes[number[chain]])
        runs = _runs(hit[first[t] : first[t + 1]])
        out.append((int(t), sum(n for _, n in runs), max(n for _, n in runs), runs, np.unique(np.concatenate(classes)).tolist(), longest))
    return out


def _empty_index() -> TestIndex:
    return build_index([], 1)


def _listed(rows: list | None, names: tuple[str, ...]) -> list | None:
    return None if rows is None else [dict(zip(names, r)) for r in rows]


def _search(docs: DataFrame, index: TestIndex, listed: bool = True, block: int = 0):
    """``docs`` with FOUND, or with BRIEF, and the broadcast that it needs until it is written."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # one block: at most block_chars of text
    fields = FOUND if listed else BRIEF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_rows
            cols: list[list] = [[0] * n, [0] * n, [0] * n, [None] * n, [None] * n, [0] * n, [None] * n]
            for i, _, raw, offsets in text_slices(b.column(b.schema.get_field_index("text")), SHARD_BYTES):
                words, found = search_shard(shared.value, raw, offsets, listed)
                cols[0][i : i + len(words)] = words.tolist()
                for t, *values in found:
                    for col, x in zip(cols[1:], values):
                        col[i + t] = x
            runs = pa.array([_listed(m, ("start", "words")) for m in cols[3]], RUN)
            made = [*[pa.array(c, pa.int64()) for c in cols[:3]], runs]
            if listed:
                verbatim = pa.array([_listed(m, ("item", "item_start", "start", "words")) for m in cols[6]], VERBATIM)
                made += [pa.array(cols[4], pa.list_(pa.string())), pa.array(cols[5], pa.int64()), verbatim]
            else:
                classes = [None if c is None else [(block << 32) + x for x in c] for c in cols[4]]
                made += [pa.array(classes, pa.list_(pa.int64())), pa.array(cols[5], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *[f.name for f in fields]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields])), shared


def _merged(lists: list) -> tuple[int, int, list[tuple[int, int]]]:
    """Union of runs of hit words from several blocks."""
    runs: list[list[int]] = []
    for s, k in sorted((r["start"], r["start"] + r["words"]) for one in lists for r in one):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], k)
        else:
            runs.append([s, k])
    sizes = [b - a for a, b in runs]
    return sum(sizes), max(sizes, default=0), [(a, b - a) for a, b in runs]


def find_matches(docs: DataFrame, bench: DataFrame, window: int = 13, block_chars: int = 8 << 20) -> DataFrame:
    """Add n_words, n_hit, longest, matches (runs of hit words), items, longest_match and verbatim to every document.

    ``verbatim`` holds each maximal match of one item of at least a window: item, first word there, first
    word here, words; ``longest_match`` is the largest of them, while ``longest`` is the longest run of hit
    words, in which matches of several items may follow each other.

    The benchmark is read in blocks of about ``block_chars`` characters (its size is checked first);
    one block at a time is indexed, sent to the executors and searched. With one block there is no
    shuffle. With several, the matches of the blocks meet by the identity of the text.

    Null texts have no words; an item without words matches nothing; an item with a null id marks
    words but is not listed in ``items``; repeated items and documents count as often as they are there,
    item ids once. Input columns with the new names are replaced.
    """
    return _find(docs, bench, window, block_chars, True)[0]


def find_classes(docs: DataFrame, bench: DataFrame, window: int = 13, block_chars: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """Add n_words, n_hit, longest, matches, classes and longest_match, as ``find_matches`` has them, to every document.

    ``classes`` holds the classes of items whose windows occur, sorted, null where none does. The second table has
    their items, one a row (class, item_id), each item id once a class, null ids left out. Items that share a passage are
    one class, so neither table grows with documents times items.
    """
    return _find(docs, bench, window, block_chars, False)


def _find(docs: DataFrame, bench: DataFrame, window: int, block_chars: int, listed: bool) -> tuple[DataFrame, DataFrame | None]:
    fields, own, spark = FOUND if listed else BRIEF, "items" if listed else "classes", docs.sparkSession
    docs = docs.drop(*[f.name for f in fields])
    bench = bench.select("item_id", "text").where(F.length("text") > 0)
    blocks = max(1, -(-(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def block(b: int) -> TestIndex:
        rows = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return build_index([tuple(r) for r in rows.orderBy("item_id", "text").toLocalIterator()], window)

    def members(index: TestIndex, b: int) -> DataFrame:
        rows = [((b << 32) + c, i) for c, own_items in enumerate(index.members) for i in sorted({index.ids[k] for k in own_items} - {None})]
        return spark.createDataFrame(pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["class", "item_id"]))

    if blocks == 1:
        index = block(0)
        return _search(docs, index, listed)[0], None if listed else members(index, 0)
    keyed = docs.withColumn("_h", text_key())
    found = classes = None
    lists = [own, "verbatim"] if listed else [own]
    for b in range(blocks):
        index = block(b)
        hits, shared = _search(keyed.select("_h", "text"), index, listed, b)
        hits = written(hits.where("n_hit > 0").select("_h", "matches", "longest_match", *lists).dropDuplicates(["_h"]), "hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
        if not listed:
            more = written(members(index, b), "classes")
            classes = more if classes is None else classes.unionByName(more)
    flat = lambda c: F.flatten(F.collect_list(c))
    every = [F.array_sort(F.array_distinct(flat(own))).alias(own), F.max("longest_match").alias("longest_match")]
    found = found.groupBy("_h").agg(F.collect_list("matches").alias("_m"), *every, *[F.sort_array(flat(c)).alias(c) for c in lists[1:]])
    found = written(found, "found")
    base = _search(keyed, _empty_index(), listed)[0].drop(*[f.name for f in fields[1:]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(b.schema.get_field_index("_m")).to_pylist()
            got = [(0, 0, None) if r is None else _merged(r) for r in rows]
            made = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([_listed(g[2], ("start", "words")) for g in got], RUN)]
            keep = [n for n in b.schema.names if n not in ("_m", "_h")]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in keep], *made], [*keep, "n_hit", "longest", "matches"])

    joined = base.join(found, "_h", "left").withColumn("longest_match", F.coalesce("longest_match", F.lit(0).cast("long")))
    kept = [f for f in joined.schema.fields if f.name not in ("_m", "_h")]
    out = joined.mapInArrow(merge, T.StructType([*kept, *fields[1:4]]))
    return out.select(*docs.columns, *[f.name for f in fields]), classes


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, bench: DataFrame, window: int = 13) -> DataFrame:
    """Documents of which under a twentieth of the words lies in benchmark windows.

    Null and empty texts and repeated rows stay; an empty benchmark removes nothing. All columns of ``docs`` keep their values.
    """
    clashing = {f.name: f"_own_{f.name}" for f in BRIEF if f.name in docs.columns}
    kept = find_classes(docs.withColumnsRenamed(clashing), bench, window)[0].where(~contaminated())
    return kept.select([F.col(clashing.get(c, c)).alias(c) for c in docs.columns])


def decontamination_digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Words, hit words and items of every document, items counted and hashed once for each set of classes that occurs.

    Null and empty texts have zeros and the hash of an empty list; repeated rows have a row each. Columns other than
    doc_id, text and item_id are ignored, so clashing names do no harm; either table may be empty.
    """
    found, classes = find_classes(docs.select("doc_id", "text"), bench)
    found = written(found.drop("text", "matches"), "matched")
    met = found.where("classes is not null")
    each = met.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(classes, "class")
    named = written(each.groupBy("classes").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("ids"), F.count_distinct("item_id").alias("n")).select("classes", "n", F.sha2("ids", 256).alias("h")), "sets")
    none = found.where("classes is null").withColumns({"n": F.lit(0).cast("long"), "h": F.lit(None).cast("string")})
    out = met.join(small(named, 100_000), "classes", "left").unionByName(none)
    return out.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("h", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), contaminated().alias("contaminated"), "longest", "longest_match"
    )


DIGEST_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
windows AS (
  SELECT item_id, item, i AS place, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS x
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT rid, item_id, item, place, i, p.k FROM places p JOIN windows USING (k, x)),
covered AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM hits) GROUP BY rid),
listed AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY rid),
longest AS (
  SELECT rid, max(n) AS longest FROM (
    SELECT rid, g, count(*) AS n FROM (
      SELECT rid, j - row_number() OVER (PARTITION BY rid ORDER BY j) AS g
      FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS j FROM hits)) GROUP BY rid, g) GROUP BY rid),
verbatim AS (
  SELECT rid, max(n) AS longest_match FROM (
    SELECT rid, count(*) - 1 + any_value(k) AS n FROM (
      SELECT rid, item, place - i AS diagonal, k, i - row_number() OVER (PARTITION BY rid, item, place - i ORDER BY i) AS g FROM hits)
    GROUP BY rid, item, diagonal, g) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM words LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN longest USING (rid) LEFT JOIN verbatim USING (rid)
"""
