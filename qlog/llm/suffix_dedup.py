"""Exact removal of repeated byte strings by a distributed sparse suffix array.

A byte goes if some string of ``length`` bytes around it also starts elsewhere. Suffixes of every position would be far
larger than the corpus, so only some positions are anchors: of the ``GRAM``-byte grams of each window of ``length`` bytes
the one with the least hash, the leftmost of ties. Which one that is depends on the window's bytes alone, so two equal
windows have their anchor at the same place, and every repeated window is found among suffixes that start at anchors.

1. Each text is read once; runs of windows with one anchor become spans (some 1.2 % of positions). Grams that start at one
   place only cannot be repeated; their spans end here. Equal spans are counted: with two places, all their windows repeat.
2. Different spans of one gram (mostly at the edges of copied passages) fetch their bytes. Sampled splitters range-partition
   these suffixes by their leading bytes; a bucket sorts its suffixes, then the windows around them, by multikey quicksort
   (one eight-byte key at a time, only among what is still equal) and marks equal neighbours.
3. A gram at the edge of a bucket may go on in the next one, so a gram that a third of all texts share is spread over many
   buckets. Buckets report each distinct window of such grams once, by cells of windows that have all but ``CELL`` bytes in
   common; only cells that occur at several places are compared across boundaries window by window.

Places are compared by the bytes themselves inside a bucket, by 128 bits (gram and span, or window) between tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qlog.llm.common import U64, mix, text_slices, written

GRAM = 32
SEGMENT = 1 << 20
#: Spans of a bucket, and windows that are sorted at once unless one gram has more.
BUCKET, WINDOWS = 16_384, 1 << 20
#: Spans and ranges that ride to the texts in a broadcast; more go by a shuffle of the texts.
PICKED = 20_000

_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_HIGH = U64(0xFFFFFFFF00000000)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on, by doubling."""
    h, n = _BYTES[raw], 1
    while n < GRAM:
        h = h[:-n] * U64(0xD6E8FEB86659FD93) + h[n:]
        h ^= h >> U64(32)
        n *= 2
    return h * U64(0x94D049BB133111EB)


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window that starts at each position, and the grams' hashes."""
    h = gram_hashes(raw)
    low = (h & _HIGH) | np.arange(len(h), dtype=U64)  # the least hash, the leftmost of ties
    span, n = length - GRAM + 1, 1
    while 2 * n <= span:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < span:
        low = np.minimum(low[: len(low) - (span - n)], low[span - n :])
    return (low & ~_HIGH).astype(np.int64), h


def spans_of(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, gram, span, lo, hi, at) of the texts' spans: windows from ``lo`` to ``hi`` share the anchor ``at``."""
    for base in range(0, max(1, len(raw) - length + 1), SEGMENT):
        part = raw[base : base + SEGMENT + length - 1]
        own = np.clip(offsets - base, 0, len(part))
        if len(part) < length:
            continue
        anchor, h = anchors(part, length)
        starts, ends = own[:-1], own[1:]
        fits = np.flatnonzero(ends - starts >= length)
        begin = np.zeros(len(anchor) + 1, np.int8)
        begin[starts[fits]] += 1
        begin[ends[fits] - length + 1] -= 1
        valid = np.cumsum(begin[:-1], dtype=np.int8) > 0
        first = valid.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first[starts[fits]] = True
        last = valid.copy()
        last[:-1] &= first[1:] | ~valid[1:]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last)
        at, data = anchor[lo], part.tobytes()
        span = np.array([int.from_bytes(hashlib.blake2b(data[a : b + length], digest_size=8).digest(), "little", signed=True) for a, b in zip(lo.tolist(), hi.tolist())], np.int64)
        text = np.searchsorted(own, lo, "right") - 1
        for n in np.unique(text).tolist():
            i, j = np.searchsorted(text, [n, n + 1])
            shift = base - int(offsets[n])
            yield n, h[at[i:j]].view(np.int64), span[i:j], lo[i:j] + shift, hi[i:j] + shift, at[i:j] + shift


SPAN = pa.struct([("gram", pa.int64()), ("span", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("twice", pa.bool_())])
RANGE = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
READ = "doc_id long, hash binary, n_bytes long, own array<struct<lo:int,hi:int>>, spans array<struct<gram:long,span:long,lo:int,hi:int,at:int,twice:boolean>>"


def _nested(kind: pa.StructType, rows: list[list[np.ndarray]]) -> pa.ListArray:
    """One list of structs a row, from its columns."""
    ends = np.concatenate([[0], np.cumsum([len(r[0]) if r else 0 for r in rows])])
    full = [r for r in rows if r]
    cols = [np.concatenate([r[c] for r in full]) if full else [] for c in range(kind.num_fields)]
    fields = [pa.array(c, kind.field(n).type) for n, c in enumerate(cols)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def read_texts(docs: DataFrame, length: int) -> DataFrame:
    """READ for each row: SHA-256 and size of its text, windows that repeat within the text, and its spans.

    A text that a task has seen before has no spans: it is a copy anyhow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for i, j, raw, offsets in text_slices(batch.column("text")):
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                hashes = [hashlib.sha256(t).digest() for t in texts]
                parts: list[list] = [[] for _ in texts]
                for n, *cols in spans_of(raw, offsets, length):
                    parts[n].append(cols)
                own: list[list] = [[] for _ in texts]
                spans: list[list] = [[] for _ in texts]
                for n, h in enumerate(hashes):
                    if h in seen or not parts[n]:
                        continue
                    seen.add(h)
                    gram, span, lo, hi, at = (np.concatenate(c) for c in zip(*parts[n]))
                    _, first, back, count = np.unique(np.stack([gram, span], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                    again = count[back.reshape(-1)] > 1
                    own[n] = [lo[again], hi[again]]
                    first.sort()
                    spans[n] = [c[first] for c in (gram, span, lo, hi, at, again)]
                sizes = np.diff(offsets)
                cols = [batch.column("doc_id")[i:j], pa.array(hashes, pa.binary()), pa.array(sizes, pa.int64()), _nested(RANGE, own), _nested(SPAN, spans)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "hash", "n_bytes", "own", "spans"])

    return docs.mapInArrow(run, READ)


def multikey_sort(words: np.ndarray, at: np.ndarray, label: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings by ``label``, then by ``n_words`` eight-byte keys, and where each run of equal ones begins.

    Multikey quicksort: one key at a time splits what is equal so far, and only that goes on to the next key.
    ``words`` holds the eight bytes from each position on, the first byte highest.
    """
    order = np.argsort(label, kind="stable")
    edge = np.ones(len(at), bool)
    edge[1:] = label[order][1:] != label[order][:-1]
    for w in range(n_words):
        alone = edge & np.append(edge[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        run, key = np.cumsum(edge[tied]), words[at[order[tied]] + 8 * w].astype(U64)
        sub = np.lexsort((key, run))
        order[tied] = order[tied][sub]
        key = key[sub]
        edge[tied[1:]] |= (key[1:] != key[:-1]) & (run[1:] == run[:-1])
    return order, edge


#: Windows of a cell have their anchor equally far from their start, but for so many bytes.
CELL = 24
WINDOW = pa.struct([("at", pa.int32()), ("digest", pa.binary())])
BUCKETED = "hash binary, lo int, hi int, place long, cell binary, windows array<struct<at:int,digest:binary>>"
_BUCKETED = ["hash", "lo", "hi", "place", "cell", "windows"]


def _window_rows(table: pa.Table, length: int) -> Iterator[pa.Table]:
    """BUCKETED rows of a bucket: marks (no cell), and cells of windows that must be compared across boundaries.

    Of the latter, rows without a hash are witnesses: their windows repeat.
    """
    lo, at = (table[c].to_numpy().astype(np.int64) for c in ("lo", "at"))
    repeated, hashes, places = table["repeated"].to_numpy(), table["hash"].to_pylist(), table["place"].to_numpy()
    bodies = table["bytes"].combine_chunks()
    bodies = bodies.cast(pa.large_binary())
    starts = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    starts = starts - starts[0]
    padded = np.zeros(len(data) + length + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    suffix = starts[:-1] + at - lo
    order, edge = multikey_sort(words, suffix, np.zeros(len(lo), np.int64), GRAM // 8)
    gram = np.cumsum(edge) - 1  # along the order
    bounds = np.append(np.flatnonzero(edge), len(order))
    sizes = np.diff(starts) - length + 1
    taken = 0
    while taken < len(bounds) - 1:
        weight = np.cumsum(sizes[order[bounds[taken] :]])
        upto = np.searchsorted(bounds, bounds[taken] + np.searchsorted(weight, WINDOWS, "right"), "right") - 1
        upto = min(max(upto, taken + 1), len(bounds) - 1)
        part = slice(bounds[taken], bounds[upto])
        rows = order[part]
        n = sizes[rows]
        row = np.repeat(rows, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        label = np.repeat(gram[part], n) * (length + 1) + at[row] - lo[row] - step
        by, new = multikey_sort(words, starts[row] + step, label, length // 8)
        run = np.cumsum(new) - 1
        count = np.bincount(run)[run]
        known = np.zeros(run[-1] + 1, bool)
        np.logical_or.at(known, run, repeated[row[by]])
        marked = np.zeros(len(row), bool)
        marked[by] = (count > 1) | known[run]
        marked &= ~repeated[row]
        begin = np.flatnonzero(marked & ~(np.append(False, marked[:-1]) & np.append(False, row[1:] == row[:-1])))
        end = np.flatnonzero(marked & ~(np.append(marked[1:], False) & np.append(row[1:] == row[:-1], False)))
        of = row[begin]
        nothing = pa.nulls(len(of), pa.binary()), pa.nulls(len(of), pa.list_(WINDOW))
        yield pa.table([pa.array([hashes[r] for r in of.tolist()], pa.binary()), pa.array(lo[of] + step[begin], pa.int32()), pa.array(lo[of] + step[end], pa.int32()), pa.array(places[of], pa.int64()), *nothing], _BUCKETED)
        edges = [g for g in {0, len(bounds) - 2} if taken <= g < upto]
        if edges:
            open_ = new & np.isin(np.repeat(gram[part], n)[by], edges)  # one of each distinct window
            pick, witness = by[open_], (count > 1)[open_] | known[run[open_]]
            of, at_window = row[pick], step[pick]
            cell = (at[of] - lo[of] - at_window) // CELL
            sort = np.lexsort((at_window, witness, cell, of))
            of, at_window, cell, witness = of[sort], at_window[sort], cell[sort], witness[sort]
            first = np.ones(len(of), bool)
            first[1:] = (of[1:] != of[:-1]) | (cell[1:] != cell[:-1]) | (witness[1:] != witness[:-1])
            first = np.flatnonzero(first)
            body = data.tobytes()
            digest = lambda p, size: hashlib.blake2b(body[p : p + size], digest_size=16).digest()
            common = [digest(p, length - CELL) for p in (starts[of[first]] + at[of[first]] - lo[of[first]] - CELL * cell[first]).tolist()]
            each = pa.StructArray.from_arrays([pa.array(lo[of] + at_window, pa.int32()), pa.array([digest(p, length) for p in (starts[of] + at_window).tolist()], pa.binary())], fields=list(WINDOW))
            windows = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), each)
            named = [None if w else hashes[r] for w, r in zip(witness[first].tolist(), of[first].tolist())]
            no = pa.nulls(len(first), pa.int32())
            yield pa.table([pa.array(named, pa.binary()), no, no, pa.array(places[of[first]], pa.int64()), pa.array(common, pa.binary()), windows], _BUCKETED)
        taken = upto


def _bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        _, first = np.unique(table["place"].to_numpy(), return_index=True)  # the same span may have come from several copies
        for out in _window_rows(table.take(pa.array(np.sort(first))), length):
            yield from out.combine_chunks().to_batches()

    return run


def _cut(length: int):
    """Bytes of the spans that a text was picked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for n in range(batch.num_rows):
                key = batch.column("hash")[n].as_py()
                if key in seen:
                    continue
                seen.add(key)
                body = batch.column("text")[n].as_buffer().to_pybytes()
                wanted = batch.column("wanted")[n].values
                lo, hi, at = (wanted.field(c).to_pylist() for c in ("lo", "hi", "at"))
                cols = [pa.array([key] * len(lo), pa.binary()), *(wanted.field(c) for c in ("place", "span", "lo", "at", "repeated"))]
                cols += [pa.array([body[a : a + GRAM] for a in at], pa.binary()), pa.array([body[a : b + length] for a, b in zip(lo, hi)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["hash", "place", "span", "lo", "at", "repeated", "lead", "bytes"])

    return run


CUT = "hash binary, place long, span long, lo int, at int, repeated boolean, lead binary, bytes binary"


def union_of(ranges: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal byte runs [from, to) of windows that start from lo to hi."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return out


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for n in range(batch.num_rows):
                body = batch.column("text")[n].as_buffer().to_pybytes()
                wanted = batch.column("wanted")[n].values
                gone = union_of(list(zip(wanted.field("lo").to_pylist(), wanted.field("hi").to_pylist())), length)
                digest, begin = hashlib.sha256(), 0
                for a, b in [*gone, [len(body), len(body)]]:
                    digest.update(body[begin:a])
                    begin = b
                row = batch.column("hash")[n].as_py(), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), gone
                for col, v in zip(out, row):
                    col.append(v)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["hash", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def _picked(texts: DataFrame, wanted: DataFrame, run, schema: str, most: int) -> DataFrame:
    """``run`` over the texts that ``wanted`` (hash, structs) names."""
    total = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    side = F.broadcast(wanted) if total <= most else wanted
    return texts.join(side, "hash").select("hash", "text", "wanted").mapInArrow(run, schema)


def repeated_ranges(docs: DataFrame, length: int = 200, bucket: int = BUCKET, picked: int = PICKED) -> tuple[DataFrame, DataFrame]:
    """The rows read (READ) and, by text, ``wanted``: ranges of starts of repeated windows."""
    if length % 8 or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of 8 of {2 * GRAM} at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    read = written(read_texts(docs, length), "texts")
    key = F.substring("hash", 1, 16).alias("hash")
    spans = read.select(key, F.explode("spans").alias("s")).select("hash", "s.*").withColumn("place", F.xxhash64("hash", "lo"))
    grams = spans.groupBy("gram").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("gram")
    spans = written(spans.join(grams, "gram"), "spans")
    one = spans.groupBy("gram", "span").agg((F.max("twice") | (F.min("place") != F.max("place"))).alias("repeated"), F.min(F.struct("hash", "lo", "hi", "at", "place")).alias("s"))
    one = written(one.select("gram", "span", "repeated", "s.*"), "distinct_spans")
    marks = [read.select(key, F.explode("own").alias("r")).select("hash", "r.lo", "r.hi"), spans.join(one.where("repeated").select("gram", "span"), ["gram", "span"]).select("hash", "lo", "hi")]

    several = one.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    fine = one.join(several, "gram").groupBy("hash").agg(F.collect_list(F.struct("place", "span", "lo", "hi", "at", "repeated")).alias("wanted"))
    fine = written(fine, "fine_spans")
    texts = docs.where(F.octet_length("text") >= length).select(F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("hash"), "text")
    cut = written(_picked(texts, fine, _cut(length), CUT, picked).withColumn("salt", F.spark_partition_id()), "suffixes")
    total = cut.count()
    if total:
        buckets = cut.repartitionByRange(max(-(-total // bucket), 8), "lead", "span", "salt").drop("lead", "span", "salt")
        found = written(buckets.mapInArrow(_bucket(length), BUCKETED), "windows")
        marks.append(found.where("cell is null").select("hash", "lo", "hi"))
        cells = found.where("cell is not null")
        shared = cells.groupBy("cell").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("cell")
        across = written(cells.join(shared, "cell").select("hash", "place", F.inline("windows")), "across")
        seen = across.groupBy("digest").agg(F.max(F.col("hash").isNull()).alias("w"), F.min(F.xxhash64("place", "at")).alias("a"), F.max(F.xxhash64("place", "at")).alias("b")).where("w or a <> b")
        marks.append(across.where("hash is not null").join(seen.select("digest"), "digest").select("hash", F.col("at").alias("lo"), F.col("at").alias("hi")))
    every = marks[0]
    for more in marks[1:]:
        every = every.unionByName(more)
    return read, every.groupBy("hash").agg(F.collect_list(F.struct("lo", "hi")).alias("wanted"))


def suffix_dedup(docs: DataFrame, length: int = 200, bucket: int = BUCKET, picked: int = PICKED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (byte runs [from, to)) of each row.

    Each byte goes that a string of ``length`` bytes covers which also starts elsewhere, in the same text or another;
    strings never cross texts and are judged on the input. Null texts are empty; texts under ``length`` bytes stay whole.
    Rows that repeat a text are copies of each other, with or without an id, so all their bytes go (from ``length`` on).
    Very long texts are read in segments. Other columns are ignored; an empty table gives no rows. ``length`` is a multiple
    of 8, of 64 at least.
    """
    read, ranges = repeated_ranges(docs, length, bucket, picked)
    key = F.substring("hash", 1, 16).alias("hash")
    copies = read.where(F.col("n_bytes") >= length).groupBy(key).agg(F.count("*").alias("n"), F.max("n_bytes").cast("int").alias("size")).where("n > 1")
    copies = written(copies, "copies")
    partly = written(ranges.join(copies, "hash", "left_anti"), "ranges")
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
    texts = texts.select(F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("hash"), "text")
    kept = _picked(texts, partly, _kept(length), "hash binary, n_removed long, n_spans long, kept_sha256 string, removed array<array<int>>", picked)
    gone = copies.select("hash", F.col("size").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.array(F.array(F.lit(0), "size")).alias("removed"))
    changed = written(kept.unionByName(gone), "changed")
    rows = read.select("doc_id", "n_bytes", "hash").withColumn("whole", F.lower(F.hex("hash"))).withColumn("hash", key)
    found = rows.join(changed, "hash", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<array<int>>")).alias("removed"))


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; rows as in ``suffix_dedup``."""
    return suffix_dedup(docs).drop("removed")
