"""Packing: shortest-pack-first over the histogram of lengths.

Documents are tokenised and cut into pieces of at most the pack size; what remains of a document is cut
once more at its last multiple of a quarter pack, so that there are always short pieces to fill packs
with. Only the histogram of piece lengths (at most one row a length) reaches the driver. There lengths are placed longest first, each
time into the pattern with the most room, by counts of equal patterns. The patterns' slots then meet
the pieces again by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlog.llm.common import written
from qlog.llm.tokens import load_tokenizer

RANK_BITS = 44
#: Salted groups of a length whose counts are added up in one task; the sums of these are few enough for one task again.
GROUPS_A_SUM = 4096


@dataclass
class Slots:
    """Slots of all patterns, ordered by (length, first rank): ranks from ``rank`` on go to sequences from ``sequence`` on."""

    key: np.ndarray  # length << RANK_BITS | first rank
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = (length.astype(np.int64) << RANK_BITS) | rank
        at = np.searchsorted(self.key, want, "right") - 1
        return self.sequence[at] + want - self.key[at], self.offset[at]


def pack_histogram(counts: dict[int, int], size: int) -> Slots:
    """Place ``counts[length]`` pieces of each length into packs of ``size``, longest first.

    A length goes to the open pattern with the fewest tokens (the shortest pack) if it fits there,
    else it opens a new one. Patterns are chains (length, shorter chain) with a count, so the work
    depends on the number of lengths, not of pieces.
    """
    open_: dict[int, list[tuple[tuple | None, int]]] = {}  # room -> [(chain, count)]
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            room = max(open_, default=-1)
            if room >= length:
                chain, c = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                room, chain, c = size, None, n
            used = min(n, c)
            if used < c:
                open_.setdefault(room, []).append((chain, c - used))
            open_.setdefault(room - length, []).append(((length, chain), used))
            n -= used
    keys, seqs, offs, base = [], [], [], 0
    rank = dict.fromkeys(counts, 0)
    for room in sorted(open_):
        for chain, c in open_[room]:
            lengths = []
            while chain is not None:
                lengths.append(chain[0])
                chain = chain[1]
            at = 0
            for length in reversed(lengths):
                keys.append((length << RANK_BITS) | rank[length])
                seqs.append(base)
                offs.append(at)
                rank[length] += c
                at += length
            base += c
    order = np.argsort(np.array(keys, np.int64))
    return Slots(np.array(keys, np.int64)[order], np.array(seqs, np.int64)[order], np.array(offs, np.int64)[order], base)


def cuts(tokens: int, size: int) -> list[int]:
    """Ends of the pieces of a document of ``tokens`` ids."""
    ends = list(range(size, tokens + 1, size))
    rest, step = tokens % size, max(1, size // 4)
    if rest > step and rest % step:
        ends.append(tokens - rest % step)
    return ends + [tokens] if not ends or ends[-1] < tokens else ends


PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]]
)


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: its ids and ``end_id``, cut by ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for i, tokens, ends in encode.runs(b.column(1)):
                for d, (a, z) in enumerate(zip(ends[:-1], ends[1:]), i):
                    own = np.empty(z - a + 1, "<u4")
                    own[:-1], own[-1] = tokens[a:z], end_id
                    s = 0
                    for e in cuts(len(own), size):
                        piece = own[s:e]
                        rows.append((ids[d], s, len(piece), zlib.crc32(piece), len(own)))
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                        s = e
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            names = [f.name for f in PIECE.fields]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = T.StructType([*PIECE.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if keep_ids else PIECE
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, size: int = 4096, keep_ids: bool = False, ranks_a_task: int = 128) -> DataFrame:
    """Pieces of all documents with the sequence and the offset they are packed at.

    ``keep_ids`` adds each piece's token ids. Null and empty texts are one piece of ``end_id`` alone.
    Repeated rows are packed as often as they occur. An empty table gives no rows. Ranks within a
    length are counted in salted groups of about ``ranks_a_task`` rows, dealt by the number of the written row and not
    by its id, whose counts are added up in two levels. So a length that a third of all documents have is still spread,
    also where they have one id or none.
    """
    pieces = written(cut_documents(docs, tokenizer, end_id, size, keep_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = pack_histogram(counts, size)
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # slots of distinct patterns
    salts = F.greatest(F.lit(1), (F.col("count") / ranks_a_task).cast("long"))
    table = pieces.sparkSession.createDataFrame(sorted(counts.items()), "length long, count long").select("length", salts.alias("salts"))
    salted = pieces.join(F.broadcast(table), "length").withColumn("salt", F.pmod(F.xxhash64("_row"), "salts")).drop("salts")
    # sums of the groups before each group in two levels, so that no task sees all groups of a very frequent length
    before = lambda *by: Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy("length", "salt").count().withColumn("up", F.floor(F.col("salt") / GROUPS_A_SUM)).withColumn("at", F.col("salt"))
    tops = groups.groupBy("length", "up").agg(F.sum("count").alias("count")).withColumn("at", F.col("up"))
    tops = tops.select("length", "up", F.coalesce(F.sum("count").over(before("length")), F.lit(0)).alias("base"))
    first = groups.withColumn("own", F.coalesce(F.sum("count").over(before("length", "up")), F.lit(0))).join(tops, ["length", "up"])
    first = first.select("length", "salt", (F.col("base") + F.col("own")).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("_row")
    ranked = salted.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1).drop("salt", "first")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            seq, off = shared.value.place(b.column(at("length")).to_numpy(), b.column(at("rank")).to_numpy()) if b.num_rows else (np.zeros(0, np.int64),) * 2
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(at(n)) for n in keep], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*keep, "sequence_id", "offset"])

    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    out = ranked.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return out.select(*[c for c in pieces.columns if c != "_row"], "sequence_id", "offset")
