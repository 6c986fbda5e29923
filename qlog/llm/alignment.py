"""Alignment of the tokens of two tokenizers by diagonal run skipping, and counts of the id pairs that it links.

Both token sequences of a text are arrays of byte ends. Where the ends agree at the current index shift, tokens pair one
to one, and exponential probing compares ever longer stretches of both arrays at that shift and jumps over what is equal.
At a mismatch the irregular group is resolved locally, which sets the next shift.

Texts are encoded chunk by chunk, each distinct chunk once: a chunk is a run of spaces with what follows up to the next
run of spaces behind something that is no white space. Neither tokenizer lets a token cross such a place, which the
loader checks on its vocabulary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qlog.llm.common import text_slices, written
from qlog.llm.tokens import Distinct, Encoder

#: Stands for the ids of a chunk whose tokens do not give its bytes back.
BROKEN = 0xFFFFFFFF
#: Links that are listed at once; a group that holds more goes by its distinct ids.
LINKS = 1 << 22
#: Pairs of ids up to which their counts are broadcast; more are joined.
PAIRS = 500_000


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of chunks, and the first chunk of each text."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero(raw == 32)
    at = at[at >= 3]
    last, two, three = raw[at - 1], raw[at - 2], raw[at - 3]
    # Before a space: a printable ASCII character, one of two bytes beyond U+00BF, or one of three from U+4000 on; others may be white space.
    cut[at[((last > 32) & (last < 127)) | ((last > 127) & (((two >= 0xC3) & (two < 0xE0)) | ((two > 127) & (two < 0xC0) & (three >= 0xE4) & (three < 0xF0))))]] = True
    cut[offsets] = True
    cut[n] = False
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), np.searchsorted(start, offsets)


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Index behind the last token of each group in ``a`` and in ``b``, which rise and end alike."""
    ends_a: list[int] = []
    ends_b: list[int] = []
    i, j, n = 0, 0, len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:  # a one-to-one stretch at the shift j - i
            size, width = 1, 1
            while a[i + size : i + size + width] == b[j + size : j + size + width] and i + size < n:
                size += width
                width *= 2
            size = min(size, n - i)
            while width > 1:  # the first difference lies within the last width
                width //= 2
                part = a[i + size : i + size + width]
                if part and part == b[j + size : j + size + width]:
                    size += len(part)
            ends_a += range(i + 1, i + size + 1)
            ends_b += range(j + 1, j + size + 1)
            i += size
            j += size
            continue
        while x != y:  # an irregular group: whichever lies behind goes on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        ends_a.append(i)
        ends_b.append(j)
    return ends_a, ends_b


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)


def linked(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids, a in the upper half of a long, and how many links of the text each has."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    begin_a, begin_b, links = ends_a - size_a, ends_b - size_b, size_a * size_b
    codes, counts = [np.zeros(0, np.int64)], [np.zeros(0)]
    a, b = ids_a.astype(np.int64) << 32, ids_b.astype(np.int64)
    usual = np.flatnonzero(links <= LINKS)
    totals = np.cumsum(links[usual])
    for part in np.split(usual, np.searchsorted(totals, np.arange(LINKS, totals[-1] if len(totals) else 0, LINKS))):
        if len(part):
            n, wide = links[part], size_b[part]
            group = np.repeat(np.arange(len(part)), n)
            k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
            code, count = np.unique(a[begin_a[part][group] + k // wide[group]] | b[begin_b[part][group] + k % wide[group]], return_counts=True)
            codes.append(code)
            counts.append(count)
    for g in np.flatnonzero(links > LINKS):
        (own_a, n_a), (own_b, n_b) = (np.unique(x[f : f + s], return_counts=True) for x, f, s in ((a, begin_a[g], size_a[g]), (b, begin_b[g], size_b[g])))
        for x, n in zip(own_a, n_a):
            codes.append(x | own_b)
            counts.append(n * n_b)
    return _merged(codes, counts)


class Pair:
    """Two encoders of chunks, the bytes of each one's tokens, and the decimal forms of ids with what follows them."""

    def __init__(self, a: Encoder, b: Encoder, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.encoders, self.sizes = (a, b), (sizes_a, sizes_b)
        self.texts = [{s: np.array([f"{i}{s}" for i in range(len(sizes))], object) for s in ends} for sizes, ends in ((sizes_a, ",|"), (sizes_b, ",;"))]

    def written_groups(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        out = np.empty(len(ids_a) + len(ids_b), object)
        own = (self.texts[0], ids_a, ends_a, np.append(0, ends_b[:-1]), "|"), (self.texts[1], ids_b, ends_b, ends_a, ";")
        for texts, ids, ends, others, last in own:
            at = np.arange(len(ids)) + np.repeat(others, np.diff(ends, prepend=0))
            out[at] = texts[","][ids]
            out[at[ends - 1]] = texts[last][ids[ends - 1]]
        return "".join(out.tolist())[:-1]

    def align(self, texts: pa.Array) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of each text, in order."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        none = (0, 0, 0, 0, "", [], [])
        for _, _, raw, offsets in text_slices(spaced, 2 << 20):
            start, end, first = chunks(raw, offsets)
            cut = Distinct(raw, start, end, False)
            (a, of_a), (b, of_b) = (e.ids(cut) for e in self.encoders)
            of_a, of_b = of_a[first], of_b[first]
            for n in range(len(offsets) - 1):
                ids_a, ids_b = a[of_a[n] : of_a[n + 1]], b[of_b[n] : of_b[n + 1]]
                if offsets[n + 1] - offsets[n] == 1 or (ids_a == BROKEN).any() or (ids_b == BROKEN).any():
                    yield none
                    continue
                ends = align(np.cumsum(self.sizes[0][ids_a]).tolist(), np.cumsum(self.sizes[1][ids_b]).tolist())
                ends_a, ends_b = (np.array(x, np.int64) for x in ends)
                pairs, links = linked(ids_a, ids_b, ends_a, ends_b)
                digest = hashlib.sha256(self.written_groups(ids_a, ids_b, ends_a, ends_b).encode()).hexdigest()
                yield len(ids_a), len(ids_b), len(ends_a), int(links.sum()), digest, pairs, links


def _whole(encode: Callable, parts: list[bytes]) -> Callable:
    """``encode`` with BROKEN for chunks whose tokens do not give their bytes back."""

    def run(words: list[str]) -> list[list[int]]:
        return [ids if b"".join([parts[i] for i in ids]) == w.encode() else [BROKEN] for w, ids in zip(words, encode(words))]

    return run


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level(name: str) -> tuple[Callable, list[bytes]]:
    """Encoder of chunks and the bytes of each token of a byte-level vocabulary file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    from qlog.llm.tokens import _byte_letters

    tokenizer = Tokenizer.from_file(_path(name))
    tokenizer.encode_special_tokens = True
    letters = _byte_letters()
    own = {c: b for b, c in letters.items()}
    parts = [b"".join(bytes([own[c]]) if c in own else c.encode() for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]
    # A space inside a token, unless all of it is white space, could cross a chunk's edge: only a run of spaces may begin one.
    if tokenizer.normalizer is not None or any(b" " in p.lstrip(b" ") and p.decode(errors="replace").strip() for p in parts):
        raise ValueError(f"{name}: its tokens may cross the edges of chunks")
    model, direct = tokenizer.model, {b: c for b, c in letters.items()}

    def encode(words: list[str]) -> list[list[int]]:
        got: list = [None] * len(words)
        rest = []
        for n, w in enumerate(words):
            if len(w) > 1 and w[0] == " " and w[1:].isalpha() and (w.isascii() or all(c <= "ÿ" for c in w)):  # one pre-token
                got[n] = [t.id for t in model.tokenize(w.encode().decode("latin-1").translate(direct))]
            else:
                rest.append(n)
        for n, e in zip(rest, tokenizer.encode_batch_fast([words[n] for n in rest], add_special_tokens=False)):
            got[n] = e.ids
        return got

    return encode, parts


def piece_level(name: str) -> tuple[Callable, list[bytes]]:
    """Encoder of chunks and the bytes of each piece of a sentence-piece model that puts a space first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=_path(name))
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    parts = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    if any("▁" in p.lstrip("▁") for p in names) or sp.encode(" a  b", out_type=str) != sp.encode("", out_type=str) + sp.encode(" a", out_type=str) + sp.encode(" b", out_type=str):
        raise ValueError(f"{name}: its pieces may cross the edges of chunks")
    space = [sp.piece_to_id("▁")]  # a last space alone; the model puts no space before nothing
    return lambda words: [ids if w != " " else space for w, ids in zip(words, sp.encode([w[1:] for w in words], num_threads=1))], parts


@lru_cache(maxsize=2)
def load_pair(name_a: str, name_b: str) -> Pair:
    """Kept by the Python worker, so its memory of chunks serves all its tasks."""
    made = []
    for encode, parts in (byte_level(name_a), piece_level(name_b)):
        made.append((Encoder(_whole(encode, parts), False), np.array([len(p) for p in parts], np.int64)))
    return Pair(made[0][0], made[1][0], made[0][1], made[1][1])


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"


def aligned(docs: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """ALIGNED for each row: its groups by number and digest, and its distinct linked pairs of ids with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load_pair(name_a, name_b)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(0, batch.num_rows, 200):
                cols = list(zip(*pair.align(texts[i : i + 200])))
                plain = [pa.array(c, pa.string() if n == 4 else pa.int64()) for n, c in enumerate(cols[:5])]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]), pa.int32()), pa.array(np.concatenate([np.asarray(x, np.int64) for x in c]))) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays([ids[i : i + 200], *plain, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (rows that hold it linked) and best (no other pair of its A id has more), from ``aligned`` rows."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most one row for each id of B
    return counts.withColumn("best", F.col("count") == highest)


def cross_tokenizer_alignment(docs: DataFrame, name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model", most_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    Space and text are encoded by A, the text by B (which puts the space itself); both ends' common byte offsets cut the
    tokens into groups, and within a group all A tokens are linked with all B tokens. A pair's count is the number of
    rows that hold it linked; ``n_best`` counts links whose pair has the highest count of its A id, ties included, and
    ``count_sum`` adds the counts up over links. Null and empty texts, and texts that a tokenizer does not give back byte
    for byte, have no tokens: zeros and ''. Rows without an id and repeated rows are rows of their own, and count each.
    Other columns are ignored; an empty table gives no rows. Pairs are bounded by the two vocabularies, not by the corpus;
    counts are broadcast up to ``most_pairs`` of them, beyond that they are joined by pair.
    """
    rows = aligned(docs, name_a, name_b).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "aligned")
    counts = written(pair_counts(rows), "pair_counts")
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.pairs", "p.links")
    sums = links.join(counts, F.col("pairs") == F.col("pair")).groupBy("row")
    sums = sums.agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    found = rows.drop("pairs", "links").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
