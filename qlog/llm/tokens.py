"""Exact token ids of many texts with a public tokenizer, encoding each distinct piece once.

A text's ids are those of its pieces in order, because the tokenizer never lets a token cross white
space, nor a change between letters, digits and punctuation where both sides are plain. Pieces that
could behave otherwise (other scripts, apostrophes, angle brackets) are encoded as whole
white-space-delimited words. Distinct pieces are remembered from batch to batch, up to a limit; they are
found by hash and compared byte for byte, so equal hashes of different pieces do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from qlog.llm.common import U64, Hasher, spans, text_slices

#: Kinds of bytes: 0 white space, 1 letters (also those of U+00C0..U+00FF), 2 other printable, 3 and up each digit, 255 odd.
_SPACES = (9, 10, 11, 12, 13, 32)


def _kinds() -> np.ndarray:
    k = np.full(256, 255, np.uint8)
    for b in range(33, 127):
        k[b] = 1 if chr(b).isalpha() else 3 if chr(b).isdigit() else 2
    k[[ord("'"), ord("<")]] = 255
    k[list(_SPACES)] = 0
    return k


KINDS = _kinds()
WORDS = (KINDS != 0).astype(np.uint8)


def plain_pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of pieces whose ids can be joined, and the first piece of each text."""
    start, end, first = spans(raw, offsets, WORDS)
    if not len(start):
        return start, end, first
    k = KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    letters = lead[(raw[lead + 1] >= 0x80) & (raw[lead + 1] <= 0xBF) & (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    k[letters] = 1
    k[letters + 1] = 1
    odd = np.add.reduceat(k == 255, start) > 0  # words are apart by spaces, whose kind is 0
    word = np.repeat(np.arange(len(start)), end - start)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start) + np.arange(len(word))
    kind = k[at]
    cut = np.ones(len(at), bool)
    same = word[1:] == word[:-1]
    cut[1:] = ~same | (~odd[word[1:]] & ((kind[1:] != kind[:-1]) | (kind[1:] == 3)))
    begin = np.flatnonzero(cut)
    finish = np.append(begin[1:], len(at)) - 1
    starts = at[begin]
    return starts, at[finish] + 1, np.searchsorted(starts, offsets)


class Pieces:
    """Ids of pieces by hash: sorted hashes, and each one's bytes and its run in an array of ids."""

    def __init__(self, encode, most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.hash, self.row = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ends, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.starts, self.raw = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        self.bytes = Hasher(self.raw)

    def rows(self, hashes: np.ndarray, words) -> np.ndarray:
        """Row of each (distinct, sorted) hash; ``words(k)`` gives the folded bytes of those not known yet."""
        at = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[at] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            if len(self.hash) + len(new) > self.most and len(self.hash):
                self.clear()
                return self.rows(hashes, words)
            own = words(new)
            got = self.encode([w.decode() for w in own])
            ends = self.ends[-1] + np.cumsum([len(x) for x in got])
            first = len(self.ends) - 1
            self.ends = np.concatenate([self.ends, ends])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(w) for w in own])])
            self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(own), np.uint8)])
            self.bytes = Hasher(self.raw)
            self.row = np.concatenate([self.row, first + np.arange(len(new))])
            self.hash = np.concatenate([self.hash, hashes[new]])
            order = np.argsort(self.hash)
            self.hash, self.row = self.hash[order], self.row[order]
            at = np.searchsorted(self.hash, hashes)
        return self.row[at]


class Distinct:
    """Pieces of a run of texts by hash: the distinct hashes, a place of each, and the hash of each piece."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool):
        self.start, self.end, self.own = start, end, Hasher(raw, fold_case)
        self.hashes, self.at, self.back = np.unique(self.own.of(start, end), return_index=True, return_inverse=True)
        self.data = self.own.bytes.tobytes()

    def words(self, k: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[k].tolist(), self.end[k].tolist())]


class Encoder:
    """``encode`` gives the ids of words; ``fold_case`` tells whether it ignores the case of A-Z."""

    def __init__(self, encode, fold_case: bool = True):
        self.pieces, self.encode, self.fold_case = Pieces(encode), encode, fold_case

    def runs(self, texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of a run of texts, end of each text's ids from 0 on)."""
        for i, _, raw, offsets in text_slices(texts, most_bytes):
            start, end, first = plain_pieces(raw, offsets)
            if not len(start):
                yield i, np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
                continue
            ids, ends = self.ids(Distinct(raw, start, end, self.fold_case))
            yield i, ids, ends[first]

    def ids(self, cut: Distinct) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of a run of texts, and where each piece's ids end, from 0 on."""
        rows = self.pieces.rows(cut.hashes, lambda new: cut.words(cut.at[new]))[cut.back]
        p = self.pieces
        begin, size, ids = p.ends[rows], p.ends[rows + 1] - p.ends[rows], p.ids
        other = np.flatnonzero(~cut.own.equal(cut.start, cut.end, p.bytes, p.starts[rows], p.starts[rows + 1]))
        if len(other):  # another piece has the same hash: these are encoded by themselves
            got = self.encode([w.decode() for w in cut.words(other)])
            size[other] = [len(x) for x in got]
            begin[other] = len(ids) + np.cumsum(size[other]) - size[other]
            ids = np.concatenate([ids, np.fromiter((x for one in got for x in one), np.uint32)])
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends


@lru_cache(maxsize=2)
def load_tokenizer(name: str) -> Encoder:
    """Encoder of a vocabulary file of the word-end kind (a path, or a name among the public ones).

    Kept by the Python worker, so its memory of pieces serves all its tasks.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    path = name
    if "/" not in name:
        import public_tokenizers

        path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    whole = lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    probe = ["Words", "and", "more", ",", "1", "2", "3", "..", "words", "."]
    if whole(["Words and\nmore, 123.. words."])[0] != [i for ids in whole(probe) for i in ids]:
        raise ValueError(f"{name}: its tokens cross white space or depend on it, so texts cannot be encoded piece by piece")
    fold_case = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
    model, direct = tokenizer.model, _byte_letters()

    def encode(words: list[str]) -> list[list[int]]:
        got: list = [None] * len(words)
        rest = []
        for n, w in enumerate(words):
            if not fold_case:
                rest.append(n)
            elif w.isascii() and w.isalpha():  # one pre-token as it stands
                got[n] = [t.id for t in model.tokenize(w.lower())]
            elif w.isalpha() and all("À" <= c <= "ÿ" or c.isascii() for c in w):
                got[n] = [t.id for t in model.tokenize(w.lower().encode().decode("latin-1").translate(direct))]
            else:
                rest.append(n)
        for n, ids in zip(rest, whole([words[n] for n in rest])):
            got[n] = ids
        return got

    return Encoder(encode, fold_case)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: printable bytes stand for themselves, others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(others)) for b in range(256)}
