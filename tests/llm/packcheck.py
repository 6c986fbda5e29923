"""Brute-force view of packed pieces, for tests."""

import zlib
from collections import defaultdict

import numpy as np


def whole_ids(texts, name="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, ids_by_doc, size=4096):
    """rows: dicts of pieces. Every id in exactly one piece, sequences gapless and within ``size``; gives the share of padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_by_doc)
    for doc, ids in ids_by_doc.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids), doc
    padded = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / max(1, total)
