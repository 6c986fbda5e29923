"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from qlog.llm import suffix_dedup as sd
from tests.llm.test_llm import ODD, frame, words


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for n, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone & ~np.append(False, gone[:-1])))
        out.append((n, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(rng):
    base = [words(rng, rng.randrange(20, 200)) for _ in range(30)]
    passage, short = words(rng, 60)[:260], words(rng, 60)[:199]
    texts = list(base)
    for b in base[:15]:  # copies with an edit, parts of texts at other places
        i = rng.randrange(len(b))
        texts += [b[:i] + "#" + b[i + 1 :], words(rng, 5) + b[i:] + words(rng, 5), b[: i // 2] + words(rng, 30)]
    texts += [words(rng, 20) + passage + words(rng, 20) + short for _ in range(40)]  # one frequent passage in other surroundings
    texts += [base[3]] * 4 + [passage[:200], passage[1:201], passage[:199], base[5] + base[5], base[6] + " " + base[6][10:]]
    texts += ["a" * 700, "ab" * 300, "é" * 260, passage[:230] + "日本" + passage, short + "x" + short]
    return texts + ODD


@pytest.mark.parametrize(("bucket", "picked"), [(sd.BUCKET, sd.PICKED), (3, 0)])
def test_against_brute_force(spark, bucket, picked):
    texts = corpus(random.Random(9))
    out = sd.suffix_dedup(frame(spark, texts).repartition(3), bucket=bucket, picked=picked)
    rows = sorted(out.collect())
    want = brute(texts)
    assert [tuple(r)[:5] for r in rows] == want and sum(w[2] > 0 for w in want) > 80
    for r in rows:
        b = (texts[r["doc_id"]] or "").encode()
        kept = b"".join(b[x:y] for x, y in zip([0] + [e for _, e in r["removed"]], [s for s, _ in r["removed"]] + [len(b)]))
        assert hashlib.sha256(kept).hexdigest() == r["kept_sha256"] and sum(e - s for s, e in r["removed"]) == r["n_removed"]


def test_other_lengths_and_segments(spark, monkeypatch):
    texts = corpus(random.Random(10))[:90]
    out = sd.suffix_dedup(frame(spark, texts).repartition(2), length=64)
    assert sorted(tuple(r)[:5] for r in out.collect()) == brute(texts, 64)
    with pytest.raises(ValueError, match="multiple of 8"):
        sd.suffix_dedup(frame(spark, texts), length=201)


def test_digest_of_odd_rows(spark):
    texts = ["x" * 199, words(random.Random(1), 50)]
    df = spark.createDataFrame([(1, texts[1], 2), (None, texts[1], 3), (2, texts[0], 4), (2, texts[0], 4), (3, None, 5)], "doc_id long, text string, hash int")
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in sd.suffix_dedup_digest(df).collect())
    want = brute([texts[1], texts[1], texts[0], texts[0], None])
    assert got == sorted((i, *w[1:]) for i, w in zip(["1", "None", "2", "2", "3"], want))
    assert sd.suffix_dedup_digest(df.limit(0)).count() == 0


def test_multikey_sort_against_sorted():
    rng = np.random.default_rng(5)
    raw = np.concatenate([rng.integers(97, 99, 3000), np.zeros(64, np.int64)]).astype(np.uint8)
    at, label = rng.integers(0, 2900, 800), rng.integers(0, 3, 800)
    words8 = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    order, edge = sd.multikey_sort(words8, at, label, 3)
    keys = [(label[i], raw[at[i] : at[i] + 24].tobytes()) for i in order]
    assert keys == sorted(keys) and edge.tolist() == [n == 0 or keys[n] != keys[n - 1] for n in range(len(keys))]


def test_segments_of_long_texts(monkeypatch):
    raw = np.frombuffer(words(random.Random(3), 900).encode(), np.uint8)
    whole = {p for _, _, _, lo, hi, _ in sd.spans_of(raw, np.array([0, len(raw)]), 200) for a, b in zip(lo, hi) for p in range(a, b + 1)}
    monkeypatch.setattr(sd, "SEGMENT", 777)
    spans = [(a, b, c) for _, _, _, lo, hi, at in sd.spans_of(raw, np.array([0, len(raw)]), 200) for a, b, c in zip(lo, hi, at)]
    assert {p for a, b, _ in spans for p in range(a, b + 1)} == whole == set(range(len(raw) - 199))
    assert all(0 <= c - b and c - a <= 200 - sd.GRAM for a, b, c in spans)
