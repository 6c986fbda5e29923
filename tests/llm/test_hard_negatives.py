"""Hard negatives against brute force: ties, repeats, negative scores, large components, hot labels."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from qlog.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int"


def brute(rows, every, positives=5, k=10, scale=256):
    """rows: (vec_id, vector, label), all of them usable."""
    whole = [[math.floor(Fraction(c) * scale) for c in v] for _, v, _ in rows]
    out = []
    for n, (anchor, v, label) in enumerate(rows):
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(whole[n], whole[m])), i, lab) for m, (i, w, lab) in enumerate(rows) if m != n and len(w) == len(v)]
        for minus, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted(x for x in scored if x[2] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus)[:k]
            out += [(anchor, positive, r, i, -minus, -s) for r, (s, i, _) in enumerate(window, 1)]
    return sorted(out)


def run(spark, rows, every, **more):
    df = spark.createDataFrame([(i, v, lab, "x", 0) for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, every=every, **more).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_BLOCKS", 3)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(60)]  # ties
    rows += [(20, [0.25] * 6, 1), (20, [0.25] * 6, 1), (7, [1.0, 2.0], 0), (40, [1.0, 2.5], 0), (60, [2.0, 2.0], 1)]  # repeats, another length
    want = brute(rows, 20)
    assert len(want) > 500 and run(spark, rows, 20) == want
    assert run(spark, rows, 20, positives=2, k=3) == brute(rows, 20, 2, 3)


def test_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1.0, 1e9, 1e7]) * rng.random() for _ in range(3)], i % 2) for i in range(30)]
    rows = [(i, [c / 256 for c in v], lab) for i, v, lab in rows]
    assert run(spark, rows, 10) == brute(rows, 10)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(0, [1e12, 1.0], 0), (1, [1e12, 1.0], 0)], 10)


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 1.0], 1), (3, [-1.0, 0.0], 0), (4, [0.0, 0.0], 1)]
    odd = [(None, [1.0, 0.0], 0), (100, None, 0), (200, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [0.8, 0.0], None), (8, [], 1)]
    assert run(spark, good + odd, 100) == brute(good, 100) == [(0, 1, 1, 2, 65536, 32768)]
    assert run(spark, [], 100) == [] and run(spark, good[1:], 100) == []


def test_slots_and_best():
    score, uppers = np.array([9, 8, 7, 5, 4, -1]), np.array([9, 7, 4])
    assert hn.slots_of(score, uppers).tolist() == [0, 0, 1, 1, 2, 2]
    ids = np.arange(100)[::-1]
    assert ids[hn.best_of(np.ones(100), ids, 3)].tolist() == [0, 1, 2]


def test_relabelled(spark):
    df = spark.createDataFrame([(7, [1.0], 9, "x", 0), (8, [1.0], 9, "x", 0), (14, [1.0], None, "x", 0), (0, [1.0], 3, "x", 0)], SCHEMA)
    assert [r["label"] for r in hn.relabelled(df).collect()] == [0, 9, None, 4]
