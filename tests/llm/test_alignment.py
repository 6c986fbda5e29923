"""Token alignment against whole texts encoded at once, groups from sets of ends, links counted pair by pair."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from qlog.llm import alignment as al
from tests.llm.test_llm import ODD, frame, words

TEXTS = ODD + [
    " ", "  ", " 　 a", "a▁b ▁", "a\x00b", "a  b   c    d\n\n e \t f  g", "don't <s> x </s> <unk> <|endoftext|> y", "日本語 かな 한국어 é́ ﬁ 👩‍👩‍👧 🏳️‍🌈 x",
    "12 345 6,789.00 $x_y;\r\n();\r\n", "x " * 3000, "ab" * 4000, " " * 700 + "z", "\n" * 50 + "end ", "ÿÀ ÷× ªº ²³ x", "  a  b \x85c \x1c d",
]


def brute(texts):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    from qlog.llm.tokens import _byte_letters

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = {c: b for b, c in _byte_letters().items()}
    rows, every = [], []
    for text in texts:
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = []
        for i in sp.encode(text) if text else []:
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        whole = (" " + text).encode() if text else b""
        if not text or any(b"".join(x for _, x in s) != whole for s in (a, b)):
            a = b = []
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in cuts:
            k, m = ends[0].index(c, i) + 1, ends[1].index(c, j) + 1
            groups.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
            i, j = k, m
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        every += links.keys()
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    counts, best = Counter(every), {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    return [(n, a, b, g, sum(ls.values()), sum(k for p, k in ls.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in ls.items()), d) for n, (a, b, g, ls, d) in enumerate(rows)]


@pytest.mark.parametrize("most_pairs", [al.PAIRS, 0])
def test_against_whole_texts(spark, most_pairs):
    rng = random.Random(2)
    texts = TEXTS + [words(rng, rng.randrange(1, 60)) for _ in range(40)]
    out = al.cross_tokenizer_alignment(frame(spark, texts).repartition(3), most_pairs=most_pairs)
    assert sorted(tuple(r) for r in out.collect()) == brute(texts)


def test_repeated_rows_and_rows_without_id(spark):
    df = spark.createDataFrame([(1, "one two", 5), (1, "one two", 5), (None, "one two", 5), (2, None, 5)], "doc_id long, text string, pairs int")
    out = sorted(tuple(r)[1:] for r in al.cross_tokenizer_alignment(df).collect())
    one = brute(["one two"] * 3)[0][1:]
    assert out == sorted([one] * 3 + [(0, 0, 0, 0, 0, 0, "")])
    assert al.cross_tokenizer_alignment(df.limit(0)).count() == 0


def test_align_against_sets_of_ends():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.randrange(1, 300)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n + 1)), n}) for _ in range(2))
        if rng.random() < 0.5:  # long one-to-one stretches
            b = sorted({*a} - {rng.choice(a[:-1] or [0])} | {n})
        cuts = sorted({*a} & {*b})
        assert al.align(a, b) == ([a.index(c) + 1 for c in cuts], [b.index(c) + 1 for c in cuts])


def test_links_of_large_groups(monkeypatch):
    rng = np.random.default_rng(1)
    ids_a, ids_b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    ends_a, ends_b = np.array([1, 200, 201, 300]), np.array([150, 151, 152, 300])
    want = al.linked(ids_a, ids_b, ends_a, ends_b)
    monkeypatch.setattr(al, "LINKS", 100)
    for x, y in zip(want, al.linked(ids_a, ids_b, ends_a, ends_b)):
        assert x.tolist() == y.tolist()
    assert want[1].sum() == 150 + 199 + 1 + 99 * 148


def test_other_vocabularies_are_an_error():
    with pytest.raises(ValueError, match="edges of chunks"):
        al.byte_level("word_bpe_49k.json")
