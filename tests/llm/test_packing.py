import itertools
import random

import pytest

from cuewright.llm import packing as P

TOKENIZER = pytest.mark.skipif(not __import__("os").path.exists(P.TOKENIZER), reason="no vocabulary")


def test_fullest_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        left = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 30)
        got = P._fullest(left, room)
        assert all(0 < k <= left[n] for n, k in got.items())
        items = [n for n, k in left.items() for _ in range(k)]
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= room)
        assert sum(n * k for n, k in got.items()) == best


def test_fillings_use_every_item_once():
    rng = random.Random(2)
    counts = {n: rng.randint(0, 2000) for n in range(1, 257)}
    used = {}
    for times, f in P.fillings(counts, 256):
        assert times > 0 and sum(n * k for n, k in f.items()) <= 256
        for n, k in f.items():
            used[n] = used.get(n, 0) + k * times
    assert used == {n: c for n, c in counts.items() if c}
    bins = sum(t for t, _ in P.fillings(counts, 256))
    assert bins <= 1.02 * sum(n * c for n, c in counts.items()) / 256
    assert P.fillings({}, 8) == []
    with pytest.raises(ValueError):
        P.fillings({9: 1}, 8)


@TOKENIZER
def test_pack(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["boat", "pier", "storm", "网"]) for _ in range(rng.randint(0, 60))), 1) for i in range(200)]
    docs += [(900, "word " * 500, 1), (901, None, 1), (902, "", 1), (None, "null key", 1), (903, "x" * 50_000, 1)] + docs[:5] + [(1000 + i, "same length here", 1) for i in range(300)]
    got = P.pack(spark.createDataFrame(docs, "doc_id long, text string, bin int"), "doc_id", capacity=64).collect()
    bins, spans = {}, {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.tok_from, r.tok_to))
        if r.tokens:
            bins[r.bin] = bins.get(r.bin, 0) + r.tokens
        else:
            assert r.bin is None
    assert max(bins.values()) <= 64 and sorted(bins) == list(range(len(bins)))
    assert len(bins) <= -(-sum(bins.values()) // 64) + 1
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:])) and all(b - a == 64 for a, b in s[:-1])
    assert len(spans) == 505 and len(spans[900]) > 1


@TOKENIZER
def test_pack_nothing(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0
