import numpy as np
import pytest

from cuewright.operators import intervals as I

SCHEMA = "media_id string, take_no int, s long, e long, kind string, chunk long, extra int"


def brute(items, gap):
    out, cur = [], None
    for s, e in sorted(items):
        if cur is None:
            cur = [s, e]
        elif s - cur[1] <= gap:
            cur[1] = max(cur[1], e)
        else:
            out.append(tuple(cur))
            cur = [s, e]
    return out + ([tuple(cur)] if cur else [])


def test_dyadic_union_of_random_intervals():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.integers(0, 4000, 40)
        e = np.minimum(s + rng.integers(1, 200, 40), 4096)
        a, b = I.dyadic_union(s, e, 12)
        assert list(zip(a.tolist(), b.tolist())) == brute(list(zip(s.tolist(), e.tolist())), 0)


def test_periods_across_chunks_match_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    data, want = [], []
    for take in range(4):
        s = rng.integers(0, 3_000_000, 300)
        items = [(int(a), int(a + rng.integers(1, 4000))) for a in s]
        items += [(100, 1_500_000)] if take == 3 else [(2**28 * 3 - 50, 2**28 * 3 + 5), (2**38, 2**38 + 7)]
        data += [("m", take, a, b, "x", 9, 1) for a, b in items] * 2
        runs = brute(items, 1000)
        want += [("m", take, "period", *r) for r in runs] + [("m", take, "gap", x[1], y[0]) for x, y in zip(runs, runs[1:])]
    got = I.periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["media_id", "take_no"], "s", "e", 1000)
    assert rows(got) == sorted(want, key=repr)


def test_silence_of_just_the_limit_joins(spark, rows):
    df = spark.createDataFrame([("a", 0, 0, 10, None, None, None), ("a", 0, 1010, 1020, None, None, None), ("a", 0, 2021, 2030, None, None, None)], SCHEMA)
    got = I.periods_and_gaps(df, ["media_id", "take_no"], "s", "e", 1000)
    assert rows(got) == [("a", 0, "gap", 1020, 2021), ("a", 0, "period", 0, 1020), ("a", 0, "period", 2021, 2030)]


def test_nulls_bad_rows_and_empty(spark, rows):
    bad = [(None, None, 5, 9, "k", 1, 1), ("a", 0, None, 9, "k", 1, 1), ("a", 0, 5, None, "k", 1, 1), ("a", 0, -1, 9, "k", 1, 1), ("a", 0, 9, 9, "k", 1, 1), ("a", 0, 5, 2**60, "k", 1, 1)]
    got = I.periods_and_gaps(spark.createDataFrame(bad, SCHEMA), ["media_id", "take_no"], "s", "e", 0)
    assert rows(got) == [(None, None, "period", 5, 9)]
    assert I.periods_and_gaps(spark.createDataFrame([], SCHEMA), ["media_id", "take_no"], "s", "e", 0).count() == 0


def test_speech_periods_ignore_nan_and_text(spark, rows):
    nan = float("nan")
    w = spark.createDataFrame([("a", 0, 0.0, 0.5, None), ("a", 0, nan, 1.0, "x"), ("a", 0, 0.1, nan, "x"), ("a", 0, 3.0, 3.2, " "), ("a", 0, None, 9.0, "x")], "media_id string, take_no int, start double, end double, text string")
    assert rows(I.speech_periods(w)) == [("a", 0, "gap", 500, 3000), ("a", 0, "period", 0, 500), ("a", 0, "period", 3000, 3200)]


@pytest.mark.parametrize("order", [1, -1])
def test_order_does_not_matter(spark, rows, order):
    data = [("a", 0, i * 700, i * 700 + 300, "k", 1, 1) for i in range(50)][::order]
    got = I.periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["media_id", "take_no"], "s", "e", 399)
    assert len(rows(got)) == 99


def test_long_intervals_cost_no_more(spark, rows):
    """Intervals over many chunks and levels, nested, overlapping and up to the last exact time, against brute force."""
    rng = np.random.default_rng(7)
    data, want = [], []
    for take in range(6):
        items = []
        for _ in range(60):
            a = int(rng.integers(0, 2 ** int(rng.integers(10, 45))))
            items.append((a, a + int(2 ** rng.uniform(0, 40 if take % 2 else 25))))
        items += [(2**52 + 3, 2**53 - 1), (2**53 - 5, 2**53)] if take == 5 else [(2**47, 2**52)] if take == 4 else []
        gap = 0
        data += [("m", take, a, b, "x", 9, 1) for a, b in items]
        runs = brute(items, gap)
        want += [("m", take, "period", *r) for r in runs] + [("m", take, "gap", x[1], y[0]) for x, y in zip(runs, runs[1:])]
    got = I.periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["media_id", "take_no"], "s", "e", 0)
    assert rows(got) == sorted(want, key=repr)
