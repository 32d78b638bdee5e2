import random
from statistics import median

from pyspark.sql import functions as F

from cuewright.operators import outliers as O

SCHEMA = "media_id string, take_no int, idx int, start double, end double, text string, med double, block int"


def words(spark, durs, take=0, at=0):
    out = []
    for i, d in enumerate(durs):
        s = 1.0 + i * 10
        out.append(("m", take, at + i, s, None if d is None else round(s + d / 1000, 3), "w", 1.0, 2))
    return spark.createDataFrame(out, SCHEMA)


def brute(durs, neg=()):
    good = [d for d in durs if d is not None and d >= 10]
    med = median(good) if good else None
    out = {}
    for i, d in enumerate(durs):
        if d is None:
            continue
        a = b = i
        while a and durs[a - 1] == d:
            a -= 1
        while b + 1 < len(durs) and durs[b + 1] == d:
            b += 1
        if d < 10:
            out[i] = "impossible"
        elif med and d > 5 * med:
            out[i] = "spike"
        elif b - a >= 5:
            out[i] = "stuck"
    return out


def test_flags_match_brute_force_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 16)
    rng = random.Random(3)
    durs = []
    while len(durs) < 400:
        d = rng.choice([None, 5, 100, 120, 130, 2000, rng.randint(50, 300)])
        durs += [d] * rng.choice([1, 1, 1, 5, 6, 9, 40])
    w = words(spark, durs)
    got = {r.idx: r.defect for r in O.implausible_words(w.unionByName(w)).collect()}
    assert got == brute(durs)


def test_negative_times_nulls_and_empty(spark):
    df = spark.createDataFrame([("m", 0, 0, -0.5, 0.2, "x", 1.0, 1), ("m", 0, 1, 1.0, 1.2, None, 1.0, 1), ("m", 0, None, 1.0, 1.001, "x", 1.0, 1), (None, None, 0, 0.0, 0.001, "x", 1.0, 1), ("m", 0, 3, float("nan"), 1.0, "x", 1.0, 1)], SCHEMA)
    got = sorted(((r.media_id, r.idx, r.defect) for r in O.implausible_words(df).collect()), key=repr)
    assert got == [("m", 0, "impossible"), (None, 0, "impossible")] or got == [(None, 0, "impossible"), ("m", 0, "impossible")]
    assert O.implausible_words(spark.createDataFrame([], SCHEMA)).count() == 0


def test_medians(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4]] + [("b", 7)] + [("c", None)], "k string, v long")
    got = {r.k: (r.med, r.mad) for r in O.source_medians(df, ["k"], "v").collect()}
    assert got == {"a": (2.5, 1.0), "b": (7.0, 0.0)}


def test_rolling_window_finds_a_local_spike(spark):
    durs = [100 + i % 7 for i in range(60)] + [900] + [1000 + i % 7 for i in range(60)]
    durs[30] = 700
    got = {r.idx: r.defect for r in O.implausible_words(words(spark, durs), half_window=10).collect()}
    assert got.get(30) == "spike" and 100 not in got


def test_hot_source_has_no_unbounded_window(spark):
    plan = O.implausible_words(words(spark, [100] * 50))._jdf.queryExecution().toString()
    for line in plan.splitlines():
        if "windowspecdefinition(media_id" in line and "_run" in line:
            assert "block" in line
    assert F is not None
