import random

from pyspark.sql import functions as F

from cuewright.operators import keys as Ks
from cuewright.operators import ordered as Or


def test_running_sum_dense_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(Or, "BLOCK", 8)
    monkeypatch.setattr(Or, "FAN", 4)
    rng = random.Random(5)
    pos = sorted(rng.sample(range(2000), 300))
    df = spark.createDataFrame([("a", p, p % 5, "c") for p in pos] + [(None, 3, 1, "c")], "k string, p long, v int, block string")
    total, want = 0, {}
    for p in pos:
        total += p % 5
        want[p] = total
    got = {r.p: r.s for r in Or.running_sum(df.drop("block"), ["k"], "p", "v", "s").where("k = 'a'").collect()}
    assert got == want
    d = Or.dense(df.drop("block"), ["k"], "p")
    assert {r.p: r.pos for r in d.where("k = 'a'").collect()} == {p: i for i, p in enumerate(pos)}
    n = Or.neighbours(d, ["k"], "pos", 2, back=lambda w: F.lag("p", 2).over(w), on=lambda w: F.lead("p").over(w))
    for r in n.where("k = 'a'").collect():
        i = r.pos
        assert r.back == (pos[i - 2] if i > 1 else None) and r.on == (pos[i + 1] if i + 1 < len(pos) else None)
    assert n.count() == 301


def test_carried(spark):
    data = [("a", b, b if b % 7 == 3 else None) for b in range(40)]
    got = {r.block: r.carried for r in Ks.carried(spark.createDataFrame(data, "k string, block long, v long"), ["k"], "block", "v", fan=4).collect()}
    last, want = None, {}
    for _, b, v in data:
        want[b] = last
        last = v if v is not None else last
    assert got == want


def test_once_takes_the_first_delivery(spark, rows):
    df = spark.createDataFrame([("a", 1, "late", 9), ("a", 1, "first", 2), ("a", 1, "first", 2), (None, 1, None, 5)], "k string, n int, t string, loaded_at int")
    assert rows(Ks.once(df, ["k", "n"], ["t"])) == [("a", 1, "first"), (None, 1, None)]


def test_ms_handles_everything(spark):
    df = spark.createDataFrame([(0.0005,), (float("nan"),), (float("inf"),), (None,), (-1.2,)], "x double")
    assert [r[0] for r in df.select(Ks.ms("x")).collect()] == [1, None, None, None, -1200]
