"""The path with a model that confirms conjunctions, on groups of any length."""

import random

from pyspark.sql import functions as F

from cuewright.functions import lexicon
from cuewright.operators import segment as S
from cuewright.plans.segmentation import segment_with_model
from cuewright.plans.word_queries import _Yes

W = "w array<struct<pos:int,s_ms:bigint,e_ms:bigint,text:string>>"


def test_cuts_of_lists_are_those_of_columns(spark):
    rng = random.Random(5)
    words = ["and", "or", "so", "but", "we", "to", "it'll,", "boat", "pier,", "kind", "of", "very", "quickly", "good", "look.", "up", "And,", "so\x1f", "boat,\x1f", "as", "well", "useful"]
    data, made = [], []
    for k in range(300):
        texts = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        ok = [i for i in range(len(texts)) if rng.random() < 0.6]
        data.append((k, [(i, 0, 0, t) for i, t in enumerate(texts)], ok))
        made.append((S.clause_commas(texts), S.open_conjunctions(texts), S.clause_conjunctions(texts, set(lexicon.default_pairs()), set(ok))))
    w = F.col("w")
    df = spark.createDataFrame(data, f"k int, {W}, ok array<int>").orderBy("k")
    got = df.select(S.comma_cuts(w), S.ambiguous_conjunctions(w), S.conjunction_cuts(w, F.col("ok"), S.protected_positions(w, lexicon.default_pairs()))).collect()
    assert [tuple(r) for r in got] == made
    assert all(any(m[i] for m in made) for i in range(3))


def test_rows_over_the_limits_are_those_of_columns(spark):
    rng = random.Random(9)
    data = []
    for k in range(200):
        n = rng.randint(1, 40)
        data.append((k, [(i, i * 300, None if rng.random() < 0.2 else i * 300 + 250, "é" * rng.randint(1, 6)) for i in range(n)], True))
    df = spark.createDataFrame(data, f"k int, {W}, yes boolean")
    long = {r.k for r in df.where(S.array_over(F.col("w"))).collect()}
    got = S.cut_rows(df.repartition(3), ["k"], "p", lambda t, s, e: [1], "yes", long_only=True, find=lambda t: [len(t)]).collect()
    assert 0 < len(long) < 200 and {r.k for r in got if r.p == 1} == long
    assert {(r.k, r.p, len(r.w)) for r in got} == {x for k, w, _ in data for x in ([(k, 0, 1), (k, 1, len(w) - 1)] if k in long else [(k, 0, len(w))])}
    assert all(r.at in ([], [len(r.w)]) for r in got) and any(r.at for r in got)


def test_a_group_of_many_confirmed_conjunctions():
    n = 200_000
    texts = [("so" if i % 10 == 5 else "and" if i % 10 == 0 else f"w{i % 7}") for i in range(n)]
    assert S.clause_conjunctions(texts, set(lexicon.default_pairs()), set(S.open_conjunctions(texts))) == sorted([*range(5, n, 10), n - 10])


def test_estimates_of_size_do_not_grow_with_every_cut(spark):
    text = "the old potter found the silver whistle near the stone bridge so cats came near it in the cold morning light and birds sang all day long over there while rain fell"
    words = spark.createDataFrame([("m", 0, i, i * 400, i * 400 + 300, t) for i, t in enumerate(text.split())], "media_id string, take_no int, pos int, s_ms long, e_ms long, text string")
    cues = segment_with_model(words, _Yes, attempts=1, delays=())
    assert " ".join(r.text for r in sorted(cues.collect(), key=lambda r: r.ws)) == text
    assert cues._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 10_000
