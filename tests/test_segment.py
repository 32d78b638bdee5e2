import random

import pytest
from pyspark.sql import functions as F

from cuewright.functions import lexicon
from cuewright.operators import segment as S
from cuewright.operators import words as Wd

W = "w array<struct<pos:int,s_ms:bigint,e_ms:bigint,text:string>>"


def array(spark, text):
    w = [(i, i * 400, i * 400 + 300, t) for i, t in enumerate(text.split())]
    return spark.createDataFrame([(w,)], W)


def table(spark, text, media="m"):
    return spark.createDataFrame([(media, 0, i, i * 400, i * 400 + 300, t) for i, t in enumerate(text.split())], "media_id string, take_no int, pos int, s_ms long, e_ms long, text string")


def cuts(spark, text, fn):
    return array(spark, text).select(fn(F.col("w"))).first()[0]


def test_groups(spark):
    g = S.group_table(S.sentence_groups(table(spark, "Good day. This is fine! ok")))
    assert sorted((r.ws, r.we) for r in g.collect()) == [(0, 2), (2, 5), (5, 6)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("we built the small tool yesterday, it works quite well now", [6]),
        ("we packed the red apples, very ripe pears and plums", []),
        ("we built this, it works quite well now", []),
        ("we built the small tool yesterday, it'll work quite well now", [6]),
    ],
)
def test_comma_split(spark, text, want):
    assert cuts(spark, text, S.comma_cuts) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("we saw the old boat but nobody came near it", [5]),
        ("we saw the old boat so we went home early", [5]),
        ("we saw the old boat so good that day again", []),
        ("we saw the old boat so cats came near it", []),
        ("we saw the old boat and you went home early", [5]),
        ("we saw the old boat and cats came near it", []),
    ],
)
def test_conjunction_split(spark, text, want):
    assert cuts(spark, text, S.conjunction_cuts) == want
    if "cats" in text:
        assert cuts(spark, text, lambda w: S.conjunction_cuts(w, F.array(F.lit(5)))) == [5]
        assert cuts(spark, text, S.ambiguous_conjunctions) == [5]


def test_fold_is_the_recursion(spark):
    """Cutting at the rightmost allowed comma and then in both halves gives the same cuts."""

    def recurse(cands, a, b):
        for j in reversed([c for c in cands if a <= c < b]):
            if j - a >= 4 and b - j - 1 >= 4:
                return recurse(cands, a, j + 1) + [j + 1] + recurse(cands, j + 1, b)
        return []

    rng = random.Random(8)
    data, want = [], []
    for k in range(60):
        words = [rng.choice(["it", "we", "boat", "old"]) + ("," if rng.random() < 0.25 else "") for _ in range(40)]
        data.append((k, [(i, 0, 0, t) for i, t in enumerate(words)]))
        want.append(recurse([i for i in range(39) if words[i].endswith(",") and words[i + 1].rstrip(",") in lexicon.CLAUSE_STARTERS], 0, 40))
    df = spark.createDataFrame(data, f"k int, {W}")
    assert [r[0] for r in df.orderBy("k").select(S.comma_cuts(F.col("w"))).collect()] == want


def test_emergency_cuts():
    words = [f"w{i}" for i in range(31)]
    assert S.emergency_cuts(words) == [15]
    words[14] = "the"
    assert S.emergency_cuts(words) == [16]
    assert S.emergency_cuts(["x" * 130]) == []
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice(["and", "the", "boat", "because", "so", "we", "pier,"]) for _ in range(rng.randint(1, 90))]
        at = [0, *S.emergency_cuts(words), len(words)]
        assert at == sorted(set(at))
        assert all(b - a <= 30 and sum(len(w) + 1 for w in words[a:b]) <= 120 or b - a == 1 for a, b in zip(at, at[1:]))


def test_block_cuts():
    assert S.block_cuts([(50, 200)] * 4, 90, 360) == [1, 2, 3]
    assert S.block_cuts([(30, 100), (30, 100), (60, 150)], 90, 360) == [2]
    assert S.block_cuts([(500, 9000)], 90, 360) == []


def test_merge_chain(spark):
    cues = spark.createDataFrame([("m", 0, i, i, i + 1, t) for i, t in enumerate(["we like dogs", "and cats", "We end.", "and birds"])], "media_id string, take_no int, seg_no int, start_ms long, end_ms long, text string")
    marked = S.merge_candidates(cues)
    assert {r.seg_no: r.may_merge for r in marked.collect()} == {0: False, 1: True, 2: False, 3: False}
    out = S.merge_confirmed(marked.withColumn("confirmed", F.lit(True)))
    assert [(r.text, r.parts) for r in out.orderBy("seg_no").collect()] == [("we like dogs and cats", 2), ("We end.", 1), ("and birds", 1)]


def test_segment_words_loses_nothing(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice(["boat", "and", "we", "it", "the", "pier,", "end.", "because", "but"]) for _ in range(600))
    cues = S.segment_words(table(spark, text)).orderBy("seg_no").collect()
    assert " ".join(c.text for c in cues) == text
    assert [c.seg_no for c in cues] == list(range(len(cues)))
    assert all(len(c.text) <= 120 and len(c.text.split()) <= 30 for c in cues)


def test_clip_modes(spark):
    times = [(0, 200), (400, 600), (1000, 5000), (5000, 5200), (5400, 5600)]
    df = spark.createDataFrame([("m", 0, i, s, e, "w") for i, (s, e) in enumerate(times)], "media_id string, take_no int, pos int, s_ms long, e_ms long, text string")
    for mode in ("snapshot", "exact"):
        got = {r.pos: r.e_ms for r in Wd.clip_inflated(df, mode=mode).collect()}
        assert got == {0: 200, 1: 600, 2: 1600, 3: 5200, 4: 5600}
    two = df.where("pos < 2").withColumn("e_ms", F.col("s_ms") + 9000)
    assert {r.e_ms for r in Wd.clip_inflated(two).collect()} == {9000, 9400}


def test_exact_clip_sees_what_it_cut(spark):
    times = [(i * 1000, i * 1000 + (6000 if i % 3 else 300)) for i in range(30)]
    df = spark.createDataFrame([("m", 0, i, s, e, "w") for i, (s, e) in enumerate(times)], "media_id string, take_no int, pos int, s_ms long, e_ms long, text string")
    a = {r.pos: r.e_ms for r in Wd.clip_inflated(df, mode="exact").collect()}
    b = {r.pos: r.e_ms for r in Wd.clip_inflated(df).collect()}
    assert len(a) == len(b) == 30


def test_overlaps(spark):
    df = spark.createDataFrame([("m", 0, 0, 0, 1000, "a"), ("m", 0, 1, 800, 1200, "b"), ("m", 0, 2, 2000, 2200, "c")], "media_id string, take_no int, pos int, s_ms long, e_ms long, text string")
    assert {r.pos: r.e_ms for r in Wd.without_overlaps(df).collect()} == {0: 800, 1: 1200, 2: 2200}


def test_aligned_words(spark):
    seg = lambda p, words: (None, 0.0, 1.0, p, words)
    data = [("m", "en", [seg(0.61, [("gone", None, 0.0, 0.1)]), seg(0.60, [(" hi ", None, 0.0, 0.1), ("", "yo", 0.2, None)]), seg(None, [("x", None, None, 0.1), (" ", None, 0.3, 0.4)])])]
    got = [(r.idx, r.seg_idx, r.text, r.end) for r in Wd.aligned_words(spark.createDataFrame(data, Wd.ALIGNED)).orderBy("idx").collect()]
    assert got == [(0, 1, "hi", 0.1), (1, 1, "yo", None)]


def test_rule_cuts_are_those_of_the_steps(spark):
    """One pass over a group against the three column rules one after the other, on random groups."""
    import random

    from pyspark.sql import functions as F

    from cuewright.operators import segment as S

    rng = random.Random(4)
    pool = "we it and but so or the boat, pier, and, they because which lamp to very quickly of course such as if when left, saw it'll".split()
    rows = [(i, [(k, k * 300, k * 300 + 250 if k % 7 else None, rng.choice(pool)) for k in range(rng.randint(2, 90))]) for i in range(120)]
    df = spark.createDataFrame(rows, "g int, w array<struct<pos int, s_ms long, e_ms long, text string>>")
    pairs = [("of", "course"), ("such", "as"), ("and", "it")]
    none = F.array().cast("array<int>")
    a = S._exploded(df.withColumn("_c", S.comma_cuts(F.col("w"))), ["g"], [], F.col("_c"), "p1")
    a = a.withColumn("_c", F.when(S.array_over(F.col("w")), S.conjunction_cuts(F.col("w"), None, S.protected_positions(F.col("w"), pairs))).otherwise(none))
    b = S._exploded(a, ["g"], ["p1"], F.col("_c"), "p2").withColumn("_t", F.when(S.array_over(F.col("w"), False), F.transform("w", lambda x: x.text)).otherwise(F.array().cast("array<string>")))
    c = S._exploded(S.cut_arrays(b, "_t", "_c", S.emergency_cuts), ["g"], ["p1", "p2"], F.col("_c"), "p3")
    want = {}
    for r in c.select("g", F.get("w", F.lit(0)).pos.alias("at")).collect():
        want.setdefault(r.g, set()).add(r.at)
    for g, w in rows:
        got = S.rule_cuts([x[3] for x in w], [x[1] for x in w], [x[2] for x in w], set(pairs))
        assert got == sorted(want[g] - {0})


def test_a_take_without_marks_is_cut_in_time_that_grows_with_its_words(spark):
    from pyspark.sql import functions as F

    from cuewright.operators import segment as S

    n, pool = 200_000, "the old boat left and we saw so many lamps, but it was late when they came".split()
    text = F.element_at(F.split(F.lit(" ".join(pool)), " "), (F.pmod(F.xxhash64("id"), F.lit(len(pool))) + 1).cast("int"))
    words = spark.range(n).select(F.lit("m").alias("media_id"), F.lit(0).alias("take_no"), F.col("id").cast("int").alias("pos"), (F.col("id") * 300).alias("s_ms"), (F.col("id") * 300 + 200).alias("e_ms"), text.alias("text"))
    got = S.segment_words(words).agg(F.sum(F.col("we") - F.col("ws")).alias("n"), F.max(F.length("text")).alias("chars"), F.max("we").alias("last")).first()
    assert (got.n, got.last) == (n, n) and got.chars < 120


def test_exact_clip_in_blocks_is_the_one_from_left_to_right(spark, rows, monkeypatch):
    """Small blocks, outliers side by side so that a block's cuts change the next one's, against one pass over the source."""
    import random

    from cuewright.operators import words as Wd

    monkeypatch.setattr(Wd, "BLOCK", 16)
    rng = random.Random(9)
    data, want = [], []
    for take, n in enumerate((200, 2, 47)):
        t, s, e = 0, [], []
        for _ in range(n):
            d = rng.choice([180, 220, 150, 4000, 9000, 15000, 0])
            s.append(t)
            e.append(None if rng.random() < 0.1 else t + d)
            t += rng.choice([200, 300, 6000, 20000])
        data += [("m", take, i, a, b) for i, (a, b) in enumerate(zip(s, e))]
        given = sorted(b - a for a, b in zip(s, e) if b is not None and b > a)
        cut = Wd._clip_block(s, list(e), 0, n, given[len(given) // 2] if given else 180) if n >= 3 else e
        want += [("m", take, i, a, b) for i, (a, b) in enumerate(zip(s, cut))]
    df = spark.createDataFrame(data, "media_id string, take_no int, pos int, s_ms long, e_ms long")
    assert rows(Wd.clip_inflated(df, mode="exact")) == sorted(want, key=repr)
