import random

from cuewright.operators.segment import segment_words
from cuewright.plans.exchange import NoBackend
from cuewright.plans.segmentation import segment_with_model


def table(spark, texts):
    data = [("m", k, i, i * 400, i * 400 + 300, t) for k, text in enumerate(texts) for i, t in enumerate(text.split())]
    return spark.createDataFrame(data, "media_id string, take_no int, pos int, s_ms long, e_ms long, text string")


def cues(df):
    return sorted((r.take_no, r.seg_no, r.ws, r.we, r.text) for r in df.collect())


def test_without_answers_it_is_the_rules(spark):
    rng = random.Random(3)
    words = ["boat", "and", "we", "it", "the", "pier,", "end.", "because", "but", "so"]
    df = table(spark, [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 60, 400)])
    assert cues(segment_with_model(df, NoBackend, attempts=1, delays=())) == cues(segment_words(df))


def test_marks_verdicts_and_merges_are_used(spark):
    left = "the old potter found the silver whistle near the stone bridge in the cold morning light"
    right = "guide kept the film reel behind the mill while rain fell on the upper deck again"
    text = f"{left} {right} and cats slept"

    def backend():
        class Model:
            def chat(self, system, user, max_tokens, temperature):
                if "sentence marks" in system:
                    return user.split("Text: ")[-1].replace("light guide", "light. guide")
                return "CONTINUATION" if "CONTINUATION" in system else "YES"

        return Model()

    got = cues(segment_with_model(table(spark, [text, "Short one."]), backend, attempts=1))
    assert " ".join(t for k, *_, t in got if k == 0) == text
    assert [t for k, *_, t in got if k == 0][0] == left
    assert [t for k, *_, t in got if k == 1] == ["Short one."]


def test_a_run_of_long_groups_is_cut_as_a_whole(spark):
    """Against block_cuts over the whole run, far beyond any fixed number of groups."""
    from cuewright.operators import segment as S
    from cuewright.plans.segmentation import long_blocks

    sizes = [31 + (k * 7) % 25 for k in range(700)]
    rows, pos = [], 0
    for g, n in enumerate(sizes):
        rows.append(("m", g, [(pos + k, (pos + k) * 100, (pos + k) * 100 + 90, "word") for k in range(n)]))
        pos += n
    rows += [("m", 700, [(pos, 0, 1, "short.")]), ("m", 701, [(pos + 1 + k, k, k + 1, "word") for k in range(40)]), ("n", 5, [(k, k, k + 1, "word") for k in range(40)])]
    df = spark.createDataFrame(rows, "media_id string, group_id int, w array<struct<pos int, s_ms long, e_ms long, text string>>")
    got = {(r.media_id, r.first): (r.groups, len(r.w)) for r in long_blocks(df, ["media_id"]).collect()}
    cuts = [0, *S.block_cuts([(n, 5 * n) for n in sizes], 3 * S.MAX_WORDS, 3 * S.MAX_CHARS), len(sizes)]
    want = {("m", a): (b - a, sum(sizes[a:b])) for a, b in zip(cuts, cuts[1:])} | {("m", 701): (1, 40), ("n", 5): (1, 40)}
    assert got == want
