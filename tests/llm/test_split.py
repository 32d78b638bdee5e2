import random

import pytest

from cuewright.llm import split as Sp

KEYS = ["media_id", "seg_no"]
SCHEMA = "media_id string, seg_no int, text string, start double, end double, piece int, _text string"


def cut(spark, rows, words=None, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(Sp.split_oversized(df, KEYS, words, **kw).collect(), key=lambda r: (r.seg_no, r.piece))


@pytest.mark.parametrize("overlap", [0, 3])
def test_pieces_fit_and_lose_nothing(spark, overlap):
    rng = random.Random(overlap)
    rows = []
    for i in range(40):
        words = [rng.choice(["boat", "the", "storm,", "end.", "“Wait!”", "a"]) for _ in range(rng.randint(31, 200))]
        rows.append(("m", i, " ".join(words), 0.0, len(words) * 0.4))
    by = {}
    for p in cut(spark, rows, overlap=overlap):
        assert p.within and len(p.text) <= 120 and len(p.text.split()) <= 30 and round((p.end - p.start) * 1000) <= 9000
        by.setdefault(p.seg_no, []).append(p)
    for _, i, text, _, _ in rows:
        joined = []
        for p in by[i]:
            w = p.text.split()
            assert w[: p.overlap_words] == (joined[-p.overlap_words :] if p.overlap_words else [])
            assert p.overlap_words == (overlap if p.piece else 0)
            joined += w[p.overlap_words :]
        assert joined == text.split()


def test_unspaced_text(spark):
    text = "老陶工在第二集里掉落了破帆。" * 20
    got = cut(spark, [("m", 1, text, None, None)])
    assert "".join(p.text for p in got) == text and all(p.text.endswith("。") for p in got)
    got = cut(spark, [("m", 1, "船" * 500, None, None)], overlap=2)
    assert "".join(p.text[p.overlap_words :] for p in got) == "船" * 500 and all(len(p.text) <= 120 for p in got)


def test_cuts_fall_at_sentences(spark):
    text = "The boat left the pier before noon today. " * 6
    got = cut(spark, [("m", 1, text.strip(), None, None)])
    assert all(p.text.endswith("today.") for p in got)


def test_word_times(spark):
    text = " ".join(f"w{i}" for i in range(40))
    words = spark.createDataFrame([("m", 1, i, f" w{i}", i * 0.5, i * 0.5 + 0.4, 9) for i in range(40)] * 2, "media_id string, seg_no int, idx int, text string, start double, end double, seg_idx int")
    got = cut(spark, [("m", 1, text, 0.0, 19.9)], words)
    assert all(p.within for p in got) and got[0].start == 0.0 and got[-1].end == 19.9
    for p in got:
        first = int(p.text.split()[0][1:])
        assert p.start == first * 0.5


def test_edges(spark):
    rows = [("m", 1, None, 0.0, 20.0), ("m", 2, "", 0.0, 20.0), ("m", 3, "short", 0.0, 20.0), ("m", 4, "x" * 130, None, None), ("m", 5, "fits", 0.0, 9.0), (None, 6, "y " * 31, float("nan"), None), ("m", 7, None, None, None)]
    got = cut(spark, rows)
    assert {p.seg_no for p in got} == {1, 2, 3, 4, 6}
    assert [p.text for p in got if p.seg_no == 4] == ["x" * 120, "x" * 10]
    assert all(p.within for p in got if p.seg_no == 6)
    assert "".join(p.text for p in got if p.seg_no == 3) == "short"
    assert cut(spark, []) == []
    with pytest.raises(ValueError):
        Sp.split_oversized(spark.createDataFrame([], SCHEMA), KEYS, overlap=30)


def test_very_long_text(spark):
    got = cut(spark, [("m", 1, "the boat left, " * 20_000, None, None)])
    assert all(p.within for p in got) and sum(len(p.text.split()) for p in got) == 60_000


def test_blanks_of_any_length_do_not_count():
    text = "a" * 118 + " " * 500 + "b" + " " * 300
    piecer = Sp._Piecer(text, None, None, None, (120, 30, 9000), 0)
    assert piecer.trimmed(0, 400) == (0, 118) and piecer.within(0, 400) and not piecer.within(0, len(text))
    assert piecer.trimmed(200, 300) == (200, 200) and piecer.within(200, 300)


def pieces(text, chars=60, **kw):
    return [p["text"] for p in Sp._Piecer(text, None, None, None, (chars, kw.pop("words", 30), 9000), kw.pop("overlap", 0)).pieces()]


def test_headings_and_lists_are_nodes():
    text = "# One\n\n- the boat left the pier\n- the storm came at noon\n- nobody saw it\n\n## Heading two\n\nThe guide slept. The mill stood still.\n\n# Three\nshort"
    got = pieces(text)
    assert all(len(p) <= 60 for p in got) and not any(p.rstrip().endswith("Heading two") and "boat" in p for p in got)
    assert not any("nobody" in p and "Heading two" in p for p in got) and any(p.startswith("## Heading two\n\nThe guide slept.") for p in got)
    assert "".join("".join(p.split()) for p in got) == "".join(text.split())
    assert pieces("# A\nx\n\n# B\ny") == ["# A\nx\n\n# B\ny"]  # siblings merge while they fit
    nested = "- fruit\n  - apples from the hill\n  - pears from the yard\n- tools\n  - a long iron key\n  - an old copper lamp"
    assert pieces(nested, 58) == ["- fruit\n  - apples from the hill\n  - pears from the yard", "- tools\n  - a long iron key\n  - an old copper lamp"]


def test_abbreviations_are_no_cuts():
    text = "We walked slowly along the wet stone pier and met Dr. Smith there at 6 p.m. before dinner. Then it rained."
    assert not any(p.endswith("Dr.") for p in pieces(text, 54))
    assert pieces("He met Dr. Smith. It rained all day.", 20)[0] == "He met Dr. Smith."
