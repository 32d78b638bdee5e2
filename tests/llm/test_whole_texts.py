"""Cases the operators left out."""

import os

import pytest

from cuewright.llm import leaks as Le
from cuewright.llm import packing as P
from cuewright.llm import pairs as Pa
from cuewright.llm import truncation as Tr


def test_sign_off_of_a_subtitle_text_is_whole():
    tables = Tr.EndTables()
    for i in range(10):
        tables.add_text(f"The guide slept on deck {i}. The boat left.\n\nSubtitles: Ana")
    tables.finish()
    srt = "1\n00:00:01,000 --> 00:00:02,000\nThe boat left.\n\n2\n00:00:03,000 --> 00:00:04,000\n"
    assert Tr.judge(srt + "Subtitles: Ben", tables) >= Tr.CUT
    assert Tr.judge(srt + "The guide slept on", tables) < Tr.CUT


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no vocabulary")
def test_long_texts_count_as_the_tokenizer_does(spark):
    texts = ["shipwreck harbourmaster's  end.\n\n" * 3000, "船が港を出た。それから嵐が来た、" * 3000, "a b" + " " * 30_000 + "c", "x1" * 30_000 + "  tail"]
    enc = P._encoding(P.TOKENIZER)
    got = P.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.tokens for r in got} == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no vocabulary")
def test_every_text_of_a_key_is_packed(spark):
    docs = [(1, "a"), (1, "the boat left"), (1, "a"), (None, "one"), (None, "two three"), (None, None), (2, "y" * 300_000)]
    got = P.pack(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", capacity=64).collect()
    assert len({(r.doc_id, r.digest) for r in got}) == 6 and len([r for r in got if r.doc_id is None]) == 3
    enc = P._encoding(P.TOKENIZER)
    assert sum(r.tokens for r in got) == sum(len(enc.encode_ordinary(t)) for t in ("a", "the boat left", "one", "two three", "y" * 300_000))


def test_unspaced_leak_with_latin_words_and_blanks(spark):
    item = "船长在 3 号码头看见了 Ana 的旧船然后 GPS 坏了他们走回村子里去了"
    docs = [(0, item), (1, item.replace(" ", "")), (2, f"前文{item.replace(' ', '')}后文abc"), (3, "，".join(item.replace(" ", ""))), (4, "船长在 3 号码头看见了别人的旧船")]
    got = Le.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3] and all(r.first_at < r.first_to for r in got)


def test_reply_in_an_unlisted_script_is_in_another_language(spark):
    de = "der alte Töpfer fand eine silberne Pfeife neben der Steinbrücke"
    en = "the old potter found a silver whistle near the stone bridge"
    ko, el = "늙은 도공이 돌다리 옆에서 은으로 만든 작은 호루라기를 발견했다", "ο γέρος αγγειοπλάστης βρήκε μια ασημένια σφυρίχτρα στη γέφυρα"
    rows = [(i, en, de, "de") for i in range(30)] + [(100 + i, en, ko, "ko") for i in range(30)] + [(200, en, ko, "de"), (201, en, el, "de"), (202, en, ko + " GPS", "de")]
    got = {r.seg_no: r.defect for r in Pa.judged_pairs(spark.createDataFrame(rows, "seg_no int, source string, reply string, target string"), ["seg_no"]).collect()}
    assert [got[k] for k in (200, 201, 202)] == ["wrong_lang"] * 3
    assert not any(got[k] for k in (*range(30), *range(100, 130)))


def test_no_mark_decides_by_itself():
    """Fitted where whole texts end without marks, the same end is whole; where they end in marks, it is cut."""
    with_marks, without = Tr.EndTables(), Tr.EndTables()
    for i in range(60):
        with_marks.add_text(f"The guide slept on deck {i}. The boat left the pier.")
        without.add_text(f"The guide slept on deck {i}. The boat left the pier")
    for t in (with_marks, without):
        t.finish()
    text = "The guide slept again. The boat left the mill"
    assert Tr.judge(text, with_marks) < Tr.CUT <= Tr.judge(text, without)
    assert Tr.judge(text + ".", with_marks) > Tr.CUT


def test_thresholds_follow_language_and_source(spark):
    good, bad = "The boat left the pier. The guide slept.", "The boat left the pier. The gui"
    rows = [(i, good, "en", "calm") for i in range(200)] + [(1000 + i, bad if i % 2 else good, "en", "torn") for i in range(200)] + [(2000, None, None, None), (2001, good, None, None)]
    t = Tr.truncated(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"])
    got = {r.doc_id: r for r in t.collect()}
    assert len(got) == len(rows) and got[1].threshold < got[1000].threshold
    assert not any(got[i].cut for i in range(200)) and all(got[1000 + i].cut == bool(i % 2) for i in range(200))
    assert not got[2000].cut and got[2000].log_odds is None and not got[2001].cut


def test_the_end_is_read_as_far_as_it_takes():
    """Marks and figures beyond any fixed number of characters do not hide the last letters."""
    assert Tr._end_view("the old boat left " + "* " * 5000, Tr.sentence_view).endswith("old boat left")


def test_leaks_in_parts_are_the_leaks_in_one(spark, rows):
    """Several groups of items and several automata of each find what one automaton finds."""
    import random

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(30)] + [(99, " ".join(rng.choices(vocabulary, k=3000)))]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=60)
        if d % 2:
            _, t = rng.choice(items)
            w = t.split()
            a = rng.randrange(max(1, len(w) - 20))
            words[20:20] = w[a : a + rng.randint(8, 20)]
        docs.append((d, " ".join(words)))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = rows(Le.leaks(df, it))
    assert len(one) > 20 and rows(Le.leaks(df, it, group_chars=6_000, automaton_chars=1_500)) == one
    sizes = [len(Le._automaton(items, 12, 24, k, 4)) for k in range(4)]
    assert sum(sizes) == len(Le._automaton(items, 12, 24)) and max(sizes) < 2 * min(sizes)


def test_spans_of_accents_written_apart():
    import unicodedata

    text = "Voilà — « l'été dernier, le vieux potier a trouvé un sifflet près du pont de pierre » dit-il."
    apart = unicodedata.normalize("NFD", text)
    p = sorted(Le.passages("l'été dernier, le vieux potier a trouvé un sifflet près du pont de pierre"))[0]
    for t in (text, apart, text.replace("fi", "ﬁ")):
        a, b = Le.original_span(t, p)
        assert 0 < a < b < len(t) and Le.plain(t[a:b]).replace(" ", "") == p.replace(" ", "")
