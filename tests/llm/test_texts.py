import random
import unicodedata

import pytest

from cuewright.llm import leaks as L
from cuewright.llm import lookalike as Lo
from cuewright.llm import repetition as Re
from cuewright.llm import text as Tx


@pytest.fixture(scope="module")
def spelling(spark):
    return Lo.Spelling(Lo.look_alikes(Lo.confusables(spark)))


@pytest.mark.parametrize(
    ("text", "share"),
    [
        (None, 0), ("", 0), ("123 !", 0), ("we went home early today", 0),
        ("the old boat left. The OLD boat, left!", 0.5), ("no no no no no no no no no no", 0.9), ("不不不不不不不不不不", 0.9), ("no no no, we left the old pier at noon", 0),
        ("谢谢你老师。谢谢你老师。谢谢你老师。", 2 / 3), ("hahahahahahahahaha", 16 / 18), ("hahahahahahah", 10 / 13), ("in 10000 days", 0), ("बारिश में नाव गई। बारिश में नाव गई। बारिश में नाव गई।", 2 / 3),
    ],
)
def test_repeated_share(text, share):
    letters, again = Re.repeated_letters(text)
    assert (again / letters if letters else 0) == pytest.approx(share, abs=0.01)


def test_repetition_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 30))]
        again = [False] * len(words)
        for i in range(len(words) - 2):
            if any(words[j : j + 3] == words[i : i + 3] for j in range(i)):
                again[i : i + 3] = [True] * 3
        assert Re.repeated_letters(" ".join(words)) == (sum(map(len, words)), sum(len(w) for w, a in zip(words, again) if a))


def test_repetition_frame(spark):
    df = spark.createDataFrame([("a", "x y z " * 40_000, 5), ("b", None, 6), (None, "", 7)], "k string, text string, letters int")
    got = {r.k: (r.letters, round(r.repeated_share, 3)) for r in Re.repetition(df).collect()}
    assert got == {"a": (120_000, 1.0), "b": (0, 0.0), None: (0, 0.0)}
    assert Re.repetition(df.where("k = 'z'")).count() == 0


SAME = [("Danke, Ana.", "Dank­e, Ana."), ("ﬁn é", "fin é"), ("Меrсі", "Merci"), ("Спасибо", "Cпacибo"), ("！ａｂ", "!ab"), ("“Wait” ", "‎“Wait”"), ("ガ", "ガ"), ("…", "...")]
DIFFERENT = [("é", "e"), ("A", "a"), ("1", "2"), ("a.", "a!"), ("3、7", "3, 7"), ("“a”", '"a"')]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(spelling, a, b):
    assert spelling.skeleton(a) == spelling.skeleton(b)
    assert spelling.consistent(a) == spelling.consistent(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_visible_difference(spelling, a, b):
    assert spelling.skeleton(a) != spelling.skeleton(b)
    assert spelling.consistent(a) != spelling.consistent(b)


def test_consistent_script(spelling):
    assert spelling.consistent("Меrсі, Paul") == "Merci, Paul"
    assert spelling.consistent("пpaвда и сор") == "правда и сор"
    assert {"LATIN", "CYRILLIC"} <= spelling.scripts("сор")
    assert spelling.scripts("дa") == {"CYRILLIC"} and not spelling.scripts("дz")
    assert spelling.consistent("力を入れる。へ、ヘ") == "力を入れる。へ、ヘ" and spelling.consistent("Όχι, ευχαριστώ") == "Όχι, ευχαριστώ"


@pytest.mark.parametrize("pair", ["νv", "υu", "ρp", "οo", "ոn", "սu", "հh", "ѵv", "ԌG", "ꓮA", "АΑ", "еe"])
def test_letters_of_the_public_table(spelling, pair):
    assert spelling.skeleton(pair[0]) == spelling.skeleton(pair[1])
    word = "b" + pair[1] + "d"
    assert spelling.consistent("b" + pair[0] + "d") == spelling.consistent(word)


def test_equal_look_is_equal_consistent_form(spelling):
    """Texts respelled at random within their classes, composed or not, keep one consistent form; it looks as they do."""
    rng = random.Random(5)
    words = "мир é Merci Paul сор кот Привет Όχι ευχαριστώ naïve вода ночь hôtel ուշ ABC ice ΑΒ x".split()
    for _ in range(600):
        text = " ".join(rng.choices(words, k=rng.randint(1, 6)))
        other = "".join(rng.choice(sorted(spelling.of[c].values())) if c in spelling.of and rng.random() < 0.5 else c for c in unicodedata.normalize("NFD", text))
        other = unicodedata.normalize(rng.choice(["NFC", "NFD"]), other)
        form = spelling.consistent(text)
        assert spelling.consistent(other) == form == spelling.consistent(form)
        assert spelling.skeleton(form) == spelling.skeleton(text) == spelling.skeleton(other)


def test_confusables_file(tmp_path):
    path = tmp_path / "confusables.txt"
    path.write_text("\ufeff# a comment\n0430 ;\t0061 ;\tMA\t# ( а → a )\n\n043E ; 006F ; MA\n", encoding="utf-8")
    alike = Lo.look_alikes(Lo.read_confusables(str(path)))
    assert alike == {"а": ("a", "а"), "a": ("a", "а"), "о": ("o", "о"), "o": ("o", "о")}
    assert Lo.Spelling(alike).consistent("мaмa") == "мама"


def test_links(spark, rows):
    data = [(1, "Merci"), (2, "Меrсі"), (3, "Merci"), (4, "merci"), (5, None), (6, " "), (2, "Меrсі"), (None, "Merci")]
    got = Lo.same_look_links(spark.createDataFrame(data, "cue_id long, text string"), "cue_id").drop("look")
    assert rows(got) == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 0, 0)]


def test_pairs(spark, rows):
    data = [(1, "Merci", "c"), (2, "Меrсі", "c"), (3, "Merci", "c"), (4, "merci", "c"), (5, None, "c"), (6, " ", "c"), (7, "", "c"), (2, "Меrсі", "d"), (None, "Меrci", "c")]
    df = spark.createDataFrame(data, "cue_id long, text string, look string")
    assert rows(Lo.same_look_pairs(df, "cue_id")) == [(1, 2), (2, 3)]
    assert Lo.same_look_pairs(df.where("cue_id > 99"), "cue_id").count() == 0


def test_many_copies_make_no_pairs(spark):
    df = spark.range(20_000).selectExpr("id as cue_id", "'same' as text")
    assert Lo.same_look_pairs(df, "cue_id").count() == 0


ITEM = "Ana painted the blue canoe of Bela during the storm while Carlo slept near the old pier."
ZH = "阿巴泽鲁在日出之前擦干净了娜萨拉兰的破帆。克顿斯索在第二集里画了泽帕米菲的备用电池。"


def leak(spark, docs):
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, passages int")
    h = spark.createDataFrame([(1, ITEM), (2, ZH), (3, None), (4, "too short")], "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in L.leaks(d, h).collect())


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        ITEM, " ".join(w[:11]), " ".join(w[1:13]), "x" + " ".join(w[:12]), "1\n00:00:01,000 --> 00:00:02,000\n" + " ".join(w[:6]).upper() + "\n\n2\n00:00:03.000 --> 00:00:04.000\n" + " ".join(w[6:12]) + "\n",
        "[1] " + " ".join(w[:5]) + "\n[2] " + ",\n".join(w[5:12]), "ｐ ".join(w), None, "", ZH[3:28], ZH[3:26], " ".join(ZH[:30]), ITEM.replace("canoe", "ca​no­e"), "so " * 50_000 + ITEM,
    ]
    assert leak(spark, docs + docs) == sorted((i + n, 2 if i in (9, 11) else 1) for i in (0, 2, 4, 5, 9, 11, 12, 13) for n in (0, len(docs)))


def test_leak_spans_map_back(spark):
    d = spark.createDataFrame([(1, "Pre. " + ITEM.upper())], "doc_id long, text string")
    h = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    r = L.leaks(d, h).first()
    assert ("Pre. " + ITEM.upper())[r.first_at : r.first_to].startswith("ANA PAINTED") and r.passages == 6


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    items = [" ".join(rng.choice("abcd") for _ in range(14)) for _ in range(10)]
    docs = [" ".join(rng.choice("abcd") for _ in range(6)) + " " + items[i % 10][2 * (i % 3) : 2 * (i % 3) + 2 * rng.randint(9, 13) - 1] for i in range(40)]
    want = {(i, k) for i, d in enumerate(docs) for k, t in enumerate(items) for s in range(3) if f" {' '.join(t.split()[s : s + 12])} " in f" {d} "}
    got = L.leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert L.leaks(got.selectExpr("doc_id", "'x' as text").where("doc_id < 0"), got.selectExpr("item_id", "'x' as text")).count() == 0
