import pickle
import random

from cuewright.llm import grams
from cuewright.llm import language as La
from cuewright.llm import pairs as Pa
from cuewright.llm import truncation as Tr

EN = "the old potter found a silver whistle near the stone bridge and the guide kept the film reel".split()
DE = "der alte Töpfer fand eine silberne Pfeife neben der Steinbrücke und die Führerin behielt die Filmrolle".split()
FR = "le vieux potier a trouvé un sifflet d'argent sous le pont de pierre et la guide a gardé la bobine".split()


def sentence(rng, words, n=9):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def test_rolling_hash_is_local():
    points, owner = grams.join_texts(["abcd", "xbcd", ""])
    h = grams.rolling(points, 3)
    ends = [i for i in range(len(points)) if points[i] == ord("d")]
    assert h[ends[0]] == h[ends[1]] != 0 and h[2] == 0 and owner[ends[1]] == 1


def test_language_held_out(spark):
    rng = random.Random(1)
    data = [(sentence(rng, w), lab) for _ in range(150) for w, lab in ((EN, "en"), (DE, "de"), (FR, " FR "))] + [(None, "en"), ("x", None)]
    model = La.train_language_model(spark.createDataFrame(data, "t string, l string"), "t", "l")
    assert model.languages == ["de", "en", "fr"]
    held = [(sentence(rng, w), i) for _ in range(100) for w, i in ((EN, 1), (DE, 0), (FR, 2))]
    scores, n = model.scores([t for t, _ in held])
    assert (scores.argmax(axis=1) == [i for _, i in held]).mean() > 0.97 and (n > 0).all()


def test_defects(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        w, lab = (DE, "de") if i % 2 else (FR, "fr")
        rows.append((i, sentence(rng, EN, 12), sentence(rng, w, 12), lab, ""))
    src = sentence(rng, EN, 12)
    cases = [
        (1000, src, None, "de", "empty"), (1001, src, " [7] … ", "de", "empty"), (1002, src, "(no output)", "de", "empty"), (1003, src, "​<|end|>", "de", "empty"),
        (1004, src, "I'm sorry, but I can't help with translating this.", "de", "refusal"), (1005, src, "[3] Es tut mir leid, das kann ich nicht übersetzen", "de", "refusal"),
        (1006, src, "[12] " + src.upper().replace(" ", "  "), "de", "copy"), (1007, src, sentence(rng, FR, 12), "de", "wrong_lang"), (1008, src, "старый гончар нашёл свисток у моста", "de", "wrong_lang"),
        (1009, src, " ".join(sentence(rng, DE, 12).split()[:3]) + " si", "de", "truncated"), (1010, "41, 52!", "41, 52!", "de", ""), (1011, None, sentence(rng, DE, 12), "de", ""), (1012, src, sentence(rng, DE, 12), None, ""),
        (1013, "no " * 30, "nein " * 30, "de", ""),
    ]
    data = [(k, s, r, t, "clash") for k, s, r, t, _ in rows + cases]
    df = spark.createDataFrame(data, "seg_no int, source string, reply string, target string, defect string")
    got = {r.seg_no: r.defect for r in Pa.judged_pairs(df, ["seg_no"]).collect()}
    assert {k: got[k] or "" for k, *_ in cases} == {c[0]: c[4] for c in cases}
    assert sum(got[i] is not None for i in range(400)) <= 4
    assert Pa.judged_pairs(df.where("seg_no < 0"), ["seg_no"]).count() == 0


def test_pair_models_are_fitted_on_every_reply(spark, monkeypatch):
    n = 50_000
    replies = spark.range(n).selectExpr("id", "'one two three' as source", "translate(lpad(id, 6, '0'), '0123456789', 'abcdefghij') as reply", "'en' as target")
    counts, fitted = [], []
    made, table = La.LanguageModel.__init__, Pa.breaking_table
    monkeypatch.setattr(La.LanguageModel, "__init__", lambda model, languages, c: counts.append(c.sum()) or made(model, languages, c))
    monkeypatch.setattr(Pa, "breaking_table", lambda whole, endings: fitted.append((whole.sum(), endings.sum())) or table(whole, endings))
    Pa.judged_pairs(replies, ["id"])
    assert counts == [n * (6 + 7 + 6 + 5)]  # n-grams of one to four characters, blanks around the word included
    assert fitted == [(n, n)]


def test_reply_pairs(spark, rows):
    p = spark.createDataFrame([("m", 0, 1, 1, 2, "de", "r", 1), ("m", 0, 1, 1, 2, "de", "r", 5), ("m", 0, 4, None, None, "de", None, 1), ("m", 0, 9, 9, 9, "de", "x", 1), (None, None, 0, 0, 0, None, "y", 1)], "media_id string, take_no int, seg_no int, n int, m int, tgt_lang string, text string, loaded_at int")
    s = spark.createDataFrame([("m", 0, i, f"s{i}", 1) for i in range(5)] + [(None, None, 0, "z", 1)], "media_id string, take_no int, seg_no int, text string, loaded_at int")
    got = Pa.reply_pairs(p, s).select("media_id", "seg_no", "source", "reply")
    assert rows(got) == sorted([("m", 1, "s1 s2", "r"), ("m", 4, "s4", None), ("m", 9, None, "x"), (None, 0, "z", "y")], key=repr)


PLACES = ["on the upper deck", "near the old pier", "behind the mill", "in the cold kitchen"]


def story(rng, n=8):
    return " ".join(f"{rng.choice(['The guide', 'My neighbour', 'Dr. Lima'])} {rng.choice(['hid', 'found', 'sold'])} {rng.choice(['the film reel', 'a blue canoe', 'the glass globe'])} {rng.choice(PLACES)}." for _ in range(n))


def test_truncation(spark):
    rng = random.Random(3)
    docs = [(i, "\n\n".join(story(rng, 3) for _ in range(4)), "a") for i in range(300)]
    docs += [(1000 + i, story(rng) + "\n\nSubtitles: Ana", "b") for i in range(12)]
    raw = lambda t: t.lower().replace(".", "")
    whole = [raw(story(rng)), story(rng)[:-1] + "...", "", None, "   ", "the glass globe = le globe\nthe film reel = la bobine"]
    cut = [story(rng)[:-9], story(rng) + " Dr.", story(rng) + " The guide hid the film re...", raw(story(rng)) + " the guide found the gl", story(rng) + " My", "a = b\nc = d\nthe film", "1\n00:00:01,000 --> 00:00:02,000\nThe end.\n\n2\n00:00:0", story(rng) + "�"]
    docs += [(2000 + i, t, "c") for i, t in enumerate(whole)] + [(3000 + i, t, "d") for i, t in enumerate(cut)]
    df = spark.createDataFrame(docs, "doc_id int, text string, cut string")
    got = {r.doc_id: r.cut for r in Tr.truncated(df, ["doc_id"]).collect()}
    assert [k for k in range(2000, 2000 + len(whole)) if got[k]] == []
    assert [k for k in range(3000, 3000 + len(cut)) if not got[k]] == []
    assert sum(got[i] for i in range(300)) <= 3 and not any(got[1000 + i] for i in range(12))
    assert Tr.truncated(df.where("doc_id < 0"), ["doc_id"]).count() == 0


def test_end_tables_are_fitted_on_every_text(spark):
    n = 30_000
    texts = spark.range(n, numPartitions=3).selectExpr("concat('The boat left the pier ', id, ' times.') as text")
    tables = Tr.train_end_tables(texts, "text")
    assert tables.place_ends.sum() == n == tables.all[0].max()
    again = pickle.loads(pickle.dumps(tables))
    assert (again.all == tables.all).all() and (again.ends == tables.ends).all() and (again.sign_offs == tables.sign_offs).all()
    assert again.log_odds("the boat left", Tr.PLAIN) == tables.log_odds("the boat left", Tr.PLAIN) is not None
