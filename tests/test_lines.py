import json

import pytest
from pyspark.sql import functions as F

from cuewright.operators import translate as R
from cuewright.plans import exchange as E
from cuewright.plans.translation import translate_lines
from cuewright.sources import files as I

K = ["media_id"]


def test_parse_srt(spark):
    text = "junk\r\n7\r\n00:00:01.000 --> 00:00:02,500\r\none\r\n two \r\n\r\n3\nno time\n\n5\n00:00:03,000 --> 00:00:04,000\n\n8\n9\n00:00:05,000 --> 00:00:06,000\nlost\n\n2\n00:00:07,000 --> 00:00:08,000\nlast"
    got = [(r.line_no, r.tc_start, r.end_ms, r.text) for r in I.parse_srt(spark.createDataFrame([("m", text), ("n", None), ("o", "")], "media_id string, text string")).orderBy("line_no").collect()]
    assert got == [(1, "00:00:01,000", 2500, "one two"), (2, "00:00:03,000", 4000, ""), (3, "00:00:07,000", 8000, "last")]


def test_files_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("a b", 1, 0, 900, "x"), ("a b", 2, 1000, 1900, ""), ("a b", 3, 2000, 2900, "z")], "media_id string, line_no int, start_ms long, end_ms long, text string")
    from cuewright.functions.text import srt_time_ms

    texts = I.srt_text(cues.withColumn("tc_start", srt_time_ms("start_ms")).withColumn("tc_end", srt_time_ms("end_ms")))
    assert I.write_files(texts, str(tmp_path), ".srt").count() == 1
    assert (tmp_path / "a b.srt").read_bytes().startswith(b"\xef\xbb\xbf1\n00:00:00,000 --> 00:00:00,900\nx\n\n3\n")
    back = I.parse_srt(I.texts(spark, str(tmp_path)))
    assert [(r.media_id, r.line_no, r.start_ms, r.text) for r in back.orderBy("line_no").collect()] == [("a b", 1, 0, "x"), ("a b", 2, 2000, "z")]
    (tmp_path / "w.json").write_text(json.dumps([{"start": 0.1, "end": None, "text": "é", "seg_idx": 0}]))
    assert [(r.media_id, r.idx, r.start, r.end, r.text) for r in I.read_words_json(spark, str(tmp_path)).collect()] == [("w", 0, 0.1, None, "é")]


def test_windows(spark):
    sizes = spark.createDataFrame([("five", 5), ("nine", 9), ("none", 0), ("one", 1)], "media_id string, n int")
    got = lambda k, mode: [tuple(r)[2:] for r in R.windows(sizes, K, mode=mode).where(F.col("media_id") == k).orderBy("win").collect()]
    assert got("five", "accurate") == [(0, 4, 0, 2), (1, 5, 2, 4), (3, 5, 4, 5)]
    assert got("nine", "flexible") == [(0, 8, 0, 4), (2, 9, 4, 8), (6, 9, 8, 9)]
    assert got("none", "accurate") == [] and got("one", "accurate") == [(0, 1, 0, 1)]


def test_window_lines_agree_with_windows(spark):
    for mode in R.MODES:
        data = [(f"m{n}", i + 1, "t") for n in range(1, 23) for i in range(n)]
        lines = spark.createDataFrame(data, "media_id string, line_no int, text string")
        w = {(r.media_id, r.win): r for r in R.windows(lines.groupBy("media_id").agg(F.count("*").cast("int").alias("n")), K, mode=mode).collect()}
        want = {(m, k, i) for (m, k), r in w.items() for i in range(r.ctx_start + 1, r.ctx_end + 1)}
        shown = R.window_lines(lines, K, mode).collect()
        assert {(r.media_id, r.win, r.line_no) for r in shown} == want and len(shown) == len(want)
        assert sum(r.role == "translate" for r in shown) == len(data)


CASES = [
    ("[1] A\n[2] B", ["A", "B"]),
    ("[1-2] AB", ["AB", None]),
    ("[2-3] BC", [None, "BC"]),
    ("Line 1: A\n2：B", ["A", "B"]),
    ("1 A\n2 B", ["A", "B"]),
    ("foo\nbar", ["foo", "bar"]),
    ("[0] x", [None, None]),
    ("[1] A\n[1] B", ["B", None]),
    ("[1] [00:00:01,000 --> 00:00:02,000] A", ["A", None]),
    ("[1] A <|end|>\n[2] B", ["A", None]),
    (None, [None, None]),
]


def test_replies(spark):
    r = spark.createDataFrame([(str(i), 0, c, 2) for i, (c, _) in enumerate(CASES)], "media_id string, win int, content string, lines int")
    win = ["media_id", "win"]
    got = {}
    for x in R.resolve(r, win, R.parse_replies(r, win)).collect():
        got.setdefault(int(x.media_id), {})[x.no] = x.translated
    for i, (content, want) in enumerate(CASES):
        assert [got[i][1], got[i][2]] == want, content


def test_overflow(spark):
    r = spark.createDataFrame([("m", 0, "[2-3] BC", 2)], "media_id string, win int, content string, lines int")
    sizes = spark.createDataFrame([("m", 3)], "media_id string, n int")
    win = ["media_id", "win"]
    got = R.overflow(R.parse_replies(r, win), win, R.windows(sizes, K), sizes, K).collect()
    assert [tuple(x) for x in got] == [("m", 2, 3)]


def test_rebuild(spark):
    df = spark.createDataFrame([("m", i + 1, i * 10, i * 10 + 5, t) for i, t in enumerate([None, "a", None, "b"])], "media_id string, line_no int, start_ms long, end_ms long, translated string")
    assert [tuple(r) for r in R.rebuild(df, K).orderBy("line_no").collect()] == [("m", 1, 10, 25, "a"), ("m", 2, 30, 35, "b")]


@pytest.mark.parametrize(("said", "n", "want"), [("YES, NO", 2, [True, False]), ("NO,NO,NO", 1, [False]), ("YES", 2, [True, False]), ("maybe", 1, None), (None, 1, None), ("no.\nyes!", 2, [False, True])])
def test_verdicts(spark, said, n, want):
    df = spark.createDataFrame([(said,)], "c string")
    assert df.select(E.verdicts("c", n)).first()[0] == want


def test_new_marks():
    assert E.new_marks("we go home they stay here", "we go home. They stay, here") == [2]
    assert E.new_marks("we go home they stay here", "we go home. they stay, here", ",") == [4]
    assert E.new_marks("we go. they stay", "we go. they stay.") == [3]
    assert E.new_marks("", ".") == []


def flaky():
    class Flaky:  # local, so that workers get it by value
        def chat(self, system, user, max_tokens, temperature):
            return "ok" if user == "x" else None

    return Flaky


def test_exchange_store_is_reused(spark, tmp_path):
    store = str(tmp_path / "answers")
    asked = E.requests(spark.createDataFrame([("x",), ("x",), ("y",)], "u string"), "s", "sys", F.col("u"), 5)
    a = {(r.content, r.ok, r.attempts) for r in E.exchange(asked, flaky(), store, attempts=2, delays=()).collect()}
    assert a == {("ok", True, 1), (None, False, 2)}
    b = E.exchange(asked.where("user = 'x'"), E.NoBackend, store, attempts=1).where("ok").collect()
    assert [r.content for r in b] == ["ok"]


def test_translate_keeps_source_when_calls_fail(spark):
    lines = spark.createDataFrame([("m", i, f"line {i}") for i in range(1, 4)], "media_id string, line_no int, text string")
    got = translate_lines(lines, K, E.NoBackend, attempts=1, delays=()).orderBy("line_no").collect()
    assert [(r.translated, r.state) for r in got] == [(f"line {i}", "kept_source") for i in (1, 2, 3)]


def translator(answers, default):
    class Model:
        def chat(self, system, user, max_tokens, temperature):
            for (stage, text), said in answers.items():
                if stage in system and text in user.split("After:")[0].split("Lines to translate:")[-1]:
                    return said
            return default

    return Model


def test_windows_in_the_wrong_script_are_asked_again(spark):
    lines = spark.createDataFrame([("m", 1, "one old boat"), ("m", 2, "two new boats")], "media_id string, line_no int, text string")
    model = translator({("attempt 3", "one"): "[1] 一\n[2] 二"}, "[1] one old boat\n[2] two new boats")
    got = translate_lines(lines, K, model, attempts=1, delays=()).orderBy("line_no").collect()
    assert [r.translated for r in got] == ["一", "二"]


def test_single_lines_are_repaired(spark):
    texts = ["a red boat", "the long day", "we went home"]
    lines = spark.createDataFrame([("m", i + 1, t) for i, t in enumerate(texts)], "media_id string, line_no int, text string")
    model = translator({("only the one line", "the long day"): "[1] 漫长的一天", ("Lines", "we went home"): "[1] 我们回家", ("Translate", "a red boat"): "[1] 红船\n[2] the long day still"}, None)
    got = translate_lines(lines, K, model, attempts=1, delays=(), drift_threshold=None).orderBy("line_no").collect()
    assert [r.translated for r in got][:2] == ["红船", "漫长的一天"]


def test_merges_into_the_next_window_are_parted(spark):
    lines = spark.createDataFrame([("m", i, f"line {i}") for i in (1, 2, 3)], "media_id string, line_no int, text string")

    def make():
        class Model:
            def chat(self, system, user, max_tokens, temperature):
                if "overlap" in system:
                    return "[2] deux\n[3] trois"
                body = user.split("Lines to translate:\n")[1]
                return "[1] un\n[2-3] deux trois" if "line 1" in body else "[1] trois encore"

        return Model()

    got = translate_lines(lines, K, make, target="french", attempts=1, delays=(), drift_threshold=None).orderBy("line_no").collect()
    assert [r.translated for r in got] == ["un", "deux", "trois"]


def test_drop_folder_stream(spark, tmp_path):
    from cuewright.streaming.drop_folder import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    seen = []
    q = watch(spark, str(tmp_path / "in"), lambda df, n: seen.extend(I.parse_srt(df).collect()), str(tmp_path / "state"))
    q.awaitTermination(60)
    assert [(r.media_id, r.text) for r in seen] == [("a", "hi")]


def test_stream_of_words_closes_groups(spark, tmp_path):
    from datetime import datetime

    from cuewright.streaming.drop_folder import close_groups

    data = [("m", i, i * 100, i * 100 + 90, t, datetime(2025, 1, 1)) for i, t in enumerate("one two. three".split())]
    schema = "media_id string, idx int, s_ms long, e_ms long, text string, ts timestamp"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "w"))
    out = close_groups(spark.readStream.schema(schema).parquet(str(tmp_path / "w")))
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [(r.ws, r.we, r.text) for r in spark.sql("select * from closed").collect()] == [(0, 2, "one two.")]


def test_config_free_prompt():
    p = R.system_prompt("english", "french", glossary=["a = b"], numbers="digits", flexible=True, simplify=True, punctuation=False)
    assert "a = b" in p and "digits" in p and R.system_prompt("a", "b", custom="mine") == "mine"


def test_store_is_new_only_where_its_path_is_missing(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    from cuewright.plans.exchange import Replay, exchange, requests

    asked = requests(spark.createDataFrame([("a",), ("b",)], "t string"), "s", "system", F.col("t"), F.lit(8))
    first = exchange(asked, lambda: Replay({"a": "x"}), str(tmp_path / "store"), attempts=1, delays=())
    assert sorted((r.content, r.ok) for r in first.collect() if r.ok) == [("x", True)]
    again = exchange(asked, lambda: Replay({"b": "y"}), str(tmp_path / "store"), attempts=1, delays=())
    assert sorted(r.content for r in again.collect()) == ["x", "y"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        exchange(asked, lambda: Replay({}), str(tmp_path / "broken"), attempts=1, delays=()).collect()
    assert not isinstance(e.value, AnalysisException) or e.value.getCondition() != "PATH_NOT_FOUND"


def test_files_by_address(spark, tmp_path):
    from cuewright.sources import files as I

    df = spark.createDataFrame([("a/b", "text"), ("c", None)], "media_id string, text string")
    for folder in (str(tmp_path / "x"), f"file://{tmp_path}/y"):
        assert sorted(r.bytes for r in I.write_files(df, folder, ".txt").collect()) == [0, 4]
    assert sorted(p.name for p in (tmp_path / "y").iterdir()) == ["a_b.txt", "c.txt"] and (tmp_path / "x" / "a_b.txt").read_text() == "text"
