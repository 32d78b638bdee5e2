import pytest
from pyspark.sql import functions as F

from cuewright.functions import text as X


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("s", "compat", "plain"), [(0.0, "00:00:00,000", None), (-1.0, "00:00:00,000", None), (3725.5, "01:02:05,500", None), (1.9996, "00:00:01,1000", "00:00:02,000")])
def test_srt_time(spark, s, compat, plain):
    assert one(spark, X.srt_time(F.lit(s), compat=True)) == compat
    assert one(spark, X.srt_time(F.lit(s))) == (plain or compat)


def test_parse_srt_time(spark):
    assert one(spark, X.parse_srt_time(F.lit("01:02:05.500"))) == 3725500
    assert one(spark, X.parse_srt_time(F.lit("1:02:05,500"))) is None


def test_strip_and_words(spark):
    assert one(spark, X.strip(F.lit(" \t a b "))) == "a b"
    assert one(spark, X.root(F.lit("It'll,"))) == "it"
    assert one(spark, X.pair_word(F.lit("They've;"))) == "they"
    assert one(spark, X.ends_sentence(F.lit("now?  "))) is True
    assert one(spark, X.is_fragile(F.lit("walk to THE"))) is True
    assert one(spark, X.is_fragile(F.lit("walk to the."))) is False


@pytest.mark.parametrize(
    ("text", "spacing", "want"),
    [("你好,世界。<|end|>", "auto", "你好，世界"), ('他说"你好"和"ok"', "auto", '他说“你好”和"ok"'), ("用CUDA 8", "true", "用 CUDA 8"), ("用 CUDA 8", "false", "用CUDA 8"), ('开"口', "auto", '开"口')],
)
def test_post_process(spark, text, spacing, want):
    assert one(spark, X.post_process(F.lit(text), "Chinese", False, spacing)) == want


def test_post_process_other_language(spark):
    assert one(spark, X.post_process(F.lit("a, b."), "french", False)) == "a, b"


def test_similarity(spark):
    assert one(spark, X.char_similarity(F.lit("abc"), F.lit("bcd"))) == 0.5
    assert one(spark, X.char_similarity(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, X.char_similarity(F.lit(" "), F.lit("  "))) == 1.0


def test_cleaning(spark):
    assert one(spark, X.clean_output(F.lit("Good.\nNOTE : kept\nmore"))) == "Good."
    assert one(spark, X.clean_output(F.lit("Good.\n[2] more"))) == "Good."
    assert one(spark, X.strip_reasoning(F.lit("<Think>a\nb</think>\n[1] x"))) == "[1] x"
    assert one(spark, X.strip_reasoning(F.lit("Let me see\n[1] x"))) == "[1] x"
    assert one(spark, X.strip_reasoning(F.lit("see [1]\n[1] x"))) == "see [1]\n[1] x"
