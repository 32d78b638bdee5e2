import numpy as np
import pytest

from cuewright.llm import divergence as Di


def test_jensen_shannon():
    a, b = np.array([1.0, 0, 3]), np.array([2.0, 0, 6])
    assert Di.jensen_shannon(a, b) == pytest.approx(0) and Di.jensen_shannon(np.array([1.0, 0]), np.array([0, 2.0])) == pytest.approx(1)
    assert Di.jensen_shannon(a, np.zeros(3)) == 1.0


def test_divergence(spark):
    plain = "the old boat left the pier and the guide slept near the mill for a while"
    rows = [(i, plain, "en", 0.5) for i in range(50)] + [(100, "#### 1234 $$$$ 5678 %%%% 9012 &&&& 3456 #### 7890 $$$$ 12", "en", 0.5), (101, None, "en", 0.5), (102, "short", "en", 0.5), (103, plain, None, 0.5)]
    df = spark.createDataFrame(rows, "k long, text string, lang string, divergence double")
    got = {r.k: r.divergence for r in Di.divergence(df, label="lang", shortest=40).collect()}
    assert len(got) == len(rows) and got[101] is None and got[102] is None and got[0] < 0.2 < 1.0 < got[100]
    by_script = {r.k: r.divergence for r in Di.divergence(df, shortest=40).collect()}
    assert by_script[0] < 0.3 and by_script[100] == pytest.approx(0)  # alone in its script
    assert Di.divergence(df.where("k < 0")).count() == 0
    # said three times over, the histograms stay the same
    assert Di._distance(plain, ((h := Di.class_histogram(plain)), ["the"], (w := Di.word_histogram(plain, ["the"]))), 1) == pytest.approx(0)
    again = f"{plain} {plain} {plain}"
    assert Di.jensen_shannon(Di.class_histogram(again), h) < 0.02 and Di.jensen_shannon(Di.word_histogram(again, ["the"]), w) == pytest.approx(0)
