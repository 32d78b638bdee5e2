"""Distance of a text's histograms from a language's: character classes and common words, by Jensen-Shannon.

The method named for repetition. It does not see repetition (see the README) and is kept for what it does see: texts whose
make-up is unlike their language's.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.arrow import map_column
from cuewright.llm.pairs import script_of
from cuewright.llm.text import LETTER_RE, WORD_RE, forms

CLASSES = ("letter", "capital", "digit", "blank", "mark", "symbol")
#: Commonest words of a language that its histogram holds; texts with fewer characters have no distance.
COMMON, SHORTEST = 100, 60


def class_histogram(text: str) -> np.ndarray:
    """How many characters of each class a text has."""
    n = np.zeros(len(CLASSES))
    for c, k in Counter(text).items():
        n[1 if c.isupper() else 0 if LETTER_RE.match(c) else 2 if c.isdigit() else 3 if c.isspace() else 4 if not c.isprintable() or c in ".,;:!?'\"-()" else 5] += k
    return n


def word_histogram(text: str, common: list[str]) -> np.ndarray:
    """How often each of the common words, and any other word, occurs."""
    at = {w: i for i, w in enumerate(common)}
    n = np.zeros(len(common) + 1)
    for w in WORD_RE.findall(text.casefold()):
        n[at.get(w, len(common))] += 1
    return n


def jensen_shannon(a: np.ndarray, b: np.ndarray) -> float:
    """Square root of the divergence in bits, between 0 and 1; 1 where either is empty."""
    if not a.sum() or not b.sum():
        return 1.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    kl = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max((kl(p) + kl(q)) / 2, 0.0) ** 0.5


def _profiles(df: DataFrame, text: str, label: str) -> dict[str, tuple[np.ndarray, list[str], np.ndarray]]:
    """Per label the class histogram, the commonest words and their histogram, over all rows."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*)"), F.lit(1))
    counted = df.where(F.col(text).isNotNull()).select(F.col(label).alias("l"), F.explode(words).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    # the commonest of each salted part, then of all parts: no task ranks all words of a language
    part = F.pmod(F.xxhash64("w"), F.lit(64))
    near = W.partitionBy("l", part).orderBy(F.desc("n"), "w")
    far = W.partitionBy("l").orderBy(F.desc("n"), "w")
    some = counted.withColumn("r", F.row_number().over(near)).where(F.col("r") <= COMMON).withColumn("r", F.row_number().over(far)).where(F.col("r") <= COMMON)
    every = {r.l: r.n for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    top: dict[str, list] = {}
    for r in some.collect():  # a hundred rows a label
        top.setdefault(r.l, []).append((r.r, r.w, r.n, every[r.l]))
    schema = T.StructType([T.StructField("h", T.ArrayType(T.DoubleType()))])
    counts = map_column(df.select(F.col(label).alias("l"), F.col(text).alias("t")), "t", schema.fields, lambda texts: [[class_histogram(forms(t or "")).tolist() for t in texts]])
    sums = counts.groupBy("l").agg(*[F.sum(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(len(CLASSES))])
    classes = {r.l: np.array([r[f"h{i}"] for i in range(len(CLASSES))]) for r in sums.collect()}
    out = {}
    for lab, hist in classes.items():
        some = sorted(top.get(lab, []))
        n = np.array([x[2] for x in some] + [(some[0][3] - sum(x[2] for x in some)) if some else 0], float)
        out[lab] = (hist, [x[1] for x in some], n)
    return out


def divergence(df: DataFrame, text: str = "text", label: str | None = None, shortest: int = SHORTEST) -> DataFrame:
    """Adds `divergence`: the distance of the text's character classes from its language's plus that of its common words; between 0 and 2.

    label names the column of languages; without one texts are told apart by script. Languages are profiled over all rows. Null
    and texts shorter than `shortest` characters have null.
    """
    made = map_column(df, text, [T.StructField("_script", T.StringType())], lambda texts: [[script_of(t) if t else "" for t in texts]], keep=df.columns) if label is None else df.withColumn("_script", F.col(label))
    profiles = _profiles(made, text, "_script")
    pair = map_column(made.withColumn("_both", F.struct(F.col(text).alias("t"), F.col("_script").alias("l"))), "_both", [T.StructField("divergence", T.DoubleType())], lambda rows: [[_distance(r["t"], profiles.get(r["l"]), shortest) for r in rows]], keep=[c for c in df.columns if c != "divergence"])
    return pair


def _distance(text: str | None, profile, shortest: int) -> float | None:
    t = forms(text or "")
    if len(t) < shortest or profile is None:
        return None
    hist, common, words = profile
    return jensen_shannon(class_histogram(t), hist) + jensen_shannon(word_histogram(t, common), words)
