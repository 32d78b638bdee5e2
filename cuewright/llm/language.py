"""Language posteriors from a character n-gram naive Bayes model, trained on all labelled rows."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.grams import SEP, Windows, bucket, join_texts
from cuewright.llm.text import forms

#: Table size per language and n-gram lengths; the model has the same size whatever the data.
BITS = 15
ORDERS = (1, 2, 3, 4)
#: Languages a model may have: the labels of most rows. Rows with other labels do not train; texts asked for in them are judged by script.
MAX_LANGUAGES = 200
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters_only(text: str | None) -> str:
    """Lower-case words padded with one space; what the model sees of a text."""
    return NOT_LETTERS.sub(" ", f" {forms(text).casefold()} ") if text else " "


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of the texts (already letters_only)."""
    points, owner = join_texts(texts)
    where, who = [], []
    windows = Windows(points)
    for n in ORDERS:
        h = windows.hashes(n)
        ok = h != SEP
        if n == 1:
            ok &= points != 32
        where.append(bucket(h[ok], BITS))
        who.append(owner[ok])
    return np.concatenate(where), np.concatenate(who)


class LanguageModel:
    """Log probabilities of hashed n-grams per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts.astype(np.float64)
        total = c.sum(axis=1, keepdims=True)
        logp = np.log((c + 0.1) / (total + 0.1 * c.shape[1])).astype(np.float32) if languages else np.zeros((0, 1 << BITS), np.float32)
        self.logp = np.ascontiguousarray(logp.T)  # a row per bucket: all languages of an n-gram at once

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability per n-gram (texts by languages) and the number of n-grams per text."""
        clean = [letters_only(t) for t in texts]
        sums = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts), np.int64)
        if not self.languages:
            return sums, n
        step = 1000
        for a in range(0, len(clean), step):
            points, owner = join_texts(clean[a : a + step])
            windows = Windows(points)
            for size in ORDERS:
                h = windows.hashes(size)
                ok = h != SEP
                if size == 1:
                    ok &= points != 32
                who = owner[ok]
                if not len(who):
                    continue
                first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                sums[a + who[first]] += np.add.reduceat(self.logp[bucket(h[ok], BITS)], first, axis=0)
                n[a : a + step] += np.bincount(who, minlength=len(clean[a : a + step]))
        return sums / np.maximum(n, 1)[:, None], n


def train_language_model(df: DataFrame, text: str, label: str) -> LanguageModel:
    """Counts the hashed n-grams of all labelled rows, per label; runs when called.

    Each task adds up its rows before the shuffle; the result has at most 2**15 counts a label. Rows
    with null text or label do not train.
    """
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        import pyarrow as pa

        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, lab in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist()):
                by.setdefault(lab, []).append(letters_only(t))
            for lab, texts in by.items():
                table = tables.setdefault(lab, np.zeros(1 << BITS, np.int64))
                for a in range(0, len(texts), 2000):
                    at, _ = gram_buckets(texts[a : a + 2000])
                    table += np.bincount(at, minlength=1 << BITS)
        for lab, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lab] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], names=["label", "b", "n"])

    rows = df.select(F.col(text).alias("t"), F.lower(F.trim(label)).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    known = [r[0] for r in rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MAX_LANGUAGES).collect()]
    rows = rows.where(F.col("l").isin(known)) if known else rows
    got = rows.mapInArrow(count, schema).groupBy("label", "b").agg(F.sum("n").alias("n")).toArrow()
    labels = got.column("label").to_pylist()
    languages = sorted(set(labels))
    at = {lab: i for i, lab in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << BITS), np.int64)
    if labels:
        counts[[at[x] for x in labels], got.column("b").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel(languages, counts)
