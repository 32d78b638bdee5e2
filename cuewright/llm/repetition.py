"""Repetition inside a single text.

The share of a text's letters that belong to wording already said earlier in it. Wording is a run of
at least three words (six characters in scripts without spaces, or inside one word, which may be words run together), or one
word or syllable said again and again. A first saying never counts.

Histogram divergence (the distance of a text's character classes and common words from a language's)
does not see repetition: a sentence said five times has the histograms of the sentence said once. It
is therefore not used here; see the README.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuewright.llm.arrow import map_column
from cuewright.llm.text import ASCII_WORD_RE, LETTERS_RE, WORD_RE, forms, letter_count, unspaced

WORDS = 3
CHARS = 6
#: Times in a row from which a short unit counts as said many times.
MANY = 4
STUTTER_RE = re.compile(r"(.{1,3}?)\1{%d,}" % (MANY - 1))


def _repeated_units(units: list, n: int) -> list[bool]:
    """Which units lie in a run of n that began earlier, too."""
    again = [False] * len(units)
    grams = [units[i : i + n] for i in range(len(units) - n + 1)] if isinstance(units, str) else list(zip(*(units[k:] for k in range(n))))
    if len(set(grams)) == len(grams):  # most texts
        return again
    seen: set = set()
    until = 0
    for i, gram in enumerate(grams):
        if gram in seen:
            for j in range(max(i, until), i + n):
                again[j] = True
            until = i + n
        else:
            seen.add(gram)
    return again


def _characters(t: str) -> tuple[int, int]:
    """Letters, and letters said before, of a run of characters."""
    again = _repeated_units(t, CHARS)
    for m in STUTTER_RE.finditer(t):
        for j in range(m.start() + len(m.group(1)), m.end()):
            again[j] = True
    return len(t), sum(again)


def repeated_letters(text: str | None) -> tuple[int, int]:
    """Letters of a text, and how many of them repeat earlier wording of the same text."""
    if not text:
        return 0, 0
    t = forms(text).casefold()
    if unspaced(t):
        return _characters("".join(LETTERS_RE.findall(t)))
    words = (ASCII_WORD_RE if t.isascii() else WORD_RE).findall(t)
    stutters = STUTTER_RE.search(t) is not None
    sizes = [len(w) if w.isalpha() else letter_count(w) for w in words]
    again = _repeated_units(words, WORDS)
    total = sum(sizes)
    repeated = sum(s for s, a in zip(sizes, again) if a)
    for w, s, a in zip(words, sizes, again):
        if a or s < MANY:
            continue
        plain = w.isalpha()
        if plain and s < 2 * CHARS and not stutters:
            continue
        letters = w if plain else "".join(LETTERS_RE.findall(w))
        said = STUTTER_RE.sub(r"\1", letters)
        repeated += len(letters) - len(said)
        if len(said) >= 2 * CHARS:  # words may be run together
            repeated += sum(_repeated_units(said, CHARS))
    return total, repeated


def _shares(texts: list) -> list[list]:
    found = [repeated_letters(t) for t in texts]
    return [[a for a, _ in found], [b for _, b in found], [b / a if a else 0.0 for a, b in found]]


def repetition(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds letters, repeated_letters and repeated_share to every row.

    Null, empty and letterless texts have 0 letters and share 0. Whole texts are read; time is linear in
    their length. Columns of these names in df are replaced; all other columns pass unchanged.
    """
    fields = [T.StructField("letters", T.LongType()), T.StructField("repeated_letters", T.LongType()), T.StructField("repeated_share", T.DoubleType())]
    names = [f.name for f in fields]
    return map_column(df, text, fields, _shares, keep=[c for c in df.columns if c not in names])
