"""Splitting oversized segments at natural boundaries, by packing a structure tree.

A text is a tree: sections under headings (a level for each depth of heading), paragraphs, list items (a level for each
indentation), lines, sentences, clauses, words, characters. Sibling nodes are merged while they fit together; only nodes over the
limits are opened. What comes of an opened section, paragraph or item stays by itself, so that no heading ends a piece that its text
does not begin; parts of sentences and clauses go on filling the piece before them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.sentences import Observed
from cuewright.llm.text import CLOSERS, FINAL, UNSPACED_RE
from cuewright.operators.keys import join_on, ms

MAX_CHARS, MAX_WORDS, MAX_MS = 120, 30, 9000
#: Deepest heading and list indentation that make a level of their own.
HEADINGS, INDENTS = 6, 3
HEADING_RE = regex.compile(r"(?m)^[ \t]*(#{1,6})[ \t]+\S.*$")
ITEM_RE = regex.compile(r"(?m)^([ \t]*)(?:[-*+•‣◦]|\d{1,3}[.)])[ \t]+\S")
PARAGRAPH_RE = regex.compile(r"\n[ \t\r]*\n\s*")
LINE_RE = regex.compile(r"\n+")
SENTENCE_RE = regex.compile(rf"(?:[.!?…]+[{CLOSERS}]*|[…]+)(?=\s)\s*|[{FINAL.replace('.', '').replace('!', '').replace('?', '').replace('…', '')}]+[{CLOSERS}]*\s*")
CLAUSE_RE = regex.compile(r"[,;:，、；：،؛—–](?=\s)\s*|[，、；：،؛]")
BLANK_RE = regex.compile(r"\s+")
CHARACTER_RE = regex.compile(r"\X")


def _sentence_cuts(text: str) -> list[int]:
    """Where sentences begin: at marks, but for those that the sentence operator's stated odds let go on (abbreviations, quotations)."""
    found = [m.end() for m in SENTENCE_RE.finditer(text)]
    if not found:
        return found
    spans = [m.span() for m in regex.finditer(r"\S+", text)]
    seen = Observed([text[a:b] for a, b in spans], [0] * len(spans), None)
    goes = np.where(seen.settled != 0, seen.settled, seen.stated) < 0
    ends = {a: not goes[i - 1] for i, (a, _) in enumerate(spans) if i}
    return [c for c in found if ends.get(c, True)]


def structure(text: str) -> list[list[int]]:
    """Where nodes of each level begin, from the outermost level to the innermost; the last two are sentences' inner levels."""
    if "\n" not in text:  # one line
        return [[]]
    heads = [(m.start(), len(m.group(1))) for m in HEADING_RE.finditer(text)]
    levels = [[at for at, depth in heads if depth <= d] for d in range(1, HEADINGS + 1)] if heads else []
    of_head = {m.end() for m in HEADING_RE.finditer(text)}
    levels.append([m.end() for m in PARAGRAPH_RE.finditer(text) if m.start() not in of_head])
    items = [(m.start(), len(m.group(1).expandtabs(4)) // 2) for m in ITEM_RE.finditer(text)]
    levels += [[at for at, deep in items if deep <= d] for d in range(INDENTS)] if items else []
    levels.append([m.end() for m in LINE_RE.finditer(text)])
    return levels


class _Piecer:
    """Cuts one text. words: (text, start ms, end ms) in order, or None to place times by character."""

    def __init__(self, text: str, start: int | None, end: int | None, words: list | None, limits: tuple[int, int, int], overlap: int):
        self.text, self.start, self.end = text, start, end
        self.max_chars, self.max_words, self.max_ms = limits
        self.overlap = overlap
        self.spaced = [m.span() for m in regex.finditer(r"[^ ]+", text)]
        self.timed: list[tuple[int, int, int | None, int | None]] = []
        at = 0
        for w, s, e in words or []:
            w = (w or "").strip()
            if w and (k := text.find(w, at)) >= 0:
                self.timed.append((k, k + len(w), s, e))
                at = k + len(w)
        # units are what an overlap counts: the given words, else words, or characters where words are not spaced
        units = [(a, b) for a, b, _, _ in self.timed]
        if not units:
            units = [s for a, b in self.spaced for s in ([m.span() for m in CHARACTER_RE.finditer(text, a, b)] if UNSPACED_RE.search(text[a:b]) else [(a, b)])]
        self.unit_starts = [a for a, _ in units]
        self.unit_ends = [b for _, b in units]
        ink = [m.span() for m in regex.finditer(r"\S+", text)]
        self.ink_starts, self.ink_ends = [a for a, _ in ink], [b for _, b in ink]
        self.space_starts = [a for a, _ in self.spaced]
        self.space_ends = [b for _, b in self.spaced]
        self.cuts = structure(text)
        self.firm = len(self.cuts)  # levels whose opened nodes stay by themselves
        sentences, blanks = _sentence_cuts(text), [m.end() for m in BLANK_RE.finditer(text)]
        bound = {m.end() for m in SENTENCE_RE.finditer(text)} - set(sentences)  # after an abbreviation, and the like
        self.cuts += [sentences, [m.end() for m in CLAUSE_RE.finditer(text)], [c for c in blanks if c not in bound], blanks]
        self.cuts.append(self.unit_starts[1:])
        self.cuts.append(None)  # characters, found when needed
        self.seen: dict = {}

    def back(self, a: int) -> int:
        """Where a piece that begins at a begins with its overlap."""
        i = bisect_left(self.unit_starts, a)
        return self.unit_starts[max(0, i - self.overlap)] if self.overlap and i > 0 and self.unit_starts else a

    def times(self, a: int, b: int) -> tuple[int | None, int | None]:
        if self.timed:
            inside = self.timed[bisect_right(self.unit_ends, a) : bisect_left(self.unit_starts, b)]
            s = [x[2] for x in inside if x[2] is not None]
            e = [x[3] for x in inside if x[3] is not None]
            if s and e:
                lo, hi = (min(s), max(e)) if a > 0 or self.start is None else (self.start, max(e))
                if b >= len(self.text) and self.end is not None:
                    hi = self.end
                return (lo, hi) if hi >= lo else (lo, lo)
        if self.start is None or self.end is None or not self.text:
            return None, None
        span = self.end - self.start
        return self.start + span * a // len(self.text), self.start + span * b // len(self.text)

    def trimmed(self, a: int, b: int) -> tuple[int, int]:
        """The stretch without the blanks around it; an empty one where it is all blank."""
        i, j = bisect_right(self.ink_ends, a), bisect_left(self.ink_starts, b) - 1
        return (max(a, self.ink_starts[i]), min(b, self.ink_ends[j])) if i <= j else (a, a)

    def within(self, a: int, b: int) -> bool:
        x, y = self.trimmed(a, b)
        if y - x > self.max_chars:
            return False
        if bisect_left(self.space_starts, b) - bisect_right(self.space_ends, a) > self.max_words:
            return False
        s, e = self.times(a, b)
        return s is None or e - s <= self.max_ms

    def fits(self, a: int, b: int) -> bool:
        return self.within(self.back(a), b)

    def between(self, a: int, b: int, level: int) -> list[int]:
        cuts = self.cuts[level]
        if cuts is None:
            return [m.end() for m in CHARACTER_RE.finditer(self.text, a, b)][:-1]
        return cuts[bisect_right(cuts, a) : bisect_left(cuts, b)]

    def pack(self, a: int, b: int, level: int = 0) -> list[tuple[int, int]]:
        if self.fits(a, b):
            return [(a, b)]
        while level < len(self.cuts) and not (inner := self.between(a, b, level)):
            level += 1
        if level == len(self.cuts):
            return [(a, b)]
        out: list[tuple[int, int]] = []
        closed = False  # what the last piece came from was opened, and stays by itself
        for x, y in zip([a, *inner], [*inner, b]):
            made = self.pack(x, y, level + 1)
            opened = len(made) > 1 and level < self.firm
            for k, p in enumerate(made):
                blank = not self.text[p[0] : p[1]].strip()
                if out and (blank or (not (opened or closed) and self.fits(out[-1][0], p[1]))):
                    out[-1] = (out[-1][0], p[1])
                else:
                    out.append(p)
            closed = opened
        return out

    def pieces(self) -> list[dict]:
        found = []
        for a, b in self.pack(0, len(self.text)):
            own = bisect_left(self.unit_starts, a)
            lo, shared = self.back(a), min(self.overlap, own)
            if lo < a and not self.within(lo, b):  # one indivisible unit; it goes without overlap
                lo, shared = a, 0
            x, y = self.trimmed(lo, b)
            s, e = self.times(lo, b)
            found.append({"text": self.text[x:y], "start": None if s is None else s / 1000, "end": None if e is None else e / 1000, "overlap_words": shared, "within": self.within(lo, b)})
        return found


def over_limits(text: Column, start_ms: Column, end_ms: Column, max_chars: int = MAX_CHARS, max_words: int = MAX_WORDS, max_ms: int = MAX_MS) -> Column:
    """Whether a segment is over a limit; without times it is judged by its text, without text by its times."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return (
        F.coalesce(F.char_length(text) > max_chars, F.lit(False))
        | F.coalesce(words > max_words, F.lit(False))
        | F.coalesce(end_ms - start_ms > max_ms, F.lit(False))
    )


def split_oversized(segments: DataFrame, keys: list[str], words: DataFrame | None = None, *, overlap: int = 0, max_chars: int = MAX_CHARS, max_words: int = MAX_WORDS, max_ms: int = MAX_MS) -> DataFrame:
    """The pieces of every segment over the limits: keys, piece, pieces, text, start, end, overlap_words, within.

    segments: keys, text, start, end (seconds), one row per key; segments within the limits give no rows.
    words: keys, idx, text, start, end; with them cuts fall between words and pieces carry word
    times, otherwise times are placed by character. Consecutive pieces share `overlap` words (characters
    in unspaced scripts without words). `within` is false only for one indivisible unit that is itself over
    a limit. A null or blank text, over the limit in time alone, comes out as one piece.
    """
    if overlap < 0 or overlap >= max_words:
        raise ValueError("overlap must lie between 0 and the word limit")
    # the tree keeps names of its own, whatever else the keys are called
    s = segments.select(*keys, F.col("text").alias("_text"), ms("start").alias("_start"), ms("end").alias("_end"))
    s = s.where(over_limits(F.col("_text"), F.col("_start"), F.col("_end"), max_chars, max_words, max_ms))
    unit = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("w", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    if words is None:
        s = s.withColumn("_words", F.lit(None).cast(unit))
    else:
        w = words.select(*keys, F.struct(F.col("idx").cast("long").alias("i"), F.col("text").alias("w"), ms("start").alias("s"), ms("end").alias("e")).alias("_w"))
        grouped = join_on(s.select(*keys), w, keys).groupBy(*keys).agg(F.sort_array(F.collect_set("_w")).alias("_words"))
        s = join_on(s, grouped, keys, "left")
    limits = (max_chars, max_words, max_ms)
    key_fields = [segments.schema[k] for k in keys]
    made = T.StructType(
        key_fields
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("pieces", T.IntegerType()), ("text", T.StringType()), ("start", T.DoubleType()), ("end", T.DoubleType()), ("overlap_words", T.IntegerType()), ("within", T.BooleanType()))]
    )

    def cut_up(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for b in batches:
            source, rows = [], []
            for i, (text, start, end, ws) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_text", "_start", "_end", "_words")))):
                if text is None or not text.strip():
                    got = [{"text": text, "start": None if start is None else start / 1000, "end": None if end is None else end / 1000, "overlap_words": 0, "within": False}]
                else:
                    got = _Piecer(text, start, end, [(w["w"], w["s"], w["e"]) for w in ws] if ws else None, limits, overlap).pieces()
                for k, p in enumerate(got):
                    source.append(i)
                    rows.append({"piece": k, "pieces": len(got)} | p)
            take = pa.array(source, pa.int32())
            cols = [b.column(k).take(take) for k in keys] + [pa.array([r[f.name] for r in rows], f.type) for f in list(schema)[len(keys) :]]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return s.mapInArrow(cut_up, made)
