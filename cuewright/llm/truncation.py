"""Texts cut off by a field's limit or in transfer.

A backward character n-gram model: for the last characters before a point (10, 6 or 4 of them, backing off to
the kind of the last one) it knows how often a text, sentence or line ends there and how often it goes on. A
text's final context is judged by the log-odds of ending against going on, with a threshold of its own for each
language and source. No mark decides by itself: a full stop is one more context, and so is its absence.

Some of the texts that the model learns endings from are cut themselves. Cuts fall on any place alike, so the
share of them is the smallest share that any kind of place has among ends beside its share among all places, and
that much of all places is taken out of the ends.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.grams import Windows, bucket, join_texts, rolling
from cuewright.llm.text import CLOSERS, ENDED_RE, FINAL, LETTER_RE, NUMBER_LINE_RE, TIMECODE_RE, UNSPACED, forms, without_structure
from cuewright.operators.keys import join_on
from cuewright.session import cut

#: Tables of a fixed size, whatever the corpus: context lengths, and buckets of each.
ORDERS = (10, 6, 4)
BITS = 22
#: Each context is counted in two rows under unlike hashes; the smaller count is read, so that a rare context seldom borrows a frequent one's.
ROWS = 2
#: A context decides from so many occurrences on; below, a shorter one does. In marked texts only the ends of
#: paragraphs are seen to end (about every sixth sentence does), which takes more occurrences.
ENOUGH = {1: 50, 2: 50, 3: 100, 4: 100}
#: The shortest context needs so many times as many.
SHORT = 3
#: Share of ends that a context has before it is seen, and how many occurrences that counts for.
PRIOR = {1: (0.1, 10), 2: (0.1, 10), 3: (0.15, 20), 4: (0.15, 20)}
#: Log-odds of ending below which a text was cut where texts are cut as often as on the whole; each language and source moves it
#: by the odds of its own share of cuts, at most by MOVE, and has its share from all its rows and PSEUDO of the usual kind.
CUT, MOVE, PSEUDO = -3.5, 1.0, 50.0
#: Tables leave a task in parts of so many buckets, whose sums are made in so many tasks.
PART, SUMS = 1 << 16, 16
PLAIN, LIST, THAI, MARKED, SRT = 1, 2, 3, 4, 5
#: Kinds of places in a text, by the last character or, in subtitle files and lists, by the line.
KINDS = ("word", "final", "ellipsis", "other", "number line", "time line", "before =", "after =")
WORD, FINAL_MARK, ELLIPSIS, OTHER, NUMBER_LINE, TIME_LINE, BEFORE, AFTER = range(len(KINDS))
#: Stated shares of kinds among the ends of whole texts, per style; they count for so many texts.
STATED = {PLAIN: {WORD: 1.0}, LIST: {AFTER: 1.0}, THAI: {WORD: 0.9, FINAL_MARK: 0.1}, MARKED: {FINAL_MARK: 0.965, WORD: 0.005, OTHER: 0.02, ELLIPSIS: 0.01}}
STATED[SRT] = STATED[MARKED]
STATED_TEXTS = 20.0
#: The least share of all places that a kind needs to tell how many of the ends are cuts.
TELLING = 0.01
#: Weight of the last letters where no mark follows them and the place or the paragraph has spoken.
LETTERS_WEIGHT = 0.25
#: The place counts for so many paragraphs beside those seen to begin alike.
KEY_COUNT = 2
#: The longest context asked in marked texts; the mark and the last letters tell an abbreviation.
MARKED_ORDER = 6
_END = "\1"
_STOP_RE = regex.compile(rf"[{FINAL}]+[{CLOSERS}]*(?=\s*\Z|\s*\n|\s+[^\p{{Ll}}\s]|[{UNSPACED}])")
_OTHER_RE = regex.compile(r"[^\p{L}\p{M}\p{N}\1]+")
_BETWEEN_RE = regex.compile(rf"(?<=[{UNSPACED}]) (?=[{UNSPACED}])")
_UPPER_RE = regex.compile(r"\p{Lu}")
_NUMBER_RE = regex.compile(r"\p{N}")
_LINE_END_RE = re.compile(r"\s*\n\s*")
_TERM_END_RE = re.compile(r"\s+=\s+|\s*\n\s*")
#: The same for texts of ASCII characters only, which most are.
_ASCII_STOP_RE = re.compile(r"[.!?]+[\"')\]]*(?=\s*\Z|\s*\n|\s+[^a-z\s])")
_ASCII_LETTERS = {c: " " if not chr(c).isalnum() else "0" if chr(c).isdigit() else chr(c).lower() for c in range(128) if c != 1}
_ASCII_DIGITS = {c: "0" for c in range(48, 58)}
_BLANK_RE = regex.compile(r"[^\S\1]+")
#: Marks after which a sentence goes on, as it does after a word.
_WORD_MARKS = ",;:，、；：،؛-–—"
_UNSPACED_START_RE = regex.compile(f"[{UNSPACED}]")
_THAI_RE = regex.compile(r"\p{Thai}")
_ELLIPSIS_RE = regex.compile(rf"(?:\.\.+|…+)[{CLOSERS}\s]*\Z")
_MARK_RE = regex.compile(rf"[{FINAL},;:，、；：،؛\"“”„«»「」¿¡]")
_PARTIAL_TIME_RE = regex.compile(r"\d{1,2}:\d{0,2}(?::\d{0,2}(?:[.,]\d{0,3})?)?(?:\s*-{0,2}>?(?:\s*\d{1,2}(?::\d{0,2}(?::\d{0,2}(?:[.,]\d{0,3})?)?)?)?)?\s*")
_PARAGRAPH_RE = regex.compile(r"\n\s*\n")


def style_of(text: str) -> int:
    """LIST if most lines are 'term = term', THAI by script, PLAIN without capitals and marks, else MARKED."""
    lines = [x for x in text.splitlines() if x.strip()]
    if lines and 2 * sum(" = " in x for x in lines) > len(lines):
        return LIST
    if _THAI_RE.search(text) and 2 * len(_THAI_RE.findall(text)) > len(LETTER_RE.findall(text)):
        return THAI
    if not _MARK_RE.search(text) and not _UPPER_RE.search(text):
        return PLAIN
    return MARKED


def _letters(text: str) -> str:
    if text.isascii():
        return " ".join(text.translate(_ASCII_LETTERS).split()).replace(" \1", _END)
    t = _OTHER_RE.sub(" ", text.casefold())
    t = _NUMBER_RE.sub("0", t)
    return _BETWEEN_RE.sub("", t).replace(" \1", _END).strip(" ")


def sentence_view(text: str) -> str:
    """Letters only, with a sign where a sentence ends."""
    return _letters((_ASCII_STOP_RE if text.isascii() else _STOP_RE).sub(_END, text))


def line_view(text: str) -> str:
    """Letters only, with a sign where a line ends."""
    return _letters(_LINE_END_RE.sub(_END, text))


def term_view(text: str) -> str:
    """Letters only, with a sign where a term of a list ends."""
    return _letters(_TERM_END_RE.sub(_END, text))


def mark_view(text: str) -> str:
    """Letters and marks, with a sign where a line ends."""
    t = text.casefold()
    if "\n" in t:
        t = _LINE_END_RE.sub(_END, t)
    if t.isascii():
        return " ".join(t.translate(_ASCII_DIGITS).split())
    t = _NUMBER_RE.sub("0", t)
    return _BLANK_RE.sub(" ", t).strip(" ")


def first_key(paragraph: str) -> str:
    """How a paragraph begins: its first word, or first two letters in scripts without spaces."""
    p = paragraph.strip().casefold()
    if not p:
        return ""
    return p[:2] if _UNSPACED_START_RE.match(p) else p.split()[0].rstrip(":,.")


def is_srt(text: str) -> bool:
    return "-->" in text and TIMECODE_RE.search(text) is not None


def _classes() -> np.ndarray:
    """Kind of place after each character of the basic plane; 255 after a blank. What lies beyond is letters."""
    import unicodedata

    table = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        k = unicodedata.category(chr(c))[0]
        if chr(c).isspace():
            table[c] = 255
        elif k in "LMN":
            table[c] = WORD
    for chars, kind in ((FINAL.replace("⁇-⁉", "⁇⁈⁉"), FINAL_MARK), ("…", ELLIPSIS), (_WORD_MARKS, WORD)):
        for c in chars:
            table[ord(c)] = kind
    return table


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return _classes()


def _class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _class_table()[np.minimum(points, 0xFFFF)]
    return np.bincount(kinds[kinds != 255], minlength=len(KINDS))[: len(KINDS)]


def places(text: str, plain: str, style: int, srt: bool) -> np.ndarray:
    """How many places of each kind a text has."""
    if style == LIST:
        out = np.zeros(len(KINDS), np.int64)
        for line in text.splitlines():
            at = line.find(" = ")
            out[BEFORE] += len(line) if at < 0 else at
            out[AFTER] += 0 if at < 0 else len(line) - at
        return out
    out = _class_counts(plain)
    if srt:
        out[TIME_LINE] = sum(len(m.group()) for m in TIMECODE_RE.finditer(text))
        out[NUMBER_LINE] = sum(len(m.group().strip()) for m in NUMBER_LINE_RE.finditer(text))
    return out


def place_of_end(text: str, plain: str, style: int, srt: bool) -> int:
    """The kind of the place where a text ends (text and plain have no blanks at their end)."""
    if style == LIST or srt:
        last = text[text.rfind("\n") + 1 :].strip()
        if style == LIST:
            return AFTER if " = " in last else BEFORE
        if last.isdigit():
            return NUMBER_LINE
        if _PARTIAL_TIME_RE.fullmatch(last) or "-->" in last:
            return TIME_LINE
    if not plain:
        return OTHER
    if ENDED_RE.search(plain):
        return ELLIPSIS if _ELLIPSIS_RE.search(plain) else FINAL_MARK
    return min(int(_class_table()[min(ord(plain[-1]), 0xFFFF)]), OTHER)


class EndTables:
    """Counts per context: ends and all; per first key of a paragraph: unmarked last ones and all; per style and kind of place: ends and all places."""

    def __init__(self):
        self.ends = np.zeros((len(ORDERS) * ROWS + 1, 1 << BITS), np.int32)
        self.all = np.zeros_like(self.ends)
        self.place_ends = np.zeros((SRT + 1, len(KINDS)))
        self.place_all = np.zeros_like(self.place_ends)
        self.asked: dict[tuple[str, int], float | None] = {}

    def __getstate__(self) -> dict:
        """What tasks are sent: the places of the tables that hold something."""
        at = np.flatnonzero(self.all)
        tables = {name: getattr(self, name).ravel()[at] for name in ("ends", "all")}
        signed = np.flatnonzero(self.sign_offs)
        return self.__dict__ | tables | {"at": at, "asked": {}, "sign_offs": (signed, self.sign_offs[signed])}

    def __setstate__(self, state: dict) -> None:
        empty = EndTables()
        at = state.pop("at")
        for name in ("ends", "all"):
            table = getattr(empty, name)
            table.ravel()[at] = state[name]
            state[name] = table
        signed, values = state["sign_offs"]
        state["sign_offs"] = np.zeros(1 << BITS)
        state["sign_offs"][signed] = values
        self.__dict__ |= state

    def finish(self) -> EndTables:
        """Makes log-odds of the counts of places, after taking out of the ends what cuts put there."""
        self.place_odds = np.zeros_like(self.place_ends)
        self.cut_share = np.zeros(SRT + 1)
        for style in range(PLAIN, SRT + 1):
            stated = np.zeros(len(KINDS))
            for k, share in STATED[style].items():
                stated[k] = share
            e, a = self.place_ends[style], self.place_all[style]
            places_ = (a + stated + 0.1) / (a + stated + 0.1).sum()
            ends = (e + STATED_TEXTS * stated) / (e.sum() + STATED_TEXTS)
            telling = places_ >= TELLING
            if style != LIST:  # cuts fall inside what is said; numbers and times are seen by themselves
                telling[[NUMBER_LINE, TIME_LINE]] = False  # (of subtitle texts)
            share = float(np.min(((ends + 0.5 / (e.sum() + STATED_TEXTS)) / places_)[telling])) if e.sum() else 0.0
            self.cut_share[style] = share = min(share, 0.5)
            whole = np.maximum(ends - share * places_, 0.0) / (1 - share)
            self.place_odds[style] = np.log((whole + 0.05 / (e.sum() + STATED_TEXTS)) / places_)
        # of the unmarked last paragraphs, too, some are cuts: those of as many texts as were cut, on all beginnings alike
        e, a = self.ends[-1].astype(float), self.all[-1].astype(float)
        usual = min(1.5 * self.cut_share[MARKED] * self.place_ends[MARKED].sum() / max(a.sum(), 1.0), 1.0)
        self.sign_offs = np.maximum(e - 1 - usual * a - 3 * np.sqrt(usual * a), 0.0)  # one may be the text that is judged
        return self

    def add_views(self, views: list[str], style: int) -> None:
        if not views:
            return
        points, _ = join_texts(views)
        sign = points == 1
        ended = np.zeros(len(points), bool)
        ended[:-1] = sign[1:]
        last = np.zeros(len(points), bool)
        last[:-1] = points[1:] == 0  # a text's own end counts neither way
        points, ended, last = points[~sign], ended[~sign], last[~sign]
        windows = Windows(points)
        for k, n in enumerate(ORDERS):
            h = windows.hashes(n)
            ok = (h != 0) & (points != 32) & ~(last & ~ended)
            for tables, of in ((self.all, ok), (self.ends, ok & ended)):
                seen, times = np.unique(h[of], return_counts=True)
                for row in range(ROWS):
                    np.add.at(tables[k * ROWS + row], self.places(seen, style, row), times.astype(np.int32))

    @staticmethod
    def places(h: np.ndarray, style: int, row: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return bucket((h + np.uint64(style)) * np.uint64(2 * row + 1) ^ (h >> np.uint64(17 + 11 * row)), BITS)

    @staticmethod
    def key_bucket(key: str) -> int:
        return zlib.crc32(key.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)

    def add_text(self, text: str) -> list[tuple[str, int]]:
        """The views of a text to train on, by style; its paragraphs and places are counted at once."""
        text = text.rstrip()
        style, srt = style_of(text), is_srt(text)
        kind = SRT if srt and style == MARKED else style
        whole = without_structure(text)
        plain = whole.rstrip()
        self.place_all[kind] += places(text, plain, style, srt)
        if text:
            self.place_ends[kind, place_of_end(text, plain, style, srt)] += 1
        if style in (LIST, THAI):
            view = term_view if style == LIST else line_view
            return [(view(whole), style)] if not srt else []
        if style == PLAIN:
            return []
        views = [(sentence_view(whole), PLAIN)]
        if not srt:
            views.append((mark_view(whole), MARKED))
            paragraphs = [p for p in _PARAGRAPH_RE.split(whole) if p.strip()]
            for i, p in enumerate(paragraphs):
                if key := first_key(p):
                    b = self.key_bucket(key)
                    self.all[-1, b] += 1
                    if i and i == len(paragraphs) - 1 and not ENDED_RE.search(p):
                        self.ends[-1, b] += 1
        return views

    def log_odds(self, view: str, style: int) -> float | None:
        """Log-odds that a text ends after this view's last letters; None where every context is too rare."""
        view = view.rstrip(_END + " ").replace(_END, "")[-ORDERS[0] :]
        if (view, style) not in self.asked:
            if len(self.asked) > 100_000:
                self.asked.clear()
            self.asked[view, style] = self._log_odds(view, style)
        return self.asked[view, style]

    def _log_odds(self, view: str, style: int) -> float | None:
        for k, n in enumerate(ORDERS):
            if len(view) < n or (style == MARKED and n > MARKED_ORDER):
                continue
            points = np.frombuffer(view[-n:].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            at = [(k * ROWS + row, self.places(rolling(points, n)[-1:], style, row)[0]) for row in range(ROWS)]
            a, e = min(int(self.all[i]) for i in at), min(int(self.ends[i]) for i in at)
            if a >= ENOUGH[style] * (1 if n > 4 else SHORT):
                share, weight = PRIOR[style]
                return float(np.log((e + share * weight) / (a - e + (1 - share) * weight)))
        return None

    def key_odds(self, paragraph: str, place_odds: float) -> float:
        """Log-odds that a paragraph beginning like this one is a text's last and has no mark at its end; of a rare beginning those of the place."""
        key = first_key(paragraph)
        b = self.key_bucket(key)
        a, e = (int(self.all[-1, b]), float(self.sign_offs[b])) if key else (0, 0.0)
        share = 1 / (1 + np.exp(-place_odds))
        return float(np.log((e + KEY_COUNT * share) / (a - e + KEY_COUNT * (1 - share))))


_PLACE_ENDS, _PLACE_ALL = len(ORDERS) * ROWS + 1, len(ORDERS) * ROWS + 2


def _packed(counts: np.ndarray) -> bytes:
    """Counts by the place of their bytes, of which most are zero."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def train_end_tables(df: DataFrame, text: str) -> EndTables:
    """Fits the model on all rows; runs when called.

    Each task adds up its rows and gives its tables in packed parts; parts of the same place are added up
    together, and only counts that can decide anything leave that sum.
    """
    f = T.StructField
    part = T.StructType([f("k", T.IntegerType()), f("p", T.IntegerType()), f("e", T.BinaryType()), f("a", T.BinaryType())])
    schema = T.StructType([f("k", T.IntegerType()), f("b", T.IntegerType()), f("e", T.LongType()), f("a", T.LongType())])

    def count(batches):
        import pyarrow as pa

        tables = EndTables()
        views: dict[int, list[str]] = {}
        size = 0
        for batch in batches:
            for t in batch.column("t").to_pylist():
                for view, style in tables.add_text(forms(t)):
                    views.setdefault(style, []).append(view)
                    size += len(view)
                if size > 1_000_000:
                    for style, some in views.items():
                        tables.add_views(some, style)
                    views, size = {}, 0
        for style, some in views.items():
            tables.add_views(some, style)
        every = [*zip(tables.ends, tables.all), (tables.place_ends.ravel(), tables.place_all.ravel())]
        for k, (e, a) in enumerate(every):
            for p in range(0, len(a), PART):
                if a[p : p + PART].any() or e[p : p + PART].any():
                    yield pa.RecordBatch.from_pylist([{"k": k, "p": p, "e": _packed(e[p : p + PART]), "a": _packed(a[p : p + PART])}], schema=pa.schema([("k", pa.int32()), ("p", pa.int32()), ("e", pa.binary()), ("a", pa.binary())]))

    def add(batches):
        import pyarrow as pa

        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, p, e, a in zip(*(batch.column(c).to_pylist() for c in ("k", "p", "e", "a"))):
                both = np.stack([_unpacked(e), _unpacked(a)])
                sums[k, p] = sums[k, p] + both if (k, p) in sums else both
        for (k, p), (e, a) in sums.items():
            least = min(ENOUGH.values()) if k < len(ORDERS) * ROWS else 1  # smaller counts decide nothing
            at = np.flatnonzero((a >= least) | (k >= _PLACE_ENDS) & (e > 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array((p + at).astype(np.int32)), pa.array(e[at]), pa.array(a[at])], names=["k", "b", "e", "a"])

    rows = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.col("t") != ""))
    got = rows.mapInArrow(count, part).repartition(SUMS, "k", "p").mapInArrow(add, schema).toArrow()
    tables = EndTables()
    k, b, e, a = (got.column(c).to_numpy() for c in ("k", "b", "e", "a"))
    of = k < _PLACE_ENDS
    tables.ends[k[of], b[of]] = np.minimum(e[of], 2**31 - 1)
    tables.all[k[of], b[of]] = np.minimum(a[of], 2**31 - 1)
    tables.place_ends.ravel()[b[~of]] = e[~of]
    tables.place_all.ravel()[b[~of]] = a[~of]
    return tables.finish()


def _end_view(plain: str, view) -> str:
    """The view of the end of a text, of at least as many characters as the longest context has."""
    n = 100
    while True:
        v = view(plain[-n:])
        if n >= len(plain) or len(v.replace(_END, "")) > 2 * ORDERS[0]:
            return v
        n *= 4


def judge(text: str | None, tables: EndTables) -> float | None:
    """Log-odds that the text ends where it ends; None where there is no text, minus infinity after a broken character."""
    t = forms(text or "").rstrip()
    if not t:
        return None
    if t.endswith("\ufffd"):
        return float("-inf")
    style, srt = style_of(t), is_srt(t)
    plain = without_structure(t).rstrip()
    kind = SRT if srt and style == MARKED else style
    place = place_of_end(t, plain, style, srt)
    odds = float(tables.place_odds[kind, place])
    if not plain or place in (NUMBER_LINE, TIME_LINE, BEFORE):
        return odds
    if style in (LIST, THAI):
        of = tables.log_odds(_end_view(plain, term_view if style == LIST else line_view), style) if place != FINAL_MARK else None
    elif style == PLAIN or place == ELLIPSIS:
        of = tables.log_odds(_end_view(_ELLIPSIS_RE.sub("", plain), sentence_view), PLAIN)
    elif place == FINAL_MARK:
        of = tables.log_odds(_end_view(plain, mark_view), MARKED)
    else:  # no mark: the letters before it, and how the last paragraph begins
        paragraphs = _PARAGRAPH_RE.split(plain)
        of = tables.log_odds(_end_view(plain, sentence_view), PLAIN)
        usual = PRIOR[PLAIN][0]
        letters = 0.0 if of is None else min(of - float(np.log(usual / (1 - usual))), 0.0)
        return (tables.key_odds(paragraphs[-1], odds) if len(paragraphs) > 1 else odds) + LETTERS_WEIGHT * letters
    return odds if of is None else of  # the longer context takes the place of the shorter


def truncated(docs: DataFrame, keys: list[str], text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds `cut` (whether the text was cut off), `log_odds` (of ending where it ends) and `threshold` to keys.

    The model is fitted on all rows when called; thresholds come from all rows of each value of the columns
    `by` (those that exist; nulls are a value), by their share of texts below the usual threshold. Null, empty and
    blank texts have no odds and are not cut; texts that end in a broken character are. Repeated rows are judged alike.
    """
    by_ = [c for c in by if c in docs.columns]
    given = docs.sparkSession.sparkContext.broadcast(train_end_tables(docs, text))
    own = [c for c in by_ if c not in keys]
    made = T.StructType([*(docs.schema[k] for k in [*keys, *own]), T.StructField("log_odds", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            odds = [judge(t, given.value) for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in [*keys, *own]), pa.array(odds, pa.float64())], names=[*keys, *own, "log_odds"])

    judged = cut(docs.select(*keys, *own, F.col(text).alias("_t")).mapInArrow(run, made))
    low = F.count(F.when(F.col("log_odds") < CUT, 1))
    groups = judged.where("log_odds is not null").groupBy(*by_).agg(F.count("*").alias("_n"), low.alias("_low"))
    n, lows = groups.agg(F.sum("_n"), F.sum("_low")).first()
    usual = ((lows or 0) + 1.0) / ((n or 0) + 2.0)
    share = (F.col("_low") + PSEUDO * usual) / (F.col("_n") + PSEUDO)
    move = F.log(share / (1 - share)) - float(np.log(usual / (1 - usual)))
    groups = groups.select(*by_, (F.lit(CUT) + F.least(F.greatest(move, F.lit(-MOVE)), F.lit(MOVE))).alias("threshold"))
    rows = join_on(judged, groups, by_, "left") if by_ else judged.withColumn("threshold", F.lit(CUT))
    return rows.select(*keys, F.coalesce(F.col("log_odds") < F.col("threshold"), F.lit(False)).alias("cut"), "log_odds", F.coalesce("threshold", F.lit(CUT)).alias("threshold"))
