"""Scalar functions on text, as Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions import lexicon


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space of any kind at both ends (trim() knows only U+0020)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def rstrip_chars(x: Column | str, chars: str) -> Column:
    """Without any of the characters at the end."""
    return F.rtrim(_c(x), F.lit(chars))


def ends_sentence(x: Column | str) -> Column:
    """Whether a word ends with . ? or !, white space after it aside."""
    return F.coalesce(_c(x).rlike(r"(?U)[.?!]\s*\z"), F.lit(False))


def root(x: Column | str, trailing: str = ",.") -> Column:
    """The lower-case word up to an apostrophe: it'll -> it."""
    return F.element_at(F.split(rstrip_chars(F.lower(strip(x)), trailing), "'"), 1)


def pair_word(x: Column | str) -> Column:
    """A word as the protected pairs have it: lower case, no marks at the end, no contraction."""
    bare = rstrip_chars(F.lower(strip(x)), ".,!?;:'\"")
    return F.regexp_replace(bare, r"'(s|re|ve|m|ll|d|t)\z", "")


def is_intensified(word: Column | str) -> Column:
    """Whether the word after "so" makes it an intensifier."""
    w = _c(word)
    return w.isin(*lexicon.SO_INTENSIFIED) | (w.endswith("ly") & (F.char_length(w) > 4)) | w.rlike("(" + "|".join(lexicon.SO_SUFFIXES) + r")\z")


def is_fragile(text: Column | str) -> Column:
    """Whether a text ends with a word that binds to the next."""
    return F.coalesce(_c(text).rlike(r"(?i)(?<![\p{L}\p{M}\p{N}_])(" + "|".join(lexicon.FRAGILE) + r")\s*\z"), F.lit(False))


def srt_time(seconds: Column | str, compat: bool = False) -> Column:
    """HH:MM:SS,mmm of seconds; below 0 as 0, fractions rounded half to even.

    compat prints a fraction that rounds to a whole second as ,1000; otherwise it carries.
    """
    s = F.greatest(_c(seconds), F.lit(0.0))
    if compat:
        whole = F.floor(s)
        milli = F.bround((s - whole) * 1000).cast("long")
    else:
        total = (F.floor(s) * 1000 + F.bround((s - F.floor(s)) * 1000)).cast("long")
        whole, milli = F.floor(total / 1000), F.pmod(total, F.lit(1000))
    whole = whole.cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)), milli)


def srt_time_ms(ms: Column | str) -> Column:
    """HH:MM:SS,mmm of whole milliseconds; null for null."""
    m = F.greatest(_c(ms), F.lit(0))
    part = lambda by, mod: F.pmod(F.floor(m / by), F.lit(mod))
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(m / 3600000), part(60000, 60), part(1000, 60), F.pmod(m, F.lit(1000)))
    return F.when(_c(ms).isNotNull(), text)


def parse_srt_time(x: Column | str) -> Column:
    """Milliseconds of a timecode with comma or point; null where it is none."""
    pattern = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})$"
    part = lambda i: F.regexp_extract(_c(x), pattern, i).cast("long")
    return F.when(_c(x).rlike(pattern), part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4))


#: Ranges of the script classes; han alone is what the spacing rules know.
HAN = "一-鿿"
CJK = HAN + "㐀-䶿　-〿＀-￯"
KANA = "぀-ヿ"
HANGUL = "가-힯"
SCRIPT_OF = {"chinese": CJK, "japanese": CJK + KANA, "korean": CJK + HANGUL}


def has_cjk(x: Column | str, chars: str = CJK) -> Column:
    return F.coalesce(_c(x).rlike(f"[{chars}]"), F.lit(False))


def missed_script(text: Column | str, source: Column | str, target: str = "chinese") -> Column:
    """A translated line that has no character of the target's script though it has letters, and is a copy or three words long."""
    t, s = _c(text), _c(source)
    words = F.size(F.filter(F.split(strip(t), r"\s+"), lambda w: w != ""))
    return F.coalesce(t.isNotNull() & ~has_cjk(t, SCRIPT_OF.get(target, CJK)) & ((strip(t) == strip(s)) | (words >= 3)) & t.rlike(r"\p{L}"), F.lit(False))


def strip_template_tokens(x: Column | str) -> Column:
    return strip(F.regexp_replace(_c(x), r"<\|.*?\|>", ""))


def strip_end_marks(x: Column | str) -> Column:
    return rstrip_chars(x, "。？！.!?")


def wide_commas(x: Column | str, target: str) -> Column:
    return F.translate(_c(x), ",", "，") if target.strip().lower() in lexicon.FULLWIDTH else _c(x)


def wide_quotes(x: Column | str, target: str) -> Column:
    """Straight double quotes around text with Han characters become curly ones; an unpaired last one stays."""
    if target.strip().lower() not in lexicon.FULLWIDTH:
        return _c(x)
    parts = F.split(_c(x), '"', -1)
    n = F.size(parts)

    def around(p: Column, i: Column) -> Column:
        inside = (i % 2 == 1) & (i < n - 1)
        wide = inside & p.rlike(f"[{HAN}]")
        return F.when(i == 0, p).when(inside, F.concat(F.when(wide, F.lit("“")).otherwise(F.lit('"')), p, F.when(wide, F.lit("”")).otherwise(F.lit('"')))).when(i % 2 == 1, F.concat(F.lit('"'), p)).otherwise(p)

    return F.array_join(F.transform(parts, around), "")


def cjk_spacing(x: Column | str, mode: str = "auto") -> Column:
    """One space between Han and Latin letters or digits ('true'), none ('false'), or as it is ('auto')."""
    t = _c(x)
    if mode == "auto":
        return t
    for a, b in ((HAN, "a-zA-Z"), ("a-zA-Z", HAN), (HAN, "0-9"), ("0-9", HAN)):
        t = F.regexp_replace(t, f"([{a}])([{b}])", "$1 $2") if mode == "true" else F.regexp_replace(t, f"([{a}]) ([{b}])", "$1$2")
    return t


def post_process(x: Column | str, target: str = "chinese", add_punctuation: bool = True, spacing: str = "auto") -> Column:
    """Template tokens, final marks, commas, quotes and spacing, in this order."""
    t = strip_template_tokens(x)
    if not add_punctuation:
        t = strip_end_marks(t)
    return cjk_spacing(wide_quotes(wide_commas(t, target), target), spacing)


def char_sets(x: Column | str) -> Column:
    """The distinct characters of a stripped text; empty for an empty text."""
    t = strip(x)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(t, "")))


def char_similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the character sets; 0 if a text is empty, 1 if both hold nothing but blanks."""
    x, y = char_sets(a), char_sets(b)
    share = F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))
    return F.when((_c(a) == "") | (_c(b) == ""), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(1.0)))


def clean_output(x: Column | str) -> Column:
    """A reply up to its first remark (Note: and the like) and without bracketed lines after the first."""
    t = _c(x)
    for word in ("Note", "Explanation", "Example", "Disclaimer"):
        t = strip(F.regexp_replace(t, rf"(?is)\b{word}\s*:.*", ""))
    return strip(F.regexp_replace(t, r"\n\[.*?\].*", ""))


def strip_reasoning(x: Column | str) -> Column:
    """A reply without tagged reasoning and without prose before its first line that begins with a bracket."""
    t = _c(x)
    for tag in ("think", "reason", "reasoning"):
        t = F.regexp_replace(t, rf"(?is)<{tag}>.*?</{tag}>", "")
    t = strip(t)
    before = F.regexp_extract(t, r"(?s)\A(.*?\n)\[", 1)
    drop = (before != "") & (strip(before) != "") & ~before.rlike(r"\[.*?\]")
    return strip(F.when(drop, F.substring(t, F.char_length(before) + 1, F.char_length(t))).otherwise(t))


def min_tokens(length: Column | str, reasoning: bool = False) -> Column:
    return F.greatest(F.lit(512 if reasoning else 200), (_c(length) * 1.5).cast("int"))


def without_bom(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "^﻿", "")


def strip_ansi(x: Column | str) -> Column:
    """Without the escape sequences that colour a terminal."""
    return F.regexp_replace(_c(x), r"\x1B(?:[@-Z\\\-_]|\[[0-?]*[ -/]*[@-~])", "")
