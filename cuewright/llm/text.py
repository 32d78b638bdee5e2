"""Character classes and normal forms shared by the operators of this subpackage (plain Python, no Spark)."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Characters that show nothing.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
INVISIBLE_RE = regex.compile(f"[{INVISIBLE}]+")
#: Sentence-final marks, and marks that close after them.
FINAL = ".!?…。！？．｡।॥؟۔‼⁇-⁉"
CLOSERS = "\"'’”“»›」』＂＇)\\]）】》"
OPENERS = "\"'‘“„«‹「『¿¡(\\[（【《"
FINAL_RE = regex.compile(f"[{FINAL}]")
ENDED_RE = regex.compile(f"[{FINAL}][{CLOSERS}\\s]*\\Z")
#: Scripts written without spaces between words.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
UNSPACED_RE = regex.compile(f"[{UNSPACED}]")
LETTER_RE = regex.compile(r"[\p{L}\p{M}]")
LETTERS_RE = regex.compile(r"[\p{L}\p{M}]+")
ASCII_WORD_RE = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)*")
WORD_RE = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*")


def forms(text: str) -> str:
    """Compatibility form without invisible characters: full-width, ligatures, combining accents and odd spaces made ordinary."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFKC", INVISIBLE_RE.sub("", unicodedata.normalize("NFKC", text)))


#: Structure of subtitle files and numbered lines: timecode lines, number lines, leading line numbers.
TIMECODE_RE = re.compile(r"\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}(?:\s*-->\s*\d{1,2}:\d{2}:\d{2}[.,]\d{1,3})?")
NUMBER_LINE_RE = re.compile(r"(?m)^[ \t]*(?:\[?\d+\]?|#\d+)[ \t]*\r?$")
LINE_NUMBER_RE = re.compile(r"(?m)^[ \t]*(?:\[\d+(?:-\d+)?\]|#?\d+[.:)\]](?=\s))[ \t]*")


DIGIT_RE = re.compile(r"\d")


def without_structure(text: str) -> str:
    """Text without subtitle numbers, timecodes and line numbers."""
    if not DIGIT_RE.search(text):
        return text
    t = NUMBER_LINE_RE.sub("", TIMECODE_RE.sub("", text) if ":" in text else text)
    return LINE_NUMBER_RE.sub("", t)


def letter_count(text: str) -> int:
    return sum(map(len, LETTERS_RE.findall(text)))


def unspaced(text: str) -> bool:
    """Whether most of the text's letters belong to scripts without spaces between words."""
    if text.isascii() or not UNSPACED_RE.search(text):
        return False
    letters = letter_count(text)
    return letters > 0 and 2 * len(UNSPACED_RE.findall(text)) > letters
