"""One consistent form for text that looks the same, and the rows that only look the same.

Every letter stands for its class: the letters of other scripts that look like it. A token's resolved script
set is the intersection, over its letters, of the scripts their classes are written in; a token is spelled in the
script that can spell all of it. Every step looks at classes only, so that equal looks give equal spellings.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.arrow import map_column
from cuewright.llm.text import forms
from cuewright.session import cut

#: Rows of one look or spelling meet in so many parts, so that a very common one is no hot key.
SALTS = 16
#: Scripts written together, which count as one; the first word of their characters' names.
TOGETHER = {x: "CJK" for x in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "BOPOMOFO", "HANGUL", "IDEOGRAPHIC", "HALFWIDTH")}
#: Letters that look like another of their own script.
OWN_SCRIPT = {"ɑ": "a", "ɡ": "g"}
_TOKEN_RE = regex.compile(r"([\p{L}\p{M}]+)")
_LETTER_RE = regex.compile(r"\p{L}")


@lru_cache(maxsize=65536)
def script_of(letter: str) -> str:
    word = unicodedata.name(letter, "UNKNOWN").split(" ")[0]
    return TOGETHER.get(word, word)


def letters() -> list[str]:
    """Every letter that compatibility forms leave as it is."""
    some = (chr(c) for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000)
    return [c for c in some if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c) == c]


def confusables(spark: SparkSession) -> dict[str, str]:
    """The public table of confusable characters, as the Unicode library among Spark's own jars holds it: letter -> prototype."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    some = letters()
    return dict(zip(some, checker.getSkeleton("\n".join(some)).split("\n")))


def read_confusables(path: str) -> dict[str, str]:
    """The same from a file in the form of the published confusables.txt: code ; code ... ; type # comment."""
    found = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            part = line.split("#")[0].split(";")
            if len(part) >= 2:
                found["".join(chr(int(x, 16)) for x in part[0].split())] = "".join(chr(int(x, 16)) for x in part[1].split())
    return {c: found.get(c, c) for c in letters()}


def look_alikes(prototypes: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Each letter with the letters, one a script, that look like it; letters without any are left out.

    Letters are alike if they share their prototype and case; caseless ones join where only one case has it. Within a
    script letters stay apart (the one that is the prototype, else the first, stands for its script), as do letters that read
    from right to left, whose shapes join, and those of the East Asian scripts, which are written together; a difference of case, accent or digit is none of look.
    """
    groups: dict[str, dict[str, list[str]]] = {}
    for c, p in prototypes.items():
        if unicodedata.bidirectional(c) == "L" and unicodedata.normalize("NFD", c) == c and script_of(c) != "CJK":
            k = unicodedata.category(c)
            groups.setdefault(p, {}).setdefault(k if k in ("Lu", "Ll") else "Lo", []).append(c)
    out: dict[str, tuple[str, ...]] = {}
    for p, by in groups.items():
        cased = [k for k in ("Lu", "Ll") if k in by]
        if "Lo" in by and len(cased) <= 1:
            by = {cased[0] if cased else "Lo": [c for k in [*cased, "Lo"] for c in by[k]]}
        for some in by.values():
            of: dict[str, str] = {}
            for c in sorted(some, key=lambda c: (c != p, c)):
                of.setdefault(script_of(c), c)
            if len(of) > 1:
                for c in of.values():
                    out[c] = tuple(sorted(of.values(), key=lambda c: (script_of(c) != "LATIN", script_of(c))))
    return out


def foreign_letters(alike: dict[str, tuple[str, ...]]) -> str:
    """All letters of the other scripts that have twins of Latin ones or of each other; a text without any is spelled as it is."""
    scripts = {script_of(c) for c in alike} - {"LATIN"}
    return "".join([c for c in letters() if script_of(c) in scripts] + list(OWN_SCRIPT))


class Spelling:
    """Spells texts consistently by a table of look-alikes."""

    def __init__(self, alike: dict[str, tuple[str, ...]], foreign: str | None = None):
        self.of = {c: {script_of(x): x for x in cs} for c, cs in alike.items()}
        self.first = {ord(c): cs[0] for c, cs in alike.items()} | {ord(k): v for k, v in OWN_SCRIPT.items()}
        self.foreign = frozenset(foreign_letters(alike) if foreign is None else foreign)
        self.resolved = lru_cache(maxsize=65536)(self._resolved)
        self.spelled = lru_cache(maxsize=65536)(self._spelled)

    def skeleton(self, text: str) -> str:
        """What texts share exactly when they look the same: forms() with every letter as the first of its class."""
        t = forms(text).strip()
        if t.isascii() or self.foreign.isdisjoint(t):
            return t
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(self.first))

    def scripts(self, token: str) -> frozenset[str]:
        """The scripts in which the whole token can be written; empty if it mixes scripts and no one can spell it."""
        return self.resolved(unicodedata.normalize("NFD", token).translate(self.first))[0]

    def _resolved(self, token: str) -> tuple[frozenset[str], str | None]:
        """Of a token of classes: its scripts, and the script of most of its letters that have no twin."""
        left: frozenset[str] | None = None
        own: dict[str, int] = {}
        for c in token:
            if c in self.of:
                may = frozenset(self.of[c])
            elif _LETTER_RE.match(c):
                s = script_of(c)
                may = frozenset((s,))
                own[s] = own.get(s, 0) + 1
            else:
                continue
            left = may if left is None else left & may
        return left or frozenset(), min(own, key=lambda s: (-own[s], s)) if own else None

    def _spelled(self, token: str, script: str) -> str:
        return "".join(self.of[c].get(script, c) if c in self.of else c for c in token)

    def consistent(self, text: str) -> str:
        """One spelling of a text: forms(), then every token in the one script that can spell all of it.

        Where several can, the script that most of the text's tokens can only be written in decides, else Latin. A token
        that no script can spell takes that of most of its letters without a twin.
        """
        t = forms(text).strip()
        if t.isascii() or self.foreign.isdisjoint(t):
            return t
        tokens = _TOKEN_RE.split(unicodedata.normalize("NFD", t).translate(self.first))
        votes: dict[str, int] = {"LATIN": 0}
        for x in tokens[1::2]:
            may, _ = self.resolved(x)
            if len(may) == 1:
                (s,) = may
                votes[s] = votes.get(s, 0) + len(x)
        main = min(votes, key=lambda s: (-votes[s], s != "LATIN", s))
        for i in range(1, len(tokens), 2):
            may, most = self.resolved(tokens[i])
            if not may:
                to = most or main
            else:
                to = main if main in may else "LATIN" if "LATIN" in may else min(may)
            tokens[i] = self.spelled(tokens[i], to)
        return unicodedata.normalize("NFC", "".join(tokens))


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def consistent_form(df: DataFrame, text: str = "text", alike: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds `consistent` (the text in one consistent spelling), `look` and `own` (128-bit hashes of that spelling and of the text).

    Rows with equal `look` look the same when displayed; nulls give nulls. alike: a table as of
    look_alikes(), by default of the confusable characters that come with Spark (some thousand letters, sent to every task).
    """
    alike = look_alikes(confusables(df.sparkSession)) if alike is None else alike
    foreign = foreign_letters(alike)

    def made(texts: list, spelling: Spelling) -> list[list]:
        found = [None if t is None else spelling.consistent(t) for t in texts]
        return [found, [None if t is None else _hash(t) for t in found], [None if t is None else _hash(t) for t in texts]]

    fields = [T.StructField("consistent", T.StringType()), T.StructField("look", T.BinaryType()), T.StructField("own", T.BinaryType())]
    names = [f.name for f in fields]
    return map_column(df, text, fields, made, keep=[c for c in df.columns if c not in names], prepare=lambda: Spelling(alike, foreign))


def _looks(df: DataFrame, key: str, text: str, alike) -> DataFrame:
    """Keys with the hashes of look and text, once each, without null keys and texts that show nothing; a checkpoint."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & (F.trim("t") != ""))
    return cut(consistent_form(rows, "t", alike).where(F.col("consistent") != "").select("k", "look", "own").distinct())


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _to_every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def same_look_pairs(df: DataFrame, key: str, text: str = "text", alike: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose texts look the same but differ as strings.

    Null, empty and blank texts are left out. Exact copies are never compared with one another: the
    spellings of a look are paired first (usually two or three), rows join to these pairs by spelling in salted parts, so
    work follows the size of the result. Repeated rows of a key count once; null keys have no pair. Normalises all texts when
    called (one checkpoint of keys and hashes).
    """
    rows = _looks(df, key, text, alike)  # read three times
    spellings = rows.groupBy("look", "own").agg(F.lit(1).alias("one"))
    several = spellings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    spellings = spellings.join(several, "look").select("look", "own")
    a, b = spellings.withColumnRenamed("own", "own_a"), spellings.withColumnRenamed("own", "own_b")
    pairs = a.join(b, "look").where("own_a <> own_b").select("own_a", "own_b")
    left = _salted(rows.select(F.col("k").alias("a"), F.col("own").alias("own_a")), "a")
    right = rows.select(F.col("k").alias("b"), F.col("own").alias("own_b"))
    half = _to_every_salt(pairs).join(left, ["own_a", "_salt"]).drop("_salt")
    return _to_every_salt(half).join(_salted(right, "b"), ["own_b", "_salt"]).where("a < b").select("a", "b").distinct()


def same_look_links(df: DataFrame, key: str, text: str = "text", alike: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The same without pairs: key, look, copies (other keys with the very same text), links (keys that only look the same).

    One row per key and text; its size is that of the input, however many texts look the same. Left out are
    the rows that same_look_pairs leaves out.
    """
    rows = _looks(df, key, text, alike)
    spelled = rows.groupBy("look", "own").agg(F.count("*").alias("_own"))
    looks = spelled.groupBy("look").agg(F.sum("_own").alias("_all"))
    sizes = _to_every_salt(spelled.join(looks, "look"))
    got = _salted(rows, "k").join(sizes, ["look", "own", "_salt"])
    return got.select(F.col("k").alias(key), F.hex("look").alias("look"), (F.col("_own") - 1).alias("copies"), (F.col("_all") - F.col("_own")).alias("links"))
