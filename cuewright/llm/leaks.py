"""Evaluation texts leaking into training text: one Aho-Corasick automaton over all passages."""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.text import UNSPACED, UNSPACED_RE, forms, unspaced, without_structure

WORDS = 12
CHARS = 24
#: Characters of items whose text one broadcast holds, and whose passages one automaton holds (about 350 bytes each);
#: beyond them items go into several groups, and a group's passages into several automata, one after the other.
GROUP_CHARS, AUTOMATON_CHARS = 10_000_000, 1_000_000
TOKEN_RE = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Apostrophes and hyphens inside a word join it.
JOINED_RE = regex.compile(r"(?<=\p{L}\p{M}*)['’‘ʼ\-‐‑](?=\p{L})")
CLUSTER_RE = regex.compile(r"\X", regex.DOTALL)
BETWEEN_RE = regex.compile(rf"(?<=[{UNSPACED}]) (?=[{UNSPACED}])")


def plain(text: str) -> str:
    """Lower-case words and digits with one space between; no space between characters of unspaced scripts."""
    t = " ".join(TOKEN_RE.findall(JOINED_RE.sub("", forms(without_structure(text)).casefold())))
    return BETWEEN_RE.sub("", t)


def passages(text: str, words: int = WORDS, chars: int = CHARS) -> set[str]:
    """Every passage of the item that counts as a leak: so many words, or characters where words are not spaced."""
    p = plain(text)
    if unspaced(p):
        p = p.replace(" ", "")
        return {p[i : i + chars] for i in range(len(p) - chars + 1)}
    w = p.split(" ")
    return {" ".join(w[i : i + words]) for i in range(len(w) - words + 1)}


def _automaton(items: list[tuple[int, str]], words: int, chars: int, part: int = 0, parts: int = 1) -> ahocorasick.Automaton:
    """Of the passages whose hash falls to the part, so that one long item, too, is spread over all parts."""
    owners: dict[str, set[int]] = {}
    for item, text in items:
        for p in passages(text or "", words, chars):
            if parts == 1 or zlib.crc32(p.encode("utf-8", "surrogatepass")) % parts == part:
                owners.setdefault(p, set()).add(item)
    found = ahocorasick.Automaton()
    for p, ids in owners.items():
        found.add_word(p, (len(p), tuple(sorted(ids))))
    if owners:
        found.make_automaton()
    return found


def _automata(items: list[tuple[int, str]], words: int, chars: int, part: int = 0, parts: int = 1) -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of items in spaced words, for plain texts; of unspaced items, for plain texts without any blank."""
    tight = [x for x in items if unspaced(plain(x[1] or ""))]
    loose = [x for x in items if not unspaced(plain(x[1] or ""))]
    return _automaton(loose, words, chars, part, parts), _automaton(tight, words, chars, part, parts)


#: The automata of the last part a worker scanned with: tasks of one part share them.
_BUILT: dict = {}


def _needs_unspaced(tight: ahocorasick.Automaton) -> bool:
    """Whether every passage holds a character of an unspaced script, so that a document without any holds none of them."""
    return all(UNSPACED_RE.search(p) for p in tight.keys())


def _built(name: tuple, items: list, words: int, chars: int, part: int, parts: int):
    if _BUILT.get("name") != name:
        _BUILT.clear()
        loose, tight = _automata(items, words, chars, part, parts)
        _BUILT.update(name=name, automata=(loose, tight, _needs_unspaced(tight)))
    return _BUILT["automata"]


@lru_cache(maxsize=65536)
def _kept(cluster: str) -> str:
    return "".join(c for c in forms(cluster).casefold() if TOKEN_RE.match(c))


def original_span(text: str, passage: str) -> tuple[int, int] | None:
    """Where in the original text a passage of its plain form begins and ends.

    The text is normalised cluster by cluster; only documents with a find pay for this. None where the plain form of the whole
    differs from that of its clusters.
    """
    marks = [m.span() for r in _STRUCTURE for m in r.finditer(text)]
    hidden = bytearray(len(text))
    for a, b in marks:
        hidden[a:b] = b"\1" * (b - a)
    at, upto, made = [], [], []
    a = 0
    for cluster in text if text.isascii() else CLUSTER_RE.findall(text):  # accents written apart are normalised with their letter
        b = a + len(cluster)
        if not hidden[a]:
            for c in _kept(cluster):
                made.append(c)
                at.append(a)
                upto.append(b)
        a = b
    flat, want = "".join(made), passage.replace(" ", "")
    k = flat.find(want)
    return None if k < 0 else (at[k], upto[k + len(want) - 1])


from cuewright.llm.text import LINE_NUMBER_RE, NUMBER_LINE_RE, TIMECODE_RE  # noqa: E402

_STRUCTURE = (TIMECODE_RE, NUMBER_LINE_RE, LINE_NUMBER_RE)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", words: int = WORDS, chars: int = CHARS, group_chars: int = GROUP_CHARS, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Documents that hold a passage of an evaluation item: doc_key, item_key, first_at, first_to, passages.

    first_at and first_to are offsets of the first passage in the original text (null where none maps back); passages counts
    distinct passages found. The evaluation set goes to the tasks in groups of bounded size (GROUP_CHARS), their passages in automata
    of bounded size (AUTOMATON_CHARS); a set of usual size is one of each, and documents are then scanned once, without any
    shuffle of texts. Null texts and items shorter than a passage find nothing; null keys of documents are kept as such.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_key).alias("i"), F.col(text).alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull()).distinct()
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-size // group_chars))
    found = None
    for g in range(groups):
        some = known if groups == 1 else known.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        rows = [(r.i, r.t) for r in some.collect()]  # about group_chars characters
        given = spark.sparkContext.broadcast(rows)
        parts = max(1, -(-sum(len(t) for _, t in rows) // automaton_chars))
        for part in range(parts):
            one = _scan(docs, items, given, uuid.uuid4().hex, doc_key, item_key, text, words, chars, part, parts)
            found = one if found is None else found.unionByName(one)
    first = F.min(F.when(F.col("first_at").isNotNull(), F.struct("first_at", "first_to"))).alias("_f")
    merged = found.distinct().groupBy(doc_key, item_key).agg(first, F.sum("passages").alias("passages"))
    return merged.select(doc_key, item_key, F.col("_f.first_at").alias("first_at"), F.col("_f.first_to").alias("first_to"), "passages")


def _scan(docs: DataFrame, items: DataFrame, given, name: str, doc_key: str, item_key: str, text: str, words: int, chars: int, part: int, parts: int) -> DataFrame:
    """One pass over all documents with the automata of one part of the passages of a group of items."""
    key, item = docs.schema[doc_key], items.schema[item_key]
    long = lambda n: T.StructField(n, T.LongType())
    schema = T.StructType([T.StructField(doc_key, key.dataType), T.StructField(item_key, item.dataType), long("first_at"), long("first_to"), long("passages")])

    def scan(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        loose, tight, needs = _built((name, part), given.value, words, chars, part, parts)
        as_schema = to_arrow_schema(schema)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            if len(loose) or len(tight):
                for doc, value in zip(b.column(doc_key).to_pylist(), b.column(text).to_pylist()):
                    if not value:
                        continue
                    p = f" {plain(value)} "
                    hits: dict = {}
                    for end, (n, ids) in loose.iter(p) if len(loose) else ():
                        a, z = p[end - n], p[end + 1] if end + 1 < len(p) else " "
                        found = p[end - n + 1 : end + 1]
                        if " " in found and (a != " " or z != " "):
                            continue  # inside a longer word
                        for i in ids:
                            hits.setdefault(i, {}).setdefault(found, end)
                    p = p.replace(" ", "")
                    for end, (n, ids) in tight.iter(p) if len(tight) and not (needs and (p.isascii() or not UNSPACED_RE.search(p))) else ():
                        for i in ids:
                            hits.setdefault(i, {}).setdefault(p[end - n + 1 : end + 1], end)
                    for i, of in hits.items():
                        first = min(of, key=of.get)
                        lo, hi = original_span(value, first) or (None, None)
                        for col, v in zip(out, (doc, i, lo, hi, len(of))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, as_schema)], schema=as_schema)

    return docs.select(doc_key, text).mapInArrow(scan, schema)
