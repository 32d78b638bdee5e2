"""Filling containers of a fixed capacity with texts measured in tokens: minimum bin slack.

Only the number of items of each length matters for a filling, and lengths lie between 1 and the
capacity; so the fillings are found on the driver from a table of at most `capacity` counts. Per
filling the largest length left is taken, and a subset-sum table kept as a bitset over the lengths
still available finds the fullest combination with it; that combination is then used as often as the
counts allow. Items are handed to the places of the fillings by their rank among items of their
length, in parallel.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
#: Vocabulary of a public tokenizer, as ranks; a parameter, never part of this repository.
TOKENIZER = os.environ.get("CUEWRIGHT_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how that kind of tokenizer cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranks are counted in salted parts of each length, so that a very common length is no hot key: one part per so many
#: pieces in all, within these bounds.
PER_SALT, SALTS = 1_000_000, (64, 4096)


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds `tokens`, the length of the text in tokens of the given vocabulary; 0 for null and empty texts."""
    keep = [c for c in df.columns if c not in (text, "tokens")]
    made = T.StructType([df.schema[c] for c in keep] + [T.StructField("tokens", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int32())], names=[*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, made)


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """How often each filling is used, and how many items of each length it holds; every item is used once."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    out: list[tuple[int, dict[int, int]]] = []
    while left:
        big = max(left)
        filling = {big: 1}
        room = capacity - big
        if room:
            for n, k in _fullest({n: c - (n == big) for n, c in left.items() if n <= room and c - (n == big) > 0}, room).items():
                filling[n] = filling.get(n, 0) + k
        times = min(left[n] // k for n, k in filling.items())
        out.append((times, filling))
        for n, k in filling.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _fullest(left: dict[int, int], room: int) -> dict[int, int]:
    """The items that fill the room best: bit s of the set says that s can be reached."""
    reached, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for n in sorted(left, reverse=True):
        many, k = min(left[n], room // n), 1
        while many:  # 1, 2, 4, ... of the length at a time
            k = min(k, many)
            steps.append((n, k, reached))
            reached |= (reached << (n * k)) & mask
            many -= k
            k *= 2
        if reached >> room & 1:
            break
    best = reached.bit_length() - 1
    chosen: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            chosen[n] = chosen.get(n, 0) + k
            best -= n * k
    return chosen


def pack(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every text's place: key, digest, piece, tok_from, tok_to, tokens, bin.

    A text is split, into pieces of the capacity and a rest, only if it exceeds the capacity. No bin holds
    more than the capacity. Texts of 0 tokens take no room and get bin null; repeated rows of a key are
    packed once; rows of one key, or of none, whose texts differ are all packed, told apart by digest (MD5 of the text, null for
    null). Runs token counting when called (one checkpoint).
    """
    from cuewright.session import cut

    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    named = df.select(key, F.md5(text).alias("digest"), F.col(text).alias("_text"))
    sized = cut(token_counts(named, "_text", tokenizer).groupBy(key, "digest").agg(F.min("tokens").alias("tokens")))
    parts = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    pieces = sized.select(key, "digest", "tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    lo = F.col("piece") * capacity
    pieces = pieces.select(key, "digest", "piece", lo.alias("tok_from"), F.least(lo + capacity, F.col("tokens")).alias("tok_to"))
    salts = int(min(max(sized.count() // PER_SALT, SALTS[0]), SALTS[1]))
    pieces = pieces.withColumn("tokens", F.col("tok_to") - F.col("tok_from")).withColumn("_salt", F.pmod(F.xxhash64(key, "digest", "piece"), F.lit(salts)).cast("int"))
    salted = pieces.groupBy("tokens", "_salt").agg(F.count("*").alias("n")).toArrow()  # at most capacity x salts rows
    table = np.zeros((capacity + 1, salts), np.int64)
    table[salted.column("tokens").to_numpy(), salted.column("_salt").to_numpy()] = salted.column("n").to_numpy()
    starts = np.cumsum(table, axis=1) - table
    used = fillings({n: int(c) for n, c in enumerate(table.sum(axis=1)) if n and c}, capacity)
    # per length: from which rank on, the bin it goes to, and how many of the length a bin of that filling takes
    places: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    bins = 0
    for times, filling in used:
        for n, k in filling.items():
            places.setdefault(n, []).append((taken.get(n, 0), bins, k))
            taken[n] = taken.get(n, 0) + k * times
        bins += times
    given = df.sparkSession.sparkContext.broadcast((starts, {n: tuple(np.array(x) for x in zip(*p)) for n, p in places.items()}))
    rank = F.row_number().over(W.partitionBy("tokens", "_salt").orderBy(key, "digest", "piece")) - 1
    ranked = pieces.withColumn("_rank", rank)
    made = T.StructType([df.schema[key], *(ranked.schema[c] for c in ("digest", "piece", "tok_from", "tok_to", "tokens")), T.StructField("bin", T.LongType())])

    def run(batches):
        import pyarrow as pa

        starts, places = given.value
        for b in batches:
            n, salt, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "_salt", "_rank"))
            r = r + starts[n, salt]
            at = np.full(len(n), -1, np.int64)
            for length in np.unique(n):
                if length:
                    rows = np.flatnonzero(n == length)
                    first, base, each = places[int(length)]
                    i = np.searchsorted(first, r[rows], "right") - 1
                    at[rows] = base[i] + (r[rows] - first[i]) // each[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "digest", "piece", "tok_from", "tok_to", "tokens")), pa.array(at, pa.int64(), mask=at < 0)], names=made.names)

    return ranked.mapInArrow(run, made)
