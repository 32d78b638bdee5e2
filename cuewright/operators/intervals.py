"""Merging of overlapping intervals and the gaps between them, by dyadic blocks.

Every interval belongs to the chunk of 2**18 ms in which it begins, and is cut at that chunk's end. Inside a
chunk the intervals are decomposed into canonical dyadic blocks; blocks below a covering block are removed,
sibling pairs are merged upward and adjacent blocks are coalesced (all in numpy, for many chunks at once). What
reaches beyond a chunk is one number, the latest end so far, carried over the chunks that hold anything; so an
interval costs the same whatever its length. Each chunk then hands only its first and last run to the next level,
where 4096 sibling chunks are put together, and so on: no task ever sees a whole source, and a source of any
length needs three small further levels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.operators.keys import TAKE, carried, ms
from cuewright.session import cut

CHUNK_BITS = 18
LEVEL_BITS = 12
TOP_BITS = 54
#: Whole milliseconds up to here are exact in a double; nothing beyond is a time.
LATEST = 2**53
#: Intervals handled by numpy at once.
SLICE = 200_000


def dyadic_union(start: np.ndarray, end: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of integer intervals [start, end) as sorted disjoint runs.

    No interval may cross a multiple of 2**top, and runs are not joined across one.
    """
    levels: list[np.ndarray] = []
    lo, hi = start.astype(np.int64), end.astype(np.int64)
    for level in range(top + 1):
        live = lo < hi
        lo, hi = lo[live], hi[live]
        if level == top:
            found = lo
        else:
            left, right = (lo & 1) == 1, (hi & 1) == 1
            found = np.concatenate([lo[left], hi[right] - 1])
            lo, hi = (lo + left) >> 1, (hi - right) >> 1
        levels.append(np.unique(found))
    for level in range(top - 1, -1, -1):  # what an ancestor covers goes
        own = levels[level]
        for above in range(level + 1, top + 1):
            if not len(own):
                break
            if len(levels[above]):
                up = own >> (above - level)
                at = np.minimum(np.searchsorted(levels[above], up), len(levels[above]) - 1)
                own = own[levels[above][at] != up]
        levels[level] = own
    for level in range(top):  # two siblings make their parent
        own = levels[level]
        pair = np.flatnonzero((own[:-1] & 1 == 0) & (own[1:] == own[:-1] + 1))
        if len(pair):
            levels[level + 1] = np.union1d(levels[level + 1], own[pair] >> 1)
            keep = np.ones(len(own), bool)
            keep[pair] = keep[pair + 1] = False
            levels[level] = own[keep]
    s = np.concatenate([b << k for k, b in enumerate(levels)])
    e = np.concatenate([(b + 1) << k for k, b in enumerate(levels)])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != e[:-1]) | (s[1:] & ((1 << top) - 1) == 0)
    last = np.roll(first, -1)
    return s[first], e[last]


def _runs_of_chunks(batches):
    """Per row the runs of the chunk's pieces, in the chunk's own coordinates."""
    for batch in batches:
        col = batch.column("pieces")
        offsets = col.offsets.to_numpy() - col.offsets[0].as_py()
        flat = col.flatten()
        s, e = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        group = np.repeat(np.arange(len(col)), np.diff(offsets))
        base = group << CHUNK_BITS
        s, e = s + base, e + base
        out_s, out_e = [], []
        row = 0
        while row < len(col):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
            part = slice(offsets[row], offsets[stop])
            a, b = dyadic_union(s[part], e[part], CHUNK_BITS)
            out_s.append(a)
            out_e.append(b)
            row = stop
        rs = np.concatenate(out_s) if out_s else np.empty(0, np.int64)
        re_ = np.concatenate(out_e) if out_e else np.empty(0, np.int64)
        of = rs >> CHUNK_BITS
        at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(col)))]).astype(np.int32)
        start = batch.column("chunk").to_numpy(zero_copy_only=False).astype(np.int64)[of] << CHUNK_BITS
        runs = pa.StructArray.from_arrays([rs - (of << CHUNK_BITS) + start, re_ - (of << CHUNK_BITS) + start], ["f", "t"])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in batch.schema.names if n != "pieces"), pa.ListArray.from_arrays(pa.array(at), runs)],
            names=[*(n for n in batch.schema.names if n != "pieces"), "runs"],
        )


def _stitch(batches):
    """Puts the nodes of sibling chunks together; what lies between a node's first and last run is final.

    A node is the first and the last run of a stretch of time; their inside is settled already.
    """
    for batch in batches:
        names = [n for n in batch.schema.names if n != "nodes"]
        periods, gaps, nodes = [], [], []
        for group in batch.column("nodes").to_pylist():
            group.sort(key=lambda n: n["af"])
            done, between = [], []
            head = tail = None  # the first and the latest run; head is tail while there is one run only
            for n in group:
                first, last, single = [n["af"], n["at"]], [n["bf"], n["bt"]], n["af"] == n["bf"]
                if tail is None:
                    head, tail = first, first if single else last
                    continue
                if first[0] <= tail[1]:  # goes on across the chunk's edge
                    tail[1] = max(tail[1], first[1])
                    if single:
                        continue
                    if tail is not head:
                        done.append(tuple(tail))
                    tail = last
                else:
                    between.append((tail[1], first[0]))
                    if tail is not head:
                        done.append(tuple(tail))
                    if not single:
                        done.append(tuple(first))
                        tail = last
                    else:
                        tail = first
            periods.append([{"f": f, "t": t} for f, t in done])
            gaps.append([{"f": f, "t": t} for f, t in between])
            nodes.append({"af": head[0], "at": head[1], "bf": tail[0], "bt": tail[1]})
        run = pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())]))
        node = pa.struct([(c, pa.int64()) for c in ("af", "at", "bf", "bt")])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(periods, run), pa.array(gaps, run), pa.array(nodes, node)],
            names=[*names, "periods", "gaps", "node"],
        )


def periods_and_gaps(df: DataFrame, keys: list[str], start_ms: str, end_ms: str, max_silence_ms: int = 0) -> DataFrame:
    """Continuous periods and the gaps between them, per keys.

    Input: intervals [start_ms, end_ms) in whole ms; rows with a null bound, a negative start or an
    end not after the start are not intervals and are left out, as is anything beyond 2**53 ms, where
    doubles have no whole milliseconds.
    Intervals at most max_silence_ms apart belong to one period. Result: keys, kind ('period' or
    'gap'), from_ms, to_ms. Repeated rows change nothing; null keys form a source; an empty
    table gives an empty result. Runs the decomposition when called (two checkpoints of the runs of chunks).
    """
    run = T.ArrayType(T.StructType([T.StructField("f", T.LongType()), T.StructField("t", T.LongType())]))
    key_fields = [df.schema[k] for k in keys]
    chunk = T.StructField("chunk", T.LongType())
    s, e = F.col("_s"), F.col("_e")
    wide = (
        df.select(*keys, F.col(start_ms).cast("long").alias("_s"), F.col(end_ms).cast("long").alias("_e"))
        .where((s >= 0) & (e > s) & (e <= LATEST))
        .groupBy(*keys, "_s")
        .agg((F.max("_e") + max_silence_ms).alias("_e"))
    )
    size = 1 << CHUNK_BITS
    c = F.col("chunk")
    pieces = (
        wide.withColumn("chunk", F.shiftright(s, CHUNK_BITS))
        .groupBy(*keys, "chunk")
        .agg(
            F.collect_list(F.struct((s - c * size).cast("int").alias("s"), F.least(e - c * size, F.lit(size)).cast("int").alias("e"))).alias("pieces"),
            F.max("_e").alias("upto"),
        )
    )
    upto = T.StructField("upto", T.LongType())
    runs = cut(pieces.mapInArrow(_runs_of_chunks, T.StructType([*key_fields, chunk, upto, T.StructField("runs", run)])))
    # what earlier chunks reach into this one joins its runs; what reaches beyond this one prolongs its last
    begin = c * size
    into = F.coalesce(F.greatest(F.col("carried"), begin), begin)
    covered = F.least(into, begin + size)
    left = F.filter("runs", lambda r: r.t > covered)
    touches = F.coalesce(F.get(left, F.lit(0)).f <= covered, F.lit(False))
    pair = lambda f, t: F.struct(f.alias("f"), t.alias("t"))
    joined = F.when(into <= begin, F.col("runs")).when(touches, F.concat(F.array(pair(begin, F.get(left, F.lit(0)).t)), F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0))))).otherwise(F.concat(F.array(pair(begin, covered)), left))
    farthest = F.greatest("upto", into)
    longer = F.concat(F.slice("runs", F.lit(1), F.size("runs") - 1), F.array(pair(F.element_at("runs", -1).f, farthest)))
    runs = carried(runs, keys, "chunk", "upto", best=F.max).withColumn("runs", joined)
    runs = runs.select(*keys, "chunk", F.when(farthest > begin + size, longer).otherwise(F.col("runs")).alias("runs"))
    first, last = F.col("runs")[0], F.element_at("runs", -1)
    nodes = F.struct(first.f.alias("af"), first.t.alias("at"), last.f.alias("bf"), last.t.alias("bt"))
    level = runs.select(
        *keys,
        "chunk",
        nodes.alias("node"),
        F.when(F.size("runs") > 2, F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 2, F.lit(0)))).alias("periods"),
        F.transform(
            F.slice("runs", F.lit(2), F.size("runs")),
            lambda x, i: F.struct(F.get("runs", i).t.alias("f"), x.f.alias("t")),
        ).alias("gaps"),
    )
    node = T.StructType([T.StructField(n, T.LongType()) for n in ("af", "at", "bf", "bt")])
    schema = T.StructType([*key_fields, chunk, T.StructField("periods", run), T.StructField("gaps", run), T.StructField("node", node)])
    level = cut(level)  # each level is read twice; the runs are few, the decomposition is not cheap
    found = []
    for _ in range(CHUNK_BITS, TOP_BITS, LEVEL_BITS):
        found.append(level.select(*keys, "periods", "gaps"))
        level = (
            level.groupBy(*keys, F.shiftright("chunk", LEVEL_BITS).alias("chunk"))
            .agg(F.collect_list("node").alias("nodes"))
            .mapInArrow(_stitch, schema)
        )
    found.append(level.select(*keys, "periods", "gaps"))
    n = F.col("node")
    ends = F.when(n.af == n.bf, F.array(F.struct(n.af.alias("f"), n.at.alias("t")))).otherwise(
        F.array(F.struct(n.af.alias("f"), n.at.alias("t")), F.struct(n.bf.alias("f"), n.bt.alias("t")))
    )
    found.append(level.select(*keys, ends.alias("periods"), F.lit(None).cast(run).alias("gaps")))

    out = None
    for part in found:
        both = part.select(
            *keys,
            F.explode(
                F.concat(
                    F.transform(F.coalesce("periods", F.array().cast(run)), lambda x: F.struct(F.lit("period").alias("kind"), x.f.alias("f"), (x.t - max_silence_ms).alias("t"))),
                    F.transform(F.coalesce("gaps", F.array().cast(run)), lambda x: F.struct(F.lit("gap").alias("kind"), (x.f - max_silence_ms).alias("f"), x.t.alias("t"))),
                )
            ).alias("x"),
        ).select(*keys, "x.kind", F.col("x.f").alias("from_ms"), F.col("x.t").alias("to_ms"))
        out = both if out is None else out.unionByName(both)
    return out


def speech_periods(words: DataFrame, max_silence_ms: int = 1000, keys: list[str] = TAKE) -> DataFrame:
    """Periods of speech of every take and the silences between them, from word times in seconds."""
    timed = words.where((F.col("start") >= 0) & (F.col("end") > F.col("start")) & ~F.isnan("end"))
    timed = timed.select(*keys, ms("start").alias("s_ms"), ms("end").alias("e_ms"))
    # a word shorter than half a millisecond still speaks at its start
    timed = timed.withColumn("e_ms", F.greatest("e_ms", F.col("s_ms") + 1))
    return periods_and_gaps(timed, keys, "s_ms", "e_ms", max_silence_ms)
