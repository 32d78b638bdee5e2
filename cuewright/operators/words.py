"""Words: extraction from alignment results, repair of inflated times, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.text import strip
from cuewright.operators.keys import TAKE, blocks, join_on, ms, once, spread_over_blocks
from cuewright.operators.ordered import BLOCK, dense, neighbours, running_sum
from cuewright.session import cut

#: Segments above this probability of holding no speech are dropped.
NO_SPEECH = 0.60
#: The schema of an alignment result, one row per media.
ALIGNED = (
    "media_id string, language string, segments array<struct<text string, start double, end double, no_speech_prob double,"
    " words array<struct<word string, text string, start double, end double>>>>"
)


def aligned_words(results: DataFrame) -> DataFrame:
    """Words of nested alignment results: media_id, idx, seg_idx, start, end, text.

    Segments over the no-speech limit are dropped but still count for seg_idx; a word's text is its field
    `word`, or `text` where that is null or empty; words without start or with blank text are dropped; an
    end may be missing. Null segments and words give no rows.
    """
    seg = results.select("media_id", F.posexplode("segments").alias("seg_idx", "s")).where(F.coalesce(F.col("s.no_speech_prob"), F.lit(0.0)) <= NO_SPEECH)
    w = seg.select("media_id", "seg_idx", F.posexplode("s.words").alias("n", "w"))
    w = w.select("media_id", "seg_idx", "n", F.col("w.start").alias("start"), F.col("w.end").alias("end"), strip(F.coalesce(F.nullif(F.col("w.word"), F.lit("")), F.col("w.text"), F.lit(""))).alias("text"))
    w = w.where(F.col("start").isNotNull() & (F.col("text") != ""))
    return _numbered(w).select("media_id", "idx", "seg_idx", "start", "end", "text")


def _numbered(w: DataFrame) -> DataFrame:
    """idx from 0 per media in order of segment and word: words before the segment, plus the place inside it."""
    inside = F.row_number().over(W.partitionBy("media_id", "seg_idx").orderBy("n")) - 1
    sizes = w.groupBy("media_id", "seg_idx").agg(F.count("*").alias("_n"))
    before = running_sum(sizes, ["media_id"], "seg_idx", "_n", "_ahead", inclusive=False).select("media_id", "seg_idx", "_ahead")
    return join_on(w.withColumn("_in", inside), before, ["media_id", "seg_idx"]).withColumn("idx", (F.col("_in") + F.col("_ahead")).cast("int"))


def spoken_words(words: DataFrame, segments: DataFrame | None = None, keys: list[str] = TAKE) -> DataFrame:
    """The words table as extraction would give it: keys, pos (from 0, dense), idx, seg_idx, s_ms, e_ms, text.

    Of repeated deliveries one is taken; words without start or text go, and with segments given those of
    segments over the no-speech limit. e_ms may be null.
    """
    w = once(words, [*keys, "idx"], ["seg_idx", "start", "end", "text"])
    w = w.select(*keys, "idx", "seg_idx", ms("start").alias("s_ms"), ms("end").alias("e_ms"), strip("text").alias("text")).where(F.col("s_ms").isNotNull() & (F.col("text") != ""))
    if segments is not None:
        quiet = once(segments, [*keys, "seg_no"], ["no_speech_prob"]).where(F.col("no_speech_prob") > NO_SPEECH)
        w = join_on(w, quiet.select(*keys, F.col("seg_no").alias("seg_idx")), [*keys, "seg_idx"], "left_anti")
    return dense(w, keys, "idx").select(*keys, "pos", "idx", "seg_idx", "s_ms", "e_ms", "text")


def nested(words: DataFrame, segments: DataFrame, media: Column) -> DataFrame:
    """The alignment result that words and segments would come from, one row per media; for round trips and export.

    A media's words gather in one row, as the nested format has it.
    """
    parts = words.groupBy("media_id", "take_no", "seg_idx").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("text").alias("word"), F.lit(None).cast("string").alias("text"), "start", "end"))).alias("w"))
    s = segments.select("media_id", "take_no", F.col("seg_no").alias("seg_idx"), "text", "start", "end", "no_speech_prob")
    both = join_on(s, parts, ["media_id", "take_no", "seg_idx"], "left")
    inner = F.transform(F.coalesce("w", F.expr("cast(array() as array<struct<idx:int,word:string,text:string,start:double,end:double>>)")), lambda x: F.struct(x.word.alias("word"), x.text.alias("text"), x.start.alias("start"), x.end.alias("end")))
    seg = F.struct("seg_idx", "text", "start", "end", "no_speech_prob", inner.alias("words"))
    out = both.withColumn("media_id", media).groupBy("media_id").agg(F.sort_array(F.collect_list(seg)).alias("x"))
    return out.select(
        "media_id",
        F.lit(None).cast("string").alias("language"),
        F.transform("x", lambda x: F.struct(x.text.alias("text"), x.start.alias("start"), x.end.alias("end"), x.no_speech_prob.alias("no_speech_prob"), x.words.alias("words"))).alias("segments"),
    )


def upper_median(sorted_array: Column) -> Column:
    """The middle element, the upper one of two; null for an empty array."""
    return F.get(sorted_array, F.floor(F.size(sorted_array) / 2).cast("int"))


def duration_medians(words: DataFrame, keys: list[str] = TAKE, default_ms: int = 180) -> DataFrame:
    """Upper median of the positive word durations per source, `med_ms`, by counting each duration first."""
    d = words.select(*keys, (F.col("e_ms") - F.col("s_ms")).alias("d")).withColumn("d", F.when(F.col("d") > 0, F.col("d")))
    counts = d.groupBy(*keys, "d").agg(F.count("*").alias("n"))
    up = W.partitionBy(*keys).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    known = counts.where(F.col("d").isNotNull()).withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    mid = F.floor(F.col("all") / 2)
    med = known.where((mid < F.col("upto")) & (mid >= F.col("upto") - F.col("n"))).select(*keys, F.col("d").alias("med_ms"))
    return join_on(counts.select(*keys).distinct(), med, keys, "left").withColumn("med_ms", F.coalesce("med_ms", F.lit(default_ms).cast("long")))


#: A word longer than RATIO times the usual and than FLOOR ms is cut to CAP times the usual, at least CAP_FLOOR ms.
RATIO, FLOOR, CAP, CAP_FLOOR, REACH = 5, 1000, 3, 500, 10


def clip_inflated(words: DataFrame, keys: list[str] = TAKE, mode: str = "snapshot") -> DataFrame:
    """e_ms without trailing silence: words far longer than the 10 words on both sides are cut short.

    The usual duration is the upper median of the positive durations around the word, without the word
    itself; where there are none, of the source. Sources of fewer than three words stay as they are. mode
    'snapshot' looks at the times as given, in bounded windows. mode 'exact' goes from left to right
    and sees what it has cut already, in blocks that are done again until their neighbours agree (checkpoints).
    """
    if mode == "exact":
        return _clip_exact(words, keys)
    d = F.when(F.col("e_ms") > F.col("s_ms"), F.col("e_ms") - F.col("s_ms"))
    rows = words.withColumn("_d", d)
    rows = neighbours(
        rows, keys, "pos", REACH,
        _before=lambda w: F.collect_list("_d").over(w.rowsBetween(-REACH, -1)),
        _after=lambda w: F.collect_list("_d").over(w.rowsBetween(1, REACH)),
        _next=lambda w: F.lead("s_ms").over(w),
    )
    info = join_on(words.groupBy(*keys).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.count("*").alias("_n")), duration_medians(words, keys), keys)
    info = spread_over_blocks(info, "_lo", "_hi", BLOCK)
    rows = join_on(rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")), info.select(*keys, "block", "_n", "med_ms"), [*keys, "block"])
    usual = F.coalesce(upper_median(F.sort_array(F.concat("_before", "_after"))), F.col("med_ms"))
    cap = F.least(F.col("s_ms") + F.greatest(usual * CAP, F.lit(CAP_FLOOR)), F.col("_next"))
    long = (F.col("_n") >= 3) & (F.col("_d") > F.greatest(usual * RATIO, F.lit(FLOOR))) & (cap < F.col("e_ms"))
    return rows.withColumn("e_ms", F.when(F.coalesce(long, F.lit(False)), cap).otherwise(F.col("e_ms"))).select(*words.columns)


def _clip_block(s: list[int], e: list[int | None], first: int, last: int, fallback: int) -> list[int | None]:
    """Ends of the words from first up to last, from left to right, each seeing what was cut before it."""
    for i in range(first, last):
        if e[i] is None:
            continue
        around = sorted(e[j] - s[j] for j in range(max(0, i - REACH), min(len(s), i + REACH + 1)) if j != i and e[j] is not None and e[j] > s[j])
        usual = around[len(around) // 2] if around else fallback
        if e[i] - s[i] <= max(usual * RATIO, FLOOR):
            continue
        cap = s[i] + max(usual * CAP, CAP_FLOOR)
        if i + 1 < len(s):
            cap = min(cap, s[i + 1])
        e[i] = min(e[i], cap)
    return e[first:last]


def _clip_exact(words: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks are cut with what is known of the words before them, and cut again while that turns out to be otherwise.

    A block hears of the one before it only by the ends of its last REACH words, so few blocks are done twice; in the worst case
    there are as many rounds as a source has blocks.
    """
    facts = join_on(words.groupBy(*keys).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.count("*").alias("_n")), duration_medians(words, keys), keys)
    facts = spread_over_blocks(facts, "_lo", "_hi", BLOCK).select(*keys, "block", "_n", "med_ms")
    w = F.struct("pos", F.col("s_ms").alias("s"), F.col("e_ms").alias("e"), "core")
    state = blocks(words.select(*keys, "pos", "s_ms", "e_ms"), "pos", BLOCK, REACH).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(w)).alias("w"))
    state = join_on(state.where(F.exists("w", lambda x: x.core)), facts, [*keys, "block"])
    before = F.transform(F.filter("w", lambda x: ~x.core & (x.pos < F.col("block") * BLOCK)), lambda x: x.e)
    ends = T.ArrayType(T.LongType())
    state = state.withColumn("known", before)
    made = T.StructType([*state.schema.fields, T.StructField("ends", ends)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for rows, n, med, known in zip(*(b.column(c).to_pylist() for c in ("w", "_n", "med_ms", "known"))):
                s, e = [x["s"] for x in rows], [x["e"] for x in rows]
                first = len(known)
                last = first + sum(x["core"] for x in rows)
                e[:first] = known
                out.append(_clip_block(s, e, first, last, med) if n >= 3 else e[first:last])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int64()))], names=[*b.schema.names, "ends"])

    state = cut(state.mapInArrow(run, made))
    while True:
        tail = F.slice("ends", F.greatest(F.size("ends") - REACH + 1, F.lit(1)), F.lit(REACH))
        heard = join_on(state, state.select(*keys, (F.col("block") + 1).alias("block"), tail.alias("_heard")), [*keys, "block"], "left")
        new = F.col("_heard").isNotNull() & ~F.col("_heard").eqNullSafe(F.col("known"))
        if heard.where(new).isEmpty():
            break
        again = heard.where(new).withColumn("known", F.col("_heard")).drop("_heard", "ends").mapInArrow(run, made)
        state = cut(heard.where(~new).drop("_heard").unionByName(again))
    core = F.filter("w", lambda x: x.core)
    done = state.select(*keys, F.explode(F.transform(core, lambda x, i: F.struct(x.pos.alias("pos"), F.get("ends", i).alias("e")))).alias("x")).select(*keys, "x.pos", F.col("x.e").alias("_e"))
    return join_on(words, done, [*keys, "pos"]).withColumn("e_ms", F.col("_e")).select(*words.columns)


def without_overlaps(words: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """e_ms at most the next word's start."""
    rows = neighbours(words, keys, "pos", 1, _next=lambda w: F.lead("s_ms").over(w))
    return rows.withColumn("e_ms", F.when(F.col("e_ms").isNotNull(), F.least("e_ms", "_next"))).drop("_next")


def with_ends(words: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """A missing end becomes the next word's start, or the word's own."""
    rows = neighbours(words, keys, "pos", 1, _next=lambda w: F.lead("s_ms").over(w))
    return rows.withColumn("e_ms", F.coalesce("e_ms", "_next", "s_ms")).drop("_next")
