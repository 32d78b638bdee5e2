"""Implausible measurements per source: physical bounds, spikes and stuck values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.operators.keys import TAKE, blocks, join_on, ms, spread_over_blocks

#: Positions per block; a block is what one window partition holds.
BLOCK = 4096


def source_medians(df: DataFrame, keys: list[str], value: str, mad: bool = True) -> DataFrame:
    """Exact median of a whole-number measurement per source, as `med`, and the median absolute deviation, as `mad`.

    Counts each distinct value first (also before the shuffle), so a source with a third of all
    rows moves only its histogram. The median of an even count is the middle of the two middle values.
    """

    def middle(counts: DataFrame, v: str, name: str) -> DataFrame:
        up = W.partitionBy(*keys).orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow)
        of = W.partitionBy(*keys)
        ranked = counts.withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(of))
        lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
        has = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n"))
        return ranked.groupBy(*keys).agg(((F.max(F.when(has(lo), F.col(v))) + F.max(F.when(has(hi), F.col(v)))) / 2).alias(name))

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    med = middle(counts, "_v", "med")
    if not mad:
        return med
    away = join_on(counts, med, keys).withColumn("_d", F.abs(F.col("_v") - F.col("med")))
    away = away.groupBy(*keys, "_d").agg(F.sum("_n").alias("_n"))
    return join_on(med, middle(away, "_d", "mad"), keys)


def _extents(named: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Per source the median of its good values (null if it has none) and its first and last position, from one histogram."""
    h = named.groupBy(*keys, "_value").agg(F.count(F.when(~F.col("_bad"), 1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    up = W.partitionBy(*keys).orderBy("_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    h = h.withColumn("_upto", F.sum("_n").over(up)).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    has = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n"))
    at = lambda r: F.max(F.when(has(r), F.col("_value")))
    med = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2
    return h.groupBy(*keys).agg(med.alias("med"), F.min("_lo").alias("_first"), F.max("_hi").alias("_last"))


def rolling_hampel(window: W, value: Column, half: int) -> tuple[Column, Column]:
    """Rolling median and median absolute deviation of the 2 * half + 1 rows around each row (fewer at the ends)."""
    near = F.collect_list(value).over(window.rowsBetween(-half, half))

    def bind(x: Column, use) -> Column:  # evaluates x once
        return F.get(F.transform(F.array(x), use), F.lit(0))

    def mid(a: Column) -> Column:
        return bind(F.sort_array(a), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)

    both = bind(near, lambda n: bind(mid(n), lambda m: F.struct(m.alias("med"), mid(F.transform(n, lambda x: F.abs(x - m))).alias("mad"))))
    return both["med"], both["mad"]


def _measured(df: DataFrame, keys: list[str], pos: str, value: str, flags: list[str], halo: int) -> DataFrame:
    """Blocks with halo of one row per position: repeated deliveries are dropped inside the block."""
    cut_up = blocks(df.select(*keys, pos, value, *flags).where(F.col(value).isNotNull()), pos, BLOCK, halo)
    w = W.partitionBy(*keys, "block").orderBy(pos, value, *flags)
    seen = F.lag(F.struct(pos)).over(w)
    return cut_up.withColumn("_seen", F.coalesce(seen[pos].eqNullSafe(F.col(pos)), F.lit(False))).where(~F.col("_seen") & F.col(pos).isNotNull()).drop("_seen")


def flag_implausible(
    df: DataFrame,
    keys: list[str],
    pos: str,
    value: str,
    *,
    impossible: Column | None = None,
    at_least: int = 0,
    spike_ratio: float | None = 5.0,
    half_window: int | None = None,
    mads: float = 8.0,
    stuck_run: int = 6,
) -> DataFrame:
    """Hampel filter with stuck-value runs and physical bounds; one row per implausible measurement.

    df holds whole-number measurements at whole positions, per source (keys). A measurement is
      impossible  where the given condition holds or it is below at_least,
      else spike  against the source's normal value: with half_window None the window is the whole
                  source and a spike exceeds spike_ratio times its median; with half_window k the
                  median and its absolute deviation roll over the k rows on both sides, and a
                  spike lies more than `mads` scaled deviations (1.4826 each, and at least a
                  twentieth of the median) from the median, above or below,
      else stuck  in a run of stuck_run or more consecutive positions with equal measurements.
    Medians are taken over measurements that are not below at_least. Result: keys, pos, value, defect.
    Rows without measurement or position
    are left out and end a run; repeated rows count once
    for runs (for the median a repeated delivery counts as often as it came, unless removed before);
    of differing rows of one position the smallest value counts; null keys form a source.
    """
    halo = max(stuck_run - 1, half_window or 0)
    bad = F.coalesce(impossible, F.lit(False)) if impossible is not None else F.lit(False)
    named = df.select(*keys, pos, F.col(value).alias("_value"), (bad | (F.col(value) < at_least)).alias("_bad"))
    rows = _measured(named, keys, pos, "_value", ["_bad"], halo)
    w = W.partitionBy(*keys, "block").orderBy(pos)
    v = F.col("_value")
    goes_on = F.coalesce((F.lag(v).over(w) == v) & (F.lag(pos).over(w) == F.col(pos) - 1), F.lit(False))
    rows = rows.withColumn("_run", F.sum((~goes_on).cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("_long", F.count("*").over(W.partitionBy(*keys, "block", "_run")) >= stuck_run)
    if half_window is None:
        per_block = spread_over_blocks(_extents(named, keys, pos), "_first", "_last", BLOCK)
        rows = join_on(rows.where("core"), per_block.select(*keys, "block", "med"), [*keys, "block"], "left")
        spike = v > F.col("med") * spike_ratio
    else:
        good = F.when(~F.col("_bad"), v)
        med, mad = rolling_hampel(w, good, half_window)
        rows = rows.select("*", med.alias("med"), mad.alias("mad")).where("core")
        spike = F.abs(v - F.col("med")) > mads * F.greatest(1.4826 * F.col("mad"), 0.05 * F.col("med"))
    defect = (
        F.when(F.col("_bad"), F.lit("impossible"))
        .when(F.coalesce(spike, F.lit(False)), F.lit("spike"))
        .when(F.col("_long"), F.lit("stuck"))
    )
    return rows.select(*keys, pos, v.alias(value), defect.alias("defect")).where(F.col("defect").isNotNull())


def word_durations(words: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """keys, idx, dur_ms and negative (a time below 0) of words that have both times; of repeated deliveries one row."""
    s, e = ms("start"), ms("end")
    timed = words.select(*keys, "idx", (e - s).alias("dur_ms"), ((s < 0) | (e < 0)).alias("negative")).where(F.col("dur_ms").isNotNull())
    return timed.distinct()


def implausible_words(words: DataFrame, keys: list[str] = TAKE, half_window: int | None = None) -> DataFrame:
    """Words whose duration cannot be right for their take, with the reason (see flag_implausible)."""
    return flag_implausible(
        word_durations(words, keys), keys, "idx", "dur_ms", impossible=F.col("negative"), at_least=10, half_window=half_window
    )
