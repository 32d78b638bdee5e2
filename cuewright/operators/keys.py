"""Keys, repeated deliveries and bounded blocks: what the other operators build on.

A source (a take, a media file) may hold a third of all rows, so nothing here gathers a whole
source in one task. Positions are cut into blocks of a fixed size, with a halo of neighbours
where a result depends on them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAKE = ["media_id", "take_no"]


def once(df: DataFrame, keys: list[str], values: list[str], arrived: str = "loaded_at") -> DataFrame:
    """One row per key: the first delivery, ties by the smallest values. Null keys form a key of their own.

    Only keys and values are kept. The minimum is taken before the shuffle as well as after it,
    so a key delivered very often does not reach one task as rows.
    """
    by = [arrived] if arrived in df.columns and arrived not in keys + values else []
    first = F.min(F.struct(*by, *values)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[v].alias(v) for v in values])


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys in which null equals null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; the keys appear once."""
    right = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return a.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def ms(seconds: Column | str) -> Column:
    """Whole milliseconds of seconds, rounded half up; null for null, NaN, infinities and what has no whole milliseconds in a double (from 2**53 ms on)."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**53 / 1000))
    return F.when(ok, F.round(c * 1000).cast("long"))


def blocks(df: DataFrame, pos: str, size: int, halo: int = 0) -> DataFrame:
    """Adds `block`, the number of the position's block, and `core`.

    With a halo, rows near a block's edge appear in the neighbouring block too, there with core
    false. Rows without a position are in block null.
    """
    p = F.col(pos)
    own = F.floor(p / F.lit(size)).cast("long")
    if halo == 0:
        return df.withColumn("block", own).withColumn("core", F.lit(True))
    if halo >= size:
        raise ValueError("the halo must be smaller than the block")
    at = F.pmod(p, F.lit(size))
    near = F.filter(
        F.array(own, F.when(at < halo, own - 1), F.when(at >= size - halo, own + 1)), lambda x: x.isNotNull()
    )
    near = F.when(p.isNull(), F.array(F.lit(None).cast("long"))).otherwise(near)
    return df.withColumn("block", F.explode(near)).withColumn("core", F.col("block").eqNullSafe(own))


def spread_over_blocks(per_source: DataFrame, first_pos: str, last_pos: str, size: int) -> DataFrame:
    """A row of a source becomes one row for each block from first_pos to last_pos; none where these are null.

    Joining block rows with these on source and block has no hot key, whatever the source holds.
    """
    lo, hi = (F.floor(F.col(p) / F.lit(size)).cast("long") for p in (first_pos, last_pos))
    return per_source.withColumn("block", F.explode(F.sequence(lo, hi)))


def carried(df: DataFrame, keys: list[str], block: str, value: str, fan: int = 1024, best: Callable[[str], Column] | None = None) -> DataFrame:
    """Adds `carried`: the value of the nearest earlier block of the same source that has one, or, with best=F.max, the largest of all earlier blocks.

    df holds one row per source and block. Windows run over groups of `fan` blocks, then over the groups,
    so that no window holds more than `fan` blocks or one row per group of a source.
    """
    group = F.floor(F.col(block) / F.lit(fan)).cast("long")
    df = df.withColumn("_group", group)
    over = best or (lambda c: F.last(c, ignorenulls=True))
    w = W.partitionBy(*keys, "_group").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    near = df.withColumn("_near", over(value).over(w))
    last = df.where(F.col(value).isNotNull()).groupBy(*keys, "_group").agg((best(value) if best else F.max_by(value, block)).alias("_last"))
    everyone = join_on(df.select(*keys, "_group").distinct(), last, [*keys, "_group"], "left")
    far = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    everyone = everyone.select(*keys, "_group", over("_last").over(far).alias("_far"))
    return join_on(near, everyone, [*keys, "_group"], "left").withColumn("carried", F.greatest("_near", "_far") if best else F.coalesce("_near", "_far")).drop("_near", "_far", "_group")
