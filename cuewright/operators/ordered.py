"""Ordered sequences of any length: positions, running sums and neighbours in bounded windows.

Every window here runs over a block of a source, never over the source; what blocks hand to each other
is summed up in two levels (`carried`, `running_sum`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.operators.keys import join_on

BLOCK = 4096
FAN = 1024


def _offsets(per_block: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of the value over all earlier blocks of the source, per block, in two levels."""
    group = F.floor(F.col("block") / FAN).cast("long")
    rows = per_block.withColumn("_group", group)
    near = W.partitionBy(*keys, "_group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    far = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    groups = rows.groupBy(*keys, "_group").agg(F.sum(value).alias("_sum")).withColumn("_far", F.coalesce(F.sum("_sum").over(far), F.lit(0))).drop("_sum")
    rows = rows.withColumn("_near", F.coalesce(F.sum(value).over(near), F.lit(0)))
    return join_on(rows, groups, [*keys, "_group"]).select(*keys, "block", (F.col("_near") + F.col("_far")).alias("_before"))


def running_sum(df: DataFrame, keys: list[str], pos: str, value: str, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the running sum of a whole-number value over each source's rows in order of pos (unique per source)."""
    rows = df.withColumn("block", F.floor(F.col(pos) / BLOCK).cast("long"))
    totals = rows.groupBy(*keys, "block").agg(F.sum(value).alias("_total"))
    frame = W.partitionBy(*keys, "block").orderBy(pos).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    rows = join_on(rows, _offsets(totals, keys, "_total"), [*keys, "block"])
    return rows.withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "block")


def dense(df: DataFrame, keys: list[str], order: str, name: str = "pos") -> DataFrame:
    """Adds each row's position, from 0 and without gaps, among its source's rows in order of a unique whole number."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", name, inclusive=False).withColumn(name, F.col(name).cast("int")).drop("_one")


def neighbours(df: DataFrame, keys: list[str], pos: str, reach: int, **columns) -> DataFrame:
    """Adds columns computed over a window of each row's neighbours; pos must be dense.

    columns: name = function of an ordered window over a block with `reach` rows of the neighbouring blocks.
    """
    own = F.floor(F.col(pos) / BLOCK).cast("long")
    at = F.pmod(F.col(pos), F.lit(BLOCK))
    near = F.filter(F.array(own, F.when(at < reach, own - 1), F.when(at >= BLOCK - reach, own + 1)), lambda x: x.isNotNull())
    rows = df.withColumn("_block", F.explode(near)).withColumn("_core", F.col("_block") == own)
    w = W.partitionBy(*keys, "_block").orderBy(pos)
    for name, f in columns.items():
        rows = rows.withColumn(name, f(w))
    return rows.where("_core").drop("_block", "_core")
