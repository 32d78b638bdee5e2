"""Queries of the general problems (intervals, implausible measurements)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.operators.intervals import speech_periods
from cuewright.operators.outliers import implausible_words
from cuewright.plans.tables import table


def p3_found(spark, d):
    return speech_periods(table(spark, d, "words")).select("media_id", "take_no", "kind", "from_ms", "to_ms")


def p3_speech_share(spark, d):
    """Per take: its periods, their length, and the silence between them."""
    p = speech_periods(table(spark, d, "words"))
    long = F.col("to_ms") - F.col("from_ms")
    is_period = F.col("kind") == "period"
    return p.groupBy("media_id", "take_no").agg(
        F.count(F.when(is_period, 1)).alias("periods"),
        F.sum(F.when(is_period, long).otherwise(0)).alias("speech_ms"),
        F.sum(F.when(~is_period, long).otherwise(0)).alias("silence_ms"),
    )


def p7_found(spark, d):
    return implausible_words(table(spark, d, "words")).select("media_id", "take_no", "idx", "defect")


def p7_rolling(spark, d):
    """The same words judged by a rolling window of 15 words on both sides."""
    return implausible_words(table(spark, d, "words"), half_window=15).select("media_id", "take_no", "idx", "dur_ms", "defect")


QUERIES = {"p3_found": p3_found, "p3_speech_share": p3_speech_share, "p7_found": p7_found, "p7_rolling": p7_rolling}

_PERIODS = """
with t as (
  select distinct media_id, take_no, cast(round("start" * 1000) as bigint) as s,
         greatest(cast(round("end" * 1000) as bigint), cast(round("start" * 1000) as bigint) + 1) as e
  from words where "start" >= 0 and "end" > "start" and not isnan("end")),
g as (
  select *, max(e) over (partition by media_id, take_no order by s, e rows between unbounded preceding and 1 preceding) as before from t),
i as (
  select *, sum(case when before is null or s - before > 1000 then 1 else 0 end)
         over (partition by media_id, take_no order by s, e rows unbounded preceding) as p from g),
p as (select media_id, take_no, p, min(s) as f, max(e) as t from i group by all),
pg as (
  select media_id, take_no, 'period' as kind, f as from_ms, t as to_ms from p
  union all
  select media_id, take_no, 'gap', lag(t) over (partition by media_id, take_no order by p), f from p
  qualify lag(t) over (partition by media_id, take_no order by p) is not null)"""

_WORDS = """
with d as (
  select distinct media_id, take_no, idx, cast(round("end" * 1000) as bigint) - cast(round("start" * 1000) as bigint) as v,
         "start" < -0.0005 or "end" < -0.0005 as neg
  from words where "start" is not null and "end" is not null and not isnan("start") and not isnan("end")),
m as (select media_id, take_no, median(v) as med from d where v >= 10 and not neg group by all),
r as (
  select *, idx - row_number() over (partition by media_id, take_no, v order by idx) as run from d),
l as (select *, count(*) over (partition by media_id, take_no, v, run) as n from r)"""

ORACLE = {
    "p3_found": _PERIODS + " select * from pg",
    "p3_speech_share": _PERIODS
    + """ select media_id, take_no, count(*) filter (kind = 'period') as periods,
          cast(sum(case when kind = 'period' then to_ms - from_ms else 0 end) as bigint) as speech_ms,
          cast(sum(case when kind = 'gap' then to_ms - from_ms else 0 end) as bigint) as silence_ms
          from pg group by media_id, take_no""",
    "p7_found": _WORDS
    + """ select media_id, take_no, idx, case when neg or v < 10 then 'impossible' when v > 5 * med then 'spike' else 'stuck' end as defect
          from l left join m using (media_id, take_no) where neg or v < 10 or v > 5 * med or n >= 6""",
    "p7_rolling": _WORDS
    + """,
o as (
  select media_id, take_no, idx, neg or v < 10 as bad, v, n from l
  qualify row_number() over (partition by media_id, take_no, idx order by v, neg) = 1),
w as (
  select *, list(case when not bad then v end) filter (not bad) over (partition by media_id, take_no order by idx rows between 15 preceding and 15 following) as near from o),
h as (select *, list_median(near) as med, list_median(list_transform(near, lambda x: abs(x - list_median(near)))) as mad from w)
select media_id, take_no, idx, v as dur_ms, case when bad then 'impossible' when abs(v - med) > 8 * greatest(1.4826 * mad, 0.05 * med) then 'spike' else 'stuck' end as defect
from h where bad or coalesce(abs(v - med) > 8 * greatest(1.4826 * mad, 0.05 * med), false) or n >= 6""",
}
