"""Queries on words: extraction, times, groups, breaks and rule splits, each with the SQL that must agree."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cuewright.functions import lexicon
from cuewright.functions.text import ends_sentence, is_fragile, is_intensified, pair_word, root, srt_time
from cuewright.operators import segment as S
from cuewright.operators.keys import TAKE, join_on, once
from cuewright.operators.words import aligned_words, clip_inflated, duration_medians, nested, spoken_words, with_ends, without_overlaps
from cuewright.plans.exchange import NoBackend, diff_marks
from cuewright.plans.segmentation import CLAUSES, long_blocks, segment_with_model
from cuewright.plans.tables import table
from cuewright.session import cut

K = TAKE


def _words(spark, d):
    return spoken_words(table(spark, d, "words"))


def _grouped(spark, d):
    return S.sentence_groups(_words(spark, d))


def _groups(spark, d):
    return S.group_table(_grouped(spark, d))


def _arrays(spark, d):
    return S.gathered(_grouped(spark, d), K, "group_id")


def q_words(spark, d):
    return spoken_words(table(spark, d, "words"), table(spark, d, "segments"))


def q_words_nested(spark, d):
    """Nests words into alignment results and extracts them again."""
    w = once(table(spark, d, "words"), [*K, "idx"], ["seg_idx", "start", "end", "text"])
    s = once(table(spark, d, "segments"), [*K, "seg_no"], ["text", "start", "end", "no_speech_prob"])
    media = F.concat_ws("#", "media_id", "take_no")
    got = aligned_words(nested(w, s, media))
    return got.select("media_id", "idx", "seg_idx", F.round(F.col("start") * 1000).cast("long").alias("s_ms"), F.round(F.col("end") * 1000).cast("long").alias("e_ms"), "text")


def q_srt_time(spark, d):
    c = once(table(spark, d, "cues"), ["cue_id"], ["start_ms"]).where("start_ms is not null")
    s = F.col("start_ms") / 1000.0 + F.pmod("cue_id", F.lit(7)) * 0.00025
    return c.select("cue_id", srt_time(s).alias("tc"), srt_time(s, compat=True).alias("tc_compat"))


def q_global_upper_median(spark, d):
    return duration_medians(_words(spark, d))


def q_clip_snapshot(spark, d):
    return clip_inflated(_words(spark, d)).select(*K, "pos", "e_ms")


def q_clip_exact(spark, d):
    return clip_inflated(_words(spark, d), mode="exact").select(*K, "pos", "e_ms")


def q_overlap(spark, d):
    return without_overlaps(_words(spark, d)).select(*K, "pos", "s_ms", "e_ms")


def q_with_ends(spark, d):
    return with_ends(_words(spark, d)).select(*K, "pos", "e_ms")


def q_groups(spark, d):
    return _grouped(spark, d).select(*K, "pos", "group_id")


def q_long_groups(spark, d):
    return _groups(spark, d)


def q_fast_path(spark, d):
    return S.fast_path(_groups(spark, d))


def q_long_runs(spark, d):
    return S.long_runs(_groups(spark, d))


def q_context(spark, d):
    return S.context_of(_groups(spark, d))


def q_cues_native(spark, d):
    return S.with_timecodes(S.as_cues(_grouped(spark, d), K, "group_id"))


def q_fragile(spark, d):
    w = _words(spark, d).where(is_fragile("text"))
    return w.groupBy(F.lower("text").alias("word")).agg(F.count("*").alias("n"))


def q_root(spark, d):
    w = _words(spark, d).select(root("text").alias("root"), ends_sentence("text").alias("ends"))
    return w.groupBy("root").agg(F.count("*").alias("n"), F.count(F.when(F.col("ends"), 1)).alias("ends"), F.max(F.col("root").isin(*lexicon.CLAUSE_STARTERS)).alias("clause"))


def q_pair_word(spark, d):
    return _words(spark, d).groupBy(pair_word("text").alias("word")).agg(F.count("*").alias("n"))


def q_intensifier(spark, d):
    return _words(spark, d).select(root("text").alias("word")).distinct().where(is_intensified("word"))


def q_bigram_reject(spark, d):
    flags = S.break_flags(_words(spark, d), lexicon.pairs_table(spark))
    return flags.where("fragile or phrase or intensifier")


def q_allowed_breaks(spark, d):
    """Per take: the positions at which nothing speaks against a break."""
    flags = S.break_flags(_words(spark, d), lexicon.pairs_table(spark))
    return flags.groupBy(*K).agg(F.count("*").alias("breaks"), F.count(F.when(~F.col("fragile") & ~F.col("phrase") & ~F.col("intensifier"), 1)).alias("allowed"))


def q_list_comma(spark, d):
    a = _arrays(spark, d)
    n = F.size("w")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", i).text.endswith(",") & (i < n - 1))
    x = a.select(*K, "group_id", F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), S.is_list_comma(S._up_to_comma(F.col("w"), i)).alias("listed")))).alias("x"))
    return x.select(*K, "group_id", "x.i", "x.listed")


def q_comma_candidates(spark, d):
    return _arrays(spark, d).select(*K, "group_id", F.explode(S.comma_candidates(F.col("w"))).alias("i"))


def q_comma_split(spark, d):
    return _arrays(spark, d).select(*K, "group_id", F.explode(S.comma_cuts(F.col("w"))).alias("cut"))


def q_ambiguous(spark, d):
    return _arrays(spark, d).select(*K, "group_id", F.explode(S.ambiguous_conjunctions(F.col("w"))).alias("i"))


def q_conj_split_rules(spark, d):
    w = F.col("w")
    cuts = S.conjunction_cuts(w, None, S.protected_positions(w, lexicon.default_pairs()))
    return _arrays(spark, d).where(S.array_over(w)).select(*K, "group_id", F.explode(cuts).alias("cut"))


def q_block_split(spark, d):
    """Blocks of neighbouring long groups, cut so that no part of several groups exceeds three times the limits."""
    b = long_blocks(_arrays(spark, d), K)
    return b.select(*K, F.col("first").alias("first_group"), "groups", F.size("w").alias("words"))


def q_emergency_split(spark, d):
    """Every group over the limits, cut by the last resort alone."""
    a = _arrays(spark, d).where(S.array_over(F.col("w"), False)).withColumn("t", F.transform("w", lambda x: x.text))
    cut = S.cut_arrays(a, "t", "cuts", S.emergency_cuts)
    return cut.select(*K, "group_id", F.size("t").alias("words"), F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


def q_runon(spark, d):
    """Long groups cut at candidates that a re-punctuation would give; here every word after a comma is one."""
    pairs = set(lexicon.default_pairs())
    a = _arrays(spark, d).where(S.array_over(F.col("w")))
    a = a.withColumn("t", F.transform("w", lambda x: F.struct(x.text.alias("t"), x.s_ms.alias("s"), F.coalesce(x.e_ms, x.s_ms).alias("e"))))

    def cuts(t):
        words = [x["t"] for x in t]
        return S.run_on_cuts(words, [(x["s"], x["e"]) for x in t], [i + 1 for i, w in enumerate(words[:-1]) if w.endswith(",")], pairs)

    cut = S.cut_arrays(a, "t", "cuts", cuts)
    return cut.select(*K, "group_id", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


def q_union_breaks(spark, d):
    """Breaks after sentences and breaks after segments, each once."""
    w = _words(spark, d)
    ends = w.where(ends_sentence("text")).select(*K, (F.col("pos") + 1).alias("b"))
    segs = w.groupBy(*K, "seg_idx").agg((F.max("pos") + 1).alias("b"))
    return S.union_breaks(ends, segs)


def q_slice_breaks(spark, d):
    w = _words(spark, d)
    breaks = w.where(w.text.endswith(",")).select(*K, (F.col("pos") + 1).alias("b"))
    return S.as_cues(S.slice_at(w, breaks), K, "piece")


def q_comma_inject(spark, d):
    w = _words(spark, d)
    got = S.inject_commas(w, w.where(F.col("pos") % 5 == 4).select(*K, "pos"))
    return got.select(*K, "pos", "text")


def q_merge_rule(spark, d):
    """Cues of sentence and comma pieces merged where every second candidate is confirmed."""
    w = _words(spark, d)
    breaks = w.where(w.text.endswith(",") | ends_sentence("text")).select(*K, (F.col("pos") + 1).alias("b"))
    cues = S.as_cues(S.slice_at(w, breaks), K, "piece").withColumnRenamed("piece", "seg_no")
    marked = S.merge_candidates(cues).withColumn("confirmed", F.col("seg_no") % 2 == 0)
    return S.merge_confirmed(marked)


def q_diff_breaks(spark, d):
    """Marks that a re-punctuated text has beyond its raw text; the raw text is the group without marks."""
    t = S.as_cues(_grouped(spark, d), K, "group_id").select(*K, "group_id", "text")
    t = t.withColumn("raw", F.regexp_replace("text", r"[.,?!]", ""))
    x = diff_marks(t, "raw", "text")
    return x.select(*K, "group_id", F.array_join(F.col("new_breaks").cast("array<string>"), ",").alias("breaks"), F.array_join(F.col("new_commas").cast("array<string>"), ",").alias("commas"))


def q_band_join(spark, d, band_ms: int = 50):
    """Segments and the words whose times lie within 50 ms of theirs: the first that starts so and the last that ends so."""
    s = once(table(spark, d, "segments"), [*K, "seg_no"], ["start", "end"])
    s = s.select(*K, "seg_no", F.round(F.col("start") * 1000).cast("long").alias("a"), F.round(F.col("end") * 1000).cast("long").alias("z"))
    w = _words(spark, d).select(*K, "pos", "s_ms", "e_ms")
    bin_ = lambda c: F.floor(F.col(c) / band_ms).cast("long")

    def near(side: str, time: str):
        rows = s.where(F.col(side).isNotNull()).withColumn("bin", F.explode(F.array(bin_(side) - 1, bin_(side), bin_(side) + 1)))
        return join_on(rows, w.where(F.col(time).isNotNull()).withColumn("bin", bin_(time)), [*K, "bin"]).where(F.abs(F.col(time) - F.col(side)) < band_ms)

    first = near("a", "s_ms").groupBy(*K, "seg_no").agg(F.min("pos").alias("ws"))
    last = near("z", "e_ms").groupBy(*K, "seg_no").agg((F.max("pos") + 1).alias("we"))
    return join_on(join_on(s.select(*K, "seg_no"), first, [*K, "seg_no"], "left"), last, [*K, "seg_no"], "left")


def q_segment_words(spark, d):
    """The whole rules-only path: repaired times, groups, splits, cues with timecodes."""
    w = with_ends(without_overlaps(clip_inflated(cut(_words(spark, d)))))
    return S.with_timecodes(S.segment_words(w))


def q_segment_with_model(spark, d):
    """The path with a model, here one that never answers: the same cues as the rules give."""
    w = with_ends(without_overlaps(clip_inflated(cut(_words(spark, d)))))
    return segment_with_model(cut(w), NoBackend, attempts=1, delays=())


class _Yes:
    """Says YES to every place it is asked about, CONTINUATION to no pair, and puts no marks."""

    def chat(self, system, user, max_tokens, temperature):
        return ", ".join(["YES"] * user.count(" before word ")) if system == CLAUSES else None


def q_segment_confirmed(spark, d):
    """The path with a model that confirms every ambiguous conjunction."""
    w = with_ends(without_overlaps(clip_inflated(cut(_words(spark, d)))))
    return segment_with_model(cut(w), _Yes, attempts=1, delays=())


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_BASE = r"""
with d as (
  select media_id, take_no, idx, min(struct_pack(l := loaded_at, g := seg_idx, s := "start", e := "end", t := text)) as r from words group by all),
w0 as (
  select media_id, take_no, idx, r.g as seg_idx, cast(round(r.s * 1000) as bigint) as s_ms, cast(round(r.e * 1000) as bigint) as e_ms,
         regexp_replace(r.t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as text from d),
"""
_POS = """
w as (
  select media_id, take_no, cast(row_number() over (partition by media_id, take_no order by idx) - 1 as integer) as pos, idx, seg_idx, s_ms, e_ms, text
  from w0 where s_ms is not null and text <> '')"""
_W = _BASE + _POS
_ENDS = r"regexp_matches(text, '[.?!]\s*$')"
_G = (
    _W
    + f""",
gw as (
  select *, cast(coalesce(sum(case when {_ENDS} then 1 else 0 end) over (partition by media_id, take_no order by pos rows between unbounded preceding and 1 preceding), 0) as integer) as group_id
  from w)"""
)
_GT = (
    _G
    + """,
g0 as (
  select media_id, take_no, group_id, min(pos) as ws, max(pos) + 1 as we, cast(count(*) as integer) as n_words, cast(sum(length(text) + 1) as integer) as n_chars,
         arg_max(coalesce(e_ms, s_ms), pos) - arg_min(s_ms, pos) as dur_ms from gw group by all),
g as (select *, n_words > 30 or n_chars > 120 or dur_ms > 9000 as is_long from g0)"""
)
_ROOT = "split_part(rtrim(lower(text), ',.'), '''', 1)"
#: Words of a group with their place i in it, the size n, and what the rules look at.
_GI = (
    _G
    + f""",
gi as (
  select *, cast(row_number() over win - 1 as integer) as i, cast(count(*) over (partition by media_id, take_no, group_id) as integer) as n,
         rtrim(lower(text), '.,!?;''"') as lw, text like '%,' as comma, rtrim(lower(text), ',.') as cw, {_ROOT} as rt
  from gw window win as (partition by media_id, take_no, group_id order by pos)),
gn as (
  select *, lead(rt) over win as rt1, lead(lw, 1) over win as lw1,
         coalesce(min(case when comma then i end) over (partition by media_id, take_no, group_id order by i rows between 1 following and unbounded following), n - 1) as rend,
         min(case when lw in ('and', 'or') then i end) over (partition by media_id, take_no, group_id order by i rows between 1 following and unbounded following) as conj
  from gi window win as (partition by media_id, take_no, group_id order by i)),
gl as (
  select x.*, coalesce(split_part(x.lw1, '''', 1) in {_in(lexicon.CLAUSE_SUBJECTS)}, false) as subj,
         a.lw as w1, b.lw as w2
  from gn x
  left join gn a on a.media_id = x.media_id and a.take_no = x.take_no and a.group_id = x.group_id and a.i = x.conj + 1
  left join gn b on b.media_id = x.media_id and b.take_no = x.take_no and b.group_id = x.group_id and b.i = x.conj + 2),
gc as (
  select *, not subj and conj is not null and conj <= rend - 1 and w1 not in {_in([*lexicon.CLAUSE_STARTERS, "to"])}
            and (conj + 2 > rend or w2 is null or w2 not in {_in([*lexicon.CLAUSE_STARTERS, "to"])}) as listed,
         not subj and conj is not null and conj <= n - 2 and w1 not in {_in([*lexicon.CLAUSE_STARTERS, "to"])}
            and (w2 is null or w2 not in {_in([*lexicon.CLAUSE_STARTERS, "to"])}) as listed_on
  from gl)"""
)
_KEYS = "media_id, take_no, group_id"
_SUFFIX = "(" + "|".join(lexicon.SO_SUFFIXES) + ")$"
_VERY = lambda c: f"({c} in {_in(lexicon.SO_INTENSIFIED)} or ({c} like '%ly' and length({c}) > 4) or regexp_matches({c}, '{_SUFFIX}'))"
_PAIR = lambda c: f"""regexp_replace(rtrim(lower({c}), '.,!?;:''"'), '''(s|re|ve|m|ll|d|t)$', '')"""
_PAIRS = "(" + ", ".join(f"('{a}', '{b}')" for a, b in lexicon.default_pairs()) + ")"
_FRAGILE = lambda c: f"regexp_matches({c}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(" + "|".join(lexicon.FRAGILE) + ")\\s*$')"


def _fold(candidates: str, accept: str, cut: str) -> str:
    """Recursive SQL that takes candidates from right to left."""
    return f"""
c as ({candidates}),
cl as (select {_KEYS}, any_value(n) as n, list(i order by i desc) as l from c group by all),
r as (
  select {_KEYS}, l, cast(n as integer) as e, 1 as k, cast(null as integer) as cut from cl
  union all
  select {_KEYS}, l, case when {accept} then {cut} else e end, k + 1, case when {accept} then {cut} end
  from r where k <= len(l))
select {_KEYS}, cut from r where cut is not null"""


def _in_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _emergency(source: str, key: str) -> str:
    """Recursive SQL that cuts the word lists w of a table wherever they are over the limits: CTE `leaf` with key, a, b (ends exclusive)."""
    word = lambda of, i: f"{of}[{i} + 1]"
    clause = lambda x: f"coalesce(list_contains({_in_list([*lexicon.CLAUSE_STARTERS, 'to'])}, {x}), false)"
    # of a comma at i: where the list after it ends (the next comma, or the part's end), and the and/or in it that has a word after it
    stop = "coalesce(list_min(list_filter(range(i + 1, b), lambda x: cm[x + 1])), b - 1)"
    join = f"list_min(list_filter(range(i + 1, {stop}), lambda x: lw[x + 1] in ('and', 'or')))"
    listed = f"""coalesce({join} is not null and not coalesce(split_part({word('lw', '(i + 1)')}, '''', 1) in {_in(lexicon.CLAUSE_SUBJECTS)}, false)
        and not {clause(word('lw', f'({join} + 1)'))} and not ({join} + 2 <= {stop} and {clause(word('lw', f'({join} + 2)'))}), false)"""
    return f"""
e0 as (
  select {key}, w, list_transform(w, lambda x: regexp_matches(x, ',\\s*$')) as cm, list_transform(w, lambda x: rtrim(lower(trim(x)), '.,!?;''"')) as lw,
         list_transform(w, lambda x: lower(rtrim(x, ',.'))) as cw, list_transform(w, lambda x: split_part(rtrim(lower(trim(x)), ',.'), '''', 1)) as rt,
         list_transform(w, lambda x: {_FRAGILE('x')}) as fr, list_transform(w, lambda x: length(x) + 1) as ln from {source}),
e1 as (
  select {key}, w, cm, lw, cw, rt, fr, ln, 0 as a, cast(len(w) as integer) as b from e0
  union all
  select {key}, w, cm, lw, cw, rt, fr, ln, unnest([a, cut]), unnest([cut, b]) from (
    select *, cast(coalesce(
        -- commas that are no list's, then conjunctions, the most balanced, the rightmost of equals; else near the middle
        list_max(list_filter(commas, lambda i: abs(2 * (i - a) - n + 1) = list_min(list_transform(commas, lambda x: abs(2 * (x - a) - n + 1))))) + 1,
        list_max(list_filter(conj, lambda i: abs(2 * (i - a) - n) = list_min(list_transform(conj, lambda x: abs(2 * (x - a) - n))))),
        list_max(list_filter(free, lambda i: abs(i - a - n // 2) = list_min(list_transform(free, lambda x: abs(x - a - n // 2))))),
        a + n // 2) as integer) as cut
    from (
      select *, list_filter(range(a + 4, b - 4), lambda i: cm[i + 1] and not {listed}) as commas,
             list_filter(range(a + 4, b - 3), lambda i: cw[i + 1] = 'but' or cw[i + 1] in {_in(lexicon.SUBORDINATORS)} or (cw[i + 1] = 'and' and i + 1 < b)
               or (cw[i + 1] in ('or', 'so') and i + 1 < b and rt[i + 2] in {_in(lexicon.CLAUSE_STARTERS)})) as conj,
             list_filter(range(a + 1, b), lambda c: not fr[c]) as free
      from (select *, b - a as n from e1 where b - a >= 2 and (b - a > 30 or list_sum(ln[a + 1:b]) > 120)))) ),
leaf as (select {key}, w, a, b from e1 where not (b - a >= 2 and (b - a > 30 or list_sum(ln[a + 1:b]) > 120)))"""


_FLAGS = (
    _W
    + f""",
p as (
  select *, lag(text) over win as p, lead(text) over win as nx from w window win as (partition by media_id, take_no order by pos)),
f as (
  select media_id, take_no, pos as b, {_FRAGILE("p")} as fragile,
         ({_PAIR("p")}, {_PAIR("text")}) in {_PAIRS} and not regexp_matches(p, '[.?!]\\s*$') as phrase,
         coalesce(rtrim(lower(text), '.,!?;''"') = 'so' and nx is not null and split_part(rtrim(lower(nx), '.,!?;''"'), '''', 1) not in {_in(lexicon.CLAUSE_STARTERS)}, false) as intensifier
  from p where p is not null)"""
)
_TC = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"


def _pieces(breaks: str) -> str:
    return f""",
b as ({breaks}),
pc as (
  select w.*, cast(sum(case when w.pos > 0 and b.b is not null then 1 else 0 end) over (partition by w.media_id, w.take_no order by w.pos) as integer) as piece
  from w left join b on b.media_id = w.media_id and b.take_no = w.take_no and b.b = w.pos),
cu as (
  select media_id, take_no, piece, min(pos) as ws, max(pos) + 1 as we, arg_min(s_ms, pos) as start_ms, arg_max(coalesce(e_ms, s_ms), pos) as end_ms,
         string_agg(text, ' ' order by pos) as text from pc group by all)"""


def _folded(name: str, candidates: str, accept: str, cut: str) -> str:
    """The same as CTEs of their own: `name` holds the words (by pos) that begin a new part."""
    return f"""
{name}_c as ({candidates}),
{name}_l as (select {_KEYS}, any_value(n) as n, any_value(ws) as ws, list(i order by i desc) as l from {name}_c group by all),
{name}_r as (
  select {_KEYS}, ws, l, cast(n as integer) as e, 1 as k, cast(null as integer) as cut from {name}_l
  union all
  select {_KEYS}, ws, l, case when {accept} then {cut} else e end, k + 1, case when {accept} then {cut} end from {name}_r where k <= len(l)),
{name} as (select media_id, take_no, ws + cut as b from {name}_r where cut is not null)"""


def _parts(name: str, breaks: str) -> str:
    """Words with the part they belong to, numbered by its first word's pos, as group_id."""
    return f"""
{name} as (
  select x.media_id, x.take_no, x.pos, x.s_ms, x.e_ms, x.text, cast(max(case when y.b is not null or x.pos = 0 then x.pos end) over (partition by x.media_id, x.take_no order by x.pos) as integer) as group_id
  from w x left join (select distinct media_id, take_no, b from ({breaks})) y on y.media_id = x.media_id and y.take_no = x.take_no and y.b = x.pos)"""


def _rules(confirmed: bool = False) -> str:
    """The whole path by rules, from words with repaired times to the first words of all cues (CTE `cue`); with every ambiguous conjunction confirmed or none."""
    asked = f" or (i >= 4 and n - i >= 4 and not (cw = 'so' and coalesce({_VERY('rt1')}, false)))" if confirmed else ""
    repaired = _W.replace("\nw as (", "\nw_raw as (") + """,
m0 as (select media_id, take_no, count(*) as n, coalesce((list_sort(list(e_ms - s_ms) filter (e_ms > s_ms)))[count(*) filter (e_ms > s_ms) // 2 + 1], 180) as med from w_raw group by all),
l0 as (
  select *, case when e_ms > s_ms then e_ms - s_ms end as d, lead(s_ms) over (partition by media_id, take_no order by pos) as nx,
         list_sort(list(case when e_ms > s_ms then e_ms - s_ms end) filter (e_ms > s_ms) over (partition by media_id, take_no order by pos rows between 10 preceding and 10 following exclude current row)) as near
  from w_raw),
u0 as (select l0.*, m0.n, coalesce(near[len(near) // 2 + 1], med) as u from l0 join m0 on m0.media_id = l0.media_id and m0.take_no = l0.take_no),
c0 as (
  select media_id, take_no, pos, text, s_ms, nx, case when n >= 3 and d > greatest(u * 5, 1000) and least(s_ms + greatest(u * 3, 500), coalesce(nx, 9e15::bigint)) < e_ms
         then least(s_ms + greatest(u * 3, 500), coalesce(nx, 9e15::bigint)) else e_ms end as e_ms from u0),
w as (
  select media_id, take_no, pos, pos as idx, 0 as seg_idx, s_ms, coalesce(case when e_ms is not null then least(e_ms, coalesce(nx, e_ms)) end, nx, s_ms) as e_ms, text from c0)"""
    looks = _GI[len(_G) :]
    again = looks
    for old, new in (("gi", "hi"), ("gn", "hn"), ("gl", "hl"), ("gc", "hc"), ("gw", "g2")):
        again = re.sub(rf"\b{old}\b", new, again)
    long = f"select {_KEYS} from {{0}} group by all having count(*) > 30 or sum(length(text) + 1) > 120 or arg_max(coalesce(e_ms, s_ms), pos) - arg_min(s_ms, pos) > 9000"
    starts = "select media_id, take_no, min(pos) as b from gw group by media_id, take_no, group_id"
    return (
        repaired.replace("with d as", "with recursive d as", 1)
        + _G[len(_W) :]
        + looks
        + f""",
slow as (select distinct media_id, take_no from ({long.format('gw')})),
gs as (select *, pos - i as ws from gc where (media_id, take_no) in (select (media_id, take_no) from slow)),"""
        + _folded("k1", f"select {_KEYS}, i, n, ws from gs where comma and i < n - 1 and not listed and rt1 in {_in([*lexicon.CLAUSE_STARTERS, *lexicon.ELABORATION_STARTERS])}", "l[k] >= 4 and e - l[k] - 1 >= 4", "l[k] + 1")
        + ","
        + _parts("g2", f"{starts} union all select * from k1")
        + again
        + f""",
lg as ({long.format('g2')}),
hs as (
  select *, pos - i as ws, lag(text) over (partition by {_KEYS} order by i) as pt from hc where (media_id, take_no) in (select (media_id, take_no) from slow)),"""
        + _folded(
            "k2",
            f"""select {_KEYS}, i, n, ws from hs where ({_KEYS}) in (select ({_KEYS}) from lg)
        and (cw = 'but' or (cw in ('and', 'or', 'so') and (rt1 in {_in(lexicon.CLAUSE_STARTERS)}{asked})))
        and not (cw in ('and', 'or') and listed_on)
        and not coalesce(({_PAIR('pt')}, {_PAIR('text')}) in {_PAIRS} and not regexp_matches(pt, '[.?!]\\s*$'), false)""",
            "l[k] >= 4 and e - l[k] >= 4",
            "l[k]",
        )
        + ","
        + _parts("g3", f"{starts} union all select * from k1 union all select * from k2")
        + f""",
em as (
  select {_KEYS}, list(text order by pos) as w from g3 where (media_id, take_no) in (select (media_id, take_no) from slow)
  group by all having count(*) > 30 or sum(length(text) + 1) > 120),"""
        + _emergency("em", _KEYS)
        + ","
        + _parts("cue", f"{starts} union all select * from k1 union all select * from k2 union all select media_id, take_no, group_id + a from leaf where a > 0")
    )


_WHOLE = """,
cu as (
  select media_id, take_no, group_id, min(pos) as ws, max(pos) + 1 as we, arg_min(s_ms, pos) as start_ms, arg_max(coalesce(e_ms, s_ms), pos) as end_ms, string_agg(text, ' ' order by pos) as text from cue group by all)
select media_id, take_no, cast(row_number() over (partition by media_id, take_no order by ws) - 1 as integer) as seg_no, ws, we, start_ms, end_ms, text"""


ORACLE = {
    "q_words": _BASE
    + """
q as (select distinct media_id, take_no, seg_no from segments where no_speech_prob > 0.6)
select media_id, take_no, cast(row_number() over (partition by media_id, take_no order by idx) - 1 as integer) as pos, idx, seg_idx, s_ms, e_ms, text
from w0 where s_ms is not null and text <> ''
  and not exists (select 1 from q where q.media_id = w0.media_id and q.take_no = w0.take_no and q.seg_no = w0.seg_idx)""",
    "q_words_nested": _BASE
    + """
s as (
  select media_id, take_no, seg_no, min(struct_pack(l := loaded_at, t := text, a := "start", e := "end", p := no_speech_prob)) as r from segments group by all),
n as (select *, row_number() over (partition by media_id, take_no order by seg_no) - 1 as k from s)
select w0.media_id || '#' || w0.take_no as media_id, cast(row_number() over (partition by w0.media_id, w0.take_no order by k, idx) - 1 as integer) as idx,
       cast(k as integer) as seg_idx, s_ms, e_ms, w0.text
from w0 join n on n.media_id = w0.media_id and n.take_no = w0.take_no and n.seg_no = w0.seg_idx
where s_ms is not null and w0.text <> '' and coalesce(n.r.p, 0) <= 0.6""",
    "q_srt_time": """
with c as (select distinct cue_id, start_ms from cues where start_ms is not null),
t as (select cue_id, greatest(start_ms / 1000.0::double + (cue_id % 7) * 0.00025::double, 0.0) as s from c),
m as (select cue_id, cast(floor(s) as bigint) as w, cast(round_even((s - floor(s)) * 1000, 0) as bigint) as f from t)
select cue_id,
       printf('%02d:%02d:%02d,%03d', (w + f // 1000) // 3600, ((w + f // 1000) // 60) % 60, (w + f // 1000) % 60, f % 1000) as tc,
       printf('%02d:%02d:%02d,%03d', w // 3600, (w // 60) % 60, w % 60, f) as tc_compat from m""",
    "q_global_upper_median": _W
    + """
select media_id, take_no, coalesce((list_sort(list(e_ms - s_ms) filter (e_ms > s_ms)))[count(*) filter (e_ms > s_ms) // 2 + 1], 180) as med_ms from w group by all""",
    "q_clip_snapshot": _W
    + """,
m as (select media_id, take_no, count(*) as n, coalesce((list_sort(list(e_ms - s_ms) filter (e_ms > s_ms)))[count(*) filter (e_ms > s_ms) // 2 + 1], 180) as med from w group by all),
l as (
  select *, case when e_ms > s_ms then e_ms - s_ms end as d, lead(s_ms) over (partition by media_id, take_no order by pos) as nx,
         list_sort(list(case when e_ms > s_ms then e_ms - s_ms end) filter (e_ms > s_ms) over (partition by media_id, take_no order by pos rows between 10 preceding and 10 following exclude current row)) as near
  from w),
u as (select l.*, m.n, coalesce(near[len(near) // 2 + 1], med) as u from l join m on m.media_id = l.media_id and m.take_no = l.take_no)
select media_id, take_no, pos,
       case when n >= 3 and d > greatest(u * 5, 1000) and least(s_ms + greatest(u * 3, 500), coalesce(nx, 9e15::bigint)) < e_ms
            then least(s_ms + greatest(u * 3, 500), coalesce(nx, 9e15::bigint)) else e_ms end as e_ms from u""",
    "q_clip_exact": _W.replace("with d as", "with recursive d as", 1)
    + """,
m as (select media_id, take_no, count(*) as n, coalesce((list_sort(list(e_ms - s_ms) filter (e_ms > s_ms)))[count(*) filter (e_ms > s_ms) // 2 + 1], 180) as med from w group by all),
l as (
  select w.media_id, w.take_no, w.pos, w.s_ms, w.e_ms, m.n, m.med, lead(s_ms) over (partition by w.media_id, w.take_no order by w.pos) as nx,
         list(e_ms - s_ms) filter (e_ms > s_ms) over (partition by w.media_id, w.take_no order by w.pos rows between 1 following and 10 following) as ahead
  from w join m on m.media_id = w.media_id and m.take_no = w.take_no),
r as (
  -- from word to word, with the durations of the last ten as they were left (null where there is none)
  select media_id, take_no, -1 as pos, cast(null as bigint) as e, cast([] as bigint[]) as back from m
  union all
  select media_id, take_no, pos, e, list_slice(list_append(back, case when e > s_ms then e - s_ms end), -10, -1) from (
    select *, case when n >= 3 and e_ms - s_ms > greatest(u * 5, 1000) then least(e_ms, s_ms + greatest(u * 3, 500), coalesce(nx, 9e15::bigint)) else e_ms end as e from (
      select l.*, r.back, coalesce(list_sort(list_filter(list_concat(r.back, coalesce(l.ahead, [])), lambda x: x is not null))
                                   [len(list_filter(list_concat(r.back, coalesce(l.ahead, [])), lambda x: x is not null)) // 2 + 1], l.med) as u
      from r join l on l.media_id = r.media_id and l.take_no = r.take_no and l.pos = r.pos + 1)))
select media_id, take_no, pos, e as e_ms from r where pos >= 0""",
    "q_overlap": _W
    + """ select media_id, take_no, pos, s_ms, case when e_ms is not null then least(e_ms, coalesce(lead(s_ms) over (partition by media_id, take_no order by pos), e_ms)) end as e_ms from w""",
    "q_with_ends": _W + " select media_id, take_no, pos, coalesce(e_ms, lead(s_ms) over (partition by media_id, take_no order by pos), s_ms) as e_ms from w",
    "q_groups": _G + " select media_id, take_no, pos, group_id from gw",
    "q_long_groups": _GT + " select * from g",
    "q_fast_path": _GT + " select media_id, take_no, count(*) as groups, count(*) filter (is_long) as long_groups, count(*) filter (is_long) = 0 as fast from g group by all",
    "q_long_runs": _GT
    + """,
r as (select *, group_id - row_number() over (partition by media_id, take_no, is_long order by group_id) as run from g),
a as (select media_id, take_no, run, min(ws) as ws, max(we) as we, cast(count(*) as integer) as n_groups, cast(sum(n_words) as integer) as n_words, cast(sum(n_chars) as integer) as n_chars from r where is_long group by all)
select media_id, take_no, cast(row_number() over (partition by media_id, take_no order by ws) - 1 as integer) as block_id, ws, we, n_groups, n_words, n_chars from a""",
    "q_context": _GT
    + """,
n as (
  select *, lag(ws) over win as lws, lag(we) over win as lwe, lag(is_long) over win as ll, lead(ws) over win as rws, lead(we) over win as rwe, lead(is_long) over win as rl
  from g window win as (partition by media_id, take_no order by group_id))
select media_id, take_no, group_id, ws, we, case when ll then greatest(lwe - 30, lws) else lws end as left_ws, lwe as left_we, rws as right_ws,
       case when rl then least(rws + 30, rwe) else rwe end as right_we from n where is_long""",
    "q_cues_native": _G
    + f""",
c as (
  select media_id, take_no, group_id, min(pos) as ws, max(pos) + 1 as we, arg_min(s_ms, pos) as start_ms, arg_max(coalesce(e_ms, s_ms), pos) as end_ms, string_agg(text, ' ' order by pos) as text
  from gw group by all)
select *, {_TC("greatest(start_ms, 0)")} as tc_start, {_TC("greatest(end_ms, 0)")} as tc_end from c""",
    "q_fragile": _W + f" select lower(text) as word, count(*) as n from w where {_FRAGILE('text')} group by all",
    "q_root": _W + f", r as (select {_ROOT} as root, {_ENDS} as e from w) select root, count(*) as n, count(*) filter (e) as ends, bool_or(root in {_in(lexicon.CLAUSE_STARTERS)}) as clause from r group by all",
    "q_pair_word": _W + f" select {_PAIR('text')} as word, count(*) as n from w group by all",
    "q_intensifier": _W + f", r as (select distinct {_ROOT} as word from w) select word from r where {_VERY('word')}",
    "q_bigram_reject": _FLAGS + " select * from f where fragile or phrase or intensifier",
    "q_allowed_breaks": _FLAGS + " select media_id, take_no, count(*) as breaks, count(*) filter (not fragile and not phrase and not intensifier) as allowed from f group by all",
    "q_list_comma": _GI + f" select {_KEYS}, i, listed from gc where comma and i < n - 1",
    "q_comma_candidates": _GI + f" select {_KEYS}, i from gc where comma and i < n - 1 and not listed and rt1 in {_in([*lexicon.CLAUSE_STARTERS, *lexicon.ELABORATION_STARTERS])}",
    "q_comma_split": (_GI + ",").replace("with d as", "with recursive d as", 1)
    + _fold(f"select {_KEYS}, i, n from gc where comma and i < n - 1 and not listed and rt1 in {_in([*lexicon.CLAUSE_STARTERS, *lexicon.ELABORATION_STARTERS])}", "l[k] >= 4 and e - l[k] - 1 >= 4", "l[k] + 1"),
    "q_ambiguous": _GI
    + f""" select {_KEYS}, i from gc where cw in ('and', 'so', 'or') and i >= 4 and n - i >= 4
        and coalesce(rt1, '') not in {_in(lexicon.CLAUSE_STARTERS)} and not (cw = 'so' and coalesce({_VERY('rt1')}, false))""",
    "q_conj_split_rules": (_GI + ",").replace("with d as", "with recursive d as", 1)
    + f"""
lg as (
  select {_KEYS} from gi group by all
  having count(*) > 30 or sum(length(text) + 1) > 120 or arg_max(coalesce(e_ms, s_ms), pos) - arg_min(s_ms, pos) > 9000),
gp as (select *, lag(text) over (partition by {_KEYS} order by i) as pt from gc),"""
    + _fold(
        f"""select {_KEYS}, i, n from gp where ({_KEYS}) in (select ({_KEYS}) from lg)
        and (cw = 'but' or (cw in ('and', 'or', 'so') and rt1 in {_in(lexicon.CLAUSE_STARTERS)}))
        and not (cw in ('and', 'or') and listed_on)
        and not coalesce(({_PAIR('pt')}, {_PAIR('text')}) in {_PAIRS} and not regexp_matches(pt, '[.?!]\\s*$'), false)""",
        "l[k] >= 4 and e - l[k] >= 4",
        "l[k]",
    ),
    "q_block_split": (_GT + ",").replace("with d as", "with recursive d as", 1)
    + """
l0 as (select *, group_id - row_number() over (partition by media_id, take_no order by group_id) as run from g where is_long),
l1 as (
  select media_id, take_no, run, min(group_id) as g0, list(n_words order by group_id) as nw, list(n_chars order by group_id) as nc from l0 group by all),
b1 as (
  select media_id, take_no, g0, nw, nc, 0 as a, cast(len(nw) as integer) as b from l1
  union all
  select media_id, take_no, g0, nw, nc, unnest([a, a + k]), unnest([a + k, b]) from (
    select *, cast(list_position(cost, list_min(cost)) as integer) as k from (
      select *, list_transform(range(1, b - a), lambda i: greatest(list_sum(nw[a + 1:a + i]), list_sum(nw[a + i + 1:b]))) as cost
      from b1 where b - a >= 2 and (list_sum(nw[a + 1:b]) > 90 or list_sum(nc[a + 1:b]) > 360))))
select media_id, take_no, g0 + a as first_group, cast(b - a as integer) as groups, cast(list_sum(nw[a + 1:b]) as integer) as words from b1
where not (b - a >= 2 and (list_sum(nw[a + 1:b]) > 90 or list_sum(nc[a + 1:b]) > 360))""",
    "q_emergency_split": (_GI + ",").replace("with d as", "with recursive d as", 1)
    + f"""
em as (select {_KEYS}, list(text order by i) as w from gi group by all having count(*) > 30 or sum(length(text) + 1) > 120),"""
    + _emergency("em", _KEYS)
    + f" select {_KEYS}, cast(len(any_value(w)) as integer) as words, coalesce(string_agg(cast(a as varchar), ',' order by a) filter (a > 0), '') as cuts from leaf group by {_KEYS}",
    "q_segment_words": _rules() + _WHOLE + f", {_TC('greatest(start_ms, 0)')} as tc_start, {_TC('greatest(end_ms, 0)')} as tc_end from cu",
    "q_segment_with_model": _rules() + _WHOLE + " from cu",
    "q_segment_confirmed": _rules(confirmed=True) + _WHOLE + " from cu",
    "q_union_breaks": _W + f" select media_id, take_no, pos + 1 as b from w where {_ENDS} union select media_id, take_no, max(pos) + 1 from w group by media_id, take_no, seg_idx",
    "q_slice_breaks": _W + _pieces("select media_id, take_no, pos + 1 as b from w where text like '%,'") + " select * from cu",
    "q_comma_inject": _W + " select media_id, take_no, pos, case when pos % 5 = 4 and text not like '%,' then text || ',' else text end as text from w",
    "q_merge_rule": _W
    + _pieces(f"select media_id, take_no, pos + 1 as b from w where text like '%,' or {_ENDS}")
    + r""",
cp as (select *, lag(text) over (partition by media_id, take_no order by piece) as p from cu),
tk as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as t, list_filter(regexp_split_to_array(p || ' ' || text, '\s+'), lambda x: x <> '') as bt from cp),
jn as (
  select *, case when coalesce(p is not null and len(t) <= 8 and rtrim(lower(t[1]), '.,!?;:''"') in ('and', 'but', 'or', 'so') and not regexp_matches(p, '[.?!]\s*$')
                      and piece % 2 = 0 and len(bt) <= 30 and length(p || ' ' || text) <= 120, false) then 0 else 1 end as fresh from tk),
nm as (select *, cast(sum(fresh) over (partition by media_id, take_no order by piece) - 1 as integer) as seg_no from jn)
select media_id, take_no, seg_no, arg_min(start_ms, piece) as start_ms, arg_max(end_ms, piece) as end_ms, string_agg(text, ' ' order by piece) as text, cast(count(*) as integer) as parts from nm group by all""",
    "q_band_join": _W
    + """,
s as (select media_id, take_no, seg_no, min(struct_pack(l := loaded_at, a := "start", z := "end")) as r from segments group by all),
t as (select media_id, take_no, seg_no, cast(round(r.a * 1000) as bigint) as a, cast(round(r.z * 1000) as bigint) as z from s),
f as (select t.media_id, t.take_no, seg_no, min(pos) as ws from t join w on w.media_id = t.media_id and w.take_no = t.take_no and abs(w.s_ms - t.a) < 50 group by all),
e as (select t.media_id, t.take_no, seg_no, max(pos) + 1 as we from t join w on w.media_id = t.media_id and w.take_no = t.take_no and abs(w.e_ms - t.z) < 50 group by all)
select t.media_id, t.take_no, t.seg_no, ws, we from t left join f using (media_id, take_no, seg_no) left join e using (media_id, take_no, seg_no)""",
}
