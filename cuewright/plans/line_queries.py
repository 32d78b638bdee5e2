"""Queries on lines and cues: files, windows, replies, repair, rebuilding, text functions; with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.functions import lexicon
from cuewright.functions import text as X
from cuewright.operators import translate as R
from cuewright.operators.keys import join_on, once
from cuewright.operators.ordered import dense
from cuewright.plans.exchange import NoBackend, Replay, exchange, requests, token_budget, verdicts
from cuewright.plans.tables import table
from cuewright.plans.translation import translate_cues, translate_lines
from cuewright.sources import files as I

K = ["media_id", "take_no"]


def _cues(spark, d):
    """Cues of each media in order, numbered from 1 without gaps."""
    c = once(table(spark, d, "cues"), ["cue_id"], ["media_id", "line_no", "start_ms", "end_ms", "text"]).where("text is not null")
    return dense(c, ["media_id"], "cue_id", "no").select("media_id", (F.col("no") + 1).alias("line_no"), "cue_id", "start_ms", "end_ms", "text")


def _segments(spark, d):
    return once(table(spark, d, "segments"), [*K, "seg_no"], ["start", "end", "text"]).select(*K, (F.col("seg_no") + 1).alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), F.round(F.col("start") * 1000).cast("long").alias("start_ms"), F.round(F.col("end") * 1000).cast("long").alias("end_ms"))


def _pairs(spark, d):
    """Segments with their replies: line_no, source, translated (null where merged or missing)."""
    p = once(table(spark, d, "parsed"), [*K, "seg_no"], ["text"]).select(*K, (F.col("seg_no") + 1).alias("line_no"), F.col("text").alias("translated"))
    s = _segments(spark, d).withColumnRenamed("text", "source")
    return join_on(s, p, [*K, "line_no"], "left")


def _sizes(spark, d):
    return _segments(spark, d).groupBy(*K).agg(F.count("*").cast("int").alias("n"))


def _replies(spark, d):
    """Replies as a model might give them: per window of two lines, in the forms that occur."""
    lines = R.window_lines(_segments(spark, d), K).where("role = 'translate'")
    t = F.regexp_replace("text", r"\s+", " ")
    no, w = F.col("no").cast("string"), F.col("win")
    kind = F.pmod(w, F.lit(6))
    line = (
        F.when(kind == 0, F.concat(F.lit("["), no, F.lit("] "), t))
        .when(kind == 1, F.concat(F.lit("Line "), no, F.lit(": "), t))
        .when(kind == 2, F.concat(no, F.lit(" "), t))
        .when((kind == 3) & (F.col("no") == 1), F.concat(F.lit("[1-2] [00:00:01,000 --> 00:00:02,000] "), t))
        .when(kind == 4, F.concat(F.lit("["), no, F.lit("-"), (F.col("no") + 1).cast("string"), F.lit("] "), t, F.when(F.col("no") == 2, " <|end|>").otherwise("")))
        .when(kind == 5, F.concat(F.lit("text "), t))
    )
    rows = F.sort_array(F.collect_list(F.when(line.isNotNull(), F.struct("no", line.alias("l")))))
    return lines.groupBy(*K, "win").agg(F.array_join(F.transform(rows, lambda x: x.l), "\n").alias("content"), F.count("*").cast("int").alias("lines"))


W = [*K, "win"]


def q_srt_parse(spark, d):
    docs = table(spark, d, "documents").where(I.is_srt("text")).select("doc_id", X.without_bom("text").alias("text"))
    return I.parse_srt(docs, "doc_id")


def q_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(I.is_srt("text"), "srt").otherwise("txt").alias("kind"))


def q_txt_lines(spark, d):
    docs = table(spark, d, "documents").where(~I.is_srt("text")).select("doc_id", X.without_bom("text").alias("text"))
    return I.plain_lines(docs, "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("text")).alias("chars"), F.max_by("text", "line_no").alias("last"))


def q_timecodes(spark, d):
    c = once(table(spark, d, "cues"), ["cue_id"], ["tc_start", "tc_end", "start_ms"])
    return c.select("cue_id", X.parse_srt_time("tc_start").alias("a"), X.parse_srt_time("tc_end").alias("z"), X.srt_time_ms("start_ms").alias("tc"))


def q_export_srt(spark, d):
    """Each media's SRT text, by its length and hash."""
    c = _cues(spark, d).withColumn("tc_start", X.srt_time_ms("start_ms")).withColumn("tc_end", X.srt_time_ms("end_ms"))
    return I.srt_text(c).select("media_id", F.char_length("text").alias("chars"), F.md5("text").alias("md5"))


def q_srt_round_trip(spark, d):
    """Cues written as SRT and read again."""
    c = _cues(spark, d).withColumn("text", F.trim(F.regexp_replace(X.strip("text"), r"(?U)\s+", " "))).withColumn("tc_start", X.srt_time_ms("start_ms")).withColumn("tc_end", X.srt_time_ms("end_ms"))
    texts = I.srt_text(c).withColumn("text", X.without_bom("text"))
    return I.parse_srt(texts).select("media_id", "line_no", "start_ms", "end_ms", "text")


def q_words_json(spark, d):
    """Each take's words written as one JSON text and read again; media_id is media#take."""
    w = once(table(spark, d, "words"), [*K, "idx"], ["seg_idx", "start", "end", "text"])
    t = I.words_json(w.withColumn("media_id", F.concat_ws("#", *K)))
    back = t.select("media_id", F.explode(F.from_json("text", I.WORDS_JSON)).alias("w"))
    return back.groupBy("media_id").agg(F.count("*").alias("words"), F.count("w.text").alias("texts"), F.sum(F.round(F.col("w.start") * 1000).cast("long")).alias("starts"))


def q_output_names(spark, d):
    return table(spark, d, "media").select("media_id").distinct().select("media_id", I.output_stem(F.concat("media_id", F.when(F.col("media_id").endswith("1"), "_CN").when(F.col("media_id").endswith("2"), "_cn").otherwise("")), "CN").alias("stem"))


def q_languages(spark, d):
    names = F.create_map(*[F.lit(x) for kv in lexicon.LANGUAGES.items() for x in kv])
    return table(spark, d, "parsed").groupBy("tgt_lang").agg(F.count("*").alias("n")).select("tgt_lang", "n", F.upper("tgt_lang").isin(*lexicon.LANGUAGES.values()).alias("known"), F.try_element_at(names, F.lit("japanese")).alias("japanese"))


def q_windows_accurate(spark, d):
    return R.windows(_sizes(spark, d), K)


def q_windows_flexible(spark, d):
    return R.windows(_sizes(spark, d), K, mode="flexible")


def q_window_context(spark, d):
    return R.window_lines(_segments(spark, d), K).select(*W, "line_no", "role", "no")


def q_window_context_flexible(spark, d):
    return R.window_lines(_segments(spark, d), K, "flexible").select(*W, "line_no", "role", "no")


def q_user_prompt(spark, d):
    return R.user_prompts(R.window_lines(_segments(spark, d), K), K).select(*W, "lines", F.md5("user").alias("md5"))


def q_parse_response(spark, d):
    return R.parse_replies(_replies(spark, d), W)


def q_resolve(spark, d):
    r = _replies(spark, d)
    return R.resolve(r, W, R.parse_replies(r, W))


def q_overflow(spark, d):
    sizes = _sizes(spark, d)
    return R.overflow(R.parse_replies(_replies(spark, d), W), W, R.windows(sizes, K), sizes, K)


def q_rebuild(spark, d):
    return R.rebuild(_pairs(spark, d), K)


def q_char_sim(spark, d):
    p = _pairs(spark, d).where("translated is not null")
    a, b = X.char_sets("source"), X.char_sets("translated")
    return p.select(*K, "line_no", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("all"))


def q_drift(spark, d):
    return R.drift(_pairs(spark, d), K, 0.2).select(*K, "line_no", F.round("sim_source", 6).alias("sim_source"), F.round("sim_translated", 6).alias("sim_translated"))


def q_cjk_class(spark, d):
    c = _cues(spark, d)
    return c.select("cue_id", X.has_cjk("text").alias("cjk"), X.has_cjk("text", X.SCRIPT_OF["japanese"]).alias("with_kana"), X.has_cjk("text", X.HAN).alias("han"))


def q_cjk_miss(spark, d):
    p = _pairs(spark, d)
    return R.left_in_source_script(p, "japanese").select(*K, "line_no")


def q_post_process(spark, d):
    p = _pairs(spark, d).where("translated is not null")
    return p.select(*K, "line_no", X.post_process("translated", "chinese", False, "true").alias("a"), X.post_process("translated", "french").alias("b"))


def q_quotes(spark, d):
    q = F.regexp_replace("text", "[“”]", '"')
    return _cues(spark, d).select("cue_id", X.wide_quotes(q, "chinese").alias("text"))


def q_spacing(spark, d):
    return _cues(spark, d).select("cue_id", X.cjk_spacing("text", "true").alias("spaced"), X.cjk_spacing("text", "false").alias("tight"))


def q_strip_tokens(spark, d):
    return _pairs(spark, d).where("translated is not null").select(*K, "line_no", X.strip_template_tokens("translated").alias("text"))


def _noisy(spark, d):
    """Replies with remarks, bracketed lines and reasoning around them."""
    p = _pairs(spark, d).where("translated is not null")
    n = F.pmod("line_no", F.lit(6))
    t = F.regexp_replace("translated", r"[\[\]\n]", "")
    return p.select(
        *K, "line_no",
        F.when(n == 0, F.concat(t, F.lit("\nNote: kept names"))).when(n == 1, F.concat(t, F.lit("\n[2] more"))).when(n == 2, F.concat(t, F.lit(" explanation : as it is"))).when(n == 3, F.concat(F.lit("<think>a\nb</think>"), t))
        .when(n == 4, F.concat(F.lit("Let me see\nfirst\n[1] "), t)).otherwise(F.concat(F.lit("see [1]\n[1] "), t)).alias("said"),
    )


def q_clean_output(spark, d):
    return _noisy(spark, d).select(*K, "line_no", X.clean_output("said").alias("text"))


def q_strip_reasoning(spark, d):
    return _noisy(spark, d).select(*K, "line_no", X.strip_reasoning("said").alias("text"))


def q_verdict_parse(spark, d):
    """Verdicts of made-up answers of every shape, per segment."""
    s = _segments(spark, d)
    n = F.pmod("line_no", F.lit(5))
    said = F.when(n == 0, "YES, NO").when(n == 1, "NO,NO,NO").when(n == 2, "yes").when(n == 3, "maybe").otherwise("NO no.\nYES")
    v = s.select(*K, "line_no", verdicts(said, 2).alias("v"))
    return v.select(*K, "line_no", F.array_join(F.transform("v", lambda x: F.when(x, "T").otherwise("F")), "").alias("v"))


def q_min_tokens(spark, d):
    s = _segments(spark, d).withColumn("n", F.char_length("text"))
    return s.select(*K, "line_no", X.min_tokens("n").alias("plain"), X.min_tokens("n", True).alias("reasoning"), token_budget("text", F.col("n")).alias("text"), token_budget("verdicts", F.pmod("n", F.lit(7)).cast("int")).alias("verdicts"))


def q_requests(spark, d):
    """Requests by id: equal ones have one."""
    asked = requests(_segments(spark, d), "punctuate", "Add marks.", F.col("text"), F.lit(64))
    return asked.groupBy("request_id").agg(F.count("*").alias("n"))


def q_exchange_none(spark, d):
    asked = requests(_segments(spark, d), "punctuate", "Add marks.", F.col("text"), F.lit(64))
    return exchange(asked, NoBackend, attempts=1).groupBy("ok", "attempts").agg(F.count("*").alias("n"))


def q_translate_none(spark, d):
    """Without an answer every line keeps its source."""
    return translate_lines(_segments(spark, d), K, NoBackend, attempts=1, delays=()).select(*K, "line_no", "translated", "state")


class _Echo:
    """Answers each window with its own lines."""

    def chat(self, system, user, max_tokens, temperature):
        part = user.split("Lines to translate:\n", 1)[1].split("\n\nAfter:", 1)[0]
        return part


def q_translate_echo(spark, d):
    """With answers that repeat the lines, the rebuilt cues are the cues."""
    s = _segments(spark, d).withColumn("text", X.strip(F.regexp_replace("text", r"(?U)\s+", " "))).where("text <> ''")
    s = dense(s, K, "line_no", "no").withColumn("line_no", F.col("no") + 1).drop("no")
    return translate_cues(s, K, _Echo, target="french", attempts=1)


#: Most prompts whose answers q_replay knows; a replay table is of bounded size.
REPLAYED = 1000


def q_replay(spark, d):
    """Answers from a table: of every line's window, only the takes' first prompts are known."""
    s = _segments(spark, d)
    first = R.user_prompts(R.window_lines(s.where("line_no <= 4"), K).where("win = 0"), K).select("user", "lines").distinct().orderBy("user").limit(REPLAYED)
    known = {r.user: "\n".join(f"[{i + 1}] ligne {i + 1}" for i in range(r.lines)) for r in first.collect()}
    return translate_lines(s, K, lambda: Replay(known), target="french", attempts=1, delays=()).groupBy("state").agg(F.count("*").alias("n"))


def q_batch_summary(spark, d):
    """Media with and without replies."""
    m = table(spark, d, "media").select("media_id").distinct()
    done = table(spark, d, "parsed").select("media_id").distinct().withColumn("status", F.lit("ok"))
    return m.join(done, "media_id", "left").groupBy(F.coalesce("status", F.lit("failed")).alias("status")).agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CUES = """
with c0 as (
  select cue_id, min(struct_pack(l := loaded_at, m := media_id, n := line_no, s := start_ms, e := end_ms, t := text)) as r from cues group by all),
c as (
  select r.m as media_id, cast(row_number() over (partition by r.m order by cue_id) as integer) as line_no, cue_id, r.s as start_ms, r.e as end_ms, r.t as text
  from c0 where r.t is not null)"""
_SEG = """
with s0 as (
  select media_id, take_no, seg_no, min(struct_pack(l := loaded_at, s := "start", e := "end", t := text)) as r from segments group by all),
s as (
  select media_id, take_no, seg_no + 1 as line_no, coalesce(r.t, '') as text, cast(round(r.s * 1000) as bigint) as start_ms, cast(round(r.e * 1000) as bigint) as end_ms from s0)"""
_PAIR = (
    _SEG
    + """,
p0 as (select media_id, take_no, seg_no, min(struct_pack(l := loaded_at, t := text)) as r from parsed group by all),
p as (
  select s.media_id, s.take_no, s.line_no, s.text as source, s.start_ms, s.end_ms, p0.r.t as translated
  from s left join p0 on p0.media_id = s.media_id and p0.take_no = s.take_no and p0.seg_no + 1 = s.line_no)"""
)


def _windows(mode: str) -> str:
    t, c, first = R.MODES[mode]
    return f""",
n as (select media_id, take_no, cast(count(*) as integer) as n from s group by all),
k as (select *, unnest(range(0, (n - 1) // {t} + 1)) as k from n where n > 0),
win as (
  select media_id, take_no, cast(k as integer) as win, cast(case when k = 0 then 0 else (k - 1) * {t} + {first} end as integer) as ctx_start,
         cast(least(greatest((case when k = 0 then 0 else (k - 1) * {t} + {first} end) + {c}, least((k + 1) * {t}, n)), n) as integer) as ctx_end,
         cast(k * {t} as integer) as tr_start, cast(least((k + 1) * {t}, n) as integer) as tr_end from k),
wl as (
  select w.media_id, w.take_no, w.win, s.line_no, case when s.line_no - 1 < tr_start then 'before' when s.line_no - 1 < tr_end then 'translate' else 'after' end as role,
         case when s.line_no - 1 >= tr_start and s.line_no - 1 < tr_end then cast(s.line_no - tr_start as integer) end as no, s.text
  from win w join s on s.media_id = w.media_id and s.take_no = w.take_no and s.line_no - 1 >= ctx_start and s.line_no - 1 < ctx_end)"""


_REPLIES = (
    _SEG
    + _windows("accurate")
    + r""",
rl as (
  select media_id, take_no, win, no, regexp_replace(text, '\s+', ' ', 'g') as t, win % 6 as kind from wl where role = 'translate'),
rs as (
  select media_id, take_no, win, no, t, kind,
         case when kind = 0 then '[' || no || '] ' || t when kind = 1 then 'Line ' || no || ': ' || t when kind = 2 then no || ' ' || t
              when kind = 3 and no = 1 then '[1-2] [00:00:01,000 --> 00:00:02,000] ' || t
              when kind = 4 then '[' || no || '-' || (no + 1) || '] ' || t || case when no = 2 then ' <|end|>' else '' end when kind = 5 then 'text ' || t end as l from rl),
re as (
  select media_id, take_no, win, coalesce(string_agg(l, chr(10) order by no), '') as content, cast(count(*) as integer) as lines from rs group by all)"""
)
_ITEMS = (
    _REPLIES
    + rf""",
i0 as (
  select media_id, take_no, win, lines, unnest(list_filter(list_transform(string_split(split_part(content, '<|', 1), chr(10)),
         lambda x: {_STRIP("regexp_replace(x, '^\\[[0-9]{2}:[0-9]{2}:[0-9]{2}[，,.][0-9]{3}\\s*-->\\s*[0-9]{2}:[0-9]{2}:[0-9]{2}[，,.][0-9]{3}\\]\\s*', '')")}), lambda x: x <> '')) as l,
         generate_subscripts(list_filter(list_transform(string_split(split_part(content, '<|', 1), chr(10)), lambda x: {_STRIP("x")}), lambda x: x <> ''), 1) - 1 as ord from re),
i1 as (
  select *, case when regexp_matches(l, '^\[[0-9]+(\s*-\s*[0-9]+)?\]\s*(\[[0-9:,]+\s*-->\s*[0-9:,]+\]\s*)?.+') then 'bracket'
                 when regexp_matches(l, '^(?i)(Line\s*)?[0-9]+\s*[:：]\s*.+') then 'label' when regexp_matches(l, '^[0-9]+\s+.+') then 'bare' else 'line' end as form,
         regexp_extract(l, '^\[([0-9]+)(?:\s*-\s*([0-9]+))?\]\s*(?:\[([0-9:,]+\s*-->\s*[0-9:,]+)\]\s*)?(.+)', ['a', 'b', 'c', 'd']) as br,
         regexp_extract(l, '^(?i)(?:Line\s*)?([0-9]+)\s*[:：]\s*(.+)', ['a', 'b']) as la, regexp_extract(l, '^([0-9]+)\s+(.+)', ['a', 'b']) as ba from i0),
i2 as (
  select media_id, take_no, win, lines, cast(ord as integer) as ord, form,
         try_cast(case form when 'bracket' then br.a when 'label' then la.a when 'bare' then ba.a end as integer) as n,
         coalesce(try_cast(case form when 'bracket' then nullif(br.b, '') end as integer), try_cast(case form when 'bracket' then br.a when 'label' then la.a when 'bare' then ba.a end as integer)) as m,
         case when form = 'bracket' then nullif(br.c, '') end as tc,
         {_STRIP("case form when 'bracket' then br.d when 'label' then la.b when 'bare' then ba.b else l end")} as text from i1),
it as (select media_id, take_no, win, ord, n, m, tc, text, form, lines from i2 where form not in ('label', 'bare') or (n >= 1 and n <= lines))"""
)
_NOISY = (
    _PAIR
    + r""",
z as (
  select media_id, take_no, line_no, line_no % 6 as n, regexp_replace(translated, '[\[\]\n]', '', 'g') as t from p where translated is not null),
zn as (
  select media_id, take_no, line_no, case n when 0 then t || chr(10) || 'Note: kept names' when 1 then t || chr(10) || '[2] more' when 2 then t || ' explanation : as it is'
         when 3 then '<think>a' || chr(10) || 'b</think>' || t when 4 then 'Let me see' || chr(10) || 'first' || chr(10) || '[1] ' || t else 'see [1]' || chr(10) || '[1] ' || t end as said from z)"""
)
_SETS = """,
cs as (
  select media_id, take_no, line_no, list_distinct(regexp_split_to_array(a, '')) as a, list_distinct(regexp_split_to_array(b, '')) as b from (
    select *, {a} as a, {b} as b from p where translated is not null))"""
_CHARS = lambda c: f"list_distinct(case when {_STRIP(c)} = '' then [] else string_split({_STRIP(c)}, '') end)"
_TC = lambda c: f"case when {c} is not null then printf('%02d:%02d:%02d,%03d', greatest({c}, 0) // 3600000, (greatest({c}, 0) // 60000) % 60, (greatest({c}, 0) // 1000) % 60, greatest({c}, 0) % 1000) end"
_MS = lambda c: f"case when regexp_matches({c}, '^[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{3}}$') then cast(substr({c}, 1, 2) as bigint) * 3600000 + cast(substr({c}, 4, 2) as bigint) * 60000 + cast(substr({c}, 7, 2) as bigint) * 1000 + cast(substr({c}, 10, 3) as bigint) end"
_SPACE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '([一-鿿])([a-zA-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([一-鿿])', '\\1 \\2', 'g'), '([一-鿿])([0-9])', '\\1 \\2', 'g'), '([0-9])([一-鿿])', '\\1 \\2', 'g')"
_QUOTED = """list_aggregate(list_transform(string_split({c}, '"'), lambda x, i: case when i = 1 then x
    when i % 2 = 0 and i < len(string_split({c}, '"')) then case when regexp_matches(x, '[一-鿿]') then '“' || x || '”' else '"' || x || '"' end
    when i % 2 = 0 then '"' || x else x end), 'string_agg', '')"""
_LINES = r"""
with l as (
  select doc_id, unnest(list_transform(string_split(replace(regexp_replace(text, '^\x{FEFF}', ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: %s)) as line,
         generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as n
  from documents where %s regexp_matches(coalesce(text, ''), '[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}\s*-->\s*[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}'))"""

_BODY = "case when pre <> '' and " + _STRIP("pre") + r" <> '' and not regexp_matches(pre, '\[.*?\]') then substr(t, length(pre) + 1) else t end"

ORACLE = {
    "q_srt_parse": _LINES % (_STRIP("x"), "")
    + f""",
t as (
  select *, regexp_matches(line, '^[0-9]+$') as digits, regexp_matches(line, '^[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{3}}\\s*-->\\s*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{3}}') as time, line = '' as blank from l),
u as (
  select *, sum(blank::int) over (partition by doc_id order by n) as st, coalesce(lead(time) over (partition by doc_id order by n), false) as nt from t),
v as (
  select *, n - coalesce(max(case when not digits then n end) over (partition by doc_id, st order by n rows between unbounded preceding and 1 preceding), min(n) over (partition by doc_id, st) - 1) as k
  from u where not blank),
a as (select *, min(case when digits and nt and k % 2 = 1 then n end) over (partition by doc_id, st) as head from v),
c as (select doc_id, head, max(case when n = head + 1 then line end) as time, coalesce(string_agg(line, ' ' order by n) filter (n > head + 1), '') as text from a where n > head group by all),
f as (
  select doc_id, cast(row_number() over (partition by doc_id order by head) as integer) as line_no, replace(regexp_extract(time, '^([0-9:,.]+)', 1), '.', ',') as tc_start,
         replace(regexp_extract(time, '-->\\s*([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]{{3}})', 1), '.', ',') as tc_end, text from c)
select doc_id, line_no, tc_start, tc_end, {_MS("tc_start")} as start_ms, {_MS("tc_end")} as end_ms, text from f""",
    "q_detect": r"select doc_id, case when regexp_matches(coalesce(text, ''), '[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}\s*-->\s*[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}') then 'srt' else 'txt' end as kind from documents",
    "q_txt_lines": _LINES % (_STRIP("x"), "not") + " select doc_id, count(*) as lines, cast(sum(length(line)) as bigint) as chars, arg_max(line, n) as last from l where line <> '' group by all",
    "q_timecodes": f"""with c as (select cue_id, min(struct_pack(l := loaded_at, a := tc_start, z := tc_end, s := start_ms)) as r from cues group by all)
select cue_id, {_MS("r.a")} as a, {_MS("r.z")} as z, {_TC("r.s")} as tc from c""",
    "q_export_srt": _CUES
    + f""",
b as (
  select media_id, line_no, text, {_TC("start_ms")} as a, {_TC("end_ms")} as z from c),
x as (
  select media_id, chr(65279) || string_agg(line_no || chr(10) || a || ' --> ' || z || chr(10) || text || chr(10) || chr(10), '' order by line_no) as t
  from b where text <> '' and a is not null and z is not null group by all)
select media_id, length(t) as chars, md5(t) as md5 from x""",
    "q_words_json": """with d as (select media_id, take_no, idx, min(struct_pack(l := loaded_at, s := "start", t := text)) as r from words group by all)
select media_id || '#' || take_no as media_id, count(*) as words, count(r.t) as texts, cast(sum(cast(round(r.s * 1000) as bigint)) as bigint) as starts from d group by media_id, take_no""",
    "q_output_names": "select distinct media_id, media_id || '_CN' as stem from media",
    "q_languages": f"select tgt_lang, count(*) as n, upper(tgt_lang) in ({', '.join(repr(c) for c in lexicon.LANGUAGES.values())}) as known, 'JP' as japanese from parsed group by all",
    "q_windows_accurate": _SEG + _windows("accurate") + " select * from win",
    "q_windows_flexible": _SEG + _windows("flexible") + " select * from win",
    "q_window_context": _SEG + _windows("accurate") + " select media_id, take_no, win, line_no, role, no from wl",
    "q_window_context_flexible": _SEG + _windows("flexible") + " select media_id, take_no, win, line_no, role, no from wl",
    "q_user_prompt": _SEG
    + _windows("accurate")
    + """,
u as (
  select media_id, take_no, win, cast(count(*) filter (role = 'translate') as integer) as lines,
         nullif(string_agg(text, chr(10) order by line_no) filter (role = 'before'), '') as b, nullif(string_agg('[' || no || '] ' || text, chr(10) order by line_no) filter (role = 'translate'), '') as t,
         nullif(string_agg(text, chr(10) order by line_no) filter (role = 'after'), '') as a from wl group by all)
select media_id, take_no, win, lines, md5(concat_ws(chr(10) || chr(10), 'Before:' || chr(10) || b, 'Lines to translate:' || chr(10) || t, 'After:' || chr(10) || a)) as md5 from u""",
    "q_parse_response": _ITEMS + " select media_id, take_no, win, ord, n, m, tc, text, form from it",
    "q_resolve": _ITEMS
    + """,
sp as (select *, unnest(range(n, greatest(least(m, lines), n) + 1)) as no from it where form <> 'line' and n >= 1 and n <= lines),
st as (select media_id, take_no, win, no, arg_max(struct_pack(t := case when no = n then text end), ord) as s from sp group by all),
pl as (
  select media_id, take_no, win, row_number() over (partition by media_id, take_no, win order by ord) as no, struct_pack(t := text) as s from it i
  where form = 'line' and not exists (select 1 from it j where j.media_id = i.media_id and j.take_no = i.take_no and j.win = i.win and j.form <> 'line')),
gt as (select * from st union all select * from pl),
rw as (select media_id, take_no, win, unnest(range(1, lines + 1)) as no from re)
select rw.media_id, rw.take_no, rw.win, cast(rw.no as integer) as no, gt.s.t as translated, gt.s is not null as covered
from rw left join gt on gt.media_id = rw.media_id and gt.take_no = rw.take_no and gt.win = rw.win and gt.no = rw.no""",
    "q_overflow": _ITEMS
    + """
select distinct it.media_id, it.take_no, cast(tr_start + it.n as integer) as merged_no, cast(tr_end + 1 as integer) as overflowed_no
from it join win w on w.media_id = it.media_id and w.take_no = it.take_no and w.win = it.win join n on n.media_id = it.media_id and n.take_no = it.take_no
where form = 'bracket' and it.n between 1 and tr_end - tr_start and it.m > tr_end - tr_start and tr_end < n.n""",
    "q_rebuild": _PAIR
    + """,
b as (select *, count(translated) over (partition by media_id, take_no order by line_no) as g from p)
select media_id, take_no, cast(g as integer) as line_no, arg_min_null(start_ms, b.line_no) as start_ms, arg_max_null(end_ms, b.line_no) as end_ms, max(translated) as text from b where g > 0 group by media_id, take_no, g""",
    "q_char_sim": _PAIR
    + f""",
x as (select media_id, take_no, line_no, {_CHARS("source")} as a, {_CHARS("translated")} as b from p where translated is not null)
select media_id, take_no, line_no, cast(len(list_intersect(a, b)) as integer) as common, cast(len(list_distinct(list_concat(a, b))) as integer) as "all" from x""",
    "q_cjk_class": _CUES
    + r""" select cue_id, regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]') as cjk,
  regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}\x{3040}-\x{30ff}]') as with_kana, regexp_matches(text, '[\x{4e00}-\x{9fff}]') as han from c""",
    "q_cjk_miss": _PAIR
    + rf""" select media_id, take_no, line_no from p where translated is not null
  and not regexp_matches(translated, '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}\x{{3040}}-\x{{30ff}}]')
  and ({_STRIP("translated")} = {_STRIP("source")} or len(list_filter(regexp_split_to_array({_STRIP("translated")}, '\s+'), lambda x: x <> '')) >= 3) and regexp_matches(translated, '\p{{L}}')""",
    "q_post_process": _PAIR
    + f""",
y as (select media_id, take_no, line_no, {_STRIP("regexp_replace(translated, '<\\|.*?\\|>', '', 'g')")} as t from p where translated is not null),
q as (select *, replace(rtrim(t, '。？！.!?'), ',', '，') as u from y)
select media_id, take_no, line_no, {_SPACE.format(c=_QUOTED.format(c="u"))} as a, t as b from q""",
    "q_quotes": _CUES + ", q as (select cue_id, regexp_replace(text, '[“”]', '\"', 'g') as u from c) select cue_id, " + _QUOTED.format(c="u") + " as text from q",
    "q_spacing": _CUES
    + f""" select cue_id, {_SPACE.format(c="text")} as spaced,
  {_SPACE.format(c="text").replace("])([", "]) ([").replace("1 ", "1")} as tight from c""",
    "q_strip_tokens": _PAIR + f" select media_id, take_no, line_no, {_STRIP("regexp_replace(translated, '<\\|.*?\\|>', '', 'g')")} as text from p where translated is not null",
    "q_srt_round_trip": _CUES
    + rf""",
e as (select media_id, line_no as n, start_ms, end_ms, {_STRIP("regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')")} as text from c)
select media_id, cast(row_number() over (partition by media_id order by n) as integer) as line_no, start_ms, end_ms, text from e where text <> '' and start_ms is not null and end_ms is not null""",
    "q_drift": _PAIR
    + f""",
x as (select *, {_CHARS("source")} as a, {_CHARS("translated")} as b from p),
y as (
  select *, lead(source) over win as source2, lead(translated) over win as translated2, lead(a) over win as a2, lead(b) over win as b2, lead(line_no) over win as next
  from x window win as (partition by media_id, take_no order by line_no)),
z as (
  select media_id, take_no, line_no,
         case when source = '' or source2 = '' then 0.0::double when len(list_concat(a, a2)) = 0 then 1.0::double else len(list_intersect(a, a2)) / len(list_distinct(list_concat(a, a2)))::double end as s,
         case when translated = '' or translated2 = '' then 0.0::double when len(list_concat(b, b2)) = 0 then 1.0::double else len(list_intersect(b, b2)) / len(list_distinct(list_concat(b, b2)))::double end as t
  from y where translated is not null and translated2 is not null and source2 is not null)
select media_id, take_no, line_no, round(s, 6) as sim_source, round(t, 6) as sim_translated from z where t - s > 0.2""",
    "q_clean_output": _NOISY
    + f""",
a as (select media_id, take_no, line_no, {_STRIP("regexp_replace(said, '(?is)\\bNote\\s*:.*', '')")} as t from zn),
b as (select media_id, take_no, line_no, {_STRIP("regexp_replace(t, '(?is)\\bExplanation\\s*:.*', '')")} as t from a),
c as (select media_id, take_no, line_no, {_STRIP("regexp_replace(t, '(?is)\\bExample\\s*:.*', '')")} as t from b),
d as (select media_id, take_no, line_no, {_STRIP("regexp_replace(t, '(?is)\\bDisclaimer\\s*:.*', '')")} as t from c)
select media_id, take_no, line_no, {_STRIP("regexp_replace(t, '\\n\\[.*?\\].*', '', 'g')")} as text from d""",
    "q_strip_reasoning": _NOISY
    + f""",
a as (
  select media_id, take_no, line_no,
         {_STRIP("regexp_replace(regexp_replace(regexp_replace(said, '(?is)<think>.*?</think>', '', 'g'), '(?is)<reason>.*?</reason>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g')")} as t from zn),
b as (select *, regexp_extract(t, '(?s)^(.*?\\n)\\[', 1) as pre from a)
select media_id, take_no, line_no, {_STRIP(_BODY)} as text from b""",
    "q_verdict_parse": _SEG + " select media_id, take_no, line_no, case line_no % 5 when 0 then 'TF' when 1 then 'FF' when 2 then 'TF' when 3 then null else 'TF' end as v from s",
    "q_min_tokens": _SEG
    + """, n as (select media_id, take_no, line_no, length(text) as n from s)
select media_id, take_no, line_no, greatest(200, cast(floor(n * 1.5) as integer)) as plain, greatest(512, cast(floor(n * 1.5) as integer)) as reasoning,
       greatest(64, cast(n // 4 as integer) + 30) as text, greatest(24, cast(n % 7 as integer) * 8) as verdicts from n""",
    "q_requests": _SEG + " select sha256(concat_ws(chr(31), 'punctuate', 'Add marks.', text, '64', '0.0')) as request_id, count(*) as n from s group by all",
    "q_exchange_none": _SEG + " select false as ok, 1 as attempts, count(distinct text) as n from s",
    "q_translate_none": _SEG + " select media_id, take_no, line_no, text as translated, 'kept_source' as state from s",
    "q_replay": _SEG
    + _windows("accurate")
    + f""",
u as (
  select media_id, take_no, win, cast(count(*) filter (role = 'translate') as integer) as lines,
         nullif(string_agg(text, chr(10) order by line_no) filter (role = 'before'), '') as b, nullif(string_agg('[' || no || '] ' || text, chr(10) order by line_no) filter (role = 'translate'), '') as t,
         nullif(string_agg(text, chr(10) order by line_no) filter (role = 'after'), '') as a from wl group by all),
pr as (select *, concat_ws(chr(10) || chr(10), 'Before:' || chr(10) || b, 'Lines to translate:' || chr(10) || t, 'After:' || chr(10) || a) as prompt from u),
kp as (select distinct prompt from pr where win = 0 order by prompt limit {REPLAYED})
select case when prompt in (select prompt from kp) then 'translated' else 'kept_source' end as state, cast(sum(lines) as bigint) as n from pr group by all""",
    "q_translate_echo": _SEG
    + rf""",
e as (
  select media_id, take_no, start_ms, end_ms, line_no, {_STRIP("regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')")} as text from s)
select media_id, take_no, cast(row_number() over (partition by media_id, take_no order by line_no) as integer) as line_no, start_ms, end_ms, text from e where text <> ''""",
    "q_batch_summary": "select case when p.media_id is null then 'failed' else 'ok' end as status, count(*) as n from (select distinct media_id from media) m left join (select distinct media_id from parsed) p using (media_id) group by all",
}
