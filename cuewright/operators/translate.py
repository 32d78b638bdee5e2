"""Translation of numbered lines around a language model: windows, prompts, replies, repair, rebuilding.

Lines are keyed by source and line_no (from 1, dense). Windows do not read earlier answers, so every window of
every source runs on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import char_similarity, missed_script, post_process, strip, strip_template_tokens
from cuewright.operators.keys import join_on
from cuewright.operators.ordered import dense, neighbours, running_sum

#: Lines translated and shown per window, and lines of context before the translated ones (first window, later ones).
MODES = {"accurate": (2, 4, 1), "flexible": (4, 8, 2)}


def windows(sizes: DataFrame, keys: list[str], n: str = "n", mode: str = "accurate") -> DataFrame:
    """The windows of sources with n lines: keys, win, ctx_start, ctx_end, tr_start, tr_end (0-based, ends exclusive).

    Window k translates T lines from k * T on; it shows C lines, beginning T - first lines earlier (the first
    window shows none before). Sources without lines have no window.
    """
    t, c, first = MODES[mode]
    k, size = F.col("win"), F.col(n)
    last = F.floor((size - 1) / t).cast("int")
    w = sizes.where(size > 0).select(*keys, n, F.explode(F.sequence(F.lit(0), last)).alias("win"))
    start = F.when(k == 0, 0).otherwise((k - 1) * t + first)
    tr_end = F.least((k + 1) * t, size)
    return w.select(*keys, "win", start.cast("int").alias("ctx_start"), F.least(F.greatest(start + c, tr_end), size).cast("int").alias("ctx_end"), (k * t).cast("int").alias("tr_start"), tr_end.cast("int").alias("tr_end"))


def window_lines(lines: DataFrame, keys: list[str], mode: str = "accurate") -> DataFrame:
    """Each line in every window that shows it: keys, win, line_no, role ('before', 'translate', 'after'), no (from 1 among the translated), text.

    In flexible mode lines that have timecodes (columns tc_start, tc_end) show them, as a column `tc`.
    A line's windows follow from its number, so no join is needed; the last windows of a source are cut at its end by
    the lines that exist.
    """
    t, c, first = MODES[mode]
    i = F.col("line_no") - 1
    reach = -(-c // t)
    own = F.floor(i / t).cast("int")
    wins = F.sequence(F.greatest(own - reach, F.lit(0)), own + 1)
    timed = mode == "flexible" and {"tc_start", "tc_end"} <= set(lines.columns)
    tc = [F.concat(F.lit("["), F.col("tc_start"), F.lit(" --> "), F.col("tc_end"), F.lit("]")).alias("tc")] if timed else []
    rows = lines.select(*keys, "line_no", "text", *tc, F.explode(wins).alias("win"))
    k = F.col("win")
    start = F.when(k == 0, 0).otherwise((k - 1) * t + first)
    end = F.greatest(start + c, (k + 1) * t)
    inside = (i >= start) & (i < end)
    role = F.when(i < k * t, "before").when(i < (k + 1) * t, "translate").otherwise("after")
    shown = rows.where(inside).withColumn("role", role).withColumn("no", F.when(F.col("role") == "translate", (i - k * t + 1).cast("int")))
    # a window exists if it translates a line: window k does if line k * T exists, which is the line its own number points to
    alive = lines.where(F.pmod(i, F.lit(t)) == 0).select(*keys, F.floor(i / t).cast("int").alias("win"))
    return join_on(shown, alive, [*keys, "win"], "left_semi").select(*keys, "win", "line_no", "role", "no", "text", *(["tc"] if timed else []))


def user_prompts(shown: DataFrame, keys: list[str]) -> DataFrame:
    """The prompt of each window: context before, numbered lines, context after; timecodes before the texts of lines that show them."""
    said = F.coalesce("text", F.lit(""))
    if "tc" in shown.columns:
        said = F.concat_ws(" ", "tc", said)

    def part(role: str, of: Column) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("line_no", of.alias("t")))))
        return F.array_join(F.transform(rows, lambda x: x.t), "\n")

    numbered = F.concat(F.lit("["), F.col("no").cast("string"), F.lit("] "), said)
    p = shown.groupBy(*keys, "win").agg(part("before", said).alias("b"), part("translate", numbered).alias("t"), part("after", said).alias("a"), F.count(F.when(F.col("role") == "translate", 1)).cast("int").alias("lines"))
    head = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}:\n"), F.col(c)))
    return p.select(*keys, "win", "lines", F.concat_ws("\n\n", head("Before", "b"), head("Lines to translate", "t"), head("After", "a")).alias("user"))


def system_prompt(source: str, target: str, *, punctuation: bool = True, flexible: bool = False, simplify: bool = False, glossary: list[str] | None = None, numbers: str = "auto", custom: str = "") -> str:
    """The instruction of a job; a custom one takes the place of all."""
    if custom:
        return custom
    parts = [f"Translate the numbered subtitle lines from {source} into {target}."]
    parts.append("Keep sentence marks." if punctuation else "Leave out marks at the end of a line.")
    parts.append("Lines may be merged where word order asks for it." if flexible else "Keep every line in its place.")
    if simplify:
        parts.append("Prefer plain wording.")
    if glossary:
        parts.append("Use these terms: " + "; ".join(glossary) + ".")
    if numbers != "auto":
        parts.append({"src_lang": "Write numbers as the source does.", "digits": "Write numbers in digits.", "tgt_lang": f"Write numbers as words of {target}."}[numbers])
    parts.append("Answer with one line [N] text per line, or [N-M] text for merged lines, and nothing else.")
    return " ".join(parts)


#: The forms a reply line may have.
TIMECODE = r"^\[\d{2}:\d{2}:\d{2}[，,.]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[，,.]\d{3}\]\s*"
BRACKETED = r"^\[(\d{1,9})(?:\s*-\s*(\d{1,9}))?\]\s*(?:\[([\d:,]+\s*-->\s*[\d:,]+)\]\s*)?(.+)"
LABELLED = r"^(?i:(?:Line\s*)?(\d{1,9})\s*[:：]\s*(.+))"
BARE = r"^(\d{1,9})\s+(.+)"


def parse_replies(replies: DataFrame, keys: list[str], content: str = "content", lines: str = "lines") -> DataFrame:
    """The items of each reply: keys, ord, n, m (1-based, as written), tc, text, form ('bracket', 'label', 'bare' or 'line').

    A reply ends at its first template token. Labelled and bare numbers count only within the window's lines; lines
    of form 'line' carry no number. A null reply has no items.
    """
    body = strip(F.get(F.split(F.col(content), r"<\|", 2), F.lit(0)))
    clean = F.transform(F.split(body, "\n", -1), lambda x: strip(F.regexp_replace(strip_template_tokens(strip(x)), TIMECODE, "")))
    rows = replies.select(*keys, F.col(lines).alias("_lines"), F.posexplode(F.filter(clean, lambda x: x != "")).alias("ord", "_l"))
    part = lambda pattern, i: F.regexp_extract("_l", pattern, i)
    num = lambda pattern, i: F.try_to_number(F.nullif(part(pattern, i), F.lit("")), F.lit("999999999")).cast("int")
    form = F.when(F.col("_l").rlike(BRACKETED), "bracket").when(F.col("_l").rlike(LABELLED), "label").when(F.col("_l").rlike(BARE), "bare").otherwise("line")
    rows = rows.withColumn("form", form)
    f = F.col("form")
    n = F.when(f == "bracket", num(BRACKETED, 1)).when(f == "label", num(LABELLED, 1)).when(f == "bare", num(BARE, 1))
    m = F.when(f == "bracket", F.coalesce(num(BRACKETED, 2), n)).otherwise(n)
    text = F.when(f == "bracket", part(BRACKETED, 4)).when(f == "label", part(LABELLED, 2)).when(f == "bare", F.regexp_replace(strip(part(BARE, 2)), TIMECODE, "")).otherwise(F.col("_l"))
    out = rows.select(*keys, "_lines", "ord", n.alias("n"), m.alias("m"), F.when(f == "bracket", F.nullif(part(BRACKETED, 3), F.lit(""))).alias("tc"), strip(text).alias("text"), "form")
    valid = ~F.col("form").isin("label", "bare") | F.col("n").between(1, F.col("_lines"))
    return out.where(valid).drop("_lines")


def resolve(replies: DataFrame, keys: list[str], items: DataFrame, lines: str = "lines") -> DataFrame:
    """What each line of a window got: keys, no (from 1), translated (null if it was merged or left out), covered.

    Items set their line and cover those up to m, within the window; of several the last one counts. Without any
    numbered item the lines of the reply count in order.
    """
    size = replies.select(*keys, F.col(lines).alias("_lines"))
    numbered = items.where(F.col("form") != "line")
    has = numbered.select(*keys).distinct().withColumn("_has", F.lit(True))
    x = join_on(numbered, size, keys).where(F.col("n").between(1, F.col("_lines")))
    x = x.select(*keys, "ord", "n", F.explode(F.sequence("n", F.greatest(F.least("m", "_lines"), F.col("n")))).alias("no"), "text")
    set_ = x.groupBy(*keys, "no").agg(F.max_by(F.struct(F.when(F.col("no") == F.col("n"), F.col("text")).alias("t")), "ord").alias("s"))
    plain = join_on(items.where(F.col("form") == "line"), has, keys, "left_anti")
    plain = dense(plain, keys, "ord", "no").withColumn("no", F.col("no") + 1).select(*keys, "no", F.struct(F.col("text").alias("t")).alias("s"))
    got = set_.unionByName(plain)
    rows = size.where(F.col("_lines") > 0).select(*keys, F.explode(F.sequence(F.lit(1), "_lines")).alias("no"))
    return join_on(rows, got, [*keys, "no"], "left").select(*keys, "no", F.col("s.t").alias("translated"), F.col("s").isNotNull().alias("covered"))


def overflow(items: DataFrame, keys: list[str], windows_: DataFrame, sizes: DataFrame, source_keys: list[str], n: str = "n") -> DataFrame:
    """Items that cover a line beyond their window: source_keys, merged_no, overflowed_no (line numbers from 1)."""
    x = join_on(items.where(F.col("form") == "bracket").withColumnsRenamed({"n": "_n", "m": "_m"}), windows_, keys)
    size = F.col("tr_end") - F.col("tr_start")
    x = x.where(F.col("_n").between(1, size) & (F.col("_m") > size))
    x = join_on(x, sizes.select(*source_keys, F.col(n).alias("_all")), source_keys).where(F.col("tr_end") < F.col("_all"))
    return x.select(*source_keys, (F.col("tr_start") + F.col("_n")).cast("int").alias("merged_no"), (F.col("tr_end") + 1).cast("int").alias("overflowed_no")).distinct()


def finished(resolved: DataFrame, target: str, add_punctuation: bool = True, spacing: str = "auto") -> DataFrame:
    """Post-processed translations with their state: translated, merged, or kept_source where the window failed."""
    done = F.when(F.col("failed"), F.col("source")).when(F.col("translated").isNotNull(), post_process("translated", target, add_punctuation, spacing))
    state = F.when(F.col("failed"), "kept_source").when(F.col("translated").isNotNull(), "translated").otherwise("merged")
    return resolved.withColumn("state", state).withColumn("translated", done)


def drift(lines: DataFrame, keys: list[str], threshold: float | None = 0.16, source: str = "source", translated: str = "translated") -> DataFrame:
    """Neighbouring lines whose translations are more alike than their sources: keys, line_no, sim_source, sim_translated.

    line_no is the first of the two. A null on either side is no pair; without a threshold nothing is.
    """
    if threshold is None:
        return lines.select(*keys, "line_no", F.lit(0.0).alias("sim_source"), F.lit(0.0).alias("sim_translated")).where(F.lit(False))
    near = neighbours(lines.select(*keys, "line_no", F.col(source).alias("_s"), F.col(translated).alias("_t")), keys, "line_no", 1, _s2=lambda w: F.lead("_s").over(w), _t2=lambda w: F.lead("_t").over(w))
    near = near.where(F.col("_t").isNotNull() & F.col("_t2").isNotNull() & F.col("_s").isNotNull() & F.col("_s2").isNotNull())
    near = near.select(*keys, "line_no", char_similarity("_s", "_s2").alias("sim_source"), char_similarity("_t", "_t2").alias("sim_translated"))
    return near.where(F.col("sim_translated") - F.col("sim_source") > threshold)


def left_in_source_script(lines: DataFrame, target: str = "chinese", source: str = "source", translated: str = "translated") -> DataFrame:
    """Translated lines without a character of the target's script that are copies or at least three words long."""
    return lines.where(missed_script(translated, source, target))


def rebuild(lines: DataFrame, keys: list[str], translated: str = "translated") -> DataFrame:
    """Cues of the translated lines: keys, line_no (from 1), start_ms, end_ms, text.

    A line without translation lends its time to the nearest line before that has one; lines before the first
    translation are left out.
    """
    n = F.col(translated).isNotNull().cast("int")
    numbered = running_sum(lines.withColumn("_n", n), keys, "line_no", "_n", "_to").where(F.col("_to") > 0)
    return numbered.groupBy(*keys, F.col("_to").cast("int").alias("line_no")).agg(
        F.min_by("start_ms", F.col("line_no")).alias("start_ms"),
        F.max_by("end_ms", F.col("line_no")).alias("end_ms"),
        F.max(translated).alias("text"),
    )

