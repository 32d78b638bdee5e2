"""Lines to translated cues: windows, prompts, exchange, parsing, repair, rebuilding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.config import Settings
from cuewright.functions.text import SCRIPT_OF, has_cjk, min_tokens, post_process, strip, strip_reasoning
from cuewright.operators.keys import join_on
from cuewright.operators.translate import MODES, drift, finished, left_in_source_script, overflow, parse_replies, rebuild, resolve, system_prompt, user_prompts, window_lines, windows
from cuewright.plans.exchange import Backend, exchange, requests
from cuewright.session import cut


def translate_lines(
    lines: DataFrame,
    keys: list[str],
    make: Callable[[], Backend],
    *,
    source: str = "english",
    target: str = "chinese",
    mode: str = "accurate",
    add_punctuation: bool = True,
    spacing: str = "auto",
    glossary: list[str] | None = None,
    simplify: bool = False,
    numbers: str = "auto",
    custom: str | None = None,
    script_rounds: int = 2,
    drift_threshold: float | None = 0.16,
    repair: bool = True,
    store: str | None = None,
    **policy,
) -> DataFrame:
    """Each line with its translation: keys, line_no, source, translated, state.

    A window whose calls all failed keeps its source lines; a line merged into another has no translation. Windows
    without any character of the target's script are asked again up to script_rounds times. With repair, three more
    kinds of lines are asked again: merges that reached into the next window, neighbours that drifted together, and
    single lines without the target's script. Requests and replies are checkpointed when called, so nothing is asked twice.
    """
    shown = window_lines(lines, keys, mode)
    win = [*keys, "win"]
    ask = _Asker(make, store, policy, {"target": target, "add_punct": add_punctuation, "spacing": spacing})
    wording = {"punctuation": add_punctuation, "glossary": glossary, "simplify": simplify, "numbers": numbers}
    system = system_prompt(source, target, flexible=mode == "flexible", custom=custom or "", **wording)
    prompts = user_prompts(shown, keys)
    size = min_tokens(F.char_length("user"))
    replies = ask(prompts, "translate", system, F.col("user"), size, [*win, "lines", "user"])
    items = cut(parse_replies(replies, win))
    script = SCRIPT_OF.get(target.strip().lower())
    for k in range(script_rounds if script else 0):
        foreign = items.groupBy(*win).agg(F.max(has_cjk("text", script)).alias("_ok")).where("not _ok")
        again = join_on(replies.select(*win, "lines", "user"), foreign.select(*win), win, "left_semi")
        urged = f"{system} This is attempt {k + 2}: the answer before was not in {target}. Every line must be."
        fresh = parse_replies(ask(again, "translate again", urged, F.col("user"), size, [*win, "lines", "user"]), win)
        good = fresh.groupBy(*win).agg(F.max(has_cjk("text", script)).alias("_ok")).where("_ok").select(*win)
        items = cut(join_on(items, good, win, "left_anti").unionByName(join_on(fresh, good, win, "left_semi")))
    got = resolve(replies, win, items)
    got = join_on(got, replies.select(*win, F.col("content").isNull().alias("failed")), win)
    t = MODES[mode][0]
    got = got.select(*keys, (F.col("win") * t + F.col("no")).alias("line_no"), "translated", "failed")
    both = join_on(lines.select(*keys, "line_no", F.col("text").alias("source")), got, [*keys, "line_no"], "left")
    both = both.withColumn("failed", F.coalesce("failed", F.lit(True)))
    done = finished(both, target, add_punctuation, spacing).select(*keys, "line_no", "source", "translated", "state")
    if not repair:
        return done
    done = _resplit(cut(done), items, lines, keys, mode, ask)
    single = system_prompt(source, target, **wording) + " Translate only the one line given, without its neighbours."
    if drift_threshold is not None:
        pairs = drift(done, keys, drift_threshold)
        near = pairs.select(*keys, "line_no").unionByName(pairs.select(*keys, (F.col("line_no") + 1).alias("line_no"))).distinct()
        done = _replaced(done, _one_by_one(join_on(done, near, [*keys, "line_no"], "left_semi"), keys, single, "drift", ask), keys)
    if script:
        missed = left_in_source_script(done, target.strip().lower())
        fresh = _one_by_one(missed, keys, f"{single} Answer in {target} script.", "script", ask)
        done = _replaced(done, fresh.where(has_cjk("fresh", script)), keys)
    return done


class _Asker:
    """Asks for rows and puts the cleaned answers beside them as `content`."""

    def __init__(self, make: Callable[[], Backend], store: str | None, policy: dict, finish: dict):
        self.make, self.store, self.policy, self.finish = make, store, policy, finish

    def __call__(self, rows: DataFrame, stage: str, system: str, user: Column, size: Column, keep: list[str]) -> DataFrame:
        asked = cut(requests(rows, stage, system, user, size, keep=[c for c in keep if c != "user"]))
        said = exchange(asked, self.make, self.store, **self.policy)
        both = asked.select(*keep, "request_id").join(said.select("request_id", "content"), "request_id", "left")
        return cut(both.withColumn("content", strip_reasoning("content")).drop("request_id"))

    def done(self, text: Column) -> Column:
        return post_process(text, self.finish["target"], self.finish["add_punct"], self.finish["spacing"])


def _one_by_one(rows: DataFrame, keys: list[str], system: str, stage: str, ask: _Asker) -> DataFrame:
    """New translations of single lines: keys, line_no, fresh; none where the answer has not the form asked for."""
    user = F.concat(F.lit("Lines to translate:\n[1] "), F.col("source"))
    said = ask(rows.select(*keys, "line_no", "source"), stage, system, user, min_tokens(F.char_length(user)), [*keys, "line_no"])
    text = F.regexp_extract(strip("content"), r"^\[1(?:\s*-\s*1)?\]\s*(.+)", 1)
    return said.where(F.coalesce(text, F.lit("")) != "").select(*keys, "line_no", ask.done(strip(text)).alias("fresh")).where("fresh <> ''")


def _replaced(done: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    both = join_on(done, fresh.select(*keys, "line_no", "fresh"), [*keys, "line_no"], "left")
    state = F.when(F.col("fresh").isNotNull(), "translated").otherwise(F.col("state"))
    return cut(both.select(*keys, "line_no", "source", F.coalesce("fresh", "translated").alias("translated"), state.alias("state")))


#: Our own wording of the request to part two overlapping translations.
RESPLIT = "Two neighbouring subtitle translations overlap. Part them so that each says what its own source line says. Answer with the two lines [N] text."


def _resplit(done: DataFrame, items: DataFrame, lines: DataFrame, keys: list[str], mode: str, ask: _Asker) -> DataFrame:
    """Lines whose merge reached into the next window, asked again together with the line they reached into."""
    sizes = lines.groupBy(*keys).agg(F.max("line_no").cast("int").alias("n"))
    pairs = overflow(items, [*keys, "win"], windows(sizes, keys, mode=mode), sizes, keys)
    side = lambda name, no: done.select(*keys, F.col("line_no").alias(no), F.col("source").alias(f"s{name}"), F.col("translated").alias(f"t{name}")).where(f"t{name} is not null")
    pairs = join_on(join_on(pairs, side("a", "merged_no"), [*keys, "merged_no"]), side("b", "overflowed_no"), [*keys, "overflowed_no"])
    line = lambda no, c: F.concat(F.lit("["), F.col(no).cast("string"), F.lit("] "), F.col(c))
    user = F.concat_ws("\n", F.lit("Sources:"), line("merged_no", "sa"), line("overflowed_no", "sb"), F.lit("Translations:"), line("merged_no", "ta"), line("overflowed_no", "tb"))
    said = ask(pairs, "part", RESPLIT, user, min_tokens(F.char_length(user)), [*keys, "merged_no", "overflowed_no"])
    of = lambda no: F.call_function("regexp_extract", F.col("content"), F.concat(F.lit(r"(?m)^\s*\["), F.col(no).cast("string"), F.lit(r"\]\s*(.+)$")), F.lit(1))
    said = said.withColumn("a", of("merged_no")).withColumn("b", of("overflowed_no")).where("a <> '' and b <> ''")
    part = lambda no, c: said.select(*keys, F.col(no).alias("line_no"), ask.done(F.col(c)).alias("fresh"))
    fresh = part("merged_no", "a").unionByName(part("overflowed_no", "b"))
    return _replaced(done, fresh.groupBy(*keys, "line_no").agg(F.max("fresh").alias("fresh")), keys)


def options_of(settings: Settings, mode: str | None = None) -> dict:
    """What translate_lines takes, of a job's settings; flexible word order means the flexible mode unless one is named."""
    return {
        "source": settings.source_lang, "target": settings.target_lang, "mode": mode or ("flexible" if settings.allow_flexible_word_order else "accurate"),
        "add_punctuation": settings.add_punctuation, "spacing": settings.spacing, "glossary": settings.glossary, "simplify": settings.allow_simplify_wording,
        "numbers": settings.number_mode, "custom": settings.custom_system_prompt, "drift_threshold": settings.drift,
    }


def translate_cues(cues: DataFrame, keys: list[str], make: Callable[[], Backend], **options) -> DataFrame:
    """Cues (line_no, start_ms, end_ms, text) to translated cues, merged lines absorbed."""
    times = [c for c in ("tc_start", "tc_end") if c in cues.columns]
    lines = translate_lines(cues.select(*keys, "line_no", "text", *times), keys, make, **options)
    timed = join_on(cues.select(*keys, "line_no", "start_ms", "end_ms"), lines, [*keys, "line_no"])
    return rebuild(timed, keys)
