"""Command line: word files to subtitles, subtitles and texts to translations, or both in one run over a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cuewright.config import boolean, service, settings
from cuewright.functions.text import srt_time_ms, strip
from cuewright.operators.ordered import dense
from cuewright.operators.segment import MAX_CHARS, MAX_WORDS, segment_words, with_timecodes
from cuewright.operators.words import clip_inflated, with_ends, without_overlaps
from cuewright.plans.exchange import NoBackend, backend
from cuewright.plans.segmentation import segment_with_model
from cuewright.plans.translation import options_of, translate_cues, translate_lines
from cuewright.session import cut, ship
from cuewright.sources import files as I

KEY = ["media_id"]


def words_of(raw: DataFrame) -> DataFrame:
    """Words of word files as the segmentation takes them: those with a start and a text, times in ms, numbered without gaps."""
    w = raw.withColumn("text", strip("text")).where(F.col("start").isNotNull() & (F.col("text") != ""))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return dense(w, KEY, "idx").select("media_id", "pos", ms("start").alias("s_ms"), ms("end").alias("e_ms"), "text")


def cues_of(words: DataFrame, a, seen: Observation | None = None) -> DataFrame:
    """Cues with timecodes, by the rules or with the model that is named; `seen` counts them and those over the limits."""
    w = with_ends(without_overlaps(clip_inflated(cut(words), KEY), KEY), KEY)
    pairs = I.read_pairs(words.sparkSession, a.pairs) if a.pairs else None
    if a.seg_backend == "none":
        cues = segment_words(w, KEY, pairs)
    else:
        cues = segment_with_model(cut(w), backend(service(a.config, a.seg_backend, a.env, model=a.seg_model)), KEY, pairs, store=a.store)
    cues = with_timecodes(cues)
    if seen is None:
        return cues
    n = F.size(F.split("text", r"\s+"))
    over = F.count(F.when((n > MAX_WORDS) | (F.char_length("text") > MAX_CHARS), 1))
    return cues.observe(seen, F.count("*").alias("cues"), F.sum(F.col("we") - F.col("ws")).alias("words"), over.alias("over the limits"))


def _maker(a):
    return NoBackend if a.backend == "none" else backend(service(a.config, a.backend, a.env, url=a.url, model=a.model, key=a.key, form="messages" if a.messages else None))


def _job(a):
    return settings(a.config, source_lang=a.source, target_lang=a.target, target_lang_code=a.code, glossary=a.glossary, number_mode=a.number_mode, allow_simplify_wording=a.simplify)


def translated(cues: DataFrame, a) -> DataFrame:
    """Translated SRT texts, media_id with the language's code."""
    job = _job(a)
    made = translate_cues(cues, KEY, _maker(a), store=a.store, **options_of(job, a.mode))
    made = made.withColumn("tc_start", srt_time_ms("start_ms")).withColumn("tc_end", srt_time_ms("end_ms"))
    return I.srt_text(made).withColumn("media_id", I.output_stem(F.col("media_id"), job.target_lang_code))


def translated_lines(lines: DataFrame, a) -> DataFrame:
    """Translated plain texts; a line that was merged into another is empty."""
    job = _job(a)
    made = translate_lines(lines, KEY, _maker(a), store=a.store, **options_of(job, a.mode))
    made = made.select("media_id", "line_no", F.col("translated").alias("text"))
    return I.plain_text(made).withColumn("media_id", I.output_stem(F.col("media_id"), job.target_lang_code))


def _segment(spark, a) -> list[DataFrame]:
    I.some_texts(spark, a.input, "*.json")
    seen = Observation("segments")
    files = cut(I.srt_text(cues_of(words_of(I.read_words_json(spark, a.input)), a, seen), order="seg_no"))
    print(", ".join(f"{v or 0} {k}" for k, v in seen.get.items()))
    return [I.write_files(files, a.output, ".srt"), I.write_files(files, a.output, ".txt")]


def _translate(spark, a) -> list[DataFrame]:
    """SRT files to SRT and TXT of one content, TXT files (those without any time line) to TXT."""
    found = I.some_texts(spark, a.input, a.ext if a.ext else "*.{srt,txt}", fallback=a.charset)
    srt, txt = found.where(I.is_srt("text")), found.where(~I.is_srt("text"))
    out = []
    if not srt.isEmpty():
        files = cut(translated(I.parse_srt(srt), a))
        out += [I.write_files(files, a.output, ".srt"), I.write_files(files, a.output, ".txt")]
    if not txt.isEmpty():
        out.append(I.write_files(translated_lines(I.plain_lines(txt), a), a.output, ".txt"))
    return out


def _run(spark, a) -> list[DataFrame]:
    """Word files to subtitles and on to translations, whichever of the two is asked for."""
    if not (a.segment or a.translate):
        raise SystemExit("at least one of --segment and --translate must be true")
    if a.mode and not a.translate:
        raise SystemExit("--mode only applies with --translate true")
    if not a.segment:
        return _translate(spark, a)
    I.some_texts(spark, a.input, "*.json")
    cues = cut(cues_of(words_of(I.read_words_json(spark, a.input)), a))
    files = cut(I.srt_text(cues, order="seg_no"))
    out = [I.write_files(files, a.output, ".srt"), I.write_files(files, a.output, ".txt")]
    if a.translate:
        lines = cues.select("media_id", (F.col("seg_no") + 1).alias("line_no"), "start_ms", "end_ms", "tc_start", "tc_end", "text")
        made = cut(translated(lines, a))
        out += [I.write_files(made, a.output, ".srt"), I.write_files(made, a.output, ".txt")]
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("segment", help="word JSON files to SRT and TXT files")
    t = sub.add_parser("translate", help="SRT and TXT files to translated ones")
    r = sub.add_parser("run", help="word JSON files to SRT files and their translations")
    for x in (s, t, r):
        x.add_argument("input", help="folder to read")
        x.add_argument("output", help="folder to write, shared by all executors")
        x.add_argument("--config", help="JSON file of settings; what is said here goes before it")
        x.add_argument("--env", help="file of NAME=value lines with keys")
        x.add_argument("--store", help="folder that keeps answers")
    for x in (s, r):
        x.add_argument("--seg-backend", default="none", help="a service of the settings file that helps to segment")
        x.add_argument("--seg-model")
        x.add_argument("--pairs", help="file of protected pairs of words, two columns")
    for x in (t, r):
        x.add_argument("--backend", default="none", help="none, or a service of the settings file")
        x.add_argument("--url", default="")
        x.add_argument("--model", default="")
        x.add_argument("--key", default="")
        x.add_argument("--messages", action="store_true", help="the service speaks the messages form")
        x.add_argument("--source", help="language of the input")
        x.add_argument("--target", help="language asked for")
        x.add_argument("--code", help="code in the names of output files")
        x.add_argument("--mode", choices=["accurate", "flexible"])
        x.add_argument("--glossary", nargs="*")
        x.add_argument("--number-mode", choices=["auto", "src_lang", "digits", "tgt_lang"])
        x.add_argument("--simplify", type=boolean)
        x.add_argument("--ext", help="files to read, as a pattern; by default *.srt and *.txt")
        x.add_argument("--charset", default="ISO-8859-1", help="of files that are not UTF-8")
    r.add_argument("--segment", type=boolean, default=True)
    r.add_argument("--translate", type=boolean, default=False)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cuewright").getOrCreate()
    ship(spark)
    files = total = 0
    for part in {"segment": _segment, "translate": _translate, "run": _run}[a.command](spark, a):
        done = part.groupBy().agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first()
        files, total = files + done.files, total + (done.bytes or 0)
    print(f"{files} files, {total} bytes")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
