"""Subtitle, text and word files as DataFrames, and back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuewright.functions.text import parse_srt_time, srt_time_ms, strip, without_bom
from cuewright.operators.ordered import neighbours, running_sum
from cuewright.operators.words import ALIGNED

TIME = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
TIME_LINE = rf"^({TIME})\s*-->\s*({TIME})"
WORDS_JSON = "array<struct<start: double, end: double, text: string, seg_idx: int>>"


def texts(spark: SparkSession, path: str, glob: str = "*.srt", fallback: str = "ISO-8859-1") -> DataFrame:
    """Whole files of a folder: media_id (the file name without its ending), path, text without byte-order mark. Not recursive.

    A file that is not valid UTF-8 is read by the fallback character set.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", fallback))
    return raw.select(media_id(F.col("path")).alias("media_id"), "path", without_bom(text).alias("text"))


def some_texts(spark: SparkSession, path: str, glob: str, **options) -> DataFrame:
    """texts(), or an error where no file matches."""
    found = texts(spark, path, glob, **options)
    if found.isEmpty():
        raise FileNotFoundError(f"no {glob} in {path}")
    return found


def media_id(path: Column) -> Column:
    return F.regexp_extract(F.url_decode(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def output_stem(stem: Column, code: str) -> Column:
    """The stem of a translated file: an ending _CODE (as it is or in lower case) is not doubled."""
    return F.concat(F.regexp_replace(stem, f"(_{code}|_{code.lower()})$", ""), F.lit(f"_{code}"))


def is_srt(text: Column | str) -> Column:
    """Whether a text has an SRT time line anywhere."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.rlike(rf"{TIME}\s*-->\s*{TIME}"), F.lit(False))


def lines_of(text: Column) -> Column:
    """Stripped lines of a text."""
    return F.transform(F.split(text, r"\r?\n", -1), strip)


def parse_srt(files: DataFrame, key: str = "media_id", text: str = "text") -> DataFrame:
    """Cues of SRT texts: key, line_no, tc_start, tc_end, start_ms, end_ms, text.

    A cue is a line of digits, a time line right after it, and the lines up to the next blank one, joined
    with a space; its own number is ignored, its text may be empty. A number that no time line follows takes the
    next line with it. Other lines outside cues are ignored. Null texts have no cues.
    """
    rows = files.select(key, F.posexplode(lines_of(F.col(text))).alias("n", "line"))
    digits, blank = F.col("line").rlike(r"^\d+$"), F.col("line") == ""
    near = neighbours(rows, [key], "n", 1, _next=lambda w: F.lead("line").over(w))
    # blank lines bound stretches of lines; in a stretch the cue begins with its first number that a time line follows
    near = running_sum(near.withColumn("_digits", digits).withColumn("_blank", blank.cast("int")), [key], "n", "_blank", "_stretch").where("_blank = 0")
    w = W.partitionBy(key, "_stretch")
    before = w.orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    in_row = F.col("n") - F.coalesce(F.max(F.when(~F.col("_digits"), F.col("n"))).over(before), F.min("n").over(w) - 1)
    opens = F.col("_digits") & (in_row % 2 == 1) & F.coalesce(F.col("_next").rlike(TIME_LINE), F.lit(False))
    near = near.withColumn("_open", opens)
    near = near.withColumn("_at", F.min(F.when(F.col("_open"), F.col("n"))).over(w))
    cue = near.where(F.col("n") > F.col("_at")).groupBy(key, "_stretch", "_at").agg(
        F.max(F.when(F.col("n") == F.col("_at") + 1, F.col("line"))).alias("_time"),
        F.sort_array(F.collect_list(F.when(F.col("n") > F.col("_at") + 1, F.struct("n", "line")))).alias("_t"),
    )
    cue = running_sum(cue.withColumn("_one", F.lit(1)), [key], "_at", "_one", "line_no")
    code = lambda i: F.replace(F.regexp_extract("_time", TIME_LINE, i), F.lit("."), F.lit(","))
    out = cue.select(key, F.col("line_no").cast("int").alias("line_no"), code(1).alias("tc_start"), code(2).alias("tc_end"), F.array_join(F.transform("_t", lambda x: x.line), " ").alias("text"))
    return out.select(key, "line_no", "tc_start", "tc_end", parse_srt_time("tc_start").alias("start_ms"), parse_srt_time("tc_end").alias("end_ms"), "text")


def plain_lines(files: DataFrame, key: str = "media_id", text: str = "text") -> DataFrame:
    """Lines of plain texts that are not blank, stripped: key, line_no from 1, text."""
    kept = F.filter(lines_of(F.col(text)), lambda x: x != "")
    return files.select(key, F.posexplode(kept).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def read_words_json(spark: SparkSession, path: str) -> DataFrame:
    """Word caches (a JSON array per file): media_id, idx, seg_idx, start, end, text, in the array's order."""
    raw = texts(spark, path, "*.json")
    w = raw.select("media_id", F.posexplode(F.from_json("text", WORDS_JSON)).alias("idx", "w"))
    return w.select("media_id", "idx", "w.seg_idx", "w.start", "w.end", "w.text")


def words_json(words: DataFrame, key: str = "media_id") -> DataFrame:
    """One JSON array per media, in order of idx: key, text."""
    w = F.struct("idx", F.struct("start", "end", "text", "seg_idx").alias("w"))
    arr = F.transform(F.sort_array(F.collect_list(w)), lambda x: x.w)
    return words.groupBy(key).agg(F.to_json(arr, {"ignoreNullFields": "false"}).alias("text"))


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Alignment results (JSON objects, one per file or line) with the schema of `aligned_words`."""
    return spark.read.schema(ALIGNED).json(path, multiLine=True)


def srt_text(cues: DataFrame, key: str = "media_id", order: str = "line_no") -> DataFrame:
    """One SRT text with byte-order mark per media: key, text.

    Cues without text or without a time are left out but counted, so numbers may have gaps. A media's text
    gathers in one row, as its file does.
    """
    numbered = running_sum(cues.withColumn("_one", F.lit(1)), [key], order, "_one", "_no")
    block = F.concat_ws("\n", F.col("_no").cast("string"), F.concat_ws(" --> ", "tc_start", "tc_end"), "text", F.lit(""), F.lit(""))
    shown = numbered.where((F.col("text") != "") & F.col("tc_start").isNotNull() & F.col("tc_end").isNotNull())
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_no", block.alias("b")))), lambda x: x.b), "")
    return shown.groupBy(key).agg(F.concat(F.lit("﻿"), joined).alias("text"))


def plain_text(lines: DataFrame, key: str = "media_id", order: str = "line_no") -> DataFrame:
    """One plain text with byte-order mark per media; a null line becomes an empty one, no line end follows the last."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x.t), "\n")
    return lines.groupBy(key).agg(F.concat(F.lit("﻿"), joined).alias("text"))


def word_level(words: DataFrame, key: str = "media_id", order: str = "pos") -> DataFrame:
    """Each word as a cue of its own, for looking at times: key, text (an SRT text per media)."""
    end = F.coalesce("e_ms", "s_ms")
    return srt_text(words.withColumn("tc_start", srt_time_ms("s_ms")).withColumn("tc_end", srt_time_ms(end)), key, order)


def read_pairs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Protected pairs of a table file of two columns (CSV without a head, or Parquet): lower-case words, blank ones left out.

    They are used as a literal and sent to tasks, so more than 20 000 are an error; join larger tables (break_flags).
    """
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path)
    a, b = (F.lower(strip(F.col(c))) for c in raw.columns[:2])
    some = raw.select(a.alias("w1"), b.alias("w2")).where("w1 <> '' and w2 <> ''").distinct().limit(20_001).collect()
    if len(some) > 20_000:
        raise ValueError("more than 20000 pairs; join them as a table instead (break_flags)")
    return sorted((r.w1, r.w2) for r in some)


def write_files(files: DataFrame, folder: str, ending: str, key: str = "media_id") -> DataFrame:
    """Writes each row's text to folder/<key><ending> and returns key, path, bytes. Runs when an action asks for it.

    The folder, a path or an address (hdfs, s3, gs, abfs), must be one that all executors share. A file is written under
    another name and then moved, so a lost executor leaves no half file, and a repeated task overwrites its own.
    """
    schema = f"{key} string, path string, bytes long"

    def run(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        system.create_dir(root, recursive=True)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf["text"]):
                name = f"{str(k).replace('/', '_')}{ending}"
                data = (t or "").encode("utf-8")
                part = f"{root}/.{name}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(data)
                system.move(part, f"{root}/{name}")
                rows.append((str(k), f"{folder.rstrip('/')}/{name}", len(data)))
            yield pd.DataFrame(rows, columns=[key, "path", "bytes"])

    return files.select(F.col(key).cast("string").alias(key), "text").mapInPandas(run, schema)
