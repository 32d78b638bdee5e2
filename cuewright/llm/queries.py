"""Queries of the training-text problems; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.llm.leaks import leaks
from cuewright.llm.lookalike import consistent_form, same_look_links, same_look_pairs
from cuewright.llm.packing import pack
from cuewright.llm.pairs import judged_pairs, reply_pairs
from cuewright.llm.repetition import repetition
from cuewright.llm.sentences import sentence_units
from cuewright.llm.split import split_oversized
from cuewright.llm.truncation import truncated
from cuewright.operators.keys import once
from cuewright.plans.tables import table

SEG = ["media_id", "take_no", "seg_no"]


def p1_found(spark, d):
    return sentence_units(table(spark, d, "words"))


def p1_lengths(spark, d):
    """Per take: its sentence units and their mean length in words."""
    u = sentence_units(table(spark, d, "words"))
    words = F.col("last_idx") - F.col("first_idx") + 1
    return u.groupBy("media_id", "take_no").agg(F.count("*").alias("units"), F.round(F.avg(words), 4).alias("mean_words"), F.max(words).alias("longest"))


def p2_found(spark, d):
    """Segments of which more than half the letters repeat earlier wording; repeated deliveries meet only as keys."""
    s = table(spark, d, "segments").select(*SEG, "text")
    return repetition(s).where("2 * repeated_letters > letters").select(*SEG).distinct()


def p2_shares(spark, d):
    """The repeated share of every segment."""
    return repetition(once(table(spark, d, "segments"), SEG, ["text"])).select(*SEG, "letters", "repeated_letters", "repeated_share")


def p4_found(spark, d):
    """Segments that the splitting operator had to cut up; repeated deliveries meet only as keys."""
    return split_oversized(table(spark, d, "segments"), SEG).select(*SEG).distinct()


def p4_pieces(spark, d):
    """The pieces of oversized segments, cut between words, with word times and an overlap of two words."""
    s = once(table(spark, d, "segments"), SEG, ["text", "start", "end"])
    w = once(table(spark, d, "words"), ["media_id", "take_no", "idx"], ["seg_idx", "start", "end", "text"])
    return split_oversized(s, SEG, w.withColumnRenamed("seg_idx", "seg_no"), overlap=2)


def p5_found(spark, d):
    pairs = reply_pairs(table(spark, d, "parsed"), table(spark, d, "segments"))
    return judged_pairs(pairs, SEG).where("defect is not null").select(*SEG, "defect")


def p5_by_target(spark, d):
    """Per language asked for: replies and how many of them have each defect."""
    pairs = reply_pairs(table(spark, d, "parsed"), table(spark, d, "segments"))
    kinds = ["empty", "refusal", "copy", "wrong_lang", "truncated"]
    j = judged_pairs(pairs, SEG)
    return j.groupBy("target").agg(F.count("*").alias("replies"), *[F.count(F.when(F.col("defect") == k, 1)).alias(k) for k in kinds])


def p6_found(spark, d):
    return same_look_pairs(table(spark, d, "cues"), "cue_id").select(F.col("a").alias("cue_a"), F.col("b").alias("cue_b"))


def p6_consistent(spark, d):
    """Every cue in one consistent form."""
    c = once(table(spark, d, "cues"), ["cue_id"], ["text"])
    return consistent_form(c).select("cue_id", "consistent", F.hex("look").alias("look"))


def p6_links(spark, d):
    """Every cue with the class of its look, its exact copies and the cues that only look the same."""
    return same_look_links(table(spark, d, "cues"), "cue_id")


def p8_pack(spark, d):
    """Every document's place in containers of 2048 tokens."""
    return pack(table(spark, d, "documents"), "doc_id")


def p8_fill(spark, d):
    """How many containers are filled to which degree."""
    b = pack(table(spark, d, "documents"), "doc_id").where("bin is not null").groupBy("bin").agg(F.sum("tokens").alias("used"), F.count("*").alias("pieces"))
    return b.groupBy("used").agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"))


def p9_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "heldout")).select("doc_id", "item_id").distinct()


def p9_spans(spark, d):
    """The same finds with the place of the first passage in the document."""
    return leaks(table(spark, d, "documents"), table(spark, d, "heldout"))


def p10_found(spark, d):
    return truncated(table(spark, d, "documents"), ["doc_id"]).where("cut").select("doc_id").distinct()


def p10_by_source(spark, d):
    """Per source: its documents and how many of them were cut off."""
    t = truncated(table(spark, d, "documents"), ["doc_id", "source"])
    return t.groupBy("source").agg(F.count("*").alias("documents"), F.count(F.when(F.col("cut"), 1)).alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 4).alias("share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_lengths": p1_lengths,
    "p2_found": p2_found,
    "p2_shares": p2_shares,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_by_target": p5_by_target,
    "p6_found": p6_found,
    "p6_consistent": p6_consistent,
    "p6_links": p6_links,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_by_source": p10_by_source,
}
ORACLE: dict[str, str] = {
    "p4_found": """
with s as (
  select media_id, take_no, seg_no, min(struct_pack(l := loaded_at, t := text, s := "start", e := "end")) as r from segments group by all)
select media_id, take_no, seg_no from s
where length(r.t) > 120 or len(list_filter(string_split(r.t, ' '), lambda w: w <> '')) > 30
   or cast(round(r.e * 1000) as bigint) - cast(round(r.s * 1000) as bigint) > 9000""",
}
