"""Words to cues with a language model's help: marks for long blocks, verdicts on conjunctions, run-ons and fragments.

Each question is a row of a request table; what is asked of one source does not wait for another. Where no answer
comes, the rules decide alone, so with the backend `none` the result is that of `segment_words`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import lexicon
from cuewright.functions.text import clean_output, strip_reasoning
from cuewright.operators import segment as S
from cuewright.operators.keys import TAKE, join_on, spread_over_blocks
from cuewright.operators.ordered import dense
from cuewright.plans.exchange import Backend, diff_marks, exchange, requests, token_budget, verdicts
from cuewright.session import cut as cut_lineage

#: Our own wording of what the model is asked.
MARKS = "Put sentence marks and commas into the given text. Do not change, add or drop words. Answer with the text alone."
CLAUSES = "For each numbered place, say YES if the word begins a new clause there and NO if it joins words. Answer with YES and NO, parted by commas."
FRAGMENTS = "For each numbered pair, say CONTINUATION if the second line goes on with the first and NEW_SENTENCE if not. Answer with these words, parted by commas."
#: Fragments are asked in lots of so many cues.
LOT = 64
cut = partial(cut_lineage, sized=False)


def _said(asked: DataFrame, make: Callable[[], Backend], store: str | None, policy: dict) -> DataFrame:
    """request_id and the cleaned answer; computed once."""
    asked = asked.select("request_id", "system", "user", "max_tokens", "temperature")
    said = exchange(asked, make, store, **policy)
    return cut(said.select("request_id", clean_output(strip_reasoning("content")).alias("content")))


def _text(w: Column) -> Column:
    return F.array_join(F.transform(w, lambda x: x.text), " ")


def long_blocks(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring long groups (keys, group_id, w) as blocks of at most three times the limits: keys, first, groups, w.

    A run of long groups is cut as a whole, however long it is: one row holds the sizes of its groups, two numbers each, not their words.
    """
    chars = F.aggregate("w", F.lit(0), lambda a, x: a + F.char_length(x.text) + 1)
    sizes = arrays.select(*keys, "group_id", S.array_over(F.col("w")).alias("is_long"), F.size("w").alias("n_words"), chars.alias("n_chars"), F.get("w", F.lit(0)).pos.alias("ws"))
    first = S.neighbours(sizes, keys, "group_id", 1, _prev=lambda w: F.lag("is_long").over(w))
    first = first.withColumn("_starts", (F.col("is_long") & ~F.coalesce("_prev", F.lit(False))).cast("int"))
    runs = S.running_sum(first, keys, "group_id", "_starts", "_run").where("is_long")
    runs = runs.groupBy(*keys, "_run").agg(F.min("group_id").alias("_at"), F.sort_array(F.collect_list(F.struct("group_id", "n_words", "n_chars"))).alias("g"))
    runs = S.cut_arrays(runs, "g", "cuts", lambda g: S.block_cuts([(x["n_words"], x["n_chars"]) for x in g], 3 * S.MAX_WORDS, 3 * S.MAX_CHARS))
    # each group's block, by the block's first group
    starts = F.concat(F.array(F.lit(0)), "cuts")
    ends = F.concat("cuts", F.array(F.size("g")))
    of = runs.select(*keys, "_at", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("x"))
    of = of.select(*keys, (F.col("_at") + F.col("x.a")).cast("int").alias("first"), F.explode(F.sequence((F.col("_at") + F.col("x.a")).cast("int"), (F.col("_at") + F.col("x.b") - 1).cast("int"))).alias("group_id"))
    rows = join_on(arrays.select(*keys, "group_id", "w"), of, [*keys, "group_id"])
    return rows.groupBy(*keys, "first").agg(F.count("*").cast("int").alias("groups"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("group_id", "w"))), lambda x: x.w)).alias("w"))


def segment_with_model(words: DataFrame, make: Callable[[], Backend], keys: list[str] = TAKE, pairs: list[tuple[str, str]] | None = None, store: str | None = None, min_words: int = S.MIN_WORDS, **policy) -> DataFrame:
    """Cues as `segment_words` gives them, with a model's marks and verdicts: keys, seg_no, ws, we, start_ms, end_ms, text.

    Runs when called, a job per kind of question. policy: attempts, delays, pause of the exchange. Contexts of a block
    are the texts as they came, whatever other blocks are answered.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    pairs = lexicon.default_pairs() if pairs is None else pairs
    grouped = cut(S.sentence_groups(words, keys))
    arrays = cut(S.gathered(grouped, keys, "group_id"))
    slow = arrays.groupBy(*keys).agg(F.max(S.array_over(F.col("w"))).alias("_slow"), F.max(F.element_at("w", -1).pos).alias("_last"), F.min(F.get("w", F.lit(0)).pos).alias("_first"))
    slow = spread_over_blocks(slow.where("_slow"), "_first", "_last", 4096).select(*keys, "block", "_slow")

    # marks inside blocks of long groups
    blocks = long_blocks(arrays, keys).withColumn("raw", _text(F.col("w"))).withColumn("ws", F.get("w", F.lit(0)).pos)
    before = arrays.select(*keys, (F.col("group_id") + 1).alias("first"), F.slice(F.reverse("w"), 1, S.MAX_WORDS).alias("_b"))
    context = join_on(blocks, before, [*keys, "first"], "left").withColumn("before", _text(F.reverse("_b"))).drop("_b")
    user = F.concat_ws("\n\n", F.concat(F.lit("Before: "), F.col("before")), F.concat(F.lit("Text: "), F.col("raw")))
    asked = cut(requests(context, "marks", MARKS, user, token_budget("text", F.char_length("raw")), keep=[*keys, "ws", "raw"]))
    marked = diff_marks(asked.join(_said(asked, make, store, policy), "request_id", "left"), "raw", "content")
    marked = cut(marked.select(*keys, "ws", "new_breaks", "new_commas"))
    new = marked.select(*keys, F.explode(F.transform("new_breaks", lambda i: F.col("ws") + i)).alias("b"))
    # a break's flags need the words next to it and no others
    beside = new.select(*keys, F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("pos")).distinct()
    against = S.break_flags(join_on(words, beside, [*keys, "pos"], "left_semi"), lexicon.pairs_table(words.sparkSession, pairs), keys).where("fragile or phrase or intensifier")
    new = join_on(new, against.select(*keys, "b"), [*keys, "b"], "left_anti")
    commas = marked.select(*keys, F.explode(F.transform("new_commas", lambda i: F.col("ws") + i)).alias("pos"))
    ends = grouped.where(S.ends_sentence("text")).select(*keys, (F.col("pos") + 1).alias("b"))
    breaks = S.union_breaks(ends, new, keys=keys)
    pieces = S.slice_at(S.inject_commas(words, commas, keys), breaks, keys)
    pieces = join_on(pieces.withColumn("block", F.floor(F.col("pos") / 4096).cast("long")), slow, [*keys, "block"], "left")
    g = pieces.groupBy(*keys, "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "s_ms", "e_ms", "text"))).alias("w"), F.max(F.coalesce("_slow", F.lit(False))).alias("_s"))

    # commas, then conjunctions with verdicts
    known = set(pairs)
    a = S.cut_rows(g, [*keys, "piece", "_s"], "p1", lambda t, s, e: S.clause_commas(t.to_pylist(), min_words), "_s", find=lambda t: S.open_conjunctions(t, min_words))
    a = cut(a)
    places = F.array_join(F.transform("at", lambda i, k: F.concat_ws(" ", (k + 1).cast("string"), F.lit("before word"), (i + 1).cast("string"), F.get("w", i).text)), "\n")
    asked = cut(requests(a.where(F.size("at") > 0), "clauses", CLAUSES, F.concat_ws("\n", _text(F.col("w")), places), token_budget("verdicts", F.size("at")), keep=[*keys, "piece", "p1", "at"]))
    said = asked.join(_said(asked, make, store, policy), "request_id", "left").select(*keys, "piece", "p1", verdicts("content", F.size("at")).alias("v"))
    b = join_on(a, said, [*keys, "piece", "p1"], "left")

    def clauses(t, s, e, at: list[int], v: list[bool] | None) -> list[int]:
        return S.clause_conjunctions(t.to_pylist(), known, {i for i, yes in zip(at, v or []) if yes}, min_words)

    b = cut(S.cut_rows(b, [*keys, "piece", "p1", "_s"], "p2", clauses, "_s", ["at", "v"], long_only=True))

    # run-ons: marks again, cut at the most balanced ones
    asked = b.where(F.col("_s") & _over_text(F.col("w"))).withColumn("raw", _text(F.col("w")))
    asked = cut(requests(asked, "run-ons", MARKS, F.col("raw"), token_budget("text", F.char_length("raw")), keep=[*keys, "piece", "p1", "p2", "raw"]))
    marked = diff_marks(asked.join(_said(asked, make, store, policy), "request_id", "left"), "raw", "content")
    b = join_on(b, marked.select(*keys, "piece", "p1", "p2", "new_breaks"), [*keys, "piece", "p1", "p2"], "left").withColumn("_marked", F.coalesce(F.size("new_breaks") > 0, F.lit(False)))

    def run_ons(t, s, e, at: list[int]) -> list[int]:
        s = s.to_pylist()
        return S.run_on_cuts(t.to_pylist(), [(x, x if y is None else y) for x, y in zip(s, e.to_pylist())], at, known, min_words=min_words)

    c = cut(_numbered(S.cut_rows(b, [*keys, "piece", "p1", "p2", "_s"], "p3", run_ons, "_marked", ["new_breaks"]), keys))

    # fragments: merged into the cue before where the model says so
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    cues = c.select(*keys, "seg_no", "_s", first.s_ms.alias("start_ms"), F.coalesce(last.e_ms, last.s_ms).alias("end_ms"), _text(F.col("w")).alias("text"))
    near = S.neighbours(S.merge_candidates(cues, keys), keys, "seg_no", 1, _p=lambda x: F.lag("text").over(x))
    near = cut(near.withColumn("may_merge", F.col("may_merge") & F.col("_s")))
    lots = near.where("may_merge").groupBy(*keys, F.floor(F.col("seg_no") / LOT).alias("lot")).agg(F.sort_array(F.collect_list(F.struct("seg_no", "_p", "text"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x["_p"], F.lit(" | "), x.text)), "\n")
    asked = cut(requests(lots, "fragments", FRAGMENTS, lines, token_budget("merges", F.size("x")), keep=[*keys, "x"]))
    said = asked.join(_said(asked, make, store, policy), "request_id", "left").withColumn("v", verdicts("content", F.size("x"), "CONTINUATION", "NEW_SENTENCE"))
    yes = said.select(*keys, F.explode(F.filter("x", lambda x, k: F.coalesce(F.get("v", k), F.lit(False)))).alias("x")).select(*keys, "x.seg_no", F.lit(True).alias("confirmed"))
    joined = join_on(near.select(*keys, "seg_no", "text", "may_merge"), yes, [*keys, "seg_no"], "left")
    of = _merge_groups(joined, keys)
    c = join_on(c.select(*keys, "seg_no", "_s", "w"), of, [*keys, "seg_no"])
    c = c.groupBy(*keys, "to").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "w"))), lambda x: x.w)).alias("w"), F.max("_s").alias("_s"))

    # what is still too long is cut anyway
    c = c.withColumn("_s", F.col("_s") & S.array_over(F.col("w"), False))
    c = S.cut_into_cues(c, keys, "w", "_s", lambda w, s, e: S.emergency_cuts(w, min_words=min_words))
    return dense(cut(c.where(F.col("text") != "")), keys, "ws", "seg_no").select(*keys, "seg_no", "ws", "we", "start_ms", "end_ms", "text")


def _over_text(w: Column) -> Column:
    """Too long as a text: the last word's space does not count."""
    last = F.element_at(w, -1)
    return S.over_limits(F.size(w), F.char_length(_text(w)), F.coalesce(last.e_ms, last.s_ms) - F.get(w, F.lit(0)).s_ms)


def _numbered(parts: DataFrame, keys: list[str]) -> DataFrame:
    return dense(parts.withColumn("_ws", F.get("w", F.lit(0)).pos), keys, "_ws", "seg_no").select(*keys, "seg_no", "_s", "w")


def _merge_groups(cues: DataFrame, keys: list[str]) -> DataFrame:
    """The number of the merged cue each cue goes to, by the limits that `merge_confirmed` holds."""
    tokens = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    near = S.neighbours(cues, keys, "seg_no", 1, _p=lambda w: F.lag("text").over(w))
    both = F.concat_ws(" ", "_p", "text")
    joins = F.col("may_merge") & F.coalesce("confirmed", F.lit(False)) & (tokens(both) <= S.MAX_WORDS) & (F.char_length(both) <= S.MAX_CHARS)
    near = near.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    return S.running_sum(near, keys, "seg_no", "_new", "to").select(*keys, "seg_no", "to")
