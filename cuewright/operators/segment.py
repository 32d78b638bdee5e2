"""Segmentation of words into cues by rules: groups, long groups, blocks, splits, merges.

A group is a run of words up to a sentence mark. Sources (keys) may be of any length: positions and
group numbers come from bounded windows; a group itself is the unit that one row may hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions import lexicon
from cuewright.functions.text import ends_sentence, is_fragile, is_intensified, pair_word, root, rstrip_chars, srt_time_ms, strip
from cuewright.operators.keys import TAKE, join_on, spread_over_blocks
from cuewright.operators.ordered import dense, neighbours, running_sum
from cuewright.session import cut

MAX_CHARS, MAX_WORDS, MAX_MS, MIN_WORDS = 120, 30, 9000, 4


# groups -------------------------------------------------------------------------------------------


def sentence_groups(words: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """Adds group_id: a group closes after each word that ends with . ? or !; the last words form one, too."""
    ended = words.withColumn("_ends", ends_sentence("text").cast("int"))
    return running_sum(ended, keys, "pos", "_ends", "group_id", inclusive=False).withColumn("group_id", F.col("group_id").cast("int")).drop("_ends")


def over_limits(n_words: Column, n_chars: Column, dur: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, max_ms: int = MAX_MS) -> Column:
    """Too long by words, by characters (each word and one space) or by duration."""
    return (n_words > max_words) | (n_chars > max_chars) | F.coalesce(dur > max_ms, F.lit(False))


def group_table(grouped: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """One row per group: ws, we, n_words, n_chars, dur_ms, is_long."""
    g = grouped.groupBy(*keys, "group_id").agg(
        F.min("pos").alias("ws"),
        (F.max("pos") + 1).alias("we"),
        F.count("*").cast("int").alias("n_words"),
        F.sum(F.char_length("text") + 1).cast("int").alias("n_chars"),
        F.min_by("s_ms", "pos").alias("_s"),
        F.max_by(F.coalesce("e_ms", "s_ms"), "pos").alias("_e"),
    )
    g = g.withColumn("dur_ms", F.col("_e") - F.col("_s"))
    return g.withColumn("is_long", over_limits(F.col("n_words"), F.col("n_chars"), F.col("dur_ms"))).drop("_s", "_e")


def fast_path(groups: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """Per source whether it has no long group, so that its groups are its cues already."""
    return groups.groupBy(*keys).agg(F.count("*").alias("groups"), F.count(F.when(F.col("is_long"), 1)).alias("long_groups")).withColumn("fast", F.col("long_groups") == 0)


def long_runs(groups: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """Runs of consecutive long groups: block_id, ws, we, n_groups, n_words, n_chars."""
    first = neighbours(groups, keys, "group_id", 1, _prev=lambda w: F.lag("is_long").over(w)).withColumn("_starts", (F.col("is_long") & ~F.coalesce("_prev", F.lit(False))).cast("int"))
    numbered = running_sum(first, keys, "group_id", "_starts", "_block").where("is_long")
    return numbered.groupBy(*keys, (F.col("_block") - 1).cast("int").alias("block_id")).agg(
        F.min("ws").alias("ws"), F.max("we").alias("we"), F.count("*").cast("int").alias("n_groups"),
        F.sum("n_words").cast("int").alias("n_words"), F.sum("n_chars").cast("int").alias("n_chars"),
    )


def context_of(groups: DataFrame, keys: list[str] = TAKE, max_words: int = MAX_WORDS) -> DataFrame:
    """For each long group the words left and right of it that serve as context.

    A short neighbouring group is taken whole, of a long one the max_words nearest words.
    """
    pack = F.struct("ws", "we", "is_long")
    near = neighbours(groups.withColumn("_g", pack), keys, "group_id", 1, _l=lambda w: F.lag("_g").over(w), _r=lambda w: F.lead("_g").over(w)).where("is_long")
    lo, hi = F.col("_l"), F.col("_r")
    left = F.when(lo.is_long, F.greatest(lo.we - max_words, lo.ws)).otherwise(lo.ws)
    right = F.when(hi.is_long, F.least(hi.ws + max_words, hi.we)).otherwise(hi.we)
    return near.select(*keys, "group_id", "ws", "we", left.alias("left_ws"), lo.we.alias("left_we"), hi.ws.alias("right_ws"), right.alias("right_we"))


def as_cues(words: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One cue per group of words: by, ws, we, start_ms, end_ms, text; cues without text are left out."""
    c = words.groupBy(*keys, by).agg(
        F.min("pos").alias("ws"),
        (F.max("pos") + 1).alias("we"),
        F.min_by("s_ms", "pos").alias("start_ms"),
        F.max_by(F.coalesce("e_ms", "s_ms"), "pos").alias("end_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), " ").alias("text"),
    )
    return c.where(F.col("text") != "")


def with_timecodes(cues: DataFrame) -> DataFrame:
    return cues.withColumn("tc_start", srt_time_ms("start_ms")).withColumn("tc_end", srt_time_ms("end_ms"))


# breaks -------------------------------------------------------------------------------------------


def break_flags(words: DataFrame, pairs: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """For each word but a source's first, what speaks against a break before it.

    b (its position), fragile (the word before binds to it), phrase (both are a protected pair and no sentence ends
    between), intensifier ("so" that is not followed by the start of a clause).
    """
    near = neighbours(words, keys, "pos", 1, _p=lambda w: F.lag("text").over(w), _n=lambda w: F.lead("text").over(w)).where(F.col("_p").isNotNull())
    near = near.withColumn("w1", pair_word("_p")).withColumn("w2", pair_word("text"))
    known = pairs.select("w1", "w2").distinct().withColumn("_known", F.lit(True))
    near = near.join(known, ["w1", "w2"], "left")  # Catalyst broadcasts the pairs if they are small
    so = (rstrip_chars(F.lower(strip("text")), ".,!?;'\"") == "so") & F.col("_n").isNotNull() & ~root("_n", ".,!?;'\"").isin(*lexicon.CLAUSE_STARTERS)
    return near.select(
        *keys, F.col("pos").alias("b"), is_fragile("_p").alias("fragile"),
        (F.coalesce("_known", F.lit(False)) & ~ends_sentence("_p")).alias("phrase"), F.coalesce(so, F.lit(False)).alias("intensifier"),
    )


def union_breaks(*tables: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """The distinct breaks of all tables (columns keys, b)."""
    out = tables[0].select(*keys, "b")
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, "b"))
    return out.distinct()


def slice_at(words: DataFrame, breaks: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """Adds piece: words between two breaks form a piece; a break b lies before the word at position b."""
    marked = join_on(words, breaks.select(*keys, F.col("b").alias("pos")).distinct().withColumn("_b", F.lit(1)), [*keys, "pos"], "left")
    marked = marked.withColumn("_b", F.when(F.col("pos") > 0, F.coalesce("_b", F.lit(0))).otherwise(0))
    return running_sum(marked, keys, "pos", "_b", "piece").withColumn("piece", F.col("piece").cast("int")).drop("_b")


def inject_commas(words: DataFrame, at: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """A comma after each word at a given position (columns keys, pos), unless there is one."""
    marked = join_on(words, at.select(*keys, "pos").distinct().withColumn("_c", F.lit(True)), [*keys, "pos"], "left")
    add = F.coalesce("_c", F.lit(False)) & ~F.col("text").endswith(",")
    return marked.withColumn("text", F.when(add, F.concat("text", F.lit(","))).otherwise(F.col("text"))).drop("_c")


# splits by rules, on arrays of words ---------------------------------------------------------------


def gathered(words: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per piece with its words in order as array w of struct(pos, s_ms, e_ms, text)."""
    return words.groupBy(*keys, by).agg(F.sort_array(F.collect_list(F.struct("pos", "s_ms", "e_ms", "text"))).alias("w"))


def lower_words(w: Column, trailing: str = ".,!?;'\"") -> Column:
    return F.transform(w, lambda x: rstrip_chars(F.lower(strip(x.text)), trailing))


def is_list_comma(right: Column) -> Column:
    """Whether the lower-case words after a comma go on as a list ("a, b and c"): decided by the first and/or with a word after it."""
    subject = F.coalesce(F.element_at(F.split(F.get(right, F.lit(0)), "'"), 1).isin(*lexicon.CLAUSE_SUBJECTS), F.lit(False))
    n = F.size(right)
    joins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n - 1) & F.coalesce(F.get(right, i).isin("and", "or"), F.lit(False)))
    clause = lambda c: F.coalesce(c.isin(*lexicon.CLAUSE_STARTERS, "to"), F.lit(False))
    listed = F.transform(F.slice(joins, 1, 1), lambda i: ~clause(F.get(right, i + 1)) & ~clause(F.get(right, i + 2)))
    return ~subject & F.coalesce(F.get(listed, F.lit(0)), F.lit(False))


def _up_to_comma(w: Column, i: Column) -> Column:
    """The lower-case words after position i, up to and with the next that ends with a comma."""
    rest = F.slice(w, i + 2, F.size(w))
    stop = F.array_position(F.transform(rest, lambda x: strip(x.text).endswith(",")), True)
    return lower_words(F.when(stop > 0, F.slice(rest, F.lit(1), stop.cast("int"))).otherwise(rest))


def comma_candidates(w: Column) -> Column:
    """Positions in the array of words whose comma may part two clauses, whatever the lengths of the sides."""
    n = F.size(w)

    def may(i: Column) -> Column:
        starts = root(F.get(w, i + 1).text).isin(*lexicon.CLAUSE_STARTERS, *lexicon.ELABORATION_STARTERS)
        return F.get(w, i).text.endswith(",") & (i < n - 1) & F.coalesce(starts, F.lit(False)) & ~is_list_comma(_up_to_comma(w, i))

    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), may)


def _fold(candidates: Column, n: Column, accept: Callable[[Column, Column], Column], cut: Callable[[Column], Column]) -> Column:
    """Cuts from right to left: a candidate is taken if it suits the end of what is left, which then ends there."""
    kind = "struct<e:int,cuts:array<int>>"
    start = F.struct(n.cast("int").alias("e"), F.array().cast("array<int>").alias("cuts")).cast(kind)

    def step(acc: Column, j: Column) -> Column:
        yes = F.struct(cut(j).cast("int").alias("e"), F.concat(F.array(cut(j).cast("int")), acc.cuts).alias("cuts")).cast(kind)
        return F.when(accept(j, acc.e), yes).otherwise(acc)

    return F.aggregate(F.reverse(candidates), start, step).cuts


def comma_cuts(w: Column, min_words: int = MIN_WORDS) -> Column:
    """Where a piece is cut at commas between clauses: indices of words that begin a new part."""
    return _fold(comma_candidates(w), F.size(w), lambda j, e: (j >= min_words) & (e - j - 1 >= min_words), lambda j: j + 1)


def ambiguous_conjunctions(w: Column, min_words: int = MIN_WORDS) -> Column:
    """Positions of and/so/or that the rules cannot decide."""
    n = F.size(w)

    def may(i: Column) -> Column:
        word, after = rstrip_chars(F.lower(F.get(w, i).text), ",."), root(F.get(w, i + 1).text)
        clause = F.coalesce(after.isin(*lexicon.CLAUSE_STARTERS), F.lit(False))
        very = (word == "so") & F.coalesce(is_intensified(after), F.lit(False))
        return word.isin("and", "so", "or") & (i >= min_words) & (n - i >= min_words) & ~clause & ~very

    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), may)


def conjunction_candidates(w: Column, confirmed: Column | None = None, protected: Column | None = None) -> Column:
    """Positions of and/but/so/or before which a piece may be cut; confirmed and protected are arrays of positions in w."""
    n = F.size(w)
    at = lambda a, i: F.lit(False) if a is None else F.coalesce(F.array_contains(a, i), F.lit(False))

    def may(i: Column) -> Column:
        word, after = rstrip_chars(F.lower(F.get(w, i).text), ",."), root(F.get(w, i + 1).text)
        clause = F.coalesce(after.isin(*lexicon.CLAUSE_STARTERS), F.lit(False))
        very = (word == "so") & F.coalesce(is_intensified(after), F.lit(False))
        yes = (word == "but") | (word.isin("and", "or", "so") & (clause | (at(confirmed, i) & ~very)))
        listed = word.isin("and", "or") & is_list_comma(lower_words(F.slice(w, i + 2, n)))
        return yes & ~at(protected, i) & ~listed

    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), may)


def conjunction_cuts(w: Column, confirmed: Column | None = None, protected: Column | None = None, min_words: int = MIN_WORDS) -> Column:
    """Where a long piece is cut before conjunctions."""
    return _fold(conjunction_candidates(w, confirmed, protected), F.size(w), lambda j, e: (j >= min_words) & (e - j >= min_words), lambda j: j)


def protected_positions(w: Column, pairs: list[tuple[str, str]]) -> Column:
    """Positions in w before which a protected pair would be broken; the pairs here are a literal of bounded size."""
    if len(pairs) > 20_000:
        raise ValueError("join larger tables of pairs instead (break_flags)")
    known = F.array(*[F.lit(f"{a} {b}") for a, b in pairs]) if pairs else F.array().cast("array<string>")
    n = F.size(w)

    def broken(i: Column) -> Column:
        a, b = F.get(w, i - 1).text, F.get(w, i).text
        return (i > 0) & ~ends_sentence(a) & F.array_contains(known, F.concat_ws(" ", pair_word(a), pair_word(b)))

    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(broken(i), F.lit(False)))


def parts_of(w: Column, cuts: Column) -> Column:
    """The array of words cut into an array of arrays."""
    ends = F.concat(cuts, F.array(F.size(w)))
    return F.transform(ends, lambda e, i: F.slice(w, F.when(i == 0, 1).otherwise(F.get(ends, i - 1) + 1), e - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))))


# recursive splits, in Python -----------------------------------------------------------------------

_FRAGILE, _STARTERS, _SUBJECTS = set(lexicon.FRAGILE), set(lexicon.CLAUSE_STARTERS), set(lexicon.CLAUSE_SUBJECTS)
_COMMA_STARTERS = _STARTERS | set(lexicon.ELABORATION_STARTERS)
_INTENSIFIED, _SO_SUFFIXES = set(lexicon.SO_INTENSIFIED), tuple(lexicon.SO_SUFFIXES)
#: What the column rules strip; Python's own strip() also takes U+001C to U+001F.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _root(word: str, trailing: str = ",.") -> str:
    return word.strip(_SPACE).lower().rstrip(trailing).split("'")[0]


def _listed(right: list[str]) -> bool:
    if right and right[0].split("'")[0] in _SUBJECTS:
        return False
    for i, w in enumerate(right[:-1]):
        if w in ("and", "or"):
            return not any(x in _STARTERS or x == "to" for x in right[i + 1 : i + 3])
    return False


def _tail_is_fragile(word: str) -> bool:
    import re

    tail = re.search(r"(\w+)\s*\Z", word)
    return bool(tail) and tail.group(1).lower() in _FRAGILE


def block_cuts(sizes: list[tuple[int, int]], max_words: int, max_chars: int) -> list[int]:
    """Where a block of long groups (words, characters each) is cut: at the group that leaves the larger side smallest, the first of equals."""
    out: list[int] = []
    todo = [(0, len(sizes))]
    while todo:
        a, b = todo.pop()
        words = [w for w, _ in sizes[a:b]]
        if b - a < 2 or (sum(words) <= max_words and sum(c for _, c in sizes[a:b]) <= max_chars):
            continue
        left, total, best = 0, sum(words), None
        for k, w in enumerate(words[:-1], 1):
            left += w
            cost = max(left, total - left)
            if best is None or cost < best[0]:
                best = (cost, a + k)
        out.append(best[1])
        todo += [(a, best[1]), (best[1], b)]
    return sorted(out)


def emergency_cuts(words: list[str], max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, min_words: int = MIN_WORDS) -> list[int]:
    """Cuts until every part is within the limits: at the most balanced comma that is no list's, else before the most balanced
    conjunction or subordinator, else near the middle where no word binds to the next. Of equals the rightmost is taken. A single word stays."""
    out: list[int] = []
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        part = words[a:b]
        n = len(part)
        if n < 2 or (n <= max_words and sum(len(w) + 1 for w in part) <= max_chars):
            continue
        best = None
        for i, w in enumerate(part):
            if w.rstrip().endswith(",") and i >= min_words and n - i - 1 >= min_words:
                right = []
                for x in part[i + 1 :]:
                    right.append(x.strip().lower().rstrip(".,!?;'\""))
                    if x.strip().endswith(","):
                        break
                if not _listed(right) and (best is None or abs(2 * i - n + 1) <= best[0]):
                    best = (abs(2 * i - n + 1), i + 1)
        if best is None:
            for i, w in enumerate(part):
                word = w.rstrip(",.").lower()
                if i < min_words or n - i < min_words:
                    continue
                follows = i + 1 < n and _root(part[i + 1]) in _STARTERS
                if word == "but" or word in lexicon.SUBORDINATORS or (word == "and" and i + 1 < n) or (word in ("or", "so") and follows):
                    if best is None or abs(2 * i - n) <= best[0]:
                        best = (abs(2 * i - n), i)
        if best is None:
            mid = n // 2
            free = [c for c in range(1, n) if not _tail_is_fragile(part[c - 1])]
            best = (0, min(free, key=lambda c: (abs(c - mid), c < mid)) if free else mid)
        out.append(a + best[1])
        todo += [(a, a + best[1]), (a + best[1], b)]
    return sorted(out)


def run_on_cuts(words: list[str], times: list[tuple[int, int]], candidates: list[int], pairs: set[tuple[str, str]], max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, max_ms: int = MAX_MS, min_words: int = MIN_WORDS, depth: int = 8) -> list[int]:
    """Cuts at the most balanced allowed candidate (the leftmost of equals) while a part is over the limits."""
    import re

    def pair(w: str) -> str:
        return re.sub(r"'(s|re|ve|m|ll|d|t)\Z", "", w.strip().lower().rstrip(".,!?;:'\""))

    def bare(w: str) -> str:
        return w.strip().lower().rstrip(".,!?;'\"")

    def allowed(a: int, b: int, c: int) -> bool:
        if c - a < min_words or b - c < min_words or _tail_is_fragile(words[c - 1]):
            return False
        if not words[c - 1].rstrip().endswith((".", "!", "?")) and (pair(words[c - 1]), pair(words[c])) in pairs:
            return False
        if c - a <= 4 and words[a].strip().lower().rstrip(".,!?;:'\"") in lexicon.CONJUNCTIONS:
            return False
        here = bare(words[c])
        if here == "so" and c + 1 < len(words) and bare(words[c + 1]).split("'")[0] not in _STARTERS:
            return False
        near_comma = any(w.strip().endswith(",") for w in words[max(a, c - 3) : c])
        return not (here in ("and", "or") and c + 1 < len(words) and near_comma and _listed([bare(w) for w in words[c:b]]))

    out: list[int] = []
    todo = [(0, len(words), 0)]
    while todo:
        a, b, d = todo.pop()
        part = words[a:b]
        if d > depth or not part or not (len(part) > max_words or sum(len(w) + 1 for w in part) > max_chars or times[b - 1][1] - times[a][0] > max_ms):
            continue
        free = [c for c in candidates if a < c < b and allowed(a, b, c)]
        if free:
            c = min(free, key=lambda c: (abs(2 * c - a - b), c))
            out.append(c)
            todo += [(a, c, d + 1), (c, b, d + 1)]
    return sorted(out)


def _lists(words: list[str]) -> Callable[[int, int], bool]:
    """Whether the words from a up to b go on as a list, for any a and b, after one pass over the words."""
    n = len(words)
    low = [w.strip(_SPACE).lower().rstrip(".,!?;'\"") for w in words]
    joins = [n] * (n + 1)  # the nearest and/or from each word on
    for i in range(n - 1, -1, -1):
        joins[i] = i if low[i] in ("and", "or") else joins[i + 1]

    def listed(a: int, b: int) -> bool:
        if a < b and low[a].split("'")[0] in _SUBJECTS:
            return False
        j = joins[a] if a < n else n
        return j < b - 1 and not any(low[x] in _STARTERS or low[x] == "to" for x in range(j + 1, min(j + 3, b)))

    return listed


def clause_commas(words: list[str], min_words: int = MIN_WORDS) -> list[int]:
    """The cuts of comma_cuts, in one pass from right to left."""
    n = len(words)
    listed = None
    out: list[int] = []
    stop, end = n - 1, n  # the next comma after the one looked at; where what is left ends
    for i in range(n - 1, -1, -1):
        if "," not in words[i]:
            continue
        if i >= min_words and end - i - 1 >= min_words and i < n - 1 and words[i].endswith(",") and _root(words[i + 1]) in _COMMA_STARTERS:
            listed = listed or _lists(words)
            if not listed(i + 1, stop + 1):
                out.append(i + 1)
                end = i + 1
        if words[i].strip(_SPACE).endswith(","):
            stop = i
    return out[::-1]


def open_conjunctions(words: list[str], min_words: int = MIN_WORDS) -> list[int]:
    """The positions of ambiguous_conjunctions."""
    n = len(words)
    return [i for i in range(min_words, n - min_words + 1) if _undecided(words, i)]


def _undecided(words: list[str], i: int) -> bool:
    word = words[i].lower().rstrip(",.")
    if word not in ("and", "so", "or"):
        return False
    after = _root(words[i + 1]) if i + 1 < len(words) else ""
    return after not in _STARTERS and not (word == "so" and _intensified(after))


def _intensified(word: str) -> bool:
    return word in _INTENSIFIED or (word.endswith("ly") and len(word) > 4) or word.endswith(_SO_SUFFIXES)


def clause_conjunctions(words: list[str], pairs: set[tuple[str, str]], confirmed: set[int] | frozenset[int] = frozenset(), min_words: int = MIN_WORDS) -> list[int]:
    """The cuts of conjunction_cuts with the given pairs protected, in one pass from right to left, whatever the number of words."""
    n = len(words)
    listed = None
    out: list[int] = []
    end = n
    for i in range(n - 1, -1, -1):
        word = words[i].lower().rstrip(",.")
        if word not in ("but", "and", "or", "so") or not (i >= min_words and end - i >= min_words):
            continue
        if word != "but" and not (i + 1 < n and _root(words[i + 1]) in _STARTERS) and not (i in confirmed and _undecided(words, i)):
            continue
        if i > 0 and not words[i - 1].rstrip(_SPACE).endswith((".", "?", "!")) and (_pair_word(words[i - 1]), _pair_word(words[i])) in pairs:
            continue
        if word in ("and", "or"):
            listed = listed or _lists(words)
            if listed(i + 1, n):
                continue
        out.append(i)
        end = i
    return out[::-1]


def rule_cuts(words: list[str], starts: list, ends: list, pairs: set[tuple[str, str]], min_words: int = MIN_WORDS) -> list[int]:
    """All cuts of one group: at commas between clauses; in parts over the limits before conjunctions; in what is still over them by words
    or characters wherever it has to be. The same as comma_cuts, conjunction_cuts and emergency_cuts one after the other, in
    time that grows with the words of a group, whatever its length.
    """
    n = len(words)
    commas = clause_commas(words, min_words)

    def size(a: int, b: int) -> tuple[int, int]:
        return b - a, sum(len(w) + 1 for w in words[a:b])

    out: list[int] = []
    for a, b in zip([0, *commas], [*commas, n]):
        if a:
            out.append(a)
        many, chars = size(a, b)
        last = ends[b - 1] if ends[b - 1] is not None else starts[b - 1]
        long = many > MAX_WORDS or chars > MAX_CHARS or (last is not None and starts[a] is not None and last - starts[a] > MAX_MS)
        before = [a + c for c in clause_conjunctions(words[a:b], pairs, min_words=min_words)] if long else []
        for x, y in zip([a, *before], [*before, b]):
            if x > a:
                out.append(x)
            many, chars = size(x, y)
            if many > MAX_WORDS or chars > MAX_CHARS:
                out += [x + c for c in emergency_cuts(words[x:y], min_words=min_words)]
    return out


def _pair_word(word: str) -> str:
    import re

    return re.sub(r"'(s|re|ve|m|ll|d|t)\Z", "", word.strip(_SPACE).lower().rstrip(".,!?;:'\""))


def over_in_batch(w, with_duration: bool = True) -> list[bool]:
    """array_over of a batch's arrays of words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at = w.offsets.to_numpy().astype("int64")
    text, start, end = (w.values.field(c) for c in ("text", "s_ms", "e_ms"))
    chars = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(text), -1).to_numpy(zero_copy_only=False).astype("int64") + 1)])
    many = np.diff(at)
    over = (many > MAX_WORDS) | (chars[at[1:]] - chars[at[:-1]] > MAX_CHARS)
    if with_duration:
        none = many == 0
        first, last = (pa.array(i, pa.int64(), mask=none) for i in (at[:-1], at[1:] - 1))
        dur = pc.subtract(pc.coalesce(end.take(last), start.take(last)), start.take(first))
        over |= pc.fill_null(pc.greater(dur, MAX_MS), False).to_numpy(zero_copy_only=False)
    return over.tolist()


def cut_rows(df: DataFrame, keep: list[str], level: str, fn: Callable[..., list[int]], when: str, extra: list[str] | None = None, long_only: bool = False, find: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """One row per part of each row's words w: the kept columns, the part's number in column `level`, w and, with find, `at`.

    A Python function finds the cuts of rows where `when` holds (with long_only, of those over the limits) from Arrow arrays of texts, starts
    and ends and the values of the extra columns. `at` is what find says of the texts of parts over the limits where `when` holds,
    elsewhere empty. Parts are slices of the batch's words, which are not copied.
    """
    f = T.StructField
    made = [*(df.schema[k] for k in keep), f(level, T.IntegerType()), df.schema["w"], *([f("at", T.ArrayType(T.IntegerType()))] if find else [])]
    extra = extra or []

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            w = b.column("w")
            at = w.offsets.to_pylist()
            text, start, end = (w.values.field(c) for c in ("text", "s_ms", "e_ms"))
            yes = b.column(when).to_pylist()
            ask = [x and y for x, y in zip(yes, over_in_batch(w))] if long_only else yes
            more = {c: b.column(c) for c in extra}
            of, number, bounds = [], [], []
            for row, (x, y, go) in enumerate(zip(at, at[1:], ask)):
                cuts = fn(text.slice(x, y - x), start.slice(x, y - x), end.slice(x, y - x), *(c[row].as_py() for c in more.values())) if go and y > x + 1 else []
                of += [row] * (len(cuts) + 1)
                number += range(len(cuts) + 1)
                bounds += [x, *(x + c for c in cuts)]
            parts = pa.ListArray.from_arrays(pa.array([*bounds, at[-1]], pa.int32()), w.values)
            take = pa.array(of, pa.int32())
            columns = [*(b.column(k).take(take) for k in keep), pa.array(number, pa.int32()), parts]
            if find:
                found = [find(text.slice(x, y - x).to_pylist()) if long and yes[row] else [] for row, x, y, long in zip(of, bounds, [*bounds[1:], at[-1]], over_in_batch(parts))]
                columns.append(pa.array(found, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[c.name for c in made])

    return df.select(*dict.fromkeys([*keep, when, "w", *extra])).mapInArrow(run, T.StructType(made))


def cut_into_cues(df: DataFrame, keys: list[str], column: str, when: str, fn: Callable[[list, list, list], list[int]]) -> DataFrame:
    """One cue per part of each row's words (pos, text, s_ms, e_ms): keys, ws, we, start_ms, end_ms, text.

    A Python function finds the cuts where `when` holds; elsewhere a row is one cue.
    """
    f = T.StructField
    made = T.StructType([*(df.schema[k] for k in keys), f("ws", T.IntegerType()), f("we", T.IntegerType()), f("start_ms", T.LongType()), f("end_ms", T.LongType()), f("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            col = b.column(column)
            at = col.offsets.to_pylist()
            pos, text, start, end = (col.values.field(c) for c in ("pos", "text", "s_ms", "e_ms"))
            of: list[int] = []
            out: list[list] = [[] for _ in kinds]
            for row, (x, y, yes) in enumerate(zip(at, at[1:], b.column(when).to_pylist())):
                p, t, s, e = (f.slice(x, y - x).to_pylist() for f in (pos, text, start, end))
                cuts = fn(t, s, e) if yes and y > x + 1 else []
                for i, j in zip([0, *cuts], [*cuts, y - x]):
                    of.append(row)
                    for o, v in zip(out, (p[i], p[j - 1] + 1, s[i], s[j - 1] if e[j - 1] is None else e[j - 1], " ".join(t[i:j]))):
                        o.append(v)
            take = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), *(pa.array(o, k) for o, k in zip(out, kinds))], names=made.names)

    return df.select(*keys, column, when).mapInArrow(run, made)


def cut_arrays(df: DataFrame, column: str, name: str, fn: Callable[[list], list[int]]) -> DataFrame:
    """Adds an array of cuts that a Python function finds for each row's array of words, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cuts = [fn(w) if w else [] for w in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cuts, pa.list_(pa.int32()))], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


# merging -------------------------------------------------------------------------------------------


def merge_candidates(cues: DataFrame, keys: list[str] = TAKE) -> DataFrame:
    """Adds may_merge: short cues that begin with and/but/so/or after a cue that ends no sentence (cue: seg_no dense, text)."""
    near = neighbours(cues, keys, "seg_no", 1, _prev=lambda w: F.lag("text").over(w))
    tokens = F.filter(F.split(F.col("text"), r"\s+"), lambda x: x != "")
    begins = rstrip_chars(F.lower(F.get(tokens, F.lit(0))), ".,!?;:'\"").isin(*lexicon.CONJUNCTIONS)
    may = F.col("_prev").isNotNull() & (F.size(tokens) <= 8) & begins & ~ends_sentence("_prev")
    return near.withColumn("may_merge", F.coalesce(may, F.lit(False))).drop("_prev")


def merge_confirmed(cues: DataFrame, keys: list[str] = TAKE, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Joins each confirmed candidate (columns may_merge, confirmed) to the cue before it where both fit the limits together.

    The limits are held against the cue before as it was, so a chain may exceed them. Result: seg_no
    (new, dense), start_ms, end_ms, text, parts.
    """
    tokens = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    near = neighbours(cues, keys, "seg_no", 1, _prev=lambda w: F.lag("text").over(w))
    both = F.concat_ws(" ", "_prev", "text")
    joins = F.col("may_merge") & F.coalesce("confirmed", F.lit(False)) & (tokens(both) <= max_words) & (F.char_length(both) <= max_chars)
    near = near.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
    numbered = running_sum(near, keys, "seg_no", "_new", "_to")
    return numbered.groupBy(*keys, (F.col("_to") - 1).cast("int").alias("seg_no")).agg(
        F.min_by("start_ms", F.col("seg_no")).alias("start_ms"),
        F.max_by("end_ms", F.col("seg_no")).alias("end_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(numbered["seg_no"], "text"))), lambda x: x.text), " ").alias("text"),
        F.count("*").cast("int").alias("parts"),
    )


# the whole ----------------------------------------------------------------------------------------


def _exploded(df: DataFrame, keys: list[str], path: list[str], cuts: Column, level: str) -> DataFrame:
    """One row per part of each row's words, with the part's number in column `level`."""
    return df.withColumn("_p", F.transform(parts_of(F.col("w"), cuts), lambda x, i: F.struct(i.alias("i"), x.alias("w")))).select(*keys, *path, F.explode("_p").alias("_p")).select(*keys, *path, F.col("_p.i").alias(level), F.col("_p.w").alias("w"))


def array_over(w: Column, with_duration: bool = True) -> Column:
    chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.char_length(x.text) + 1)
    last = F.element_at(w, -1)
    dur = F.coalesce(last.e_ms, last.s_ms) - F.get(w, F.lit(0)).s_ms if with_duration else F.lit(None).cast("long")
    return over_limits(F.size(w), chars, dur)


def segment_words(words: DataFrame, keys: list[str] = TAKE, pairs: list[tuple[str, str]] | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """Words to cues by the rules alone: keys, seg_no, ws, we, start_ms, end_ms, text.

    Sources without a long group keep their sentence groups. In the others every group is cut at clause commas, long
    parts before conjunctions, and parts still too long by words or characters until they fit. Checkpoints the
    words and the parts when called.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    pairs = lexicon.default_pairs() if pairs is None else pairs
    grouped = cut(sentence_groups(words, keys))
    g = gathered(grouped, keys, "group_id")
    long = g.withColumn("_long", array_over(F.col("w")))
    slow = long.groupBy(*keys).agg(F.max("_long").alias("_slow"), F.max("group_id").alias("_last")).where("_slow")
    at = spread_over_blocks(slow.withColumn("_zero", F.lit(0)), "_zero", "_last", 256).select(*keys, "block", "_slow")
    g = join_on(g.withColumn("block", F.floor(F.col("group_id") / 256).cast("long")), at, [*keys, "block"], "left").drop("block")
    known = set(pairs)
    c = cut_into_cues(g.withColumn("_s", F.coalesce("_slow", F.lit(False))), keys, "w", "_s", lambda w, s, e: rule_cuts(w, s, e, known, min_words))
    return dense(cut(c.where(F.col("text") != "")), keys, "ws", "seg_no").select(*keys, "seg_no", "ws", "we", "start_ms", "end_ms", "text")
