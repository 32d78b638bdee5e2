"""Defective pairs of prompt and response: empty, refused, copied, in another language, broken off.

Languages: posteriors of a character n-gram naive Bayes model, of the reply and of its prompt; a reply is in another
language where they speak against the one asked for, and in the prompt's own language sooner than in a third. Breaking off: how
the reply's last letters end replies or go on, by n-gram counts over all replies, together with the share of the usual letters
that it has; what the two say is learned from replies as they are and from the same replies cut short.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.llm.grams import Windows, bucket, join_texts
from cuewright.llm.language import LanguageModel, letters_only, train_language_model
from cuewright.llm.repetition import repeated_letters
from cuewright.llm.text import LETTERS_RE, forms, letter_count
from cuewright.operators.keys import join_on, once
from cuewright.session import cut

#: End tokens and line numbers around a reply, and replies that only say there is none.
END_TOKEN_RE = regex.compile(r"<\|[^|<>]*\|>|</?s>|\[/?INST\]|<(?:eos|bos|pad|unk|end_of_turn)>", regex.I)
LINE_NUMBER_RE = regex.compile(r"^\s*(?:\[\s*\d+\s*(?:-\s*\d+\s*)?\]|\(\d+\)|(?:line\s*)?#?\d+\s*[.:)：](?!\d))\s*", regex.I)
PLACEHOLDERS = {
    "no output", "output", "n a", "na", "none", "null", "nil", "nan", "empty", "blank", "no translation", "no text", "no response",
    "no answer", "no result", "no content", "not available", "untranslated", "translation unavailable", "sin salida", "sin traducción",
    "pas de sortie", "aucune sortie", "pas de traduction", "keine ausgabe", "keine übersetzung", "leer", "нет вывода", "нет перевода", "пусто",
    "无输出", "没有输出", "无", "空", "无翻译", "出力なし", "なし", "翻訳なし",
}
#: Saying that one will not or cannot do what was asked, by language.
REFUSALS = regex.compile(
    "|".join(
        [
            r"\b(?:can ?not|can['’ ]?t|unable to|not able to|won['’ ]?t|will not|refuse to|decline to)\b(?: \w+){0,3}? (?:translat\w*|assist|help (?:you )?with|provide|complete|process|fulfil+|comply|answer|handle)",
            r"\bas an? (?:ai|large language model|language model|assistant)\b",
            r"\bno (?:\w+ ){0,4}(?:traducir|atender|ayudar|cumplir|procesar|completar|responder a)\b",
            r"\bmodelo de (?:lenguaje|ia)\b",
            r"\bne (?:peux|puis|suis|saurais) (?:\w+ ){0,6}(?:traduire|répondre|aider|traiter|satisfaire|fournir)\b",
            r"\ben tant que (?:modèle|ia|assistant)\b",
            r"\b(?:kann|werde|darf|möchte) (?:\w+ ){0,4}nicht (?:\w+ ){0,2}(?:übersetz|helf|bearbeit|beantwort|erfüll|unterstütz|nachkomm)\w*",
            r"\b(?:als|ein) (?:ki|sprachmodell)\b",
            r"\bне (?:могу|можем|буду|в состоянии|способен) (?:\w+ ){0,3}(?:перев|выполн|помо|обработ|ответ|предостав)\w*",
            r"\bязыков\w+ модел",
            r"(?:无法|不能|没法|不便|不会)[^，。,.！!？?]{0,8}(?:翻译|处理|协助|完成|提供|帮助|回答|满足)",
            r"(?:内容|字幕|文本|请求)[^。！!]{0,6}(?:无法|不能)(?:翻译|处理|提供)?",
            r"语言模型|語言模型|言語モデル",
            r"(?:翻訳|お応え|対応|処理|お手伝い|回答|提供|お答え)[^。、]{0,6}(?:できません|出来ません|できかね|いたしかね)",
            r"ไม่สามารถ.{0,12}(?:แปล|ช่วย|ดำเนินการ)",
            r"لا (?:يمكنني|أستطيع|نستطيع).{0,14}(?:ترجم|مساعد|تنفيذ)",
            r"(?:अनुवाद|सहायता|मदद|अनुरोध).{0,14}नहीं (?:कर|दे) सक",
        ]
    )
)
#: Letters that languages need for the same content, relative to English; a prior for the ratios that the data give.
LETTERS = {"en": 1.0, "de": 1.08, "fr": 1.08, "es": 1.05, "ru": 1.05, "zh": 0.3, "ja": 0.42, "th": 0.95, "hi": 0.95, "ar": 0.8, "": 1.0}
PRIOR_PAIRS = 20
_TOKENS_RE = regex.compile(r"[\p{L}\p{M}\p{N}'’]+|[，。,.！!？?、]")
_FOLDED_RE = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: The model of breaking off is fitted on all replies, each as it is and cut at a share of its letters between these.
CUT_AT = (0.1, 0.6)
#: The kinds of replies it tells apart: log share of the usual letters in steps from the least to the most, and log-odds of the last letters.
SHARE_LEAST, SHARE_MOST, SHARE_STEP = -3.0, 1.0, 0.05
ENDINGS = (-4.0, -3.0, -2.0, -1.0, 0.0)
#: Stated spread of sound replies' log shares, share of replies that break off, and for how many replies these count.
SPREAD, BROKEN, STATED_REPLIES = 0.2, 0.03, 50.0
END_BITS = 18
END_ORDERS = (6, 4, 3)
SCRIPTS = [("th", regex.compile(r"\p{Thai}+")), ("hi", regex.compile(r"\p{Devanagari}+")), ("ar", regex.compile(r"\p{Arabic}+")), ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]+")), ("zh", regex.compile(r"\p{Han}+")), ("ru", regex.compile(r"\p{Cyrillic}+")), ("Latin", regex.compile(r"\p{Latin}+"))]
#: Letters of every other script, which stand for a language that is none of LETTERS.
OTHER, OTHER_RE = "other", regex.compile(r"[^\P{L}\p{Thai}\p{Devanagari}\p{Arabic}\p{Hiragana}\p{Katakana}\p{Han}\p{Cyrillic}\p{Latin}\p{Common}\p{Inherited}]+")

_ORDER = {name: i for i, name in enumerate([*(name for name, _ in SCRIPTS), OTHER])}


def bare(reply: str | None) -> str:
    """A reply without end tokens, invisible characters, padding and line number."""
    return LINE_NUMBER_RE.sub("", forms(END_TOKEN_RE.sub(" ", reply)).strip()).strip() if reply else ""


def folded(text: str) -> str:
    return "".join(_FOLDED_RE.findall(forms(text).casefold()))


@lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    for name, r in SCRIPTS:
        if r.match(ch):
            return name
    return OTHER if OTHER_RE.match(ch) else ""


def script_of(text: str) -> str:
    """The script, by the language that stands for it, of most letters; kana decides for ja; OTHER for a script that is not listed; '' without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else ""
    n: dict[str, int] = {}
    for ch, k in Counter(text).items():
        if s := _script(ch):
            n[s] = n.get(s, 0) + k
    if n.get("ja") and n["ja"] * 8 >= n.get("zh", 0):
        n["ja"] += n.pop("zh", 0)
    return min(n, key=lambda s: (-n[s], _ORDER[s])) if n else ""


SAME_SCRIPT = {"Latin": {"en", "de", "fr", "es"}}


def languages_of(texts: list[str], model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language of each text (script first, then naive Bayes among the languages of that script), the scores and n-gram counts."""
    scores, n = model.scores(texts)
    at = {lab: i for i, lab in enumerate(model.languages)}
    out = []
    for i, t in enumerate(texts):
        s = script_of(t)
        if s == "Latin":
            some = [k for k in at if k not in LETTERS or k in SAME_SCRIPT["Latin"]]
            s = max(some, key=lambda k: scores[i, at[k]]) if some else "en"
        out.append(s)
    return out, scores, n


def _judge(replies, sources, targets, model: LanguageModel):
    """Per pair: defect that is certain without lengths ('' if none), languages and script, first-said letters of both, and the language evidence."""
    clean = [bare(r) for r in replies]
    source_text = [s or "" for s in sources]
    src, src_scores, src_n = languages_of(source_text, model)
    own, scores, n = languages_of(clean, model)
    at = {lab: i for i, lab in enumerate(model.languages)}
    defect, script, first_r, first_s, all_r, all_s, margin, prompt = [], [], [], [], [], [], [], []
    for i, (c, s, tgt) in enumerate(zip(clean, source_text, targets)):
        lr, ls = letter_count(c), letter_count(s)
        words = " ".join(LETTERS_RE.findall(c.casefold()))
        if not lr:
            d = "" if not ls and regex.search(r"\d", c) else "empty"
        elif words in PLACEHOLDERS:
            d = "empty"
        elif REFUSALS.search(" ".join(_TOKENS_RE.findall(c.casefold()))) and not REFUSALS.search(s.casefold()):
            d = "refusal"
        elif ls and folded(c) == folded(s):
            d = "copy"
        else:
            d = ""
        defect.append(d)
        script.append("" if d else script_of(c))
        m = p = None
        if not d and tgt in at and own[i] in at:
            m = float(scores[i, at[own[i]]] - scores[i, at[tgt]])
            # the prompt's own evidence for the reply's language against the one asked for
            p = float(src_scores[i, at[own[i]]] - src_scores[i, at[tgt]]) * min(int(src_n[i]), 1000)
        margin.append(m)
        prompt.append(p)
        a, b = repeated_letters(c)
        all_r.append(a)
        first_r.append(a - b)
        a, b = repeated_letters(s)
        all_s.append(a)
        first_s.append(a - b)
    return clean, defect, src, own, script, first_r, first_s, all_r, all_s, margin, prompt, n


#: From this mean log-odds per n-gram on, a reply is in another language than asked for (times the n-grams: short texts need more);
#: where the prompt is in the reply's language, from half as much on, for what is left untranslated is a defect of its own kind.
FOREIGN = 0.25
FOREIGN_ENOUGH = 6.0
PROMPT_SURE = 10.0
#: A target language is written in one script if so many replies are there and this share of them are.
SCRIPT_REPLIES, SCRIPT_SHARE = 5, 0.6


def _cut_short(text: str) -> str:
    """The text cut at a share of its length that follows from the text."""
    lo, hi = CUT_AT
    return text[: max(1, int(len(text) * (lo + (hi - lo) * (zlib.crc32(text.encode("utf-8", "surrogatepass")) % 1000) / 1000)))]


class EndModel:
    """How often last letters end a reply and how often they go on, by hashed context, over all replies."""

    def __init__(self, ends: np.ndarray, all_: np.ndarray):
        self.ends, self.all = ends, all_

    def log_odds(self, texts: list[str], own: int = 1) -> np.ndarray:
        """Log odds of ending against going on for each text's last letters, from the longest context seen often enough.

        own: how often the text's own ending was counted, which is taken out of the counts.
        """
        points, _ = join_texts(texts)
        stops = np.flatnonzero(points == 0)[1:] - 1
        out = np.zeros(len(texts))
        left = np.ones(len(texts), bool)
        windows = Windows(points)
        for k, n in enumerate(END_ORDERS):
            h = windows.hashes(n)[stops]
            b = bucket(h, END_BITS)
            e, a = np.maximum(self.ends[k][b] - own, 0), np.maximum(self.all[k][b] - own, 0)
            use = left & (h != 0) & (a >= 8)
            out[use] = np.log((e[use] + 0.3) / (a[use] - e[use] + 0.3))
            left &= ~use
        return out


def _tail(reply: str | None) -> str:
    return letters_only(bare(reply)).strip()


def train_end_model(df: DataFrame, text: str) -> EndModel:
    """Counts endings and continuations of every context of every row; tables of a fixed size. Runs when called."""
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("e", T.LongType()), T.StructField("a", T.LongType())])

    def count(batches):
        import pyarrow as pa

        ends = np.zeros((len(END_ORDERS), 1 << END_BITS), np.int64)
        all_ = np.zeros_like(ends)
        for batch in batches:
            texts = [_tail(t) for t in batch.column("t").to_pylist()]
            for a in range(0, len(texts), 5000):
                points, _ = join_texts(texts[a : a + 5000])
                stops = np.flatnonzero(points == 0)[1:] - 1
                windows = Windows(points)
                for k, n in enumerate(END_ORDERS):
                    h = windows.hashes(n)
                    all_[k] += np.bincount(bucket(h[h != 0], END_BITS), minlength=1 << END_BITS)
                    h = h[stops]
                    ends[k] += np.bincount(bucket(h[h != 0], END_BITS), minlength=1 << END_BITS)
        k, b = np.nonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(ends[k, b]), pa.array(all_[k, b])], names=["k", "b", "e", "a"])

    got = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(count, schema).groupBy("k", "b").agg(F.sum("e").alias("e"), F.sum("a").alias("a")).toArrow()
    ends = np.zeros((len(END_ORDERS), 1 << END_BITS), np.int32)
    all_ = np.zeros_like(ends)
    k, b = got.column("k").to_numpy(), got.column("b").to_numpy()
    ends[k, b], all_[k, b] = np.minimum(got.column("e").to_numpy(), 2**31 - 1), np.minimum(got.column("a").to_numpy(), 2**31 - 1)
    return EndModel(ends, all_)


def _share_kind(log_share: Column) -> Column:
    return F.floor((F.least(F.greatest(log_share, F.lit(SHARE_LEAST)), F.lit(SHARE_MOST - SHARE_STEP / 2)) - SHARE_LEAST) / SHARE_STEP).cast("int")


def _ending_kind(value: Column) -> Column:
    return sum((F.when(value >= e, 1).otherwise(0) for e in ENDINGS), F.lit(0))


def breaking_table(whole: np.ndarray, endings: np.ndarray) -> np.ndarray:
    """Per kind of reply (share by ending) whether it has broken off.

    whole: counts of replies as they are, by kind; endings: counts of the endings of replies cut short. Shares of sound
    replies spread about the usual as their middle half does, those of broken ones as if cut anywhere between the limits, and
    endings speak for themselves; how many replies are broken follows from all of them by expectation and maximisation.
    """
    ns, ne = whole.shape
    middle = SHARE_LEAST + SHARE_STEP * (np.arange(ns) + 0.5)
    order = np.argsort(np.abs(middle), kind="stable")
    upto = np.cumsum(whole.sum(axis=1)[order])
    n = upto[-1] if ns else 0
    half = abs(middle[order][np.searchsorted(upto, n / 2)]) if n else 0.0
    spread = max((n * 1.4826 * half + STATED_REPLIES * SPREAD) / (n + STATED_REPLIES), SHARE_STEP)
    sound = np.exp(-0.5 * (middle / spread) ** 2) / spread / np.sqrt(2 * np.pi) * SHARE_STEP + 1e-9
    lo, hi = CUT_AT
    left = np.exp(SHARE_LEAST + SHARE_STEP * np.arange(ns))
    short = (np.clip(left * np.exp(SHARE_STEP), 0, hi) - np.clip(left, 0, hi)) / hi + 1e-9
    e_short = (endings + 1.0) / (endings.sum() + ne)
    e_sound = (whole.sum(axis=0) + 1.0) / (n + ne)
    share = BROKEN
    for _ in range(20):
        broken = share * np.outer(short, e_short)
        odds = broken / (broken + (1 - share) * np.outer(sound, e_sound))
        share = ((whole * odds).sum() + STATED_REPLIES * BROKEN) / (n + STATED_REPLIES)
        e_sound = ((whole * (1 - odds)).sum(axis=0) + 1.0) / ((whole * (1 - odds)).sum() + ne)
    return odds > 0.5


def judged_pairs(pairs: DataFrame, keys: list[str], source: str = "source", reply: str = "reply", target: str = "target") -> DataFrame:
    """Every pair with its defect (null if sound), the languages found and the share of expected letters.

    Fits the language model and the model of breaking off on all replies, counts endings over all
    of them (a checkpoint of the pairs and small jobs when called), takes the usual length ratio of every pair of languages, as the exact median of ratios in
    thousandths, and the script of every target from all pairs, then judges each pair. A null or blank reply is empty; a null
    target is never 'wrong_lang', a target too rare for the language model only by script; a source without letters never makes a reply
    truncated or copied.
    """
    spark = pairs.sparkSession
    pairs = cut(pairs.select(*dict.fromkeys([*keys, source, reply, target])))  # read to fit twice and to judge
    model = train_language_model(pairs, reply, target)
    given = spark.sparkContext.broadcast(model)
    ending = spark.sparkContext.broadcast(train_end_model(pairs, reply))
    f = T.StructField
    long, real, string = T.LongType(), T.DoubleType(), T.StringType()
    made = T.StructType(
        [pairs.schema[k] for k in keys]
        + [f("target", string), f("defect", string), f("src", string), f("own", string), f("script", string), f("first_r", long), f("first_s", long), f("all_r", long), f("all_s", long), f("margin", real), f("prompt", real), f("grams", long), f("ending", real), f("cut_share", real), f("cut_ending", real)]
    )

    def judge(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(made)
        for b in batches:
            tgt = [t.strip().lower() if t else None for t in b.column("_t").to_pylist()]
            clean, defect, *rest, n = _judge(b.column("_r").to_pylist(), b.column("_s").to_pylist(), tgt, given.value)
            ends = ending.value.log_odds([letters_only(c).strip() for c in clean])
            letters = [0 if x else letter_count(c) for c, x in zip(clean, defect)]
            short = [_cut_short(c) if n_ else None for c, n_ in zip(clean, letters)]
            at = [i for i, c in enumerate(short) if c]
            cut_share, cut_ending = [None] * len(short), [None] * len(short)
            for i, e in zip(at, ending.value.log_odds([letters_only(short[i]).strip() for i in at], own=0)):
                cut_share[i], cut_ending[i] = letter_count(short[i]) / letters[i], float(e)
            cols = [tgt, defect, *rest, n.tolist(), ends.tolist(), cut_share, cut_ending]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keys] + [pa.array(c, x.type) for c, x in zip(cols, list(schema)[len(keys) :])], schema=schema)

    rows = pairs.select(*keys, F.col(source).alias("_s"), F.col(reply).alias("_r"), F.col(target).alias("_t")).mapInArrow(judge, made)
    rows = cut(rows)  # read for the ratios, the scripts, the fit and the verdict
    by_grams = F.col("margin") * F.col("grams")
    of_prompt = F.coalesce((F.col("own") == F.col("src")) & (F.col("prompt") >= PROMPT_SURE), F.lit(False))
    ease = F.when(of_prompt, 0.5).otherwise(1.0)
    by_model = (F.col("own") != F.col("target")) & (F.col("margin") >= FOREIGN * ease) & (by_grams >= FOREIGN_ENOUGH * ease)
    # the scripts that replies to each target are written in
    scripts = rows.where((F.col("script") != "") & F.col("target").isNotNull()).groupBy("target", "script").agg(F.count("*").alias("n"))
    scripts = scripts.groupBy("target").agg(F.max_by("script", F.struct("n", "script")).alias("usual_script"), F.max("n").alias("_n"), F.sum("n").alias("_all"))
    scripts = scripts.where((F.col("_n") >= SCRIPT_REPLIES) & (F.col("_n") >= SCRIPT_SHARE * F.col("_all"))).select("target", "usual_script")
    rows = rows.join(scripts, "target", "left")
    other_script = (F.col("script") != "") & (F.col("script") != F.col("usual_script")) & (F.col("margin").isNull() | (F.col("margin") > 0))
    foreign = F.coalesce(by_model, F.lit(False)) | F.coalesce(other_script, F.lit(False))
    rows = rows.withColumn("foreign", foreign & F.col("target").isNotNull())
    ratio = F.when((F.col("first_s") > 0) & (F.col("first_r") > 0), F.round(1000 * F.log(F.col("first_r") / F.col("first_s"))).cast("long"))  # of what is said once
    sound = (F.col("defect") == "") & ~F.col("foreign")
    seen = rows.where(sound & ratio.isNotNull()).groupBy("src", "target", ratio.alias("_ratio")).agg(F.count("*").alias("_n"))
    upto = W.partitionBy("src", "target").orderBy("_ratio")
    seen = seen.withColumn("_upto", F.sum("_n").over(upto)).withColumn("n", F.sum("_n").over(W.partitionBy("src", "target")))
    usual = seen.where(2 * F.col("_upto") >= F.col("n")).groupBy("src", "target").agg((F.min("_ratio") / 1000).alias("mid"), F.max("n").alias("n"))
    prior = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k, float(np.log(v)))])
    of = lambda c: F.coalesce(F.try_element_at(prior, F.col(c)), F.lit(0.0))
    usual = usual.select("src", "target", ((F.col("mid") * F.col("n") + PRIOR_PAIRS * (of("target") - of("src"))) / (F.col("n") + PRIOR_PAIRS)).alias("usual"))
    rows = join_on(rows, usual, ["src", "target"], "left")
    looping = (F.col("all_r") > 2 * F.col("first_r")) & (F.col("all_s") > 2 * F.col("first_s"))
    once_said, in_all = F.col("first_r") / F.col("first_s"), F.col("all_r") / F.col("all_s")
    said = F.when(looping, F.greatest(once_said, in_all)).otherwise(once_said)
    share = F.when(F.col("first_s") > 0, said / F.exp(F.coalesce(F.col("usual"), of("target") - of("src"))))
    rows = cut(rows.select(*keys, "defect", "foreign", "src", "own", "target", share.alias("share"), "ending", "margin", "grams", "cut_share", "cut_ending"))
    fit = rows.where(F.col("cut_share").isNotNull() & ~F.col("foreign") & (F.col("share") > 0))
    ns, ne = round((SHARE_MOST - SHARE_LEAST) / SHARE_STEP), len(ENDINGS) + 1
    of_share = _share_kind(F.log("share"))
    counted = fit.groupBy(of_share.alias("s"), _ending_kind(F.col("ending")).alias("e"), _ending_kind(F.col("cut_ending")).alias("c")).agg(F.count("*").alias("n")).collect()  # one row per kind
    whole, endings = np.zeros((ns, ne)), np.zeros(ne)
    for r in counted:
        whole[r.s, r.e] += r.n
        endings[r.c] += r.n
    table = F.array(*[F.lit(bool(x)) for x in breaking_table(whole, endings).ravel()])
    broken = F.when(F.col("share") > 0, F.get(table, of_share * ne + _ending_kind(F.col("ending"))))
    defect = F.when(F.col("defect") != "", F.col("defect")).when(F.col("foreign"), F.lit("wrong_lang")).when(F.coalesce(broken, F.lit(False)), F.lit("truncated"))
    return rows.select(*keys, defect.alias("defect"), "src", "own", "target", "share", "ending", "margin", "grams")


def reply_pairs(parsed: DataFrame, segments: DataFrame) -> DataFrame:
    """Each reply beside the text of the segments n to m it answers: media_id, take_no, seg_no, source, reply, target.

    Of repeated deliveries one is taken. Without n the reply answers seg_no, without m only n. A reply to
    segments that do not exist has an empty source.
    """
    keys = ["media_id", "take_no", "seg_no"]
    p = once(parsed, keys, ["n", "m", "tgt_lang", "text"])
    n = F.coalesce("n", "seg_no")
    p = p.select(*keys, n.alias("_n"), F.greatest(F.coalesce("m", n), n).alias("_m"), F.col("tgt_lang").alias("target"), F.col("text").alias("reply"))
    s = once(segments, keys, ["text"]).withColumnRenamed("seg_no", "_seg")
    wanted = p.select(*keys, F.explode(F.sequence("_n", "_m")).alias("_seg"))
    found = join_on(wanted, s, ["media_id", "take_no", "_seg"])
    found = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_seg", "text"))).alias("_x"))
    found = found.select(*keys, F.array_join(F.transform("_x", lambda x: x.text), " ").alias("source"))
    return join_on(p.select(*keys, "target", "reply"), found, keys, "left")
