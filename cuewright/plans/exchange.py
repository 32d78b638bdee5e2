"""Asking a language model, as a step between two tables.

Requests are rows; a backend answers them partition by partition; the answers are written to a table keyed by
the request, so that a repeated run, a retried task or a lost executor finds them again instead of asking anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import rstrip_chars, strip

#: Delays in seconds before another attempt; tests set none.
DELAYS = (5.0, 15.0, 30.0)


class Backend(Protocol):
    """Answers one request; None for a failed call. Created once per task."""

    def chat(self, system: str, user: str, max_tokens: int, temperature: float) -> str | None: ...


@dataclass
class NoBackend:
    """Never answers: the rules-only path."""

    def chat(self, system, user, max_tokens, temperature):
        return None


@dataclass
class Replay:
    """Answers from a given table of bounded size: (system, user) or user -> content."""

    answers: dict = field(default_factory=dict)

    def chat(self, system, user, max_tokens, temperature):
        return self.answers.get((system, user), self.answers.get(user))


@dataclass
class Http:
    """A chat service that speaks one of the two common JSON forms; any error is a failed call."""

    url: str
    model: str
    key: str = ""
    messages_form: bool = False
    timeout: float = 120.0

    def body(self, system, user, max_tokens, temperature) -> dict:
        talk = [{"role": "user", "content": user}]
        if self.messages_form:
            return {"model": self.model, "system": system, "messages": talk, "max_tokens": max_tokens, "temperature": temperature}
        return {"model": self.model, "messages": [{"role": "system", "content": system}, *talk], "max_tokens": max_tokens, "temperature": temperature}

    def chat(self, system, user, max_tokens, temperature):
        import urllib.request

        head = {"Content-Type": "application/json"} | ({"x-api-key": self.key} if self.messages_form else {"Authorization": f"Bearer {self.key}"})
        ask = urllib.request.Request(self.url, json.dumps(self.body(system, user, max_tokens, temperature)).encode(), head)
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as got:
                said = json.load(got)
            return said["content"][0]["text"] if self.messages_form else said["choices"][0]["message"]["content"]
        except Exception:  # noqa: BLE001 - the table records the failure
            return None


#: How families of open models mark who speaks.
TEMPLATES = {
    "tags": "<|system|>\n{system}\n<|end|>\n<|user|>\n{user}\n<|end|>\n<|assistant|>\n",
    "im": "<|im_start|>system\n{system}\n<|im_end|>\n<|im_start|>user\n{user}\n<|im_end|>\n<|im_start|>assistant\n",
    "inst": "[SYSTEM_PROMPT]{system}[/SYSTEM_PROMPT]\n[INST]{user}[/INST]",
}


def chat_prompt(system: Column | str, user: Column | str, template: str = "tags") -> Column:
    """System and user text as one prompt of a model family; an unknown family is read as 'tags'."""
    before, rest = TEMPLATES.get(template, TEMPLATES["tags"]).split("{system}")
    between, after = rest.split("{user}")
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(before), col(system), F.lit(between), col(user), F.lit(after))


@dataclass
class Completion:
    """A local server that goes on with a prompt; any error is a failed call."""

    url: str
    template: str = "tags"
    timeout: float = 300.0

    def body(self, system, user, max_tokens, temperature) -> dict:
        form = TEMPLATES.get(self.template, TEMPLATES["tags"])
        prompt = form.replace("{user}", "\0").replace("{system}", system).replace("\0", user)
        return {"prompt": prompt, "n_predict": max_tokens, "max_tokens": max_tokens, "temperature": temperature, "stop": ["<|end|>", "<|im_end|>", "</s>"]}

    def chat(self, system, user, max_tokens, temperature):
        import urllib.request

        ask = urllib.request.Request(self.url, json.dumps(self.body(system, user, max_tokens, temperature)).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as got:
                said = json.load(got)
            return said["content"] if "content" in said else said["choices"][0]["text"]
        except Exception:  # noqa: BLE001 - the table records the failure
            return None


BACKENDS: dict[str, Callable[..., Backend]] = {"none": NoBackend, "replay": Replay, "http": Http, "completion": Completion}


def backend(service: dict) -> Callable[[], Backend]:
    """What makes the backend of a service as config.service() gives it; its form is chat, messages, or a template of a local model."""
    if service["form"] in TEMPLATES:
        return lambda: Completion(service["url"], service["form"])
    return lambda: Http(service["url"], service["model"], service["key"], service["form"] == "messages")


def requests(df: DataFrame, stage: str, system: Column | str, user: Column | str, max_tokens: Column | int, temperature: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Adds request_id (of everything that is asked), stage, system, user, max_tokens, temperature to the kept columns."""
    col = lambda x: F.lit(x) if not isinstance(x, Column) else x
    out = df.select(*(keep or []), F.lit(stage).alias("stage"), col(system).alias("system"), col(user).alias("user"), col(max_tokens).cast("int").alias("max_tokens"), F.lit(temperature).alias("temperature"))
    asked = F.concat_ws("\x1f", "stage", "system", "user", F.col("max_tokens").cast("string"), F.col("temperature").cast("string"))
    return out.withColumn("request_id", F.sha2(asked, 256))


def answer(asked: DataFrame, make: Callable[[], Backend], attempts: int = 3, delays: tuple[float, ...] = DELAYS, pause: float = 0.0) -> DataFrame:
    """One row per distinct request: request_id, content, ok, attempts. Empty answers are tried again."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        backend = make()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                said, tried = None, 0
                while tried < max(attempts, 1):
                    said = backend.chat(r.system, r.user, int(r.max_tokens), float(r.temperature))
                    tried += 1
                    if said and said.strip():
                        break
                    said = None
                    if tried < attempts and delays:
                        time.sleep(delays[min(tried - 1, len(delays) - 1)])
                rows.append((r.request_id, said, said is not None, tried))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(rows, columns=["request_id", "content", "ok", "attempts"])

    once = asked.select("request_id", "system", "user", "max_tokens", "temperature").dropDuplicates(["request_id"])
    return once.mapInPandas(run, "request_id string, content string, ok boolean, attempts int")


def exchange(asked: DataFrame, make: Callable[[], Backend], store: str | None = None, **policy) -> DataFrame:
    """Answers, from the store where it has them; new ones are added to it. Runs when called if a store is given.

    The store is a folder all executors share. Without one the answers are computed where they are used, which is right
    only for backends that always say the same.
    """
    if store is None:
        return answer(asked, make, **policy)
    spark = asked.sparkSession
    schema = "request_id string, content string, ok boolean, attempts int"
    try:
        known = spark.read.schema(schema).parquet(store)
    except AnalysisException as e:  # a store that is not there yet has no answers; any other failure is one
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    fresh = asked if known is None else asked.join(known.where("ok").select("request_id"), "request_id", "left_anti")
    answer(fresh, make, **policy).write.mode("append").parquet(store)
    all_ = spark.read.schema(schema).parquet(store)
    return all_.groupBy("request_id").agg(F.max_by(F.struct("content", "ok", "attempts"), F.col("ok").cast("int")).alias("a")).select("request_id", "a.*")


def verdicts(content: Column | str, n: Column | int, yes: str = "YES", no: str = "NO") -> Column:
    """n yes/no verdicts of an answer; null if it holds none or is missing.

    All words are read first (parted by commas and blanks, marks at their end aside); if their number is not n, only
    the parts between commas and line ends that are nothing but a verdict count; too many are cut, too few
    filled up with no.
    """
    c = F.col(content) if isinstance(content, str) else content
    n = F.lit(n) if not isinstance(n, Column) else n
    words = F.transform(F.split(F.regexp_replace(c, ",", " "), r"(?U)\s+"), lambda t: rstrip_chars(F.upper(t), ".,!?"))
    loose = F.transform(F.filter(words, lambda t: t.isin(yes, no)), lambda t: t == yes)
    lines = F.transform(F.split(F.regexp_replace(c, ",", "\n"), "\n"), lambda t: F.upper(strip(t)))
    strict = F.transform(F.filter(lines, lambda t: t.isin(yes, no)), lambda t: t == yes)
    filled = F.concat(F.slice(strict, F.lit(1), F.greatest(n, F.lit(1))), F.array_repeat(F.lit(False), F.greatest(n - F.size(strict), F.lit(0))))
    return F.when(F.size(loose) == n, loose).when(F.size(strict) > 0, F.slice(filled, F.lit(1), F.greatest(n, F.lit(1))))


def token_budget(kind: str, size: Column) -> Column:
    """Tokens to allow an answer: 'text' by characters, 'verdicts' and 'merges' by number."""
    if kind == "text":
        return F.greatest(F.lit(64), F.floor(size / 4).cast("int") + 30)
    return F.greatest(F.lit(24), size * 8) if kind == "verdicts" else F.greatest(F.lit(8), size * 14)


def new_marks(raw: str, marked: str, marks: str = ".?!") -> list[int]:
    """Indices of the words of raw after which the marked text has a mark that raw has not.

    The texts are aligned by difflib's matching blocks; a mark that is not matched to a mark is new, and belongs to
    the word of the nearest matched character before it.
    """
    import difflib

    to_raw: dict[int, int] = {}
    for a, b, size in difflib.SequenceMatcher(None, raw, marked).get_matching_blocks():
        to_raw.update(zip(range(b, b + size), range(a, a + size)))
    word, of = 0, []
    for ch in raw:
        of.append(None if ch == " " else word)
        word += ch == " "
    found = set()
    for at, ch in enumerate(marked):
        if ch not in marks or (at in to_raw and raw[to_raw[at]] in marks):
            continue
        back = next((k for k in range(at - 1, -1, -1) if k in to_raw), None)
        if back is not None and of[to_raw[back]] is not None:
            found.add(of[to_raw[back]])
    return sorted(found)


def diff_marks(df: DataFrame, raw: str, marked: str) -> DataFrame:
    """Adds new_breaks (indices of words that begin after a new . ? or !) and new_commas (words to get a comma)."""
    from pyspark.sql import types as T

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField("new_breaks", ints), T.StructField("new_commas", ints)])

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.int32())
        for b in batches:
            pairs = list(zip(b.column(raw).to_pylist(), b.column(marked).to_pylist()))
            breaks = [[i + 1 for i in new_marks(x, y)] if x is not None and y is not None else [] for x, y in pairs]
            commas = [new_marks(x, y, ",") if x is not None and y is not None else [] for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(breaks, kind), pa.array(commas, kind)], names=[*b.schema.names, "new_breaks", "new_commas"])

    return df.mapInArrow(run, schema)
