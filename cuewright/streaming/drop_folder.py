"""Files dropped into a folder, processed as they come, and words closed into groups as they are spoken."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import without_bom
from cuewright.sources.files import media_id


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.srt", once: bool = True):
    """Hands each batch of new files (media_id, path, text) to handle; files are seen once, over restarts too."""
    raw = spark.readStream.option("pathGlobFilter", glob).option("wholetext", "true").format("text").load(folder)
    files = raw.select(media_id(F.col("_metadata.file_path")).alias("media_id"), F.col("_metadata.file_path").alias("path"), without_bom("value").alias("text"))
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def close_groups(words: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """Sentence groups of a stream of words (media_id, idx, s_ms, e_ms, text, ts): a group leaves as soon as its mark is spoken.

    Words of a media are taken in the order of their idx as far as a batch has them; an unfinished group leaves when
    its media has been silent for `idle` of event time.
    """

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        out = []

        def close():
            out.append((key[0], held[0][0], held[-1][0] + 1, held[0][1], held[-1][2], " ".join(x[3] for x in held)))
            held.clear()

        if state.hasTimedOut:
            if held:
                close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("idx")
            for r in rows.itertuples(index=False):
                held.append((int(r.idx), int(r.s_ms), int(r.e_ms), r.text))
                if r.text.rstrip().endswith((".", "?", "!")):
                    close()
            state.update((json.dumps(held),))
            spoken = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(spoken, state.getCurrentWatermarkMs()) + _ms(idle))
        yield pd.DataFrame(out, columns=["media_id", "ws", "we", "start_ms", "end_ms", "text"])

    return (
        words.withWatermark("ts", idle)
        .groupBy("media_id")
        .applyInPandasWithState(step, "media_id string, ws int, we int, start_ms long, end_ms long, text string", "held string", "append", "EventTimeTimeout")
    )


def _ms(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
