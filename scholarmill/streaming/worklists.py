"""Incremental operators: a lookup cache that grows by batches, running state of events, sessions cut after sentences."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarmill.sources.files import exists


def grow_cache(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's first rows of new keys to the cache at ``path``; keys that it has are left out.

    Restarted with the same checkpoint it goes on where it stopped; a batch that is run again overwrites its own part,
    so each key is there once.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, F.struct(*batch.columns).alias("row"))).alias("m")).select("m.row.*")
        if exists(spark, path):
            new = new.join(spark.read.parquet(path).filter(F.col("batch") < number).select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_totals(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum of each key, as a batch or as a stream in complete or update mode."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def windowed_totals(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts by window and key; events later than ``late`` are dropped. An addition of this engine."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", key, "n")


def sessions(chunks: DataFrame, sentences: int = 3, key: str = "session_id", text: str = "chunk") -> DataFrame:
    """(session_id, text, done): text that grows by chunks, cut after ``sentences`` sentence ends; later chunks are ignored.

    A chunk "<|clear|>" empties the session. State lives in the state store, a session each, none is shared. Null chunks
    add nothing.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text_, done = state.get if state.exists else ("", False)
        for frame in frames:
            for chunk in frame.sort_values("pos")[text]:
                if chunk == "<|clear|>":
                    text_, done = "", False
                elif chunk and not done:
                    text_, done = grown(text_, chunk, sentences)
        state.update((text_, done))
        yield pd.DataFrame({key: [k[0]], "text": [text_], "done": [done]})

    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} string, text string, done boolean", "text string, done boolean", "update", GroupStateTimeout.NoTimeout)


def grown(text: str, chunk: str, sentences: int) -> tuple[str, bool]:
    """The text with a chunk added, cut behind the given number of sentence ends outside citation spans, and whether it was."""
    text += chunk
    n = i = 0
    while i < len(text) - 1:
        if text.startswith("<|cite_start|>", i):
            end = text.find("<|cite_end|>", i)
            if end < 0:
                return text, False
            i = end + len("<|cite_end|>")
            continue
        if text[i] in ".!?" and text[i + 1] in " \n":
            n += 1
            if n == sentences:
                return text[: i + 1], True
        i += 1
    return text, False


def may_complete(text: str, least: int = 3, most_chars: int = 32_000, most_tokens: int = 15_000, count: Callable[[str], int] | None = None) -> bool:
    """Whether a text is long enough to be completed and short enough for the model, by characters and by tokens."""
    count = count or (lambda t: len(t.split()))
    return least <= len(text.strip()) and len(text) <= most_chars and count(text) <= most_tokens
