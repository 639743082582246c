"""Counts over streams of documents.

Word, bigram and co-occurrence counts add up, so the batch operators run
unchanged on a streaming table in update or complete mode.  With an event time
they are counted by window, and a watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counts as K
from ..operators.context import Window
from ..plans.store import shared_dir
from ..sources.corpus import from_table


def word_counts(docs: DataFrame, **normalize: bool) -> DataFrame:
    """``(word, n)`` of a stream of documents."""
    return K.count_words(from_table(docs, **normalize))


def bigram_counts(docs: DataFrame, **normalize: bool) -> DataFrame:
    return K.count_bigrams(from_table(docs, **normalize))


def cooccurrence(docs: DataFrame, size: int | tuple[int, int] = 1, words: DataFrame | None = None, contexts: DataFrame | None = None, **normalize: bool) -> DataFrame:
    """``(word, ctx, n)`` by window contexts; vocabularies are static tables."""
    return Window(size)(from_table(docs, **normalize), words, contexts).groupBy("word", "ctx").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(rows: DataFrame, time: str, value: str | Column, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(start, end, word, n)`` by event-time windows; rows later than ``late`` are dropped once a window closed."""
    col = F.col(value) if isinstance(value, str) else value
    at = rows.select(F.col(time).alias("time"), col.alias("word")).withWatermark("time", late)
    return at.groupBy(F.window("time", length, slide or length).alias("w"), "word").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "word", "n")


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Run all that is there through ``sink``, batch by batch, and stop; offsets and state are kept in the shared folder."""
    at = shared_dir(stream.sparkSession, "stream")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q
