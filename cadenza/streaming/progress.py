"""Latest event of each job, as a batch view and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key by ``order``; exact repeats change nothing."""
    return events.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("x")).select(key, "x.*")


def latest_stream(events: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The same over a stream; state is one row a key. Write it in update mode."""
    return latest(events, key, order, keep)


def counted(events: DataFrame, time: str, *, late: str = "10 minutes", every: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events of each kind in each window; what is later than ``late`` is dropped and the state with it."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def upsert(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch of changed keys to ``write``, which must be idempotent for a batch number."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
