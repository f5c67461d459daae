"""Structured Streaming over the log: follow the change feed, keep a projection, window events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import EFFECTS, Engine
from ..operators.effects import latest_images


def change_feed(engine: Engine, max_files: int | None = None) -> DataFrame:
    """Row effects as they are published, as a stream."""
    reader = engine.spark.readStream.schema(EFFECTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(engine.storage.path("_log/row_effect"))


def follow(engine: Engine, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hand each batch of effects to ``sink``; only the last image of each key where ``compacted``."""
    writer = change_feed(engine).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def projection(engine: Engine, table: str) -> DataFrame:
    """The table as its change feed alone gives it: the last image of each key."""
    return latest_images(engine.effects().filter(F.col("table_name") == table))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and key; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
