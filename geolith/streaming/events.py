"""Structured Streaming over event files: windows, sessions, deduplication, incremental filter state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

WATERMARK = "1 day"


def _timed(events: DataFrame) -> DataFrame:
    """Events with a time zone in their time and the watermark on it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as they land in a folder; the file source remembers what it has read."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and values per window and type; works on batches and streams alike."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        _timed(events)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total", "largest")
    )


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: events no farther apart than the gap."""
    return (
        _timed(events)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")
    )


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Repeated deliveries dropped within the watermark."""
    return _timed(events).dropDuplicatesWithinWatermark([key])


def incremental_filter(updates: DataFrame, q: float, r: float) -> DataFrame:
    """Local-level filter whose state (period, x, P) lives with the stream, one per key.

    ``updates`` has iso3, period, value. Values come in order of period within
    a batch; periods no later than the last one seen are late and are left out,
    as smoothing back is batch work. A missing value only adds variance.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, x, p = state.get if state.exists else (-(1 << 60), None, None)
        rows = []
        for row in pd.concat(batches).sort_values("period").itertuples(index=False):
            if row.period <= seen:
                continue
            seen = int(row.period)
            if x is None:
                if pd.notna(row.value):
                    x, p = float(row.value), r
            else:
                p += q
                if pd.notna(row.value):
                    gain = p / (p + r)
                    x, p = x + gain * (float(row.value) - x), (1 - gain) * p
            if x is not None:
                rows.append((key[0], seen, x, p))
        state.update((seen, x, p))
        yield pd.DataFrame(rows, columns=["iso3", "period", "state", "variance"])

    return updates.groupBy("iso3").applyInPandasWithState(
        step,
        "iso3 string, period long, state double, variance double",
        "period long, x double, p double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into an in-memory table, and returns it."""
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)
