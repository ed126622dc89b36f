"""Streams: ingest once per content, progress per micro-batch, and session state with expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long a content stays known; late deliveries beyond it would pass again, so the state stays bounded.
KNOWN_FOR = "30 days"


def parquet_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 50) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def once(stream: DataFrame, key: str, at: str, known_for: str = KNOWN_FOR) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, known_for).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and value; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def progress(stream: DataFrame, path: str, checkpoint: str, summarise: Callable[[DataFrame], DataFrame]):
    """Writes a summary of every micro-batch as JSON under its number, so a repeated batch replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        summarise(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SESSIONS = "key string, first timestamp, last timestamp, n bigint, closed boolean"


def sessions(stream: DataFrame, key: str, at: str, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n, closed): a session per key that closes when it has been quiet for ``minutes`` of event time;
    rows come out on every change and once more on closing."""
    gap = pd.Timedelta(minutes=minutes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame([(k[0], pd.Timestamp(first), pd.Timestamp(last), n, True)], columns=["key", "first", "last", "n", "closed"])
            return
        times = pd.concat([f[at] for f in frames])
        first, last, n = state.get if state.exists else (times.min().value, times.max().value, 0)
        first, last, n = min(first, times.min().value), max(last, times.max().value), n + len(times)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max((last + gap.value) // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], pd.Timestamp(first), pd.Timestamp(last), n, False)], columns=["key", "first", "last", "n", "closed"])

    marked = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    return marked.groupBy("key").applyInPandasWithState(step, SESSIONS, "first bigint, last bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
