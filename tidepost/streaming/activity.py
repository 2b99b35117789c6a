"""Sighting dedupe, rolling activity, failure alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType


def first_sightings(sightings: DataFrame, delay: str) -> DataFrame:
    """One row per (source, item) within the watermark; state is dropped behind it."""
    return sightings.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["source_id", "item"])


def hourly_activity(sightings: DataFrame, delay: str = "1 day", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """S3: sightings and failures per hour and user, updated as they arrive.

    Every row goes into one hour. Rows of hours that ended before the watermark are dropped.
    """
    return (
        sightings.withWatermark("seen_at", delay)
        .groupBy(F.window("seen_at", "1 hour"), *keys)
        .agg(
            F.count(F.lit(1)).alias("sightings"),
            F.count_if(F.col("event_type") == "error").alias("failures"),
        )
        .select(F.col("window.start").alias("hour"), *keys, "sightings", "failures")
    )


def rolling_activity(hours: DataFrame, span: int = 24, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """S3: sightings and failures of ``span`` hours up to every hour, added up from counts of hours."""
    shifts = F.array(*[F.make_interval(hours=F.lit(h)) for h in range(span)])
    starts = hours.withColumn("back", F.explode(shifts)).withColumn("window_start", F.col("hour") - F.col("back"))
    return (
        starts.groupBy("window_start", *keys)
        .agg(F.sum("sightings").alias("sightings"), F.sum("failures").alias("failures"))
        .select(
            "window_start", (F.col("window_start") + F.make_interval(hours=F.lit(span))).alias("window_end"),
            *keys, "sightings", "failures",
        )
    )


def kept_updates(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes every update of an aggregate with its batch; the latest per key is the result.

    A replayed batch overwrites its own folder.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*rest), "batch").alias("last")
    return updates.groupBy(*keys).agg(last).select(*keys, "last.*")


_ALERT = StructType(
    [
        StructField("source_id", LongType()),
        StructField("consecutive_failures", LongType()),
        StructField("alert", BooleanType()),
    ]
)
_STATE = StructType([StructField("failures", LongType()), StructField("last_success", TimestampType())])


def _count_failures(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, last = state.get if state.exists else (0, None)
    last = pd.Timestamp(last) if last is not None else None
    failed_at = []
    for chunk in chunks:
        successes = chunk.loc[chunk["status"] == "success", "started_at"]
        if len(successes) and (last is None or successes.max() > last):
            last, failures = successes.max(), 0
        failed_at.append(chunk.loc[chunk["status"] == "failed", "started_at"])
    for times in failed_at:
        failures += int(len(times) if last is None else (times > last).sum())
    state.update((failures, None if last is None else last.to_pydatetime()))
    yield pd.DataFrame(
        {
            "source_id": [key[0]],
            "consecutive_failures": [failures],
            "alert": [failures >= 2],
        }
    )


def failure_alerts(runs: DataFrame) -> DataFrame:
    """Failed runs of a source since its last success, updated as runs arrive.

    Micro-batches arrive in time order; within one the order does not matter. The state of a
    source is a count and a time. A run is first reduced to source, time and status, so a batch
    brings little per source.
    """
    return (
        runs.select("source_id", "started_at", "status")
        .groupBy("source_id")
        .applyInPandasWithState(
            _count_failures, _ALERT, _STATE, "update", GroupStateTimeout.NoTimeout
        )
    )
