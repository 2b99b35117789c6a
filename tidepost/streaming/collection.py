"""Continuous collection of landed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepost.functions.similarity import MatchRule
from tidepost.operators.state import committed, empty_registry, newest_version, read_held, read_registry, write_changes
from tidepost.plans.collect import batch_changes
from tidepost.session import scratch, written
from tidepost.sources.adapters import REGISTRY, collect, counted_pages, with_completeness
from tidepost.sources.landed import LANDED_PARTS, whole_runs


def landed_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(LANDED_PARTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def collect_continuously(
    landed: DataFrame,
    state_folder: str,
    checkpoint: str,
    rule: MatchRule | None = MatchRule(),
    adapters=REGISTRY,
) -> StreamingQuery:
    """Applies every micro-batch to the newest registry and writes the next version.

    A version's mark carries the stream (its id lives in the checkpoint folder) and the batch: a
    replayed batch that was committed is left out, one that was not starts from the newest
    committed version again. A stream with a new checkpoint folder goes on from that version too.
    A version writes the buckets that the batch touches; what the batch copied on its way is
    deleted. Rows of a run whose responses are not all there yet wait beside the registry, so a run takes
    effect once, as a whole. A paged run with a gap is applied but removes nothing; what landed
    behind its first short page does not count.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        done = committed(spark, state_folder).where((F.col("stream") == stream) & (F.col("batch") == batch_id))
        if not done.isEmpty():
            return
        version = newest_version(spark, state_folder)
        before = empty_registry(spark) if version is None else read_registry(spark, state_folder, version)
        waiting = read_held(spark, state_folder, version)
        with scratch(spark, "batch"):
            there = written(batch.unionByName(waiting, allowMissingColumns=True), "landed")
            run = ["user_id", "source_id", "run_id"]
            whole = written(whole_runs(there), "whole-runs")
            landed_rows = there.join(whole, run, "left_semi")
            held = there.join(whole, run, "left_anti")
            found = collect(landed_rows, adapters, once=True)
            runs = landed_rows.groupBy("user_id", "source_id", "run_id").agg(
                F.min("started_at").alias("started_at"), F.max("started_at").alias("completed_at")
            )
            runs = with_completeness(runs, found.pages)
            postings = counted_pages(found.postings, found.pages)
            rejects = counted_pages(found.rejects, found.pages)
            changes = batch_changes(before, postings, runs, found.failures, rejects, rule)
            write_changes(changes, before, state_folder, (version or 0) + 1, stream, batch_id, held)

    return (
        landed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_registry(spark: SparkSession, state_folder: str):
    version = newest_version(spark, state_folder)
    return empty_registry(spark) if version is None else read_registry(spark, state_folder, version)
