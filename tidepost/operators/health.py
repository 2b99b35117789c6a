"""Runs and source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepost.fixed import RUNS_LISTED, TASKS_LISTED
from tidepost.functions.values import run_duration, run_label, source_state


def latest_runs(runs: DataFrame, count: int = RUNS_LISTED) -> DataFrame:
    """The newest runs of every source, with their rank.

    Spark keeps only ``count`` rows per source in each map task, so a source with many
    runs does not travel whole.
    """
    if count < 1:
        raise ValueError("count must be 1 or more")
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= count)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every source."""
    rest = [c for c in runs.columns if c != "source_id"]
    best = F.max_by(F.struct(*rest), F.struct("started_at", "run_id")).alias("run")
    return runs.groupBy("source_id").agg(best).select("source_id", "run.*")


def run_history(runs: DataFrame) -> DataFrame:
    """runs with the duration and label a history shows."""
    return runs.withColumn("duration", run_duration(F.col("started_at"), F.col("completed_at"))).withColumn(
        "label", run_label(F.col("status"), F.col("jobs_found"))
    )


def consecutive_failures(runs: DataFrame, key: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Failed runs of a source since its last success.

    Takes final attempts only. Failures are first counted per source and start time, so the
    comparison with the last success meets small groups.
    """
    finished = runs.where(F.col("status").isin("success", "failed"))
    last_success = finished.where("status = 'success'").groupBy(*key).agg(
        F.max("started_at").alias("last_success")
    )
    counted = (
        finished.join(last_success, list(key), "left")
        .groupBy(*key)
        .agg(
            F.count_if(
                (F.col("status") == "failed")
                & (F.col("last_success").isNull() | (F.col("started_at") > F.col("last_success")))
            ).alias("consecutive_failures")
        )
    )
    return counted.withColumn("alert", F.col("consecutive_failures") >= 2)


def source_health(runs: DataFrame, key: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Last attempt, last success with its job count, and the error still standing."""
    success, failed = F.col("status") == "success", F.col("status") == "failed"
    end = F.when(success | failed, F.struct("completed_at", "run_id"))
    found = F.max_by("jobs_found", F.when(success, F.struct("completed_at", "run_id")))
    return runs.groupBy(*key).agg(
        F.max("started_at").alias("last_attempt_at"),
        F.max(F.when(success, F.col("completed_at"))).alias("last_success_at"),
        F.when(F.max(success), found).alias("last_job_count"),
        F.max_by(F.when(failed, F.concat_ws(": ", "error_type", "error_message")), end).alias("last_error"),
    )


HEALTH = ("last_attempt_at", "last_success_at", "last_job_count", "last_error", "consecutive_failures")


def with_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with the health all their runs give; a source without a run among ``runs`` stays as it is.

    It follows from the runs in order of time, so a run that arrives late changes nothing that
    newer ones settled.
    """
    key = ("user_id", "source_id")
    counts = consecutive_failures(runs, key).drop("alert")
    found = source_health(runs, key).join(counts, list(key), "left")
    found = found.select(*key, F.struct(*HEALTH).alias("found"))
    hit = F.col("found").isNotNull()
    rows = sources.join(found, list(key), "left")
    return rows.withColumns(
        {c: F.when(hit, F.col(f"found.{c}")).otherwise(F.col(c)).cast(sources.schema[c].dataType) for c in HEALTH}
    ).select(*sources.columns)


def with_state(sources: DataFrame) -> DataFrame:
    """F18."""
    return sources.withColumn("state", source_state(F.col("enabled"), F.col("last_error")))


def latest_tasks(tasks: DataFrame, count: int = TASKS_LISTED) -> DataFrame:
    """T5: the newest tasks; a top-k over all partitions, no full sort."""
    return tasks.orderBy(F.desc("created_at"), "task_id").limit(count)
