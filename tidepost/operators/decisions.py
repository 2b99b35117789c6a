"""User decisions on jobs and their audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.operators.ordered import lagged


def known_decisions(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Decisions on jobs the same user owns; others count as not found."""
    return log.join(jobs.select("user_id", "job_id"), ["user_id", "job_id"], "left_semi")


def decided_jobs(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs after a log of ``(user_id, job_id, decided_at, decision_id, decision)``.

    The latest decision wins; a null one clears.
    """
    latest = log.groupBy("user_id", "job_id").agg(
        F.max_by(F.struct("decision"), F.struct("decided_at", "decision_id")).alias("last")
    )
    return (
        jobs.join(latest, ["user_id", "job_id"], "left")
        .withColumn(
            "user_decision",
            F.when(F.col("last").isNotNull(), F.col("last.decision")).otherwise(F.col("user_decision")),
        )
        .select(*jobs.columns)
    )


def decision_events(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """One event per decision with the decision before it."""
    own = log.join(jobs.select("user_id", "job_id", "user_decision"), ["user_id", "job_id"])
    own = own.withColumn("given", F.struct("decision"))
    own = lagged(own, ["user_id", "job_id"], ["decided_at", "decision_id"], {"earlier": "given"})
    previous = F.when(F.col("earlier").isNotNull(), F.col("earlier.decision")).otherwise(
        F.col("user_decision")
    )

    def quoted(column):
        return F.when(column.isNull(), "None").otherwise(F.concat(F.lit("'"), column, F.lit("'")))

    return own.select(
        "user_id",
        F.lit("job_decision_set").alias("event_type"),
        F.lit("job").alias("entity_type"),
        F.col("job_id").cast("string").alias("entity_id"),
        F.concat(
            F.lit("Job decision set to "), quoted(F.col("decision")),
            F.lit(" (was "), quoted(previous), F.lit(")"),
        ).alias("message"),
        previous.alias("previous"),
        "decision",
        F.col("decided_at").alias("created_at"),
    )
