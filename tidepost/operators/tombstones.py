"""Merged-away jobs and the job that took their place."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.session import written


def survivors(jobs: DataFrame) -> DataFrame:
    """``user_id, job_id, survivor_id`` of every merged job.

    The survivor is the first job of the chain that is not merged; null when the chain is
    broken, runs in a circle or leaves the user. Pointers double in every round, so a chain
    of length n takes log2(n) rounds; a pointer that outlives them belongs to a circle.
    """
    merged = jobs.where("status = 'merged'").select(
        "user_id", "job_id", F.col("merged_into_job_id").alias("target")
    )
    nodes = jobs.select(
        F.col("user_id").alias("node_user"),
        F.col("job_id").alias("node"),
        (F.col("status") != "merged").alias("alive"),
    )
    first = merged.join(
        nodes, (F.col("target") == F.col("node")) & (F.col("user_id") == F.col("node_user")), "left"
    )
    state = written(
        first.select(
            "user_id", "job_id", F.col("node").alias("at"), F.coalesce("alive", F.lit(True)).alias("done")
        ),
        "chains",
    )
    rounds = None
    done = 0
    while True:
        open_rows = state.where("NOT done")
        if rounds is None:
            waiting = open_rows.count()
            rounds = ceil(log2(waiting + 1)) + 1 if waiting else 0
        elif open_rows.isEmpty():
            break
        if done >= rounds:
            break
        ahead = state.select(
            F.col("user_id").alias("ahead_user"),
            F.col("job_id").alias("ahead"),
            F.col("at").alias("ahead_at"),
            F.col("done").alias("ahead_done"),
        )
        stepped = open_rows.join(
            ahead, (F.col("at") == F.col("ahead")) & (F.col("user_id") == F.col("ahead_user"))
        ).select(
            "user_id", "job_id", F.col("ahead_at").alias("at"), F.col("ahead_done").alias("done")
        )
        state = written(state.where("done").unionByName(stepped), "chains")
        done += 1
    return state.select("user_id", "job_id", F.when(F.col("done"), F.col("at")).alias("survivor_id"))
