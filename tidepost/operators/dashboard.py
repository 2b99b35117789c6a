"""The activity dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_jobs(versions: DataFrame, jobs: DataFrame, since: Column) -> DataFrame:
    """Jobs (not merged) with a material version since ``since``, once each."""
    recent = versions.where(F.col("is_material") & (F.col("seen_at") >= since)).select("job_id").distinct()
    return jobs.where("status <> 'merged'").join(recent, "job_id", "left_semi")


def dashboard(
    sources: DataFrame,
    jobs: DataFrame,
    versions: DataFrame,
    tasks: DataFrame,
    as_of: Column,
    hours: int = 24,
) -> DataFrame:
    """G1: eleven counts per user at ``as_of``; each table is read once and pre-aggregated."""
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    live = F.col("status") != "merged"
    new = live & (F.col("first_seen_at") >= since)
    by_source = sources.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sources_total"),
        F.count_if("enabled").alias("sources_enabled"),
        F.count_if(F.col("last_error").isNotNull()).alias("sources_failing"),
    )
    by_job = jobs.groupBy("user_id").agg(
        F.count_if(live).alias("jobs_total"),
        F.count_if(new).alias("jobs_seen_last_24h"),
        F.count_if(new).alias("jobs_new_last_24h"),
        F.count_if((F.col("status") == "removed") & (F.col("removed_at") >= since)).alias(
            "jobs_removed_last_24h"
        ),
        F.count_if(new & F.col("reposted_from_job_id").isNotNull()).alias("jobs_reposted_last_24h"),
    )
    by_change = (
        changed_jobs(versions, jobs, since)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("jobs_changed_last_24h"))
    )
    by_task = tasks.groupBy("user_id").agg(
        F.count_if(F.col("status") == "queued").alias("queued_tasks"),
        F.count_if(F.col("status") == "running").alias("running_tasks"),
    )
    out = by_source
    for part in (by_job, by_change, by_task):
        out = out.join(part, "user_id", "full_outer")
    return out.na.fill(0)
