"""Removal sweep after successful runs, and what it does to pending duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.operators.ordered import carried
from tidepost.session import written

LINK = ["user_id", "job_id", "source_id"]


def sweeping_runs(runs: DataFrame) -> DataFrame:
    """Runs whose silence about a posting removes it: successful, and not known to lack pages."""
    return runs.where("status = 'success' AND coalesce(complete, true)")


def next_runs(points: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, source_id, at, start, run_id): of each source and time the first of these runs that starts later."""
    starts = runs.groupBy("user_id", "source_id", F.col("started_at").alias("at")).agg(F.min("run_id").alias("run_id"))
    starts = starts.withColumns({"next": F.struct(F.col("at").alias("start"), "run_id"), "kind": F.lit(1)}).drop("run_id")
    asked = points.select("user_id", "source_id", "at").distinct()
    none = F.lit(None).cast(starts.schema["next"].dataType)
    line = starts.unionByName(asked.withColumns({"next": none, "kind": F.lit(0)}))
    # Latest first; at equal times the point comes before the start, so only later starts count.
    line = line.withColumn("back", -F.unix_micros(F.col("at").cast("timestamp")))
    line = carried(line, ["user_id", "source_id"], ["back", "kind"], {"found": "next"})
    return line.where("kind = 0").select("user_id", "source_id", "at", "found.*")


def last_starts(runs: DataFrame) -> DataFrame:
    """The newest start of a sweeping run by source."""
    return sweeping_runs(runs).groupBy("user_id", "source_id").agg(F.max("started_at").alias("last_start"))


def unseen_links(links: DataFrame, runs: DataFrame) -> DataFrame:
    """Active links that were last seen before a sweeping run of their source began. Only sources with a run among
    ``runs`` are looked at: what other sources list cannot have gone since their own last run."""
    rows = links.where("is_active").join(last_starts(runs), ["user_id", "source_id"])
    return rows.where("last_seen_at < last_start").select(*LINK, "last_seen_at")


def stale_links(links: DataFrame, runs: DataFrame) -> DataFrame:
    """M5: active links a later sweeping run of their source did not see, with that run's start."""
    stale = written(unseen_links(links, runs), "stale")
    after = next_runs(stale.select("user_id", "source_id", F.col("last_seen_at").alias("at")), sweeping_runs(runs))
    after = after.withColumnRenamed("at", "last_seen_at")
    return stale.join(after, ["user_id", "source_id", "last_seen_at"]).select(*LINK, F.col("start").alias("gone_at"))


def swept_links(links: DataFrame, stale: DataFrame) -> DataFrame:
    rows = links.join(stale, LINK, "left")
    gone = F.col("gone_at").isNotNull()
    return rows.withColumn("is_active", F.col("is_active") & ~gone).withColumn(
        "removed_at", F.coalesce("gone_at", "removed_at")
    ).select(*links.columns)


def active_anywhere(links: DataFrame) -> DataFrame:
    """Per job whether any source still lists it, and when the last link went."""
    return links.groupBy("job_id").agg(
        F.bool_or("is_active").alias("is_active"), F.max("removed_at").alias("last_removed_at")
    )


def removed_jobs(jobs: DataFrame, links: DataFrame, stale: DataFrame) -> DataFrame:
    """Active jobs that lost their last active link in this sweep, with the time."""
    affected = links.join(stale.select("job_id").distinct(), "job_id", "left_semi")
    gone = active_anywhere(affected).where("NOT is_active")
    active = jobs.where("status = 'active'").select("user_id", "job_id")
    return active.join(gone, "job_id").select("user_id", "job_id", F.col("last_removed_at").alias("gone_at"))


def swept_jobs(jobs: DataFrame, removed: DataFrame) -> DataFrame:
    rows = jobs.join(removed, ["user_id", "job_id"], "left")
    gone = F.col("gone_at").isNotNull()
    return rows.withColumn("status", F.when(gone, "removed").otherwise(F.col("status"))).withColumn(
        "removed_at", F.coalesce("gone_at", "removed_at")
    ).select(*jobs.columns)


def stranded_candidates(candidates: DataFrame, removed: DataFrame) -> DataFrame:
    """M7: pending candidates with a removed job on either side, and the first such job."""
    sides = candidates.where("status = 'pending'").select(
        "candidate_id", F.explode(F.array("job_id", "candidate_job_id")).alias("job_id")
    )
    return sides.join(removed.select("job_id", "gone_at"), "job_id").groupBy("candidate_id").agg(
        F.min("job_id").alias("gone_job"), F.min("gone_at").alias("gone_at")
    )


def stranded_in_turn(candidates: DataFrame, removals: DataFrame) -> DataFrame:
    """M7 inside a batch: pending candidates with a job on either side that is removed after they were made.

    ``candidates`` have the place ``born`` of the item that made them, null for stored ones, ``removals`` the place ``at``,
    null for the end of the batch. The first removal counts, and of jobs that go with it the one with the lowest id.
    """
    sides = candidates.where("status = 'pending'").select(
        "candidate_id", "born", F.explode(F.array("job_id", "candidate_job_id")).alias("job_id")
    )
    hits = sides.join(removals.select("job_id", "at", "gone_at"), "job_id")
    hits = hits.where("born is null or at is null or born < at")
    turn = F.struct(F.col("at").isNull(), "at", "job_id")
    return hits.groupBy("candidate_id").agg(F.min_by(F.struct("job_id", "gone_at"), turn).alias("first")).select(
        "candidate_id", F.col("first.job_id").alias("gone_job"), "first.gone_at"
    )


def dismissed_candidates(candidates: DataFrame, stranded: DataFrame) -> DataFrame:
    rows = candidates.join(stranded, "candidate_id", "left")
    hit = F.col("gone_at").isNotNull()
    return rows.withColumn("status", F.when(hit, "dismissed").otherwise(F.col("status"))).withColumn(
        "resolved_at", F.coalesce("gone_at", "resolved_at")
    ).select(*candidates.columns)


def dismissal_events(candidates: DataFrame, stranded: DataFrame) -> DataFrame:
    """One event per candidate dismissed by a removal."""
    rows = candidates.join(stranded, "candidate_id")
    candidate, job = F.col("candidate_id").cast("string"), F.col("gone_job").cast("string")
    return rows.select(
        "user_id",
        F.lit("job_merge_candidate_dismissed_on_removal").alias("event_type"),
        F.lit("job_merge_candidate").alias("entity_type"),
        candidate.alias("entity_id"),
        F.concat(
            F.lit("Dismissed merge candidate "), candidate, F.lit(" because job "), job, F.lit(" was removed")
        ).alias("message"),
        F.to_json(F.struct(job.alias("job_id"))).alias("data"),
        F.col("gone_at").alias("created_at"),
    )


@dataclass(frozen=True)
class Swept:
    """Links and jobs after a sweep, and the jobs it removed."""

    links: DataFrame
    jobs: DataFrame
    removed: DataFrame


def sweep(links: DataFrame, jobs: DataFrame, runs: DataFrame) -> Swept:
    """M5, M6: links and jobs after the sweeps of a batch of runs; ``runs`` are all runs of the batch's sources, ``links``
    and ``jobs`` hold at least what the batch touches.

    Failed runs (M6) remove nothing: they never count as a run that omitted a job. Only the state after the last run is
    kept.
    """
    stale = written(stale_links(links, runs), "stale")
    after = swept_links(links, stale)
    removed = written(removed_jobs(jobs, after, stale), "removed")
    return Swept(after, swept_jobs(jobs, removed), removed)
