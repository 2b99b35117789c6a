"""One collection batch from postings to the swept registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.redact import stored_error
from tidepost.functions.similarity import MatchRule
from tidepost.operators.health import with_health
from tidepost.operators.lifespans import lifespans
from tidepost.operators.review import comparable, new_candidates, resembling, with_reposts
from tidepost.operators.state import Changes, Registry
from tidepost.operators.sweep import dismissal_events, dismissed_candidates, stranded_in_turn, sweep, unseen_links
from tidepost.operators.upsert import matched, runs_missing_url, upserts
from tidepost.session import written


def finished_runs(
    runs: DataFrame, failures: DataFrame, postings: DataFrame, rejects: DataFrame | None
) -> DataFrame:
    """M6: runs with status, redacted error and rejects.

    A run fails as a whole: with a failed response or an item without address none of its
    items counts.
    """
    first = failures.groupBy("run_id").agg(
        F.min_by(F.struct("error_type", "error_message"), F.struct("error_type", "error_message")).alias("error")
    )
    missing = runs_missing_url(postings).where("failed").select("run_id", F.lit(True).alias("no_url"))
    out = runs.join(first, "run_id", "left").join(missing, "run_id", "left")
    failed = F.col("error").isNotNull() | F.col("no_url").isNotNull()
    message = F.coalesce("error.error_message", F.when(F.col("no_url"), "Collected job has no application URL"))
    out = out.withColumns(
        {
            "status": F.when(failed, "failed").otherwise("success"),
            "error_type": F.when(failed, F.coalesce("error.error_type", F.lit("ValueError"))),
            "error_message": F.when(failed, stored_error(message)),
        }
    ).drop("error", "no_url")
    if rejects is None:
        return out.withColumn("jobs_rejected", F.lit(0).cast("bigint"))
    counted = rejects.groupBy("run_id").agg(F.count(F.lit(1)).alias("jobs_rejected"))
    return out.join(counted, "run_id", "left").withColumn(
        "jobs_rejected", F.when(F.col("status") == "success", F.coalesce("jobs_rejected", F.lit(0))).otherwise(0)
    )


def touched_jobs(registry: Registry, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """The jobs a batch may change: those of its items, and those of its sources that were last seen before a run."""
    unseen = unseen_links(registry.links, runs)
    return written(rows.select("job_id").union(unseen.select("job_id")).distinct(), "touched-jobs")


def pending_near(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending candidates with one of these jobs on either side."""
    pending = candidates.where("status = 'pending'")
    sides = pending.select("candidate_id", F.explode(F.array("job_id", "candidate_job_id")).alias("job_id"))
    return pending.join(sides.join(ids, "job_id", "left_semi").select("candidate_id"), "candidate_id", "left_semi")


def batch_changes(
    registry: Registry,
    postings: DataFrame,
    runs: DataFrame,
    failures: DataFrame,
    rejects: DataFrame | None = None,
    rule: MatchRule | None = MatchRule(),
) -> Changes:
    """What a batch of runs does: upsert, duplicates, reposts, sweep, run rows, source health.

    ``runs`` holds ``user_id, source_id, run_id, started_at, completed_at``, and ``complete``
    where pages are known to be missing. Without a match rule no duplicates and reposts are
    looked for. Of a stored registry whole rows are read only in the buckets of jobs that the
    batch touches; elsewhere the columns that items are matched by, and links and runs of the
    batch's sources.
    """
    closed = written(finished_runs(runs, failures, postings, rejects), "runs")
    good = postings.join(closed.where("status = 'success'").select("run_id"), "run_id", "left_semi")
    items, rows = matched(registry, good)
    source = ["user_id", "source_id"]
    earlier = registry.runs.join(closed.select(*source).distinct(), source, "left_semi")
    theirs = written(earlier.unionByName(closed, allowMissingColumns=True), "their-runs")
    ids = touched_jobs(registry, rows, theirs)
    jobs, links = written(registry.near("jobs", ids), "jobs"), written(registry.near("links", ids), "links")
    made = upserts(registry, jobs, links, items, rows)
    place = rows.schema["ord"].dataType
    candidates = pending_near(registry.candidates, ids).withColumn("born", F.lit(None).cast(place))
    removals = None
    after_jobs = made.jobs
    # Who is active when matters to those who are compared, and to candidates that wait.
    if rule is not None or not candidates.isEmpty():
        times = lifespans(rows, jobs, comparable(jobs, registry.companies), links, theirs, closed)
        removals = times.removals
        if rule is not None:
            active, gone = resembling(made.new_jobs, registry, times, rule)
            after_jobs = with_reposts(after_jobs, gone)
            new = new_candidates(active, made.new_jobs, registry.candidates)
            born = made.new_jobs.select("user_id", "job_id", F.col("ord").alias("born"))
            candidates = candidates.unionByName(new.join(born, ["user_id", "job_id"]), allowMissingColumns=True)
    after = sweep(written(made.links, "links"), written(after_jobs, "jobs"), theirs)
    candidates = written(candidates, "candidates")
    at_end = after.removed.withColumn("at", F.lit(None).cast(place))
    removals = at_end if removals is None else removals.unionByName(at_end)
    stranded = written(stranded_in_turn(candidates, removals), "stranded")
    counted = closed.join(made.counters, "run_id", "left")
    counted = counted.na.fill(0, ["jobs_found", "jobs_created", "jobs_updated"])
    counted = written(counted, "closed-runs")
    health_runs = earlier.unionByName(counted, allowMissingColumns=True)
    sources = registry.sources.join(counted.select(*source).distinct(), source, "left_semi")
    candidates = candidates.drop("born")
    return Changes(
        replaced={
            "sources": with_health(sources, health_runs),
            "jobs": after.jobs,
            "links": after.links,
            "candidates": dismissed_candidates(candidates, stranded),
        },
        added={
            "runs": registry.runs.limit(0).unionByName(counted, allowMissingColumns=True),
            "companies": made.companies,
            "versions": made.versions,
            "events": dismissal_events(candidates, stranded),
        },
    )


def collect_batch(
    registry: Registry,
    postings: DataFrame,
    runs: DataFrame,
    failures: DataFrame,
    rejects: DataFrame | None = None,
    rule: MatchRule | None = MatchRule(),
) -> Registry:
    """The whole registry after a batch of runs."""
    return batch_changes(registry, postings, runs, failures, rejects, rule).applied(registry)
