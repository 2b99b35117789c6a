"""From where to where in a batch a job is active or removed, and under which names.

A place in the batch is an item's order (run start, run, position); what a run removes is removed behind its last item. A
span ``(since, until)`` holds for items behind ``since`` and before ``until``; null is before and after the whole batch.
So an item meets the registry as it is when its turn comes, however many runs a batch has.

A job is active while a link of it is. A link is from each sighting to the end of the first sweeping run of its source that
starts later. Sightings that one run ends are one row, so a job has as many rows as runs end its links, not sightings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidepost.functions.text import plain_name
from tidepost.operators.sweep import next_runs, sweeping_runs
from tidepost.session import written

JOB = ["user_id", "job_id"]
NAMES = ["company", "title", "location"]
#: The position behind all items of a run.
BEHIND = (1 << 63) - 1


@dataclass(frozen=True)
class Lifespans:
    """Of the jobs a batch touches: spans by names and status (``active`` or ``removed``) for those that are not the same
    throughout, their ids, and every removal with its place and time."""

    spans: DataFrame
    moving: DataFrame
    removals: DataFrame


def _end(start: Column, run_id: Column, kind: DataType) -> Column:
    return F.struct(start, run_id, F.lit(BEHIND)).cast(kind)


def _points(rows: DataFrame, jobs: DataFrame, links: DataFrame, runs: DataFrame, batch: DataFrame) -> DataFrame:
    """(user_id, job_id, since, until) of links: stored ones that are active, and sightings by run."""
    kind = rows.schema["ord"].dataType
    active = jobs.where("status = 'active'").select(*JOB)
    stored = links.where("is_active").join(active, JOB, "left_semi").select(
        *JOB, "source_id", F.lit(None).cast(kind).alias("since"), F.lit(None).cast(kind).alias("own_end"), F.col("last_seen_at").alias("at")
    )
    seen = rows.groupBy(*JOB, "source_id", "started_at", "run_id").agg(F.min("ord").alias("since"), F.max("seen_at").alias("at"))
    # A late sighting does not put back what the link has seen since.
    newest = links.select(*JOB, "source_id", F.col("last_seen_at").alias("newest"))
    seen = seen.join(newest, [*JOB, "source_id"], "left").select(
        *JOB, "source_id", "since", _end(F.col("started_at"), F.col("run_id"), kind).alias("own_end"), F.greatest("at", "newest").alias("at")
    )
    points = written(stored.unionByName(seen), "points")
    ends = next_runs(points.select("user_id", "source_id", "at"), sweeping_runs(runs))
    ends = ends.join(batch.select("user_id", "run_id", F.lit(True).alias("in_batch")), ["user_id", "run_id"], "left")
    points = points.join(ends, ["user_id", "source_id", "at"], "left")
    # A run of an earlier batch ends a late sighting at once: behind the late run itself.
    end = F.when(F.col("in_batch"), _end(F.col("start"), F.col("run_id"), kind))
    until = F.when(F.col("start").isNotNull(), F.greatest(end, "own_end"))
    return points.groupBy(*JOB, until.alias("until")).agg(F.min(F.struct("since")).alias("first")).select(*JOB, "first.since", "until")


def _islands(points: DataFrame, jobs: DataFrame) -> DataFrame:
    """(user_id, job_id, nth, since, until) of each time that a job is active without a break, and ``next``, where it comes
    back."""
    # A stored job that is active without a link goes with the first of its links that ends.
    linked = points.where("since is null").select(*JOB).distinct()
    bare = jobs.where("status = 'active'").select(*JOB).join(linked, JOB, "left_anti")
    ends = points.groupBy(*JOB).agg(F.min("until").alias("until"))
    kind = points.schema["since"].dataType
    bare = bare.join(ends, JOB, "left").select(*JOB, F.lit(None).cast(kind).alias("since"), "until")
    rows = points.unionByName(bare).withColumn("end", F.struct(F.col("until").isNull().alias("open"), "until"))
    by_start = Window.partitionBy(*JOB).orderBy("since", "end")
    rows = rows.withColumn("so_far", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("so_far").isNull() | (~F.col("so_far.open") & F.coalesce(F.col("since") > F.col("so_far.until"), F.lit(False)))
    rows = rows.withColumn("nth", F.sum(fresh.cast("int")).over(by_start))
    rows = rows.groupBy(*JOB, "nth").agg(F.min(F.struct("since")).alias("first"), F.max("end").alias("last"))
    rows = rows.select(*JOB, "nth", "first.since", "last.until")
    return rows.withColumn("next", F.lead("since").over(Window.partitionBy(*JOB).orderBy("nth")))


def _names(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """(user_id, job_id, company, title, location, since, until): the names of a job from each change of its content on."""
    kind = rows.schema["ord"].dataType
    changes = rows.where("created OR updated").select(
        *JOB, F.col("normalized_company").alias("company"), F.col("normalized_title").alias("title"),
        plain_name(F.col("location")).alias("location"), F.col("ord").alias("since"),
    )
    found = changes.unionByName(stored.select(*JOB, *NAMES, F.lit(None).cast(kind).alias("since")))
    in_turn = Window.partitionBy(*JOB).orderBy("since")
    found = found.withColumn("before", F.lag(F.struct(*NAMES)).over(in_turn))
    found = found.where(~F.col("before").eqNullSafe(F.struct(*NAMES))).drop("before")
    return found.withColumn("until", F.lead("since").over(in_turn))


def _overlaid(names: DataFrame, states: DataFrame) -> DataFrame:
    """Spans of a job by names and status. Either side has no gap from its first start on, so a span begins wherever one of
    them does, and is as long as until the next begins: as many rows as both sides have, not as many as pairs of theirs."""
    kind = names.select(F.struct(*NAMES).alias("names")).schema["names"].dataType
    starts = names.select(*JOB, "since", F.struct(*NAMES).alias("names"), F.lit(None).cast("string").alias("status")).unionByName(
        states.select(*JOB, "since", F.lit(None).cast(kind).alias("names"), "status")
    )
    starts = starts.groupBy(*JOB, "since").agg(F.max("names").alias("names"), F.max("status").alias("status"))
    in_turn = Window.partitionBy(*JOB).orderBy("since")
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = starts.withColumns(
        {
            "until": F.lead("since").over(in_turn),
            "names": F.last("names", ignorenulls=True).over(so_far),
            "status": F.last("status", ignorenulls=True).over(so_far),
        }
    )
    held = held.where("names is not null and status is not null")
    return held.select(*JOB, *[f"names.{n}" for n in NAMES], "status", "since", "until")


def lifespans(
    rows: DataFrame, jobs: DataFrame, stored: DataFrame, links: DataFrame, runs: DataFrame, batch: DataFrame
) -> Lifespans:
    """``rows`` are the batch's matched items, ``jobs`` and ``links`` the stored ones it touches, ``stored`` the same jobs
    with normalised names, ``runs`` all runs of the batch's sources and ``batch`` those that are its own."""
    times = written(_islands(_points(rows, jobs, links, runs, batch), jobs), "islands")
    gone = times.where("until is not null").select(
        *JOB, F.lit("removed").alias("status"), F.col("until").alias("since"), F.col("next").alias("until")
    )
    was_gone = jobs.where("status = 'removed'").select(*JOB).join(times.where("nth = 1"), JOB, "left").select(
        *JOB, F.lit("removed").alias("status"), F.lit(None).cast(rows.schema["ord"].dataType).alias("since"), F.col("since").alias("until")
    )
    states = times.select(*JOB, F.lit("active").alias("status"), "since", "until").unionByName(gone).unionByName(was_gone)
    spans = written(_overlaid(_names(rows, stored), states), "spans")
    moving = spans.where("since is not null or until is not null").select(*JOB).distinct()
    removals = times.where("until is not null").select(*JOB, F.col("until").alias("at"), F.col("until")[rows.schema["ord"].dataType.names[0]].alias("gone_at"))
    return Lifespans(spans.join(moving, JOB, "left_semi"), moving, removals)
