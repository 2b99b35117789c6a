"""Version history: which sightings change a job, and which changes matter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.operators.ordered import lagged

HASHES = ("content_hash", "material_hash")


def with_previous(sightings: DataFrame, order: list[str], fields: Sequence[str] = HASHES) -> DataFrame:
    """Sightings of jobs with ``previous_`` fields of the sighting before, and ``follows``, null for the first of a job."""
    before = {f"previous_{field}": field for field in fields}
    return lagged(sightings, ["job_id"], order, {"follows": F.lit(True), **before})


def _differs(fields: Sequence[str]) -> Column:
    return reduce(or_, [~F.col(f"previous_{field}").eqNullSafe(F.col(field)) for field in fields])


def version_history(
    sightings: DataFrame, order: list[str], content: Sequence[str] = HASHES, material: Sequence[str] = HASHES[1:]
) -> DataFrame:
    """One version per job and content, at its first sighting.

    A version is material when its material fields differ from the sighting right before,
    whatever older versions said; the first version of a job never is. A return to an old
    content adds no version. ``content`` names the columns that tell contents apart, ``material`` those of them that matter:
    hashes, or the fields themselves where they are shorter, to be hashed in the versions alone.
    """
    needed = dict.fromkeys(["job_id", *content, "seen_at", *order])
    rows = with_previous(sightings.select(*needed), order, content)
    rows = rows.where(F.col("follows").isNull() | _differs(content))
    is_material = (F.col("follows").isNotNull() & _differs(material)).alias("is_material")
    rows = rows.select("job_id", *content, *dict.fromkeys(["seen_at", *order]), is_material)
    first = F.min_by(F.struct("seen_at", "is_material"), F.struct(*order)).alias("first")
    return rows.groupBy("job_id", *content).agg(first).select("job_id", *content, "first.seen_at", "first.is_material")


def previous_version(jobs: DataFrame, versions: DataFrame, content: Sequence[str] = HASHES[:1]) -> DataFrame:
    """Jobs with the stored version of their current content, if there is one.

    ``content`` names the columns that tell contents apart, as in ``version_history``; without a value equals without one.
    """
    mine, theirs = jobs.alias("j"), versions.alias("v")
    same = reduce(and_, [F.col(f"j.{c}").eqNullSafe(F.col(f"v.{c}")) for c in content], F.col("j.job_id") == F.col("v.job_id"))
    return mine.join(theirs, same, "left").select("j.*", F.col("v.seen_at").alias("version_seen_at"), "v.is_material")
