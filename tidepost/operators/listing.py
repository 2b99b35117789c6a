"""Job listing, lookups, lineage and detail."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.fixed import HIDDEN_DECISIONS, JOBS_LISTED
from tidepost.functions.text import contains_pattern
from tidepost.functions.times import date_bound
from tidepost.operators.ordered import numbered

LIST_COLUMNS = (
    "job_id", "company_name", "title", "location", "application_url", "ats_type", "published_at",
    "first_seen_at", "last_seen_at", "status", "reposted_from_job_id", "user_decision",
)


@dataclass(frozen=True)
class JobFilter:
    """Arguments of a listing; unset ones do not filter."""

    user_id: int | str | None = None
    company: str | None = None
    title: str | None = None
    location: str | None = None
    ats_type: str | None = None
    status: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    source_id: int | str | None = None
    decision: tuple[str, ...] = ()


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Jobs with the name of their company; a job without company row is not listed."""
    return jobs.join(companies.select("company_id", "company_name"), "company_id")


def in_source(jobs: DataFrame, links: DataFrame, source_id) -> DataFrame:
    """Jobs that a source links to, active or not."""
    return jobs.join(links.where(F.col("source_id") == source_id).select("job_id"), "job_id", "left_semi")


def not_merged() -> Column:
    return F.col("status") != "merged"


def text_filters(wanted: JobFilter) -> Column:
    """P1."""
    out = F.lit(True)
    for column, needle in (
        ("company_name", wanted.company), ("title", wanted.title), ("location", wanted.location),
    ):
        if needle:
            out = out & contains_pattern(F.col(column), needle)
    return out


def equality_filters(wanted: JobFilter) -> Column:
    """Merged jobs never show, whatever status is asked."""
    out = not_merged()
    for column in ("ats_type", "status"):
        if getattr(wanted, column):
            out = out & (F.col(column) == getattr(wanted, column))
    return out


def time_filters(wanted: JobFilter) -> Column:
    """Both ends belong to the range."""
    out = F.lit(True)
    low, high = date_bound(wanted.date_from, False), date_bound(wanted.date_to, True)
    if low:
        out = out & (F.col("first_seen_at") >= _literal(low))
    if high:
        out = out & (F.col("first_seen_at") <= _literal(high))
    return out


def _literal(bound) -> Column:
    return F.lit(bound.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def decision_filter(wanted: JobFilter) -> Column:
    """Asked decisions only, or everything but the hidden ones."""
    if wanted.decision:
        return F.col("user_decision").isin(*wanted.decision)
    return F.col("user_decision").isNull() | ~F.col("user_decision").isin(*HIDDEN_DECISIONS)


def matching_jobs(
    jobs: DataFrame, companies: DataFrame, links: DataFrame | None, wanted: JobFilter
) -> DataFrame:
    """All jobs a listing would page through."""
    if wanted.user_id is not None:
        jobs = jobs.where(F.col("user_id") == wanted.user_id)
    jobs = jobs.where(equality_filters(wanted) & time_filters(wanted) & decision_filter(wanted))
    if wanted.source_id is not None:
        jobs = in_source(jobs, links, wanted.source_id)
    return with_company(jobs, companies).where(text_filters(wanted))


def listed(jobs: DataFrame) -> DataFrame:
    """the columns of a list row."""
    return jobs.select(
        *[F.col(c) if c in jobs.columns else F.lit(None).cast("timestamp").alias(c) for c in LIST_COLUMNS]
    )


def list_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    links: DataFrame | None = None,
    wanted: JobFilter = JobFilter(),
    limit: int = JOBS_LISTED,
    offset: int = 0,
) -> DataFrame:
    """Newest first, equal times by job id."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be 1 or more and offset not negative")
    found = listed(matching_jobs(jobs, companies, links, wanted))
    return found.orderBy(F.desc("first_seen_at"), "job_id").offset(offset).limit(limit)


def owned(table: DataFrame, key: str, value, user_id) -> DataFrame:
    """One row by id, empty when it belongs to somebody else."""
    return table.where((F.col(key) == value) & (F.col("user_id") == user_id))


def of_user(table: DataFrame, user_id) -> DataFrame:
    """The rows of one user; the predicate reaches the scan."""
    return table.where(F.col("user_id") == user_id)


def lineage(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Every link of a job with the name and category of its source."""
    return links.join(
        sources.select(
            "source_id", F.col("name").alias("source_name"), F.col("category").alias("source_category")
        ),
        "source_id",
    )


def job_detail(
    jobs: DataFrame,
    companies: DataFrame,
    links: DataFrame,
    sources: DataFrame,
    versions: DataFrame,
) -> DataFrame:
    """The details of jobs, one row per entry: ``job_id, kind, n`` and the entry's columns.

    Kind ``job`` (n = 0) carries the header, ``source`` the links (oldest first), ``version``
    the versions (newest first). The shape is the same for every number of entries.
    """
    known = jobs.select("job_id")
    links, versions = (rows.join(known, "job_id", "left_semi") for rows in (links, versions))
    header = with_company(jobs, companies).withColumns({"kind": F.lit("job"), "n": F.lit(0).cast("bigint")})
    seen = lineage(links, sources).select(
        "job_id", "source_id", "source_name", "source_category", "is_active", "first_seen_at", "last_seen_at"
    )
    seen = numbered(seen, ["job_id"], ["first_seen_at", "source_id"], "n").withColumn("kind", F.lit("source"))
    newest = versions.select(
        "job_id", "seen_at", "is_material", "content_hash",
        (-F.unix_micros(F.col("seen_at").cast("timestamp"))).alias("age"),
    )
    newest = numbered(newest, ["job_id"], ["age", "content_hash"], "n").withColumn("kind", F.lit("version"))
    return (
        header.select("job_id", "kind", "n", "title", "company_name", "status")
        .unionByName(seen, allowMissingColumns=True)
        .unionByName(newest.drop("age"), allowMissingColumns=True)
    )


def recent_jobs(jobs: DataFrame, companies: DataFrame, count: int = 6) -> DataFrame:
    """The newest jobs of the start page."""
    return list_jobs(jobs, companies, limit=count)


def failing_sources(sources: DataFrame, count: int = 5) -> DataFrame:
    """The first failing sources in list order."""
    failing = sources.where(F.coalesce("last_error", F.lit("")) != "")
    return failing.orderBy("priority", "name", "source_id").limit(count)
