"""Batch upsert of postings: companies, jobs, links, versions and run counters.

A batch is a set of successful runs. Its items are ordered by (run start, run, position);
the result is what handling them one after the other gives, computed with joins and
aggregates. One difference: an item whose ATS id moves a stored job to a new fingerprint
does not free the old fingerprint for later items of the same batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.hashing import SNAPSHOT_FIELDS, content_hash, fingerprint, with_material_hash
from tidepost.functions.text import company_or_source, filled, plain_name
from tidepost.functions.urls import canonical_url
from tidepost.operators.ordered import lagged
from tidepost.operators.state import Registry
from tidepost.operators.tombstones import survivors
from tidepost.session import written
from tidepost.sources.adapters import PLAIN_HTML

ORDER = ["started_at", "run_id", "position"]
ITEM = ["run_id", "position"]
KEYS = ["user_id", "fingerprint", "ats_key", "id_key"]
CONTENT = (
    "title", "normalized_title", "description_text", "description_html", "department", "location",
    "remote_type", "employment_type", "compensation_min", "compensation_max", "currency",
    "application_url", "canonical_url", "ats_type", "external_job_id", "published_at",
    "content_hash", "raw_payload", "normalized_company",
)


def runs_missing_url(postings: DataFrame) -> DataFrame:
    """Per run the items without application URL; one is enough to fail the run."""
    missing = F.count_if(filled(F.col("application_url")).isNull())
    return postings.groupBy("run_id").agg(missing.alias("missing"), (missing > 0).alias("failed"))


def keyed(postings: DataFrame) -> DataFrame:
    """Items with company, canonical URL, fingerprint, snapshot and both hashes."""
    c = F.col
    rows = postings.withColumn("company_name", company_or_source(c("company_name"), c("source_name")))
    rows = rows.withColumn("canonical_url", canonical_url(c("application_url")))
    rows = rows.withColumns(
        {
            "normalized_company": plain_name(c("company_name")),
            "normalized_title": plain_name(c("title")),
            "fingerprint": fingerprint(
                c("company_name"), c("title"), c("location"), c("canonical_url"), c("external_job_id")
            ),
            "ats_key": F.coalesce("ats_type", F.lit("")),
            "id_key": F.coalesce("external_job_id", F.lit("")),
            "snapshot": F.struct(
                *[
                    c("canonical_url").alias("application_url")
                    if name == "application_url"
                    else F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(name)
                    if name == "published_at"
                    else c(name)
                    for name in SNAPSHOT_FIELDS
                ]
            ),
        }
    )
    rows = rows.withColumn("content_hash", content_hash(c("snapshot")))
    # Collected postings bring the text of their HTML along.
    plain = PLAIN_HTML if PLAIN_HTML in postings.columns else None
    return with_material_hash(rows, "snapshot", "material_hash", plain).withColumn("ord", F.struct(*ORDER))


def by_fingerprint(keys: DataFrame, jobs: DataFrame) -> DataFrame:
    """J4 with J9: keys with the stored job of the same fingerprint.

    A tombstone hands over to its survivor; one without survivor is revived itself.
    """
    wanted = keys.select("user_id", "fingerprint").distinct()
    stored = jobs.join(wanted, ["user_id", "fingerprint"], "left_semi").select(
        "user_id", "fingerprint", F.col("job_id").alias("hit"), (F.col("status") == "merged").alias("dead")
    )
    rows = written(keys.join(stored, ["user_id", "fingerprint"], "left"), "hits")
    if rows.where("dead").isEmpty():
        return rows.select(*keys.columns, F.col("hit").alias("target"), F.lit(False).alias("via_merge"))
    moved = survivors(jobs).select("user_id", F.col("job_id").alias("hit"), "survivor_id")
    rows = rows.join(moved, ["user_id", "hit"], "left")
    rows = rows.select(
        *keys.columns,
        F.coalesce("survivor_id", "hit").alias("target"),
        F.col("survivor_id").isNotNull().alias("via_merge"),
    )
    return written(rows, "matches")


def by_ats_id(keys: DataFrame, jobs: DataFrame) -> DataFrame:
    """Keys with the stored job of the same ATS type and id, active ones first.

    Candidates shrink to the ids asked for, and to one job per id, before the join.
    """
    ids = ["user_id", "ats_key", "id_key"]
    best = (
        jobs.where("status <> 'merged' AND ats_type <> '' AND external_job_id <> ''")
        .withColumns({"ats_key": F.col("ats_type"), "id_key": F.col("external_job_id")})
        .join(keys.select(*ids).distinct(), ids, "left_semi")
        .groupBy(*ids)
        .agg(F.min_by("job_id", F.struct(F.col("status") != "active", "job_id")).alias("ats_hit"))
    )
    return keys.join(best, ids, "left")


def joined_postings(keys: DataFrame) -> DataFrame:
    """Adds ``label``: keys that share a fingerprint or an ATS id, directly or through others.

    The smallest ``first_ord`` of a component spreads by turns over ATS ids and
    fingerprints. A round that changes nothing ends it, normally the first or second.
    """
    state = written(keys.withColumn("label", F.col("first_ord")), "labels")
    has_id = (F.col("ats_key") != "") & (F.col("id_key") != "")
    while True:
        over_id = (
            state.where(has_id).groupBy("user_id", "ats_key", "id_key").agg(F.min("label").alias("id_label"))
        )
        step = state.join(over_id, ["user_id", "ats_key", "id_key"], "left").withColumn(
            "near", F.coalesce(F.least("label", "id_label"), F.col("label"))
        )
        over_print = step.groupBy("user_id", "fingerprint").agg(F.min("near").alias("print_label"))
        step = step.join(over_print, ["user_id", "fingerprint"]).withColumn(
            "new_label", F.least("near", "print_label")
        )
        step = written(
            step.withColumn("moved", F.col("new_label") < F.col("label")).select(
                *keys.columns, F.col("new_label").alias("label"), "moved"
            ),
            "labels",
        )
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            return state


def matched_keys(items: DataFrame, registry: Registry) -> DataFrame:
    """Distinct keys of a batch with their number of items, the job each belongs to and whether that job is new."""
    jobs = registry.jobs
    keys = items.groupBy(*KEYS).agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n_items"))
    keys = by_fingerprint(keys, jobs)
    exact = keys.where("target IS NOT NULL").select(
        *KEYS, "n_items", F.col("target").alias("job_id"), "via_merge", F.lit(False).alias("is_new")
    )
    open_keys = by_ats_id(keys.where("target IS NULL").drop("target", "via_merge"), jobs)
    labelled = joined_postings(open_keys)
    heads = labelled.groupBy("user_id", "label").agg(
        F.min_by("fingerprint", "first_ord").alias("head"),
        F.min_by("ats_hit", F.when(F.col("ats_hit").isNotNull(), F.col("first_ord"))).alias("ats_hit"),
        F.min("first_ord").alias("first_ord"),
    )
    # A merged job may still hold the id that its first fingerprint gave it: then the item that
    # creates the new job (its run and place) is part of the id.
    heads = heads.withColumn("plain_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "head"), 256))
    taken = registry.near("jobs", heads.select(F.col("plain_id").alias("job_id")))
    taken = taken.select(F.col("job_id").alias("plain_id"), F.lit(True).alias("taken"))
    heads = heads.join(taken, "plain_id", "left")
    creation = F.to_json(F.struct("first_ord"))
    new_id = F.when(F.col("taken"), F.sha2(F.concat_ws("|", "plain_id", creation), 256)).otherwise(F.col("plain_id"))
    heads = heads.select(
        "user_id",
        "label",
        F.coalesce("ats_hit", new_id).alias("job_id"),
        F.col("ats_hit").isNull().alias("is_new"),
    )
    rest = labelled.drop("ats_hit").join(heads, ["user_id", "label"])
    return exact.unionByName(
        rest.select(*KEYS, "n_items", "job_id", F.lit(False).alias("via_merge"), "is_new")
    )


def sequenced(items: DataFrame, registry: Registry) -> DataFrame:
    """Items with job, and against the job's content right before: created, updated, material.

    An item older than the last sighting of its job is late: it leaves the content as it is.
    Only keys, hashes and times take part; texts and payloads stay where they were written.
    """
    matches = written(matched_keys(items, registry), "matched-keys")
    slim = items.select(
        *KEYS, *ORDER, "ord", "source_id", "seen_at", "content_hash", "material_hash",
        "company_name", "normalized_company", "normalized_title", "location",
        F.coalesce(filled(F.col("source_job_url")), F.col("application_url")).alias("link_url"),
    )
    rows = slim.join(matches.drop("n_items"), KEYS)
    # Jobs and versions shrink to those of the batch first; Spark may broadcast the ids if they are few.
    ids = matches.select("job_id").distinct()
    stored = registry.near("jobs", ids).select(
        "job_id", F.col("content_hash").alias("stored_content"), F.col("last_seen_at").alias("stored_seen")
    ).join(
        registry.near("versions", ids).select(
            "job_id",
            F.col("content_hash").alias("stored_content"),
            F.col("material_hash").alias("stored_material"),
        ),
        ["job_id", "stored_content"],
        "left",
    )
    rows = rows.join(stored, "job_id", "left").withColumn(
        "late", F.coalesce(F.col("seen_at") < F.col("stored_seen"), F.lit(False))
    )
    rows = lagged(
        rows,
        ["job_id", "late"],
        ORDER,
        {"previous_content": "content_hash", "previous_material": "material_hash"},
        counted=matches.groupBy("job_id").agg(F.sum("n_items").alias("rows")),
    )
    first = F.col("previous_content").isNull()
    before = F.coalesce("previous_content", "stored_content")
    material_before = F.when(first, F.col("stored_material")).otherwise(F.col("previous_material"))
    rows = rows.withColumns({"is_first": first, "before": before, "material_before": material_before})
    return rows.withColumns(
        {
            "created": F.col("is_new") & F.col("is_first"),
            "updated": F.col("before").isNotNull() & (F.col("before") != F.col("content_hash")) & ~F.col("late"),
        }
    ).withColumn(
        "is_material",
        F.col("updated") & ~F.col("material_before").eqNullSafe(F.col("material_hash")),
    )


def new_companies(companies: DataFrame, items: DataFrame) -> DataFrame:
    """M1: the companies a batch brings; the first spelling stays."""
    keys = ["user_id", "normalized_name"]
    seen = items.groupBy("user_id", F.col("normalized_company").alias("normalized_name")).agg(
        F.min_by("company_name", "ord").alias("company_name")
    )
    new = seen.join(companies.select(*keys).join(seen.select(*keys), keys, "left_semi"), keys, "left_anti")
    new_id = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "normalized_name"), 256)
    return new.select("user_id", new_id.alias("company_id"), "company_name", "normalized_name")


def _touched(rows: DataFrame) -> DataFrame:
    """One row per job of a batch: times, last content that differed, last own fingerprint."""
    changes = F.col("created") | F.col("updated")
    return rows.groupBy("user_id", "job_id").agg(
        F.max_by(F.struct(*ITEM), F.when(changes, F.col("ord"))).alias("pick"),
        F.max_by("fingerprint", F.when(changes & ~F.col("via_merge"), F.col("ord"))).alias("new_print"),
        F.min("seen_at").alias("first_time"),
        F.max_by("seen_at", "ord").alias("last_time"),
        F.min("ord").alias("first_ord"),
        F.max("is_new").alias("is_new"),
    )


def _with_content(touched: DataFrame, texts: DataFrame, companies: DataFrame) -> DataFrame:
    """Touched jobs with the content of the item that decides it, and its company."""
    ids = companies.select(
        "user_id", F.col("normalized_name").alias("normalized_company"), F.col("company_id").alias("new_company")
    )
    content = texts.join(ids, ["user_id", "normalized_company"], "left").select(
        F.struct(*ITEM).alias("pick"), F.struct(*CONTENT).alias("content"), "new_company"
    )
    return touched.join(content, "pick", "left").drop("pick")


def job_upsert(jobs: DataFrame, touched: DataFrame) -> DataFrame:
    """M2: stored jobs with the batch's content, and the new jobs."""
    content = [c for c in CONTENT if c != "normalized_company"]
    kept = [c for c in jobs.columns if c not in content]
    new = touched.where("is_new").select(
        "user_id", "job_id", F.col("new_company").alias("company_id"),
        *[F.col(f"content.{c}").alias(c) for c in content],
        F.col("new_print").alias("fingerprint"),
        F.col("first_time").alias("first_seen_at"), F.col("last_time").alias("last_seen_at"),
        F.lit("active").alias("status"),
    )
    hits = touched.where("NOT is_new").drop("is_new", "first_ord")
    rows = jobs.join(hits, ["user_id", "job_id"], "left")
    hit = F.col("last_time").isNotNull()
    over = {
        "company_id": F.coalesce("new_company", "company_id"),
        "fingerprint": F.coalesce("new_print", "fingerprint"),
        "first_seen_at": F.least("first_time", "first_seen_at"),
        "last_seen_at": F.greatest("last_time", "last_seen_at"),
        "status": F.when(hit, "active").otherwise(F.col("status")),
        "removed_at": F.when(~hit, F.col("removed_at")),
        "merged_into_job_id": F.when(~hit, F.col("merged_into_job_id")),
    }
    updated = rows.select(
        *[over.get(c, F.col(c)).alias(c) for c in kept],
        *[
            F.when(F.col("content").isNotNull(), F.col(f"content.{c}")).otherwise(F.col(c)).alias(c)
            for c in content
        ],
    )
    return updated.unionByName(new, allowMissingColumns=True).select(*jobs.columns)


def link_sightings(rows: DataFrame) -> DataFrame:
    """First and last sighting of every (job, source) with the latest address."""
    return rows.groupBy("user_id", "job_id", "source_id").agg(
        F.min("seen_at").alias("first_time"),
        F.max("seen_at").alias("last_time"),
        F.max_by("link_url", "ord").alias("url"),
    )


def link_upsert(links: DataFrame, sightings: DataFrame) -> DataFrame:
    """M4: a sighted link is active and carries the latest time and address."""
    rows = links.join(sightings, ["user_id", "job_id", "source_id"], "full_outer")
    hit = F.col("last_time").isNotNull()
    return rows.select(
        "user_id", "job_id", "source_id",
        F.coalesce("origin_job_id", "job_id").alias("origin_job_id"),
        F.when(F.col("last_time") < F.col("last_seen_at"), F.col("source_job_url"))
        .otherwise(F.coalesce("url", "source_job_url")).alias("source_job_url"),
        F.least("first_seen_at", "first_time").alias("first_seen_at"),
        F.greatest("last_time", "last_seen_at").alias("last_seen_at"),
        F.when(hit, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(~hit, F.col("removed_at")).alias("removed_at"),
    )


def new_versions(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """M3: first items of the (job, content) pairs that ``stored``, the versions of the batch's jobs, does not hold yet."""
    first = rows.where("is_first OR updated OR late").groupBy("user_id", "job_id", "content_hash").agg(
        F.min_by(F.struct("material_hash", "seen_at", "is_material", *ITEM), "ord").alias("v")
    )
    fresh = first.join(stored.select("job_id", "content_hash"), ["job_id", "content_hash"], "left_anti")
    return fresh.select("user_id", "job_id", "content_hash", "v.*")


def version_rows(new: DataFrame, texts: DataFrame) -> DataFrame:
    """M3: new versions with their snapshots."""
    rows = new.join(texts.select(*ITEM, "snapshot"), ITEM)
    return rows.select(
        "user_id", "job_id", "content_hash", F.col("job_id").alias("origin_job_id"),
        "material_hash", "seen_at", "snapshot", "is_material",
    )


def run_counters(rows: DataFrame) -> DataFrame:
    """Found, created and updated per run."""
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs_found"),
        F.count_if("created").alias("jobs_created"),
        F.count_if("updated").alias("jobs_updated"),
    )


@dataclass(frozen=True)
class Upserts:
    """What a batch makes of the jobs and links it was given, the companies and versions it adds, its counters, and its
    new jobs in order."""

    jobs: DataFrame
    links: DataFrame
    companies: DataFrame
    versions: DataFrame
    counters: DataFrame
    new_jobs: DataFrame


def matched(registry: Registry, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of successful runs with all they carry, and, without texts, with their jobs in order."""
    if "seen_at" not in postings.columns:
        postings = postings.withColumn("seen_at", F.col("started_at"))
    items = written(keyed(postings), "items")
    return items, written(sequenced(items, registry), "sequence")


def upserts(registry: Registry, jobs: DataFrame, links: DataFrame, items: DataFrame, rows: DataFrame) -> Upserts:
    """Matched items against ``jobs`` and ``links``, which hold at least what the batch touches."""
    added = written(new_companies(registry.companies, rows), "companies")
    names = rows.select("user_id", F.col("normalized_company").alias("normalized_name")).distinct()
    companies = registry.companies.join(names, ["user_id", "normalized_name"], "left_semi").unionByName(added)
    touched = written(_touched(rows), "touched")
    stored = registry.near("versions", rows.select("job_id").distinct())
    versions = written(new_versions(stored, rows), "versions")
    # Texts and payloads are fetched for the items that end up in a table, each once.
    needed = touched.where("pick IS NOT NULL").select("pick.*").union(versions.select(*ITEM)).distinct()
    texts = written(items.join(needed, ITEM, "left_semi"), "texts")
    # What a new job first looked like decides what it resembles.
    new_jobs = rows.where("created").select(
        "user_id", "job_id", F.col("normalized_company").alias("company"),
        F.col("normalized_title").alias("title"), plain_name(F.col("location")).alias("location"),
        "ord", "seen_at",
    )
    return Upserts(
        jobs=job_upsert(jobs, _with_content(touched, texts, companies)),
        links=link_upsert(links, link_sightings(rows)),
        companies=added,
        versions=version_rows(versions, texts),
        counters=run_counters(rows),
        new_jobs=new_jobs,
    )


@dataclass(frozen=True)
class Upserted:
    """The registry after a batch, the batch's counters and its new jobs in order."""

    registry: Registry
    counters: DataFrame
    new_jobs: DataFrame


def apply_postings(registry: Registry, postings: DataFrame) -> Upserted:
    """Postings of successful runs into the whole registry."""
    made = upserts(registry, registry.jobs, registry.links, *matched(registry, postings))
    after = registry.changed(
        jobs=made.jobs, links=made.links, companies=registry.companies.unionByName(made.companies),
        versions=registry.versions.unionByName(made.versions),
    )
    return Upserted(after, made.counters, made.new_jobs)
