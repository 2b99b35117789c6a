"""Stable hashes over sorted, null-keeping JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import filled, plain_name, squeeze, with_plain_text
from tidepost.functions.urls import canonical_url

SNAPSHOT_FIELDS = (
    "application_url",
    "ats_type",
    "company_name",
    "compensation_max",
    "compensation_min",
    "currency",
    "department",
    "description_html",
    "description_text",
    "employment_type",
    "external_job_id",
    "location",
    "published_at",
    "remote_type",
    "title",
)
MATERIAL_FIELDS = (
    "application_url",
    "compensation_max",
    "compensation_min",
    "currency",
    "department",
    "employment_type",
    "location",
    "remote_type",
    "title",
)


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the compact JSON object with sorted keys; nulls are kept."""
    entries = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*entries), {"ignoreNullFields": "false"}), 256)


def fingerprint(
    company: Column, title: Column, location: Column, url: Column, external_id: Column
) -> Column:
    """identity of a posting under cosmetic spelling changes."""
    return stable_hash(
        company=plain_name(company),
        title=plain_name(title),
        location=plain_name(location),
        url=canonical_url(url),
        external_id=F.coalesce(external_id, F.lit("")),
    )


def content_hash(snapshot: Column) -> Column:
    """F8: identity of the whole snapshot."""
    return stable_hash(**{name: snapshot[name] for name in SNAPSHOT_FIELDS})


def with_material_hash(df: DataFrame, snapshot: str, target: str, plain: str | None = None) -> DataFrame:
    """adds the identity of the fields a reader cares about; markup is ignored.

    ``plain`` names a column that has the text of the snapshot's HTML already.
    """
    c = F.col
    rows = df.withColumn("_source", c(f"{snapshot}.description_html"))
    rows = rows.withColumn("_text", c(plain)) if plain else with_plain_text(rows, "_source", "_text")
    description = F.when(filled(c("_source")).isNotNull(), c("_text")).otherwise(
        squeeze(c(f"{snapshot}.description_text"))
    )
    fields = {name: c(f"{snapshot}.{name}") for name in MATERIAL_FIELDS}
    rows = rows.withColumn(target, stable_hash(description=description, **fields))
    return rows.drop("_source", "_text")
