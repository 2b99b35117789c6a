"""Source registry: listing, filters, validation, change batches, daily plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.fixed import CATEGORIES, FREQUENCIES, SOURCE_ADAPTERS
from tidepost.functions.times import day_key, forced_key
from tidepost.functions.values import source_state
from tidepost.operators.state import Registry

SORT_KEYS = ("name", "category", "adapter", "last_success_at", "last_job_count", "status")
EDITABLE = (
    "name", "url", "category", "portfolio_firm", "adapter", "enabled", "priority", "frequency", "notes",
)
DEFAULTS = {
    "category": "user_added", "adapter": "auto", "enabled": True, "priority": 100, "frequency": "daily",
}


def list_sources(sources: DataFrame) -> DataFrame:
    """By priority, then name."""
    return sources.orderBy("priority", "name", "source_id")


def filter_sources(
    sources: DataFrame,
    category: str | None = None,
    adapter: str | None = None,
    status: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """P5: equality on category, adapter and state, and text in name or address."""
    wanted = F.lit(True)
    if category:
        wanted = wanted & (F.col("category") == category)
    if adapter:
        wanted = wanted & (F.col("adapter") == adapter)
    if status:
        wanted = wanted & (source_state(F.col("enabled"), F.col("last_error")) == status)
    needle = (text or "").strip().lower()
    if needle:
        wanted = wanted & (F.lower("name").contains(needle) | F.lower("url").contains(needle))
    return sources.where(wanted)


def sort_sources(sources: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By one of six keys; nulls come last going up and first going down."""
    if key not in SORT_KEYS:
        raise ValueError(f"no sort key {key!r}")
    column = {
        "name": F.lower("name"),
        "status": source_state(F.col("enabled"), F.col("last_error")),
    }.get(key, F.col(key))
    order = column.desc_nulls_first() if descending else column.asc_nulls_last()
    return sources.orderBy(order, "source_id")


def field_problems() -> Column:
    """Names of the fields of a source row that are not valid."""
    c = F.col
    checks = {
        "name": F.length("name").between(1, 250),
        "url": c("url").rlike(r"^(?i:https?)://[^/?#\s]+"),
        "category": c("category").isin(*CATEGORIES),
        "adapter": c("adapter").isin(*SOURCE_ADAPTERS),
        "priority": c("priority").between(1, 1000),
        "frequency": c("frequency").isin(*FREQUENCIES),
    }
    return F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]),
        lambda name: name.isNotNull(),
    )


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with the invalid fields."""
    checked = rows.withColumn("problems", field_problems())
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)


@dataclass(frozen=True)
class SourceChanges:
    """The registry after a batch of source changes, and the outcome of every change."""

    registry: Registry
    outcomes: DataFrame


def apply_source_changes(registry: Registry, changes: DataFrame) -> SourceChanges:
    """Creates, partial updates and deletes of sources.

    ``changes`` holds ``seq, user_id, op, source_id, confirm`` and the editable columns; null
    leaves a field as it is. Deletes come first, then updates, then creates, each in order of
    ``seq``. An address is taken when another remaining source had it at the start, or an
    earlier change of the batch claims it. Deleting a source drops its links and runs, never
    its jobs.
    """
    sources, keys = registry.sources, ["user_id", "source_id"]
    known = sources.select(*keys, F.lit(True).alias("known"))
    deletes = changes.where("op = 'delete'").join(known, keys, "left").select(
        "seq", *keys,
        F.when(F.col("known").isNull(), "not_found")
        .when(~F.coalesce("confirm", F.lit(False)), "confirmation_required")
        .otherwise("deleted")
        .alias("outcome"),
    )
    gone = deletes.where("outcome = 'deleted'").select(*keys).distinct()
    rest = sources.join(gone, keys, "left_anti")
    taken = rest.select("user_id", "url", F.col("source_id").alias("holder"))

    updates = changes.where("op = 'update'").join(
        rest.select(*keys, F.lit(True).alias("known")), keys, "left"
    ).join(taken, ["user_id", "url"], "left")
    claims = updates.where("known AND holder IS NULL AND url IS NOT NULL").groupBy("user_id", "url").agg(
        F.min_by("source_id", "seq").alias("claimer")
    )
    updates = updates.join(claims, ["user_id", "url"], "left")
    conflict = (F.col("holder").isNotNull() & (F.col("holder") != F.col("source_id"))) | (
        F.col("claimer").isNotNull() & (F.col("claimer") != F.col("source_id"))
    )
    updates = updates.withColumn(
        "outcome", F.when(F.col("known").isNull(), "not_found").when(conflict, "duplicate_url").otherwise("updated")
    )
    merged = updates.where("outcome = 'updated'").groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in EDITABLE]
    )
    kept = rest.join(merged, keys, "left").withColumns(
        {c: F.coalesce(f"new_{c}", c) for c in EDITABLE}
    ).select(*sources.columns)

    creates = changes.where("op = 'create'")
    first = creates.groupBy("user_id", "url").agg(F.min("seq").alias("first_seq"))
    creates = (
        creates.join(first, ["user_id", "url"])
        .join(taken, ["user_id", "url"], "left")
        .join(claims, ["user_id", "url"], "left")
    )
    duplicate = F.col("holder").isNotNull() | F.col("claimer").isNotNull() | (F.col("seq") > F.col("first_seq"))
    creates = creates.withColumn("outcome", F.when(duplicate, "duplicate_url").otherwise("created")).withColumn(
        "source_id", new_source_id()
    )
    new = creates.where("outcome = 'created'").withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()}
    ).select(*keys, *EDITABLE)
    after = registry.changed(
        sources=kept.unionByName(new, allowMissingColumns=True),
        links=registry.links.join(gone, keys, "left_anti"),
        runs=registry.runs.join(gone, keys, "left_anti"),
    )
    shown = ["seq", "user_id", "outcome"]
    outcomes = deletes.select(*shown).unionByName(updates.select(*shown)).unionByName(creates.select(*shown))
    return SourceChanges(after, outcomes)


def new_source_id() -> Column:
    return F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "url"), 256)


def daily_plan(sources: DataFrame, users: DataFrame, planned: DataFrame, as_of: Column) -> DataFrame:
    """One collection per enabled source and day of the user; days already planned are left out."""
    due = sources.where("enabled").join(users.select("user_id", "timezone"), "user_id", "left")
    zone = F.coalesce("timezone", F.lit("America/Los_Angeles"))
    due = due.withColumn("idempotency_key", day_key(F.col("source_id"), as_of, zone))
    return _plan(due.join(planned.select("user_id", "idempotency_key"), ["user_id", "idempotency_key"], "left_anti"))


def forced_plan(sources: DataFrame, request_id: str) -> DataFrame:
    """M18 on demand: every enabled source, whatever was planned; the request keeps it repeatable."""
    due = sources.where("enabled")
    return _plan(due.withColumn("idempotency_key", forced_key(F.col("source_id"), F.lit(request_id))))


def _plan(due: DataFrame) -> DataFrame:
    return due.select(
        "user_id", "source_id", F.lit("collect_source").alias("task_type"), "priority", "name",
        "idempotency_key", F.lit(1).alias("payload_version"),
    ).orderBy("priority", "name", "source_id")
