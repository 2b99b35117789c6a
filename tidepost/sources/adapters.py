"""Payload adapters: landed body -> array of items -> one posting struct per item.

An adapter is two column functions, so all adapters share one scan of the landed table
and Catalyst sees every field access.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.fixed import PAGE_SIZE
from tidepost.functions.text import filled, with_plain_text
from tidepost.functions.times import epoch_time, iso_time
from tidepost.functions.urls import board_token
from tidepost.functions.values import variant_type, whole_amount
from tidepost.session import written
from tidepost.sources.landed import (
    fetch_error_message,
    fetch_error_type,
    routed_adapter,
    unsupported,
)
from tidepost.sources.page_postings import first_text, page_postings, place, scalar_text

TEXT_FIELDS = (
    "company_name",
    "title",
    "application_url",
    "source_job_url",
    "description_text",
    "description_html",
    "department",
    "location",
    "remote_type",
    "employment_type",
    "currency",
    "ats_type",
    "external_job_id",
)
POSTING_FIELDS = TEXT_FIELDS + ("compensation_min", "compensation_max", "published_at", "raw_payload")
#: The visible text of ``description_html``, found once for all that need it.
PLAIN_HTML = "description_plain"
LINEAGE = ("user_id", "source_id", "source_name", "run_id", "started_at", "position")


@dataclass(frozen=True)
class Adapter:
    """How one payload format becomes postings.

    ``items`` maps a body to its array of items (null: the shape is wrong), ``posting``
    an item to its fields, ``texts`` names the item paths that must hold text.
    """

    items: Callable[[Column], Column]
    posting: Callable[[Column, Column, Column], dict[str, Column]]
    texts: tuple[str, ...] = ()
    needs_items: bool = False
    asks_token: bool = True


def _at(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


def _first(*texts: Column) -> Column:
    return F.coalesce(*[filled(t) for t in texts])


def payload_time(value: Column) -> Column:
    """number or text of a payload as a time."""
    number = F.try_variant_get(value, "$", "double")
    is_number = variant_type(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_number, epoch_time(number)).otherwise(
        iso_time(F.try_variant_get(value, "$", "string"))
    )


def _jobs_list(body: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(body), "$.jobs", "array<variant>")


def _bare_list(body: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")


def _ashby(item: Column, source_name: Column, page_url: Column) -> dict[str, Column]:
    """A1."""
    parts = _at(item, "compensation.summaryComponents", "array<variant>")
    salary = F.get(F.filter(parts, lambda p: _at(p, "compensationType") == "Salary"), F.lit(0))
    return {
        "company_name": source_name,
        "title": F.coalesce(_first(_at(item, "title")), F.lit("Untitled role")),
        "application_url": _first(_at(item, "applyUrl"), _at(item, "jobUrl")),
        "source_job_url": _at(item, "jobUrl"),
        "description_text": _at(item, "descriptionPlain"),
        "description_html": _at(item, "descriptionHtml"),
        "department": _first(_at(item, "department"), _at(item, "team")),
        "location": _at(item, "location"),
        "remote_type": F.coalesce(
            _first(_at(item, "workplaceType")),
            F.when(_at(item, "isRemote", "boolean"), "Remote"),
        ),
        "employment_type": _at(item, "employmentType"),
        "compensation_min": whole_amount(_at(salary, "minValue", "variant")),
        "compensation_max": whole_amount(_at(salary, "maxValue", "variant")),
        "currency": _at(salary, "currencyCode"),
        "external_job_id": _first(_at(item, "id"), _at(item, "jobUrl")),
        "published_at": _at(item, "publishedAt", "variant"),
    }


def _greenhouse(item: Column, source_name: Column, page_url: Column) -> dict[str, Column]:
    """A2."""
    return {
        "company_name": F.coalesce(_first(_at(item, "company_name")), source_name),
        "title": F.coalesce(_first(_at(item, "title")), F.lit("Untitled role")),
        "application_url": _first(_at(item, "absolute_url")),
        "source_job_url": _at(item, "absolute_url"),
        "description_html": _at(item, "content"),
        "department": _at(item, "departments[0].name"),
        "location": _at(item, "location.name"),
        "external_job_id": _at(item, "id"),
        "published_at": _at(item, "first_published", "variant"),
    }


def _pay(value: Column) -> Column:
    kind = variant_type(value)
    number = F.coalesce(
        F.try_variant_get(value, "$", "boolean").cast("int").cast("double"),
        F.try_variant_get(value, "$", "double"),
    )
    number = F.when(kind == "BOOLEAN", number).otherwise(F.try_variant_get(value, "$", "double"))
    return F.when(number == F.floor(number), number.try_cast("int"))


def _lever(item: Column, source_name: Column, page_url: Column) -> dict[str, Column]:
    """A3. Both the remote and the employment type come from ``commitment``."""
    low, high = _at(item, "salaryRange.min", "variant"), _at(item, "salaryRange.max", "variant")

    def wrong(pay: Column, raw: Column) -> Column:
        return pay.isNull() & raw.isNotNull() & (variant_type(raw) != "VOID")

    return {
        "company_name": source_name,
        "title": F.coalesce(_first(_at(item, "text")), F.lit("Untitled role")),
        "application_url": _first(_at(item, "applyUrl"), _at(item, "hostedUrl")),
        "source_job_url": _at(item, "hostedUrl"),
        "description_html": _first(_at(item, "description"), _at(item, "descriptionBody")),
        "department": _first(_at(item, "categories.department"), _at(item, "categories.team")),
        "location": _at(item, "categories.location"),
        "remote_type": _at(item, "categories.commitment"),
        "employment_type": _at(item, "categories.commitment"),
        "compensation_min": _pay(low),
        "compensation_max": _pay(high),
        "currency": _at(item, "salaryRange.currency"),
        "external_job_id": _at(item, "id"),
        "published_at": _at(item, "createdAt", "variant"),
        "invalid": wrong(_pay(low), low) | wrong(_pay(high), high),
    }


def _jsonld(item: Column, source_name: Column, page_url: Column) -> dict[str, Column]:
    """A5, with A7 for the place and A8 for the employment type."""
    url = F.coalesce(_first(_at(item, "url")), page_url)
    identifier = filled(scalar_text(_at(item, "identifier", "variant")))
    return {
        "company_name": F.coalesce(_first(_at(item, "hiringOrganization.name")), source_name),
        "title": F.coalesce(_first(_at(item, "title")), F.lit("Untitled role")),
        "application_url": url,
        "source_job_url": url,
        "description_html": _at(item, "description"),
        "location": place(_at(item, "jobLocation", "variant")),
        "remote_type": _at(item, "jobLocationType"),
        "employment_type": first_text(_at(item, "employmentType", "variant")),
        "external_job_id": F.coalesce(identifier, _first(_at(item, "url")), F.lit("")),
        "published_at": _at(item, "datePosted", "variant"),
    }


REGISTRY: dict[str, Adapter] = {
    "ashby": Adapter(
        _jobs_list,
        _ashby,
        (
            "title", "applyUrl", "jobUrl", "descriptionPlain", "descriptionHtml", "department",
            "team", "location", "workplaceType", "employmentType", "id",
        ),
    ),
    "greenhouse": Adapter(
        _jobs_list, _greenhouse, ("title", "company_name", "absolute_url", "content")
    ),
    "lever": Adapter(
        _bare_list,
        _lever,
        ("text", "applyUrl", "hostedUrl", "description", "id", "salaryRange.currency"),
    ),
    "jsonld": Adapter(
        page_postings,
        _jsonld,
        ("title", "description", "url", "jobLocationType"),
        needs_items=True,
        asks_token=False,
    ),
}


def _chosen(adapters: dict[str, Adapter], branch: Callable[[str, Adapter], Column]) -> Column:
    out = F.lit(None)
    for name, adapter in adapters.items():
        out = F.when(F.col("adapter") == name, branch(name, adapter)).otherwise(out)
    return out


def _some_no_text(item: Column, paths: tuple[str, ...]) -> Column:
    values = F.filter(F.array(*[_at(item, path, "variant") for path in paths]), lambda v: v.isNotNull())
    return F.exists(values, lambda v: ~variant_type(v).isin("STRING", "VOID"))


def _posting_struct(adapter: Adapter, name: str) -> Column:
    item, types = F.col("item"), {"compensation_min": "int", "compensation_max": "int"}
    fields = adapter.posting(item, F.col("source_name"), F.col("source_url"))
    fields.setdefault("ats_type", F.lit(name))
    wrong = fields.pop("invalid", F.lit(False))
    if adapter.texts:
        wrong = wrong | _some_no_text(item, adapter.texts)
    types["published_at"] = "variant"
    columns = [
        fields.get(f, F.lit(None)).cast(types.get(f, "string")).alias(f)
        for f in POSTING_FIELDS
        if f != "raw_payload"
    ]
    return F.struct(*columns, F.coalesce(wrong, F.lit(False)).alias("invalid"))


#: Boards that answer in pages.
PAGED = ("lever",)


@dataclass(frozen=True)
class Collected:
    """What landed responses hold: postings, counted rejects, runs that failed, and pages of paged boards."""

    postings: DataFrame
    rejects: DataFrame
    failures: DataFrame
    pages: DataFrame


def parsed(landed: DataFrame, adapters: dict[str, Adapter], max_bytes: int | None) -> DataFrame:
    """Landed rows with adapter, items, and the reason a response cannot be used."""
    out = landed.withColumn("adapter", routed_adapter(F.col("source_url"), F.col("adapter")))
    bytes_ = F.octet_length(F.col("body"))
    fetch_type = fetch_error_type(F.col("http_status"), bytes_, max_bytes)
    out = out.withColumn(
        "items",
        _chosen(adapters, lambda name, a: a.items(F.when(F.col("adapter") == name, F.col("body")))),
    )
    token_needed = F.col("adapter").isin(*[n for n, a in adapters.items() if a.asks_token])
    no_token = token_needed & board_token(F.col("source_url"), F.col("adapter")).isNull() & F.col(
        "adapter"
    ).isin("ashby", "greenhouse", "lever")
    none_found = F.col("adapter").isin(*[n for n, a in adapters.items() if a.needs_items]) & (
        F.size("items") == 0
    )
    message = F.coalesce(
        unsupported(F.col("adapter"), tuple(adapters)),
        F.when(no_token, F.concat(F.lit("Unable to determine board of "), F.col("source_url"))),
        fetch_error_message(F.col("source_url"), F.col("http_status"), bytes_, max_bytes),
        F.when(none_found, "No JSON-LD JobPosting records found"),
        F.when(
            F.col("items").isNull(),
            F.concat(F.lit("Unexpected "), F.col("adapter"), F.lit(" response shape")),
        ),
    )
    kind = F.when(
        unsupported(F.col("adapter"), tuple(adapters)).isNotNull(), "UnsupportedSourceError"
    ).otherwise(F.coalesce(fetch_type, F.lit("CollectorError")))
    return out.withColumn("error_message", message).withColumn(
        "error_type", F.when(F.col("error_message").isNotNull(), kind)
    )


#: What a response says as a whole; ``page`` is its place in its run, null where it has none.
RESPONSE = ("user_id", "source_id", "run_id", "started_at", "adapter", "page", "page_items", "error_type", "error_message")


def unfolded(parsed_rows: DataFrame, adapters: dict[str, Adapter]) -> DataFrame:
    """One row per item with its posting fields, and one with null ``item`` for a response without."""
    items = parsed_rows.select(
        "user_id", "source_id", "source_name", "source_url", "adapter", "run_id", "started_at",
        F.coalesce("skip", F.lit(0)).alias("skip"),
        F.col("skip").alias("page"),
        F.size("items").alias("page_items"),
        "error_type",
        "error_message",
        F.posexplode_outer(F.when(F.col("error_message").isNull(), F.col("items"))).alias("ix", "item"),
    )
    posting = _chosen(adapters, lambda name, a: _posting_struct(a, name))
    return items.select(
        *dict.fromkeys([*RESPONSE, *[c for c in LINEAGE if c != "position"]]),
        (F.col("skip").cast("bigint") + F.col("ix")).alias("position"),
        "skip",
        "ix",
        "item",
        F.inline_outer(F.array(posting)),
    )


def exploded(rows: DataFrame) -> DataFrame:
    """The unfolded rows that are items, with their reject reason.

    Both unfoldings are outer and filtered afterwards: a plain one would let the optimizer
    copy the parsing into an inferred filter and run it twice.
    """
    items = rows.where("item IS NOT NULL")
    reason = (
        F.when(~variant_type(F.col("item")).startswith("OBJECT"), "not an object")
        .when(filled(F.col("application_url")).isNull(), "no application URL")
        .when(F.col("invalid"), "wrong field type")
    )
    return items.withColumn("reject_reason", reason)


def collect(
    landed: DataFrame,
    adapters: dict[str, Adapter] | None = None,
    keep_payload: bool = True,
    max_bytes: int | None = None,
    once: bool = False,
) -> Collected:
    """Landed responses to postings, rejects and failed runs.

    With ``once`` the items are written as they are parsed, for callers that need more than one of the results.
    """
    adapters = adapters or REGISTRY
    rows = parsed(landed, adapters, max_bytes)
    if once:
        items = written(unfolded(rows, adapters), "responses")
        # The first row of a response stands for it.
        rows = items.where("ix IS NULL OR ix = 0").select(*RESPONSE)
    else:
        items = unfolded(rows, adapters)
        rows = rows.withColumns({"page": F.col("skip"), "page_items": F.size("items")})
    items = exploded(items)
    payload = F.col("item") if keep_payload else F.parse_json(F.lit("{}"))
    postings = items.where("reject_reason IS NULL").select(
        *LINEAGE,
        "skip",
        "page_items",
        *[f for f in POSTING_FIELDS if f != "raw_payload"],
        payload.alias("raw_payload"),
    )
    postings = with_plain_text(postings, "description_html", "plain").withColumns(
        {
            "description_text": F.coalesce(filled(F.col("description_text")), F.col("plain")),
            "published_at": payload_time(F.col("published_at")),
        }
    ).withColumnRenamed("plain", PLAIN_HTML)
    rejects = items.where("reject_reason IS NOT NULL").select(
        *LINEAGE, "skip", "page_items", "reject_reason"
    )
    failures = rows.where("error_message IS NOT NULL").select(
        "user_id", "source_id", "run_id", "started_at", "error_type", "error_message"
    )
    paged = rows.where(F.col("adapter").isin(*PAGED) & F.col("page").isNotNull())
    pages = paged.select("run_id", F.col("page").alias("skip"), F.coalesce("page_items", F.lit(0)).alias("page_items"))
    return Collected(postings, rejects, failures, pages)


def with_completeness(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """A4: runs with ``complete``, false where pages of a paged board are missing, null where nothing is paged."""
    summary = page_summary(pages).select("run_id", (~F.col("truncated")).alias("complete"))
    return runs.join(summary, "run_id", "left")


def page_summary(
    pages: DataFrame, page_size: int = PAGE_SIZE, max_pages: int | None = None
) -> DataFrame:
    """A4: per run the pages that count.

    Takes ``run_id, skip, page_items`` of every landed page. Pages after the first short
    one do not count; without ``max_pages`` all others do, however many. A gap in the offsets
    or a full last page marks the run truncated. One aggregate, no ordering of pages.
    """
    asked = F.lit(True) if max_pages is None else F.col("skip") < page_size * max_pages
    short = F.min(F.when(asked & (F.col("page_items") < page_size), F.col("skip")))
    ends = pages.groupBy("run_id").agg(short.alias("last_skip"))
    within = F.col("last_skip").isNull() | (F.col("skip") <= F.col("last_skip"))
    counted = pages.join(ends, "run_id").where(asked & within)
    return (
        counted.groupBy("run_id", "last_skip")
        .agg(
            F.count_distinct("skip").alias("pages"),
            F.sum("page_items").alias("items"),
            F.max("skip").alias("max_skip"),
        )
        .select(
            "run_id",
            "pages",
            "items",
            "max_skip",
            (
                F.col("last_skip").isNull() | (F.col("pages") * page_size != F.col("max_skip") + page_size)
            ).alias("truncated"),
        )
    )


def counted_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """A4: items without those of pages behind a short one; runs of boards without pages keep all."""
    ends = page_summary(pages).select("run_id", "max_skip")
    rows = items.join(ends, "run_id", "left")
    return rows.where("max_skip IS NULL OR skip <= max_skip").drop("max_skip")
