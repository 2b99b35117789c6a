"""Registry import from sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.fixed import SHEET_SECTIONS, SHEET_URL_HEADINGS
from tidepost.functions.text import filled, strip_spaces
from tidepost.operators.ordered import carried
from tidepost.operators.sources import new_source_id

ROW = ["user_id", "file_id", "row_number"]


def section_of(name: Column) -> Column:
    """Category a heading opens, null for other rows."""
    out = F.lit(None).cast("string")
    for heading, category in SHEET_SECTIONS.items():
        out = F.when(F.upper(name) == heading, category).otherwise(out)
    return out


def with_section(rows: DataFrame) -> DataFrame:
    """Rows with their category, taken from the last heading above; headings emit nothing."""
    named = rows.withColumn("heading", section_of(F.col("name")))
    named = carried(named, ["user_id", "file_id"], ["row_number"], {"category": "heading"})
    return named.where("heading IS NULL").drop("heading")


def usable_url(url: Column) -> Column:
    """P7."""
    return F.coalesce(
        (url != "") & ~F.upper(url).isin(*SHEET_URL_HEADINGS) & url.rlike("^https?://"), F.lit(False)
    )


def with_first_row(rows: DataFrame) -> DataFrame:
    """Rows with the first row of their file that has the same usable address."""
    first = rows.where(usable_url(F.col("url"))).groupBy("user_id", "file_id", "url").agg(
        F.min("row_number").alias("first_row")
    )
    return rows.join(first, ["user_id", "file_id", "url"], "left")


def with_existing(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the source that has their address already."""
    return rows.join(sources.select("user_id", "url", F.col("source_id").alias("existing_id")), ["user_id", "url"], "left")


def classified(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Outcome and reason per row ``(user_id, file_id, row_number, name, url)``.

    Files apply in order of ``file_id``: an address an earlier file of the batch creates is an
    update for the later ones.
    """
    clean = rows.select(
        *ROW,
        F.coalesce(strip_spaces(F.col("name")), F.lit("")).alias("name"),
        F.coalesce(strip_spaces(F.col("url")), F.lit("")).alias("url"),
    )
    out = with_existing(with_first_row(with_section(clean)), sources)
    good = (F.col("first_row") == F.col("row_number")) & F.col("category").isNotNull()
    creating = out.where(good & F.col("existing_id").isNull()).groupBy("user_id", "url").agg(
        F.min("file_id").alias("creating_file")
    )
    out = out.join(creating, ["user_id", "url"], "left")
    usable, repeated = F.col("first_row").isNotNull(), F.col("first_row") < F.col("row_number")
    no_section = F.col("category").isNull()
    action = (
        F.when(~usable, "skip")
        .when(repeated | no_section, "flag")
        .when(F.col("existing_id").isNotNull() | (F.col("creating_file") < F.col("file_id")), "update")
        .otherwise("create")
    )
    reason = (
        F.when(~usable, "No usable URL")
        .when(repeated, "Duplicate URL already seen earlier in this workbook")
        .when(no_section, "URL found before any recognized section header")
    )
    return out.select(*ROW, "name", "url", "category", action.alias("action"), reason.alias("reason"))


def preview(outcomes: DataFrame) -> DataFrame:
    """P10: what an import would do; skipped rows are not shown."""
    return outcomes.where("action <> 'skip'")


def imported_sources(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sources after an import.

    New ones are enabled only in the portfolio category; an update never touches ``enabled``,
    and a blank name keeps the old one.
    """
    order = F.struct("file_id", "row_number")
    rows = outcomes.where("action IN ('create', 'update')").groupBy("user_id", "url").agg(
        F.max_by(filled(F.col("name")), F.when(F.col("name") != "", order)).alias("new_name"),
        F.max_by("category", order).alias("new_category"),
        F.min_by(
            F.struct("name", "category"), F.when(F.col("action") == "create", order)
        ).alias("created"),
    )
    updated = (
        sources.join(rows.where("created IS NULL"), ["user_id", "url"], "left")
        .withColumns({"name": F.coalesce("new_name", "name"), "category": F.coalesce("new_category", "category")})
        .select(*sources.columns)
    )
    portfolio = F.col("created.category") == "vc_portfolio"
    new = rows.where("created IS NOT NULL").select(
        "user_id", new_source_id().alias("source_id"), "url",
        F.coalesce("new_name", "url").alias("name"), F.col("new_category").alias("category"),
        F.when(portfolio, F.col("created.name")).alias("portfolio_firm"),
        F.lit("auto").alias("adapter"), portfolio.alias("enabled"), F.lit(100).alias("priority"),
        F.lit("daily").alias("frequency"), F.lit("Imported from spreadsheet").alias("notes"),
    )
    missing = [c for c in new.columns if c not in sources.columns]
    return updated.unionByName(new.drop(*missing), allowMissingColumns=True)


def import_runs(outcomes: DataFrame, completed_at: Column) -> DataFrame:
    """Counts by action per file; the flagged rows are ``flagged_rows``."""
    counts = [
        F.count_if(F.col("action") == action).alias(f"{name}_count")
        for action, name in (("create", "created"), ("update", "updated"), ("skip", "skipped"), ("flag", "flagged"))
    ]
    return outcomes.groupBy("user_id", "file_id").agg(*counts).withColumn("completed_at", completed_at)


def flagged_rows(outcomes: DataFrame) -> DataFrame:
    """One row per flagged sheet row, so that no file's list has to fit anywhere whole."""
    return outcomes.where("action = 'flag'").select(*ROW, "name", "url", "reason")


def list_import_runs(runs: DataFrame) -> DataFrame:
    """T4: newest first."""
    return runs.orderBy(F.desc("completed_at"), "file_id")
