"""Platform probe: which adapter can read a source's page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.fixed import AGGREGATORS
from tidepost.functions.redact import redacted
from tidepost.functions.urls import authority, board_for_host
from tidepost.sources.page_postings import has_posting


def aggregator(host: Column, page: Column, signatures: dict[str, str] = AGGREGATORS) -> Column:
    """Platform of the first signature found in the host or the page."""
    out = F.lit(None).cast("string")
    for needle, platform in reversed(signatures.items()):
        out = F.when(host.contains(needle) | page.contains(needle), platform).otherwise(out)
    return out


def probe(fetched: DataFrame, signatures: dict[str, str] = AGGREGATORS) -> DataFrame:
    """``(final_url, html, error)`` rows with status, adapter, platform and address.

    Pages of a known board host are not searched for postings.
    """
    failed = F.col("error").isNotNull()
    out = fetched.withColumn("board", board_for_host(F.col("final_url")))
    searched = F.when(~failed & F.col("board").isNull(), F.col("html"))
    out = out.withColumn("has_posting", F.coalesce(has_posting(searched), F.lit(False)))
    out = out.withColumn("aggregator", aggregator(authority(F.col("final_url")), F.col("html"), signatures))
    readable = F.coalesce("board", F.when(F.col("has_posting"), "jsonld"))
    return (
        out.withColumn(
            "status",
            F.when(failed, "error")
            .when(readable.isNotNull(), "supported")
            .when(F.col("aggregator").isNotNull(), "unsupported")
            .otherwise("uncertain"),
        )
        .withColumn("adapter", F.when(~failed, F.coalesce(readable, F.lit("unsupported"))))
        .withColumn("detected_platform", F.when(~failed, F.coalesce(readable, F.col("aggregator"))))
        .withColumn("detected_application_url", F.when(~failed, F.col("final_url")))
        .drop("board", "has_posting", "aggregator")
    )


def probe_applied(sources: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Sources of the portfolio category after a probe; others stay as they are.

    A failed probe keeps adapter, platform and address and stores the redacted error.
    """
    found = results.select(
        "source_id",
        "status",
        F.col("error").alias("probe_error"),
        F.struct("adapter", "detected_platform", "detected_application_url").alias("new"),
    )
    rows = sources.join(found, "source_id", "left")
    probed = (F.col("category") == "vc_portfolio") & F.col("status").isNotNull()
    overwrite = probed & (F.col("status") != "error")
    changes = {
        name: F.when(overwrite, F.col(f"new.{name}")).otherwise(F.col(name))
        for name in ("adapter", "detected_platform", "detected_application_url")
    }
    changes["last_error"] = (
        F.when(overwrite, F.lit(None))
        .when(probed, F.nullif(redacted(F.col("probe_error")), F.lit("")))
        .otherwise(F.col("last_error"))
    )
    changes["detection_status"] = F.when(probed, F.col("status")).otherwise(F.col("detection_status"))
    changes["detected_at"] = F.when(probed, as_of).otherwise(F.col("detected_at"))
    return rows.withColumns(changes).select(*sources.columns)
