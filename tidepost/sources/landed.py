"""Landed responses: fetch outcome, adapter routing and the address that was asked.

A landed row is one response of one run: ``user_id, source_id, source_name, source_url,
adapter, run_id, started_at, skip, http_status, body``. A stream may add ``pages``, the number
of responses the run has in all; without it what lands together is the whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepost.fixed import ADAPTERS
from tidepost.functions.text import filled
from tidepost.functions.urls import board_for_host

LANDED = (
    "user_id string, source_id string, source_name string, source_url string, adapter string, "
    "run_id string, started_at timestamp, skip int, http_status int, body string"
)
LANDED_PARTS = f"{LANDED}, pages int"


def whole_runs(landed: DataFrame) -> DataFrame:
    """Ids of the runs of which as many different responses are there as they have in all."""
    response = F.struct("source_url", "skip")
    return (
        landed.groupBy("user_id", "source_id", "run_id")
        .agg(F.count_distinct(response).alias("there"), F.coalesce(F.max("pages"), F.lit(0)).alias("pages"))
        .where("there >= pages")
        .select("user_id", "source_id", "run_id")
    )


def _too_large(body_bytes: Column, max_bytes: int | None) -> Column:
    return F.lit(False) if max_bytes is None else body_bytes > max_bytes


def fetch_error_type(status: Column, body_bytes: Column, max_bytes: int | None = None) -> Column:
    """The error class of a response, null for a usable one. No body is too large unless a limit is asked for."""
    return (
        F.when(status == 429, "RateLimitError")
        .when(status.isin(401, 403), "AccessDeniedError")
        .when(status >= 400, "CollectorError")
        .when(_too_large(body_bytes, max_bytes), "CollectorError")
    )


def fetch_error_message(
    url: Column, status: Column, body_bytes: Column, max_bytes: int | None = None
) -> Column:
    """The error text that goes with the class."""
    code = status.cast("string")
    return (
        F.when(status == 429, F.concat(F.lit("Rate limited by "), url))
        .when(
            status.isin(401, 403),
            F.concat(F.lit("Access denied by "), url, F.lit(": HTTP "), code),
        )
        .when(
            status >= 400,
            F.concat(F.lit("Request to "), url, F.lit(" failed with status "), code),
        )
        .when(
            _too_large(body_bytes, max_bytes),
            F.concat(F.lit("Response from "), url, F.lit(f" exceeded {max_bytes} bytes")),
        )
    )


def routed_adapter(url: Column, requested: Column) -> Column:
    """The requested adapter, or for ``auto`` the board of the host, else ``jsonld``."""
    return F.when(requested != "auto", requested).otherwise(
        F.coalesce(board_for_host(url), F.lit("jsonld"))
    )


def unsupported(adapter: Column, known=ADAPTERS) -> Column:
    """The error text for an adapter nobody registered, else null."""
    return F.when(
        ~adapter.isin(*known), F.concat(F.lit("Unsupported collector adapter: "), adapter)
    )


def collect_url(url: Column, detection_status: Column, detected_url: Column) -> Column:
    """The probed address once a probe found a supported board there."""
    return F.when(
        (detection_status == "supported") & filled(detected_url).isNotNull(), detected_url
    ).otherwise(url)

