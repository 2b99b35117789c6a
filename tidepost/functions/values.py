"""Pay values, run labels and source states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_type(value: Column) -> Column:
    return F.schema_of_variant(value)


def whole_amount(value: Column) -> Column:
    """integral numbers as int; booleans, fractions, text and nulls become null."""
    number = F.try_variant_get(value, "$", "double")
    is_number = variant_type(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_number & (number == F.floor(number)), number.try_cast("int"))


def run_duration(started_at: Column, completed_at: Column) -> Column:
    """'42s' or '3m 5s', a dash while the run has no end.

    Both ends count in whole milliseconds, so what is rounded is their difference, not that of the microseconds.
    """
    start, end = (F.unix_millis(at.cast("timestamp")) for at in (started_at, completed_at))
    millis = end - start
    seconds = F.greatest(F.floor(millis / 1000.0 + 0.5), F.lit(0)).cast("bigint")
    return (
        F.when(completed_at.isNull(), "—")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(
            F.concat(
                F.floor(seconds / 60).cast("string"),
                F.lit("m "),
                (seconds % 60).cast("string"),
                F.lit("s"),
            )
        )
    )


def run_label(status: Column, jobs_found: Column) -> Column:
    """the status word a run history shows."""
    return (
        F.when(status == "failed", "Failed")
        .when(status == "running", "Running")
        .when((status == "success") & (jobs_found == 0), "Success · 0 jobs")
        .when(status == "success", "Success")
        .otherwise(status)
    )


def source_state(enabled: Column, last_error: Column) -> Column:
    """failed before enabled before disabled; an empty error text is no error."""
    return (
        F.when(F.coalesce(last_error, F.lit("")) != "", "failed")
        .when(enabled, "enabled")
        .otherwise("disabled")
    )


def kept_payload(payload: Column, keep: bool) -> Column:
    """the raw payload, or an empty object when payloads are not retained."""
    return payload if keep else F.lit("{}")
