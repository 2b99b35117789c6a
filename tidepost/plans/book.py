"""The book of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepost.plans.views import counterpart

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COUNTERPARTS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the SQL that must give the same rows."""

    def add(run: Query) -> Query:
        def in_utc(spark: SparkSession, folder: str) -> DataFrame:
            # The tables hold times without zone, meant as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, folder)

        QUERIES[name] = in_utc
        if sql is not None:
            COUNTERPARTS[name] = counterpart(sql)
        return run

    return add
