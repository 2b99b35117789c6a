"""Sheets of sources, landed as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows ``(file_name, row_number, name, url)`` of CSV files; only the first three columns count."""
    rows = spark.read.schema("row_number bigint, name string, url string").csv(folder)
    return rows.select(F.col("_metadata.file_name").alias("file_name"), "row_number", "name", "url")


def write_sheets(rows: DataFrame, folder: str) -> None:
    rows.select("row_number", "name", "url").write.csv(folder)
