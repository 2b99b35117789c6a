"""The catalog of portfolio sources as a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepost.functions.text import filled

# Head of the catalog.
HEAD = (
    "# Source Catalog: VC Portfolio Boards",
    "",
    "| Source | Configured URL | Detected Platform | Adapter / Status | Detected Application URL |",
    "| --- | --- | --- | --- | --- |",
)


def catalog_rows(sources: DataFrame) -> DataFrame:
    """One table line per portfolio source."""
    status = F.coalesce(filled(F.col("detection_status")), F.lit("not probed"))
    cells = [
        F.col("name"),
        F.col("url"),
        F.coalesce(filled(F.col("detected_platform")), F.lit("—")),
        F.concat_ws(" / ", "adapter", status),
        F.coalesce(filled(F.col("detected_application_url")), F.lit("—")),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return sources.where("category = 'vc_portfolio'").select("user_id", "source_id", "name", line.alias("line"))


def write_catalog(sources: DataFrame, folder: str) -> None:
    """Writes the catalog of one user; the part files in name order make the document."""
    spark = sources.sparkSession
    head = spark.createDataFrame([(0, i, text) for i, text in enumerate(HEAD)], "part int, place int, line string")
    rows = catalog_rows(sources).select(
        F.lit(1).alias("part"), F.lit(0).alias("place"), "name", "source_id", "line"
    )
    lines = rows.unionByName(head, allowMissingColumns=True)
    lines.orderBy("part", "place", "name", "source_id").select("line").write.text(folder)
