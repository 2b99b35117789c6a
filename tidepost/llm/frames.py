"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that extra or clashing columns never meet an operator's own."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def with_fields(df: DataFrame, **kinds: str) -> StructType:
    """The schema of ``df`` and further fields that are never null."""
    return StructType([*df.schema.fields, *[StructField(n, StructType.fromDDL(f"x {k}")[0].dataType, False) for n, k in kinds.items()]])


def whole(text: Column) -> Column:
    """Null counts as empty text."""
    return F.coalesce(text, F.lit(""))


def one_in(id_hash: Column, rows: int, wanted: int) -> Column:
    """True for about ``wanted`` of ``rows`` rows (all, if fewer), chosen by a hash: a bounded sample without a sort."""
    return F.pmod(id_hash, F.lit(max(1, -(-rows // max(1, wanted))))) == 0
