"""Order-dependent columns per key that hold when one key owns a third of all rows.

A window sends all rows of a key to one task. That is the cheapest way, one shuffle, as long as no key has very many rows.
Rows are counted by buckets of keys first. Those in crowded buckets are range-partitioned on (key, order) instead,
so that a large group is cut into slices; every slice is solved alone and receives what it needs
from the slices before it through one summary row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepost.session import written

#: Buckets that rows are counted by, and the rows of a bucket from which its keys are cut into slices.
BUCKETS, CROWDED = 1 << 16, 500_000


def _by_size(
    df: DataFrame, keys: list[str], whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame],
    counted: DataFrame | None = None,
) -> DataFrame:
    """``whole`` of the rows in buckets of usual size, ``cut`` of those in crowded ones; both give the same columns.

    ``counted`` has the ``rows`` by some of the keys, where they are known without a pass over ``df``.
    """
    if counted is None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
        counts = df.groupBy(bucket.alias("bucket")).count()
    else:
        bucket = F.pmod(F.xxhash64(*[k for k in keys if k in counted.columns]), F.lit(BUCKETS))
        counts = counted.groupBy(bucket.alias("bucket")).agg(F.sum("rows").alias("count"))
    # No more numbers than there are buckets.
    crowded = [r["bucket"] for r in counts.where(F.col("count") > CROWDED).collect()]
    if not crowded:
        return whole(df)
    return whole(df.where(~bucket.isin(crowded))).unionByName(cut(df.where(bucket.isin(crowded))))


def _sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ranged = df.repartitionByRange(*keys, *order).withColumn("slice", F.spark_partition_id())
    return written(ranged, "slices")


def _same(left: str, right: str, keys: list[str]) -> Column:
    out = F.col(f"{left}.slice") == F.col(f"{right}.slice")
    for key in keys:
        out = out & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return out


def lagged(
    df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str | Column], counted: DataFrame | None = None
) -> DataFrame:
    """Adds for every ``output: input`` of ``columns`` the input of the previous row of the key; ``counted`` as above."""

    def whole(rows: DataFrame) -> DataFrame:
        in_order = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({out: F.lag(col).over(in_order) for out, col in columns.items()})

    def cut(part: DataFrame) -> DataFrame:
        rows = _sliced(part, keys, order)
        inside = Window.partitionBy(*keys, "slice").orderBy(*order)
        across = Window.partitionBy(*keys).orderBy("slice")
        inputs = [(F.col(c) if isinstance(c, str) else c).alias(o) for o, c in columns.items()]
        ends = rows.groupBy(*keys, "slice").agg(F.max_by(F.struct(*inputs), F.struct(*order)).alias("end"))
        ends = ends.withColumn("before", F.lag("end").over(across)).drop("end")
        local = rows.withColumns({out: F.lag(col).over(inside) for out, col in columns.items()})
        local = local.withColumn("is_first", F.row_number().over(inside) == 1)
        joined = local.alias("l").join(ends.alias("e"), _same("l", "e", keys), "left")
        return joined.select(
            *[f"l.{c}" for c in df.columns],
            *[
                F.when(F.col("l.is_first"), F.col(f"e.before.{out}")).otherwise(F.col(f"l.{out}")).alias(out)
                for out in columns
            ],
        )

    return _by_size(df, keys, whole, cut, counted)


def carried(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds for every ``output: input`` the latest non-null input up to the row itself."""
    start, here = Window.unboundedPreceding, Window.currentRow

    def whole(rows: DataFrame) -> DataFrame:
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(start, here)
        return rows.withColumns({out: F.last(col, ignorenulls=True).over(so_far) for out, col in columns.items()})

    def cut(part: DataFrame) -> DataFrame:
        rows = _sliced(part, keys, order)
        inside = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(start, here)
        across = Window.partitionBy(*keys).orderBy("slice").rowsBetween(start, -1)
        ends = rows.groupBy(*keys, "slice").agg(
            *[
                F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order))).alias(out)
                for out, col in columns.items()
            ]
        )
        ends = ends.withColumns({out: F.last(out, ignorenulls=True).over(across) for out in columns})
        local = rows.withColumns(
            {out: F.last(col, ignorenulls=True).over(inside) for out, col in columns.items()}
        )
        joined = local.alias("l").join(ends.alias("e"), _same("l", "e", keys), "left")
        return joined.select(
            *[f"l.{c}" for c in df.columns],
            *[F.coalesce(f"l.{out}", f"e.{out}").alias(out) for out in columns],
        )

    return _by_size(df, keys, whole, cut)


def lowest_before(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """Adds the least value of ``column`` among the rows of the key before the row itself."""

    def whole(rows: DataFrame) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.min(column).over(earlier))

    def cut(part: DataFrame) -> DataFrame:
        rows = _sliced(part, keys, order)
        inside = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        across = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*keys, "slice").agg(F.min(column).alias("least"))
        ends = ends.withColumn("before", F.min("least").over(across))
        local = rows.withColumn("local", F.min(column).over(inside))
        joined = local.alias("l").join(ends.alias("e"), _same("l", "e", keys), "left")
        return joined.select(*[f"l.{c}" for c in df.columns], F.least("l.local", "e.before").alias(name))

    return _by_size(df, keys, whole, cut)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the 1-based position of the row within its key."""

    def whole(rows: DataFrame) -> DataFrame:
        in_order = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(name, F.row_number().over(in_order).cast("bigint"))

    def cut(part: DataFrame) -> DataFrame:
        rows = _sliced(part, keys, order)
        inside = Window.partitionBy(*keys, "slice").orderBy(*order)
        across = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("size"))
        sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(across), F.lit(0)))
        local = rows.withColumn("local", F.row_number().over(inside))
        joined = local.alias("l").join(sizes.alias("e"), _same("l", "e", keys), "left")
        return joined.select(
            *[f"l.{c}" for c in df.columns], (F.col("l.local") + F.col("e.before")).cast("bigint").alias(name)
        )

    return _by_size(df, keys, whole, cut)
