"""Running sums and row numbers over a whole ordered table, without one task for all.

Rows are range-partitioned by (group, order) and written once to the shared folder;
sums per partition give each partition's offset, and a window inside each partition
adds the rest.  Partitions grow with the rows, so no task holds a group; only one
row per group and partition is summed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Adds for each (name, value) of ``sums`` the sum of ``value`` over the rows of the group up
    to and including this one in ``order``.  Rows equal in ``order`` are in any order."""
    group = group or []
    dealt = df.repartitionByRange(*group, *order) if group else df.repartitionByRange(*order)
    parts = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*group, "_part").agg(*[F.sum(v).alias(f"_before_{k}") for k, v in sums.items()])
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", *[F.coalesce(F.sum(f"_before_{k}").over(ahead), F.lit(0)).alias(f"_before_{k}") for k in sums])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.join(offsets, [*group, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_before_{k}") + F.sum(v).over(inside)).alias(k) for k, v in sums.items()])


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Adds ``name``: 1, 2, ... in ``order`` over all rows."""
    return running_sums(df, order, {name: F.lit(1).cast("long")})
