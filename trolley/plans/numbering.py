"""Consecutive numbers over a whole table, in a given order, without a window over it.

Rows are dealt by ranges of the order, so a value that a third of all rows share
is spread as long as the order has further columns. Each partition numbers its
own rows; the counts of the partitions before it are joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# monotonically_increasing_id: partition in the upper bits, row in the lower 33.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], put: Callable[[DataFrame], DataFrame], pos: str = "pos") -> DataFrame:
    """df with ``pos`` (bigint from 1) in the given order, which must be total for a repeatable result.

    ``put`` writes the sorted rows: their partitions are read twice and must not change in between.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = put(dealt.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", ROW_BITS))
    # One row per partition: the window over them is bounded by the number of partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    at = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.join(offsets, "_part").select(*df.columns, (F.col("_off") + at + 1).alias(pos))
