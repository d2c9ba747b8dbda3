"""Rows that each meet a whole small table, without the table on every row.

A join would write the table's wide rows (vectors, model weights) beside every row
that needs them and sort those. Here the rows are dealt by a hash into groups of
bounded size, and each group gets the table once.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Rows of a group, at least.
GROUP = 1 << 12
#: Numbers of a table up to which it goes to the groups whole (128 MB).
WHOLE = 1 << 24


def with_whole(rows: DataFrame, n_rows: int, table: DataFrame, width: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, group: int = GROUP) -> DataFrame:
    """run(a group's rows, the table) over all rows, dealt by a hash of everything in them.

    A group has about ``group`` rows, or more where the table is wide, so that the
    copies of the table stay in proportion to the rows. Groups without rows are
    not run; the result's columns are those of ``schema``.
    """
    ship(rows.sparkSession)
    groups = max(1, -(-n_rows // max(group, 16 * width)))
    # The number of partitions is given: the rows are narrow, the work is in what they meet.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64(*rows.columns), F.lit(groups)).cast("int")
    dealt = rows.withColumn("_group", own).repartition(tasks, "_group")
    copies = table.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, "_group")
    names = [c.split()[0] for c in schema.split(", ")]

    def over(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left.combine_chunks(), right.combine_chunks()) if left.num_rows and right.num_rows else None
        return pa.table({}) if out is None else out.select(names)

    return dealt.groupBy("_group").cogroup(copies.groupBy("_group")).applyInArrow(over, schema)
