"""Array expressions evaluated inside one basket row.

Baskets are sorted, duplicate-free arrays; nothing here needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_pairs(left: str, right: str, same: Column) -> Column:
    """All pairs (a, b), a < b, of two blocks of one sorted array; ``same`` tells that they are the same block."""
    return F.flatten(
        F.transform(
            F.col(left),
            lambda a, i: F.transform(
                F.when(same, F.slice(F.col(right), i + 2, F.size(right))).otherwise(F.col(right)),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )


def subsets(items: str = "items", len_max: int = 6) -> Column:
    """Non-empty subsets of a basket of at most ``len_max`` items.

    Subset number m (1 .. 2^n - 1) holds the items whose bit is set in m, so
    every subset keeps the sorted order. A longer basket yields itself only.
    """
    return F.expr(
        f"CASE WHEN size({items}) <= {int(len_max)} THEN "
        f"transform(sequence(1, shiftleft(1, size({items})) - 1), m -> "
        f"filter({items}, (x, i) -> (shiftright(m, i) & 1) = 1)) "
        f"ELSE array({items}) END"
    )
