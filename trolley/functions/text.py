"""String helpers with Python's pad semantics.

``str.rjust`` / ``str.ljust`` never shorten a string; SQL ``lpad`` / ``rpad``
cut it to the target length. Category codes and report columns need the
Python behaviour, so a 3-digit id stays 3 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rjust(col: Column | str, width: int, fill: str = "0") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def ljust(col: Column | str, width: int, fill: str = " ") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def rjust_sql(expr: str, width: int, fill: str = "0") -> str:
    """Same as :func:`rjust`, as SQL text (works in Spark and DuckDB)."""
    return (
        f"CASE WHEN length({expr}) >= {width} THEN {expr} "
        f"ELSE lpad({expr}, {width}, '{fill}') END"
    )


def ljust_sql(expr: str, width: int, fill: str = " ") -> str:
    return (
        f"CASE WHEN length({expr}) >= {width} THEN {expr} "
        f"ELSE rpad({expr}, {width}, '{fill}') END"
    )
