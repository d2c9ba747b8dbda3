"""Small tables built by hand, and result comparison helpers."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

from trolley.sources.fixtures import Tables
from trolley.sources.tables import CATALOG, HEADERS, LINES, TAXONOMY


def tables(spark, lines, headers=(), catalog=(), taxonomy=()):
    return Tables(
        lines=spark.createDataFrame(list(lines), LINES),
        headers=spark.createDataFrame(list(headers), HEADERS),
        catalog=spark.createDataFrame(list(catalog), CATALOG),
        taxonomy=spark.createDataFrame(list(taxonomy), TAXONOMY),
    )


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(norm(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def rows(df):
    return [r.asDict() for r in df.collect()]
