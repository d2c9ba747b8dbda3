"""Schemas of the input tables and readers that hold tables to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixtures import Tables

LINES = T.StructType(
    [
        T.StructField("register", T.IntegerType()),
        T.StructField("receipt", T.LongType()),
        T.StructField("item", T.StringType()),
        T.StructField("qty", T.DoubleType()),
    ]
)
HEADERS = T.StructType(
    [
        T.StructField("register", T.IntegerType()),
        T.StructField("receipt", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("total", T.LongType()),
    ]
)
CATALOG = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("descr", T.StringType()),
    ]
)
TAXONOMY = T.StructType(
    [
        T.StructField("cat0_id", T.StringType()),
        T.StructField("cat1_id", T.StringType()),
        T.StructField("cat0_name", T.StringType()),
        T.StructField("cat1_name", T.StringType()),
        T.StructField("item", T.StringType()),
    ]
)
CATEGORY_IDS = T.StructType(
    [
        T.StructField("cat0_id", T.StringType()),
        T.StructField("cat1_id", T.StringType()),
        T.StructField("item", T.StringType()),
    ]
)


#: Columns that no row may lack; a row without one, or whose value is no value of the type, is rejected.
NEEDED = {
    "lines": ("receipt", "item", "qty"),
    "headers": ("receipt", "ts"),
    "catalog": ("item",),
    "taxonomy": ("cat0_id", "cat1_id", "item"),
}
SCHEMAS = {"lines": LINES, "headers": HEADERS, "catalog": CATALOG, "taxonomy": TAXONOMY}


def _cast(df: DataFrame, f: T.StructField) -> Column:
    """A column in the contract's type, null where it has no such value.

    Quantities become DECIMAL(18,3), so that a cancelled item nets to exactly
    0, and totals keep the numeric type they come with; decimals stay as they are.
    """
    have = df.schema[f.name].dataType
    if f.name in ("qty", "total") and isinstance(have, T.DecimalType):
        return df[f.name]
    if f.name == "total" and isinstance(have, T.NumericType):
        return df[f.name]
    want = T.DecimalType(18, 3) if f.name == "qty" else f.dataType
    return df[f.name].try_cast(want)


def missing_columns(found: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Columns that the tables lack, by table; no entry for a whole table."""
    lacks = {n: [c for c in SCHEMAS[n].fieldNames() if c not in df.columns] for n, df in found.items()}
    return {n: cols for n, cols in lacks.items() if cols}


def conform(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the contract's columns, rejects (table, row, reason)) of a table that has all of them."""
    schema = SCHEMAS[name]
    raw = F.to_json(F.struct(*[df[c] for c in schema.fieldNames()]), {"ignoreNullFields": "false"})
    reason = F.lit(None).cast("string")
    for f in schema.fields:
        value = _cast(df, f)
        reason = F.when(reason.isNotNull(), reason).when(df[f.name].isNotNull() & value.isNull(), F.lit(f"not a value: {f.name}"))
        if f.name in NEEDED[name]:
            reason = F.when(reason.isNotNull(), reason).when(df[f.name].isNull(), F.lit(f"missing: {f.name}"))
    checked = df.select(*[_cast(df, f).alias(f.name) for f in schema.fields], raw.alias("_row"), reason.alias("_reason"))
    good = checked.where(F.col("_reason").isNull()).select(*schema.fieldNames())
    bad = checked.where(F.col("_reason").isNotNull()).select(F.lit(name).alias("table"), F.col("_row").alias("row"), F.col("_reason").alias("reason"))
    return good, bad


def read_tables(spark: SparkSession, lines: str, headers: str, catalog: str, taxonomy: str) -> tuple[Tables, DataFrame]:
    """(tables, rejects): parquet tables held to the contract.

    Missing columns of all tables are reported in one error, before anything is
    read. Rows that break the contract are left out and listed as (table, row as
    JSON, reason).
    """
    paths = {"lines": lines, "headers": headers, "catalog": catalog, "taxonomy": taxonomy}
    found = {n: spark.read.parquet(p) for n, p in paths.items()}
    if lacks := missing_columns(found):
        raise ValueError("missing columns: " + "; ".join(f"{n}: {', '.join(c)}" for n, c in lacks.items()))
    parts = {n: conform(df, n) for n, df in found.items()}
    rejects = None
    for _, bad in parts.values():
        rejects = bad if rejects is None else rejects.unionByName(bad)
    return Tables(**{n: good for n, (good, _) in parts.items()}), rejects
