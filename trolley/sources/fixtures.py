"""Logical input tables built from the driver's TPC-H-style parquet files.

The job expects four tables: receipt lines, receipt headers, a catalog and an
item taxonomy. The test data has none of them, so each is a projection of an
existing table. The mappings below are fixed so that the Spark results and the
SQL written for the second engine read the same rows.

Fixed values (shared with the SQL text in :mod:`trolley.oracle`):
  register = l_orderkey % 3 + 1, receipt = l_orderkey, item = l_partkey as text
  quantity = -l_quantity when l_returnflag = 'R' (a cancelled line), else l_quantity
  header total = floor(o_totalprice / 1000)
  taxonomy cat0 id by p_type: ECONOMY 1, LARGE 2, MEDIUM 3, PROMO 4, SMALL 5, other 6
  taxonomy cat1 id = number after "Brand#" in p_brand
  parts with p_partkey % 20 = 19 are left out of the taxonomy
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAT0_IDS = {"ECONOMY": "1", "LARGE": "2", "MEDIUM": "3", "PROMO": "4", "SMALL": "5"}
CAT0_OTHER = "6"
TAXONOMY_GAP_MOD = 20
TAXONOMY_GAP_REM = 19


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _register(key: str) -> Column:
    return ((F.col(key) % 3).cast("int") + F.lit(1)).alias("register")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """register INT, receipt BIGINT, item STRING, qty DOUBLE."""
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        _register("l_orderkey"),
        F.col("l_orderkey").alias("receipt"),
        F.col("l_partkey").cast("string").alias("item"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
        .otherwise(F.col("l_quantity"))
        .alias("qty"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """register INT, receipt BIGINT, ts TIMESTAMP_NTZ, total BIGINT."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        _register("o_orderkey"),
        F.col("o_orderkey").alias("receipt"),
        F.col("o_orderdate").alias("ts"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("total"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item STRING, name STRING, descr STRING."""
    p = _table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("item"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("descr"),
    )


def _cat0_id() -> Column:
    expr = F.lit(CAT0_OTHER)
    for name in reversed(list(CAT0_IDS)):
        expr = F.when(F.col("p_type") == name, F.lit(CAT0_IDS[name])).otherwise(expr)
    return expr


def taxonomy(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """cat0_id, cat1_id, cat0_name, cat1_name, item — all STRING.

    The baskets' taxonomy lacks some parts, which get the default category; the
    queries about the taxonomy itself take the whole one.
    """
    p = _table(spark, sf_dir, "part")
    known = F.lit(True) if whole else F.col("p_partkey") % TAXONOMY_GAP_MOD != TAXONOMY_GAP_REM
    return p.where(known).select(
        _cat0_id().alias("cat0_id"),
        F.expr("substr(p_brand, 7)").cast("int").cast("string").alias("cat1_id"),
        F.col("p_type").alias("cat0_name"),
        F.col("p_brand").alias("cat1_name"),
        F.col("p_partkey").cast("string").alias("item"),
    )


def category_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cat0_id, cat1_id, item — the id-only taxonomy the taxonomy builder joins."""
    return taxonomy(spark, sf_dir).select("cat0_id", "cat1_id", "item")


@dataclass(frozen=True)
class Tables:
    lines: DataFrame
    headers: DataFrame
    catalog: DataFrame
    taxonomy: DataFrame


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        lines=lines(spark, sf_dir),
        headers=headers(spark, sf_dir),
        catalog=catalog(spark, sf_dir),
        taxonomy=taxonomy(spark, sf_dir),
    )
