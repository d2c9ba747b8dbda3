"""Result files of a run: ordered text sinks, checked readers, and a manifest to resume from.

A sink deals rows by ranges of their order and writes one text file per range, so
that the files read in name order are the whole table in order; a header line is
the first line of the first file. No file passes through the driver.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BasketConfig
from ..plans.numbering import numbered

FORMAT_VERSION = 1
Put = Callable[[DataFrame], DataFrame]


def fixed(c: Column | str) -> Column:
    """A number as "%10.5f": ten characters wide or more, five decimals, halves rounded up."""
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string("%10.5f", F.round(c, 5))


def write_lines(df: DataFrame, path: str, cells: list[Column], order: list[Column], header: list[str] | None = None) -> None:
    """Tab-separated lines of cells (null: empty) in the given order, the header line first."""
    line = F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])
    keyed = [c.alias(f"_o{i}") for i, c in enumerate(_plain(c) for c in order)]
    rows = df.select(F.lit(1).alias("_h"), line.alias("value"), *keyed)
    by = [F.col("_h"), *[_direction(c, f"_o{i}") for i, c in enumerate(order)]]
    if header is not None:
        first = df.sparkSession.range(1).select(F.lit(0).alias("_h"), F.lit("\t".join(header)).alias("value"))
        rows = first.unionByName(rows, allowMissingColumns=True)
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite").text(path)


@dataclasses.dataclass(frozen=True)
class Desc:
    """A column of an order, largest first."""

    column: Column


def _plain(c: Column | Desc) -> Column:
    return c.column if isinstance(c, Desc) else c


def _direction(c: Column | Desc, name: str) -> Column:
    return F.col(name).desc_nulls_last() if isinstance(c, Desc) else F.col(name)


def read_lines(spark: SparkSession, path: str, put: Put) -> DataFrame:
    """(pos, line) of a table written by write_lines, numbered from 1 in the order of its files."""
    m = F.col("_metadata")
    raw = spark.read.text(path).select(
        m["file_name"].alias("_f"), m["file_block_start"].alias("_b"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line")
    )
    # A block of a file lies in one partition, in its order; blocks are put in order by file name and place.
    return numbered(put(raw), [F.col("_f"), F.col("_b"), F.col("_m")], put).select("pos", "line")


def read_checked(spark: SparkSession, path: str, schema: T.StructType, put: Put) -> tuple[DataFrame, DataFrame]:
    """(rows in the schema, rejects (line, reason)) of tab-separated lines without a header.

    A line with too few or too many cells, or with a cell that is no value of its
    column's type, goes to the rejects; it never becomes a null.
    """
    cells = F.split("line", "\t")
    parsed = put(
        spark.read.text(path).withColumnRenamed("value", "line").select(
            "line", F.size(cells).alias("_n"), *[F.get(cells, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
        )
    )
    bad = F.when(F.col("_n") != len(schema.fields), F.concat(F.lit("cells: "), F.col("_n").cast("string")))
    for f in schema.fields:
        bad = bad.when(F.col(f.name).isNull(), F.lit(f"not a {f.dataType.simpleString()}: {f.name}"))
    checked = parsed.withColumn("reason", bad)
    return (
        checked.where(F.col("reason").isNull()).select(*schema.fieldNames()),
        checked.where(F.col("reason").isNotNull()).select("line", "reason"),
    )


ITEMS = T.StructType([T.StructField("item", T.StringType()), T.StructField("freq", T.LongType())])
PAIRS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("freq", T.LongType())])
#: Header lines, as the job writes them.
INTERACTION_HEADER = ["nazov", "item", "n", "max", "avg", "median", "std.dev", "list"]
RULES_HEADER = ["A", "B", "confidence", "lift"]


def write_manifest(spark: SparkSession, path: str, cfg: BasketConfig, files: dict[str, int]) -> None:
    """One JSON line: format, run parameters, and rows of each file."""
    text = json.dumps({"format": FORMAT_VERSION, "config": dataclasses.asdict(cfg), "files": files}, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")


def read_manifest(spark: SparkSession, path: str) -> tuple[BasketConfig, dict[str, int]]:
    found = json.loads(spark.read.text(f"{path}/manifest.json").first()["value"])
    if found["format"] != FORMAT_VERSION:
        raise ValueError(f"result files of format {found['format']}, not {FORMAT_VERSION}")
    cfg = found["config"]
    if cfg["timerange"] is not None:
        cfg["timerange"] = tuple(cfg["timerange"])
    return BasketConfig(**cfg), found["files"]
