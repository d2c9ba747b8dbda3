"""Text-file sources and sinks: TSV, comma CSV, basket lines, libsvm.

Everything is written by the executors into a (shared) directory and read
back with an explicit schema; no file passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import CATEGORY_IDS, TAXONOMY

# Header names of the taxonomy file as the job wrote it, and ours.
TAXONOMY_HEADER = {
    "cat0.id": "cat0_id",
    "cat1.id": "cat1_id",
    "cat0.name": "cat0_name",
    "cat1.name": "cat1_name",
    "TOVAR": "item",
}


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated text; arrays are written space-joined."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(" ", c.cast("array<string>"))
        cols.append(c.alias(f.name))
    df.select(cols).write.mode("overwrite").option("sep", "\t").option(
        "header", str(header).lower()
    ).csv(path)


def read_tsv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = False
) -> DataFrame:
    return (
        spark.read.option("sep", "\t")
        .option("header", str(header).lower())
        .schema(schema)
        .csv(path)
    )


def write_taxonomy_tsv(taxonomy: DataFrame, path: str) -> None:
    """Taxonomy with the header names of the original file."""
    back = {v: k for k, v in TAXONOMY_HEADER.items()}
    write_tsv(taxonomy.select([F.col(c).alias(back[c]) for c in TAXONOMY.fieldNames()]), path, True)


def read_taxonomy_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy TSV with a header; ids stay text. Extra columns are ignored."""
    raw = spark.read.option("sep", "\t").option("header", "true").csv(path)
    missing = [h for h in TAXONOMY_HEADER if h not in raw.columns]
    if missing:
        raise ValueError(f"taxonomy file lacks columns {missing}")
    return raw.select(
        [F.col(f"`{h}`").cast("string").alias(name) for h, name in TAXONOMY_HEADER.items()]
    )


def write_category_ids_csv(ids: DataFrame, path: str) -> None:
    """(cat0_id, cat1_id, item), comma separated, no header."""
    ids.select(*CATEGORY_IDS.fieldNames()).write.mode("overwrite").csv(path)


def read_category_ids_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATEGORY_IDS).csv(path)


def write_carts(baskets: DataFrame, path: str) -> None:
    """One line per basket: every item followed by a tab."""
    line = F.concat(F.concat_ws("\t", "items"), F.lit("\t"))
    baskets.select(line.alias("value")).write.mode("overwrite").text(path)


def read_carts(spark: SparkSession, path: str) -> DataFrame:
    """(items, size) from basket lines; the empty field after the last tab is dropped."""
    items = F.filter(F.split(F.col("value"), "\t"), lambda x: x != F.lit(""))
    return (
        spark.read.text(path)
        .select(items.alias("items"))
        .where(F.size("items") > 0)
        .select("items", F.size("items").alias("size"))
    )


def write_libsvm_text(rows: DataFrame, path: str) -> None:
    """'<label> <i>:1 ...' with the one-based, ascending indices of ``indices``."""
    pairs = F.transform(F.col("indices"), lambda i: F.concat(i.cast("string"), F.lit(":1")))
    label = F.col("label").cast("string")
    line = F.when(F.size("indices") > 0, F.concat_ws(" ", label, F.concat_ws(" ", pairs))).otherwise(
        label
    )
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """(label DOUBLE, features sparse VECTOR) through Spark's libsvm reader."""
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)
