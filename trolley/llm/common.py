"""Helpers shared by the operators: table reading, stage tables, list building.

A stage table is an intermediate result written once as Parquet in the shared
folder of ``spark.checkpoint.dir`` and read back. It cuts the lineage, keeps a
long plan from being computed twice and survives lost executors.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once per session), as --py-files would.

    Python functions that run in tasks refer to its modules.
    """
    context = spark.sparkContext
    if any(os.path.basename(f) == "trolley_llm.zip" for f in context._python_includes):
        return
    top = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="trolley-"), "trolley_llm.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Stages:
    """Numbered stage tables of one run, all under one fresh folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/trolley-llm/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        target = f"{self.path}/{self.n:02d}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)
