"""Stage tables: intermediate results written once and read back.

Writing a stage to Parquet in the shared checkpoint folder cuts the lineage
(later plans start from files, not from the whole job), keeps file statistics
for Spark's join planning, allows column pruning on re-read and survives the
loss of any executor — unlike cached blocks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root


class StageStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        base = root or checkpoint_root(spark)
        self.path = f"{base}/trolley-stages/{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)
