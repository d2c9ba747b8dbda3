"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None,
    app_name: str = "trolley",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with AQE, skew-join handling and a UTC clock.

    On a cluster, leave ``master`` unset and let spark-submit decide; the
    shuffle partition count then comes from the cluster defaults and AQE
    coalesces small partitions at run time.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    Taken from ``spark.checkpoint.dir`` (or a directory already set on the
    context). Only a local-mode session without one gets a fresh temporary
    folder; a cluster session without one is an error, because a folder on
    one machine would not survive the loss of that executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            root = os.path.dirname(current.rstrip("/"))
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)"
            )
        root = tempfile.mkdtemp(prefix="trolley-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once per session), as --py-files would.

    Python functions that run in tasks refer to its modules.
    """
    context = spark.sparkContext
    if any(os.path.basename(f) == "trolley.zip" for f in context._python_includes):
        return
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="trolley-"), "trolley.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
