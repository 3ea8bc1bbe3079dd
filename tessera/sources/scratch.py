"""Tables and files that a query keeps in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The path of a new folder below the one that spark.checkpoint.dir names; where that is unset, a local master gets a temporary one, a cluster an error. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="scratch-")
    path = f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: its lineage ends there."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
