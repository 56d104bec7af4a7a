"""Tables and files in the shared folder, for rows that several stages read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path where driver and executors both see it: below ``spark.checkpoint.dir``; a folder of our own only on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lexiflow-")
    return f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet where driver and executors both see it, and read back."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``shared_table`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
