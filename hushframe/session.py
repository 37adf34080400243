"""Where intermediate tables and releases are written."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hushframe.errors import LibraryFailure


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; a cluster without it is an
    error, since a machine-local folder would be lost with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if spark.sparkContext.master.split("[")[0] != "local":  # a local-cluster has executors of its own
        raise LibraryFailure("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="hushframe-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Materialise ``df`` once and return the stored rows; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one operator: ``with Scratch(spark) as held: t = held(df, "name")`` keeps them until the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(fresh_path(self.spark, name))
        return written(df, name, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.close()

    def close(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def small_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """Driver-side parameters as a table, handed to the JVM as one Arrow batch without Python workers."""
    return spark.createDataFrame(pa.table({k: list(v) for k, v in columns.items()}), schema)
