"""Run a stream over what is there now and read the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.session import fresh_path


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into a table in the shared folder and return the stored rows."""
    spark = stream.sparkSession
    path = fresh_path(spark, "stream-out")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", fresh_path(spark, "stream-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_all(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The same for an aggregation, with every group as it stands at the end, closed by the watermark or not.

    Each micro-batch writes the groups it changed; of a group the last version is kept, the number of the batch
    deciding.
    """
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, "stream-updates")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", fresh_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    updates = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(path)
    last = F.max_by(F.struct(*rest), "batch").alias("last")
    return updates.groupBy(*keys).agg(last).select(*keys, "last.*").select(*stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
