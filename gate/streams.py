"""Streams over the events file, drained once; the SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from gate.core import query, table
from gate.ledgers import ADMIT_SQL, budgets
from hushframe.operators.ledger import KEYS
from hushframe.session import fresh_path
from hushframe.streaming.admission import admit_micro_batches, admit_stream
from hushframe.streaming.metrics import request_metrics
from hushframe.streaming.run import drain, drain_all


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(spark, sf):
    return _stream(spark, sf).select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_name"),
        F.col("event_type").alias("dataset_name"), F.col("value").alias("cost_epsilon"), F.round(F.col("value") / 1e6, 8).alias("cost_delta"))


@query("admit_stream", ADMIT_SQL)
def _(spark, sf):
    return drain(admit_stream(_requests(spark, sf), budgets(spark, sf))).select("request_id", *KEYS, "admitted")


@query("admit_micro_batches", ADMIT_SQL)
def _(spark, sf):
    path = fresh_path(spark, "admission")
    admit_micro_batches(_requests(spark, sf), budgets(spark, sf), path, fresh_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/decisions").select("request_id", *KEYS, "admitted")


_METRICS = """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as path, count(*) as n_requests,
 count(*) filter (where event_type = 'error' and value > 50) as n_failed, count(*) filter (where value <= 10) as le_10,
 count(*) filter (where value <= 100) as le_100, count(*) filter (where value <= 1000) as le_1000 from events {where} group by 1, 2"""


def _metrics(rows):
    failed = (F.col("event_type") == "error") & (F.col("value") > 50)
    return request_metrics(rows, time="ts", path="event_type", duration="value", failed=failed)


def _by_day(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "path", "n_requests", "n_failed", "le_10", "le_100", "le_1000")


@query("request_metrics", _METRICS.format(where=""))
def _(spark, sf):
    return _by_day(_metrics(table(spark, sf, "events")))


@query("request_metrics_stream", _METRICS.format(where=""))
def _(spark, sf):
    # what is drained ends here, so the newest days are complete: all windows are emitted, not only those the watermark has passed
    return _by_day(drain_all(_metrics(_stream(spark, sf)), ["window_start", "path"]))
