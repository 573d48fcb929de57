"""Operative metrics over an arriving inference log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def refreshed_metrics(log: DataFrame, prices: DataFrame, out: str, checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    """Keep ``out`` at the metrics per (model, task) of all that has arrived.

    The state is a row of sums per (model, task); each trigger writes a version of its own and then names it as
    published, so readers (``published_metrics``) never meet half a table. ``seconds`` None: take what is there and end.
    """
    ok = F.col("success")
    sums = log.groupBy("model_id", "task").agg(
        F.count("*").alias("requests"), F.count_if(~ok).alias("errors"), F.sum("retries").alias("retries"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum(F.when(ok, F.col("latency_ms"))).alias("latency"), F.count_if(ok & F.col("latency_ms").isNotNull()).alias("timed"),
    )

    def publish(batch: DataFrame, number: int) -> None:
        price = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        cost = (F.col("input_tokens") * price("cost_input_1m") + F.col("output_tokens") * price("cost_output_1m")) / 1e6
        rows = batch.join(prices, "model_id", "left").select(
            "model_id", "task", "requests", "errors", "retries", "input_tokens", "output_tokens", F.round(F.try_divide("latency", "timed"), 1).alias("avg_latency_ms"),
            F.round(cost, 6).alias("cost"), F.round(cost / F.col("requests"), 6).alias("cost_per_request"),
        )
        rows.write.mode("overwrite").parquet(f"{out}/version={number}")
        batch.sparkSession.createDataFrame([(number,)], "version long").coalesce(1).write.mode("append").parquet(f"{out}/published")

    writer = sums.writeStream.outputMode("complete").foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def published_metrics(spark: SparkSession, out: str) -> DataFrame:
    """The version published last."""
    newest = spark.read.parquet(f"{out}/published").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{out}/version={newest}")


def windowed_metrics(log: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests, errors and mean latency per model and event-time window; rows later than ``late`` are dropped.

    ``ts`` may be a timestamp with or without zone (a watermark takes only the former; without zone, it is the session's).
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = timed.withWatermark("ts", late) if log.isStreaming else timed
    return kept.groupBy(F.window("ts", width).alias("w"), "model_id").agg(
        F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("errors"), F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("avg_latency_ms")
    )
