"""Price observations as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.sources.payloads import upsert


def observed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def hourly_prices(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """(item, window, n, least, most) by hour of ts; observations later than `late` are dropped by the watermark."""
    return (
        observations.withWatermark("ts", late).groupBy("item", F.window("ts", "1 hour"))
        .agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))
    )


def deduplicated(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per observation id, with state kept only as long as the watermark allows repeats."""
    return observations.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def keep_last_known(observations: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps (item, price, ts), the last known price, as Parquet versions under `folder`, one per micro-batch.

    A batch reads the version before it and writes its own, so a batch that is run
    again after a failure gives the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("item", "price", "ts").where("price is not null")
        base = spark.read.parquet(f"{folder}/v{number - 1}") if number else spark.createDataFrame([], new.schema)
        upsert(base, new, ["item"], "ts").write.mode("overwrite").parquet(f"{folder}/v{number}")

    return observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
