"""An extension beside the batch operators: marginals kept up to date over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_marginal(events: DataFrame, attrs: list[str], time: str, width: str, late: str) -> DataFrame:
    """Counts of attrs by time window; a window's state goes once the watermark has passed it."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *attrs).agg(F.count(F.lit(1)).alias("v")).select(F.col("w.start").alias("window_start"), *attrs, "v")


def start(marginal: DataFrame, name: str, checkpoint: str):
    """The stream into a table in memory, as far as the input goes."""
    return marginal.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
