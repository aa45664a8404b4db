"""An extension that batch runs do not need: scene counts and cloud cover by day as scenes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path


def daily_clearness(scenes: DataFrame, late: str = "2 days") -> DataFrame:
    """Scenes and their mean cloud by tile and day; state is dropped ``late`` after a day's end."""
    rows = scenes.withWatermark("datetime", late).groupBy(F.window("datetime", "1 day"), "tile_id")
    return rows.agg(F.count("*").alias("n_scenes"), F.sum("cloud_cover").alias("cloud")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tile_id", "n_scenes", "cloud")


def arrived_clearness(spark: SparkSession, folder: str) -> DataFrame:
    """All that has arrived in a folder of event files, run as a stream until its end. A day's counts leave when the
    watermark passes, so the stream is closed by the update mode and its last word on each day is kept."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).parquet(folder)
    scenes = events.select(F.col("ts").cast("timestamp").alias("datetime"), F.col("event_type").alias("tile_id"), F.get_json_object("props", "$.k").cast("double").alias("cloud_cover"))
    out, mark = new_path(spark, "stream"), new_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = daily_clearness(scenes).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct("n_scenes", "cloud"), "batch").alias("x")
    return rows.groupBy("day", "tile_id").agg(last).select("day", "tile_id", "x.n_scenes", "x.cloud")
