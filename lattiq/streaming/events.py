"""Observed trajectories from a stream of events: windowed means with late data bounded by a watermark.

The batch operators take the result as it is: run_id, t_idx, t, node, d.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def node_means(events: DataFrame, nodes: int = 15, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """node, start, d, n: mean value of each node in each window. Rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy((F.col("user_id") % nodes).alias("node"), F.window("ts", window).alias("w"))
    return w.agg(F.avg("value").alias("d"), F.count("*").alias("n")).select("node", F.col("w.start").alias("start"), "d", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """user_id, start, end, n: session windows of each user's events."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_trajectories(means: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet; a restart goes on from the checkpoint."""
    return means.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def as_trajectory(means: DataFrame, run_id: str = "observed") -> DataFrame:
    """Means read back as trajectories, time in days from the first window, d scaled to at most 1."""
    lows = means.agg(F.min("start").alias("t0"), F.max("d").alias("top"))
    days = (F.unix_timestamp("start") - F.unix_timestamp("t0")) / 86400.0
    return means.join(F.broadcast(lows)).select(F.lit(run_id).alias("run_id"), days.cast("int").alias("t_idx"), days.alias("t"), "node", (1 - F.col("d") / F.col("top")).alias("h"), (F.col("d") / F.col("top")).alias("d"), F.lit(0.0).alias("r"))
