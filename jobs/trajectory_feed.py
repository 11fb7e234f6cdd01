"""Observed trajectories kept up to date from a growing folder of events.

    python -m jobs.trajectory_feed --events PATH --out PATH --checkpoint PATH [--config FILE]

The events are a folder of Parquet files or a pattern (a single file, too, has to be given as a pattern). Each run takes
the event files that the checkpoint has not seen (a file stream with availableNow) and ends. What it
writes, all through Spark's writers with dynamic partition overwrite:

* partials/day=D/batch=B   sums of one micro-batch: node, n, total, low, high
* daily/day=D              node, n, mean, low, high over all batches; only days with new events are written again
* nodes/node=K             the trajectory's first crossing, peak and area, from the daily table; nodes with new events alone

All three are written before the checkpoint takes a batch as done. A batch that is repeated after a failure overwrites
its own partitions, and days and nodes are always computed from all partials, so a rerun, a late event or a crash at any
point ends in the same tables. Events of any lateness count.

Events without a time, a user or a value can't be placed; they are counted in the log and left out.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import metrics
from lattiq.streaming.events import read_events

log = logging.getLogger("jobs.trajectory_feed")
DEFAULTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "trajectory_feed.json")

PARTIALS = "node long, n long, total double, low double, high double, day date, batch long"
DAILY = "node long, n long, mean double, low double, high double, day date"
NODES = "days long, first_day date, crossing double, peak_time double, area double, highest double, last double, node long"


def load_config(path: str = DEFAULTS) -> dict:
    with open(path) as f:
        return json.load(f)


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def partial_sums(events: DataFrame, nodes: int) -> DataFrame:
    """day, node, n, total, low, high of the events that have a time, a user and a value."""
    e = events.where("ts is not null and user_id is not null and value is not null and not isnan(value)")
    by = e.groupBy(F.col("ts").cast("date").alias("day"), F.pmod("user_id", F.lit(nodes)).alias("node"))
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def daily_means(partials: DataFrame) -> DataFrame:
    """One row a day and node over all batches."""
    g = partials.groupBy("day", "node").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return g.select("node", "n", (F.col("total") / F.col("n")).alias("mean"), "low", "high", "day")


def node_trajectories(daily: DataFrame, threshold: float) -> DataFrame:
    """One row a node: time in days from its first day, levels as shares of its highest daily mean."""
    own = daily.groupBy("node").agg(F.min("day").alias("first_day"), F.max("mean").alias("top"), F.count("*").alias("days"))
    t = daily.join(own, "node").select(F.lit("observed").alias("run_id"), "node", F.datediff("day", "first_day").alias("t_idx"), F.datediff("day", "first_day").cast("double").alias("t"), F.coalesce(F.try_divide("mean", "top"), F.lit(0.0)).alias("d"))
    m = metrics.invasion_metrics(t.withColumn("r", F.lit(0.0)), threshold)
    return m.join(own, "node").select("days", "first_day", F.col("invasion_time").alias("crossing"), F.col("t_peak").alias("peak_time"), F.col("auc_d").alias("area"), F.col("top").alias("highest"), F.col("final_d").alias("last"), "node")


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take what is new in events into the tables below out; returns counts of what was read and written."""
    config = load_config() | (config or {})
    seen = {"batches": 0, "events": 0, "left_out": 0, "days": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.select("ts", "user_id", "value").persist()
        sums = partial_sums(batch, config["nodes"]).withColumn("batch", F.lit(number).cast("long"))
        # without an own partitioning each task would open a file for each of its days
        _overwrite(sums.repartition("day"), f"{out}/partials", "day", "batch")
        partials = session.read.schema(PARTIALS).parquet(f"{out}/partials")
        days = partials.where(F.col("batch") == number).select("day").distinct()
        # a day is a partition: the semi join reads the touched days alone
        touched = partials.where(F.col("batch") <= number).join(F.broadcast(days), "day", "left_semi")  # at most a row a calendar day
        _overwrite(daily_means(touched).repartition("day"), f"{out}/daily", "day")
        daily = session.read.schema(DAILY).parquet(f"{out}/daily")
        nodes = partials.where(F.col("batch") == number).select("node").distinct()
        moved = daily.join(F.broadcast(nodes), "node", "left_semi")  # at most config["nodes"] rows
        _overwrite(node_trajectories(moved, config["threshold"]).repartition("node"), f"{out}/nodes", "node")
        events_read = batch.count()
        placed = partials.where(F.col("batch") == number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        log.info("batch %d: read %d events, left out %d, wrote %d days", number, events_read, events_read - placed, n_days := days.count())
        seen["batches"] += 1
        seen["events"] += events_read
        seen["left_out"] += events_read - placed
        seen["days"] += n_days
        batch.unpersist()

    stream = read_events(spark, events, config["files_per_trigger"])
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("run: %s from %s into %s", seen, events, out)
    return seen


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(f"{out}/daily")


def read_nodes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{out}/nodes")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("events", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=DEFAULTS)
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("trajectory_feed").getOrCreate()
    try:
        run(spark, a.events, a.out, a.checkpoint, load_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
