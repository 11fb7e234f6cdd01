"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with this library's defaults; on a cluster use the cluster's own."""
    builder = SparkSession.builder.master(master).appName("lattiq")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    return builder.config(map=defaults | conf).getOrCreate()


@cache
def _own_folder(app: str) -> str:
    """One folder an application; the setting itself can't be changed in a running session."""
    return "file://" + tempfile.mkdtemp(prefix="lattiq_")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir)."""
    try:
        base = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the setting is absent
        base = None
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/lattiq/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder (spark.checkpoint.dir) and read again: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, name: str = "step", what: Column | None = None) -> tuple[DataFrame, int]:
    """cut(df) and its number of rows (or of rows where what holds), counted while it is written: no job of its own."""
    seen = Observation()
    n = F.count(F.lit(1)) if what is None else F.count_if(what)
    out = cut(df.observe(seen, n.alias("n")), name)
    return out, seen.get["n"]
