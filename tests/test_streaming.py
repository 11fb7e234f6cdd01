import pytest
from pyspark.sql import functions as F

from lattiq.operators import metrics
from lattiq.streaming import events

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    raw.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    q = events.write_trajectories(events.node_means(events.read_events(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = {(r["node"], r["start"]): (r["d"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = raw.agg(F.max("ts")).first()[0]
    want = {(r["node"], r["start"]): (r["d"], r["n"]) for r in events.node_means(raw).collect() if (last - r["start"]).days >= 4}
    assert want and all(got[k] == (pytest.approx(v[0]), v[1]) for k, v in want.items())
    t = events.as_trajectory(spark.read.parquet(f"{tmp_path}/out"))
    m = metrics.invasion_metrics(t, 0.3).collect()
    assert len(m) == t.select("node").distinct().count() and all(r["max_d"] <= 1 for r in m)


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:10:00", 7), (3, "2024-01-01 02:00:00", 7), (4, "2024-01-01 00:05:00", 8)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["user_id"], r["n"]) for r in events.sessions(df).collect()) == [(7, 1), (7, 2), (8, 1)]
