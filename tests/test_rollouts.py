"""Live rollouts against the batch reduction, over files of events, with a restart."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlight.operators import control
from gridlight.sources.tables import table
from gridlight.streaming import rollouts

SCHEMA = "event_id long, user_id long, ts timestamp, reward double, success boolean, done boolean"


def live(spark, source, out, checkpoint):
    steps = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    rollouts.drain(rollouts.rollouts(steps, 20), out, checkpoint)
    return spark.read.parquet(out)


@pytest.fixture
def store(spark):
    before = spark.conf.get(rollouts.STORE[0])
    rollouts.prepare(spark)
    yield
    spark.conf.set(rollouts.STORE[0], before)


def test_stream_equals_batch_after_a_restart(spark, data, tmp_path, store):
    e = table(spark, data, "events").where("event_id < 400").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").alias("success"), ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("done"))
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    want = control.truncate(e.withColumn("t", t), ["user_id"], 20)
    want = want.withColumn("ret", F.sum("reward").over(Window.partitionBy("user_id").orderBy("t"))).select("user_id", "t", "success", "done", F.round("ret", 6).alias("ret")).collect()
    rows = e.orderBy("ts", "event_id").toPandas()
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("source", "out", "checkpoint"))

    def arrive(part):
        # rows of a file come in any order
        spark.createDataFrame(part.sample(frac=1, random_state=3), SCHEMA).coalesce(1).write.mode("append").parquet(source)

    for at in (0, 60):
        arrive(rows.iloc[at : at + 60])
    early = {tuple(r) for r in live(spark, source, out, checkpoint).select("user_id", "t", "success", "done", F.round("ret", 6)).collect()}
    assert early and early < {tuple(r) for r in want}
    arrive(rows.iloc[120:])
    far = pd.DataFrame({"event_id": [10**6], "user_id": [10**6], "ts": [rows["ts"].max() + pd.Timedelta(days=1)], "reward": [0.0], "success": [False], "done": [False]})
    arrive(far)  # moves the watermark past all steps
    found = live(spark, source, out, checkpoint).select("user_id", "t", "success", "done", F.round("ret", 6).alias("ret")).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))


def test_odd_rows(spark, tmp_path, store):
    stamp = datetime(2024, 1, 1)
    rows = [(1, 7, stamp, None, None, None), (1, 7, stamp, 2.0, True, False), (2, None, stamp, 1.0, True, True), (3, 7, None, 1.0, True, True), (4, 7, stamp + timedelta(minutes=1), 1.0, False, True), (5, 7, stamp + timedelta(minutes=2), 9.0, True, False)]
    source = f"{tmp_path}/source"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    spark.createDataFrame([(9, 8, stamp + timedelta(days=1), 0.0, False, False)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    found = live(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint").where("user_id = 7").orderBy("t").collect()
    assert [(r.t, r.success, r.done, r.ret) for r in found][1:] == [(1, True, False, 2.0), (2, True, True, 3.0)]
    assert len(found) == 3


def test_what_waits_is_bounded_and_goes_at_its_millisecond(spark, tmp_path, store):
    stamp = datetime(2024, 1, 1)
    rows = [(i, 7, stamp + timedelta(seconds=i % 50, microseconds=i), 1.0, False, False) for i in range(300)]
    kept = rollouts._first(rollouts._packed(pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])), np.zeros(0, rollouts.EPISODE), 20)
    assert kept["event_id"].tolist() == [e for _, e in sorted((r[2], r[0]) for r in rows)][:20]
    # the watermark ends up at 00:10:00; a step a millisecond before it has been passed, one at it has not
    end = timedelta(minutes=10)
    steps = [(1, 1, stamp + end - timedelta(milliseconds=1), 1.0, False, False), (2, 2, stamp + end, 1.0, False, False), (3, 3, stamp + 2 * end, 1.0, False, False)]
    source = f"{tmp_path}/source"
    spark.createDataFrame(steps, SCHEMA).coalesce(1).write.parquet(source)
    assert [(r.user_id, r.t) for r in live(spark, source, f"{tmp_path}/out", f"{tmp_path}/checkpoint").collect()] == [(1, 0)]
