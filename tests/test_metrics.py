"""Counts of stages and of a stream, as their tables have them."""

import time

from pyspark.sql import functions as F

from loam.plans.all import QUERIES
from loam.streaming import metrics as m


def test_counts_of_the_box_pipeline(spark, small, tmp_path):
    stages = m.Stages(spark, f"{tmp_path}/metrics", "one")
    facts = stages.watched(QUERIES["d47_box_pipeline"](spark, small), "extracted")
    kept = stages.watched(facts.withColumn("low", F.col("confidence") < 0.65), "judged", F.col("low"))
    stages.watched(kept, "never run")
    rows = kept.select("low").collect()
    stages.save({"extracted", "judged"})
    got = {r.stage: (r.run, r.batch, r.rows_in, r.rows, r.rejected) for r in spark.read.parquet(f"{tmp_path}/metrics").collect()}
    assert got == {"extracted": ("one", None, None, len(rows), None), "judged": ("one", None, len(rows), len(rows), sum(bool(r.low) for r in rows))}


def test_counts_of_a_stream(spark, tmp_path):
    rows = [[(i, i % 3) for i in range(10)], [(i, 0) for i in range(5)], [(1, None)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "id long, bad int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.01 * k)
    listener = m.StreamCounts(spark, f"{tmp_path}/metrics")
    spark.streams.addListener(listener)
    stream = spark.readStream.schema("id long, bad int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = m.observed(stream, F.col("bad") > 0).writeStream.queryName("counted").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(100):  # the listener hears of the last batch a little later
        if len(listener.lines) == 3:
            break
        time.sleep(0.1)
    listener.close()
    got = spark.read.parquet(f"{tmp_path}/metrics").filter("stage = 'counted'").collect()
    assert sorted((r.rows_in, r.rows, r.rejected) for r in got) == [(1, 1, 0), (5, 5, 0), (10, 10, 6)]
    assert sorted(r.batch for r in got) == [0, 1, 2]
