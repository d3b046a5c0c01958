"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from loam.sources import tables
from loam.streaming import sessions


def test_memory_stream_equals_batch(spark, small, tmp_path):
    turns = tables.table(spark, small, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text").filter("session_id < 40")
    turns.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got: dict = {}

    def keep(batch, epoch):
        got.update({r.session_id: (r.n, r.last_turn, r.texts) for r in batch.collect()})

    q = sessions.memory_stream(stream, 3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want: dict = {}
    for r in sessions.last_turns(turns, ["session_id"], 3).collect():
        want.setdefault(r.session_id, []).append((r.turn, r.text))
    assert got == {k: (len(v), max(v)[0], "|".join(x for _, x in sorted(v))) for k, v in want.items()}


def test_windows_in_a_stream_equal_batch(spark, small, tmp_path):
    e = tables.table(spark, small, "events")
    e.write.parquet(str(tmp_path / "in"))
    stream = sessions.tumbling(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("loam_windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("loam_windows").collect())) == sorted(map(tuple, sessions.tumbling(e).collect()))


def test_copy_leaves_orphans(spark, tmp_path):
    parents = spark.createDataFrame([(1,)], "id long")
    rows = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, parent long")
    tables.copy_tables({"p": parents, "r": rows}, {"r": [("parent", "p", "id")]}, str(tmp_path))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "r")).collect()) == [1, 3]


def test_json_files_of_a_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.json").write_text('{\n "name": "n"\n}')
    (tmp_path / "a" / "bad.json").write_text("{not json")
    got = tables.read_json(spark, str(tmp_path / "a"), "name string").filter("name is not null").collect()
    assert [r.name for r in got] == ["n"]
