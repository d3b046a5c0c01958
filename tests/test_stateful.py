"""State that expires in a stream: late, expired and repeated events give what the batch gives."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from loam.streaming import stateful

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SENTINEL = 10**6


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema, build):
    """Runs the stream with one file a batch and gives the rows it wrote."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        stateful.start(build(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out"))


def test_cache_expires_replaces_and_invalidates(spark, tmp_path):
    schema = "session_id long, at timestamp, kind string, cache_key string, message_id long"
    first = [(1, at(0), "put", "a", 1), (1, at(5), "put", "a", 2), (1, at(5), "put", "a", 2), (1, at(6), "put", None, 9), (2, at(7), "put", "a", 3), (2, at(20), "put", "b", 4), (None, at(1), "put", "a", 5), (3, None, "put", "a", 6)]
    second = [(1, at(4), "put", "a", 7), (1, at(5), "put", "a", 2), (2, at(15), "invalidate", None, None), (2, at(14), "put", "a", 8), (4, at(190), "put", "a", 10)]
    third = [(4, at(100), "put", "b", 11), (4, at(200), "put", "c", 12)]
    log = streamed(spark, tmp_path, [first, second, third], schema, lambda s: stateful.message_cache(s, 180, "30 seconds"))
    got = sorted(map(tuple, stateful.cached(log).collect()))
    # at(100) is behind the watermark of at(190) less 30 seconds, so it was never seen; the watermark at last is at(200) less 30
    seen = spark.createDataFrame(first + second + third[1:], schema)
    want = sorted(map(tuple, stateful.live_entries(seen, F.lit(at(170)), 180).collect()))
    assert got == want and (2, "b", 4) in [r[:3] for r in got] and (2, "a") not in [r[:2] for r in got]
    done = [tuple(r) for r in log.filter("change <> 'put'").select("session_id", "cache_key", "message_id", "change").collect()]
    assert sorted(done) == [(1, "a", 1, "replaced"), (2, "a", 3, "replaced"), (2, "a", 8, "invalidated")]
    more = streamed(spark, tmp_path, [[(4, at(230), "put", "d", 13)], [(4, at(231), "put", "e", 14)]], schema, lambda s: stateful.message_cache(s, 180, "30 seconds"))
    seen = seen.unionByName(spark.createDataFrame([(4, at(230), "put", "d", 13), (4, at(231), "put", "e", 14)], schema))
    want = sorted(map(tuple, stateful.live_entries(seen, F.lit(at(201)), 180).collect()))
    assert sorted(map(tuple, stateful.cached(more).collect())) == want
    assert sorted(r.message_id for r in more.filter("change = 'expired'").collect()) == [2, 4, 9]


def test_memory_keeps_last_turns_and_forgets(spark, tmp_path):
    schema = "session_id long, at timestamp, turn long, text string, intent string"
    batches = [
        [(1, at(0), 0, "p", "trend"), (1, at(1), 1, "q", None), (1, at(1), 1, "q", None), (2, at(2), 0, None, None)],
        [(1, at(3), 3, "s", None), (1, at(2), 2, "r", "compare"), (1, at(3), 3, "s", None), (None, at(3), 1, "x", "x")],
        [(3, at(300), 0, "z", None)],
        [(1, at(301), 9, "t", None)],
    ]
    out = streamed(spark, tmp_path, batches, schema, lambda s: stateful.session_memory(s, 3, 180, "30 seconds"))
    rows = {}
    for r in out.orderBy("as_of_ms", "version").collect():
        rows.setdefault(r.session_id, []).append((r.n, r.last_turn, r.texts, r.last_intent))
    assert rows[1] == [(2, 1, "p|q", "trend"), (3, 3, "q|r|s", "compare"), (0, None, "", None), (1, 9, "t", None)]
    assert rows[2] == [(1, 0, "", None), (0, None, "", None)] and rows[3] == [(1, 0, "z", None)]


def test_projection_in_any_order_equals_batch(spark, tmp_path):
    schema = "session_id long, at timestamp, seq long, kind string"
    events = [(s, at(40 * i + s), i, k) for s in (1, 2, 3) for i, k in enumerate(["start", "step", "chunk", "step", "tool", None, "odd", "end", "step", "chunk"])]
    events += [(4, at(i), n, k) for n, (i, k) in enumerate([(0, "step"), (100, "chunk"), (700, "end"), (701, "step"), (1500, "step")])]
    early, late = [e for i, e in enumerate(events) if i % 3], [e for i, e in enumerate(events) if not i % 3]
    flush = [(SENTINEL, at(100_000), 0, "end")]
    out = streamed(spark, tmp_path, [early, late + early[:7], flush], schema, lambda s: stateful.event_projection(s, 300, "1 hour"))
    got = sorted(tuple(r) for r in out.collect() if r.session_id != SENTINEL)
    batch = sorted(map(tuple, stateful.projected_with_pauses(spark.createDataFrame(events, schema), 300).collect()))
    assert got == batch
    assert [e for s, q, _, e in batch if s == 4] == ["STEP_STARTED", "TEXT_MESSAGE_CONTENT", "STEP_FINISHED", "RUN_FINISHED", "STEP_STARTED", "STEP_FINISHED", "STEP_STARTED", "STEP_FINISHED"]


def test_empty_streams(spark, tmp_path):
    schema = "session_id long, at timestamp, seq long, kind string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
    stateful.start(stateful.event_projection(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert stateful.projected_with_pauses(spark.createDataFrame([], schema)).count() == 0
