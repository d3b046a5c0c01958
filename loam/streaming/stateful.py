"""Session state that expires in a stream (F24, F25, F33): processors for transformWithStateInPandas with value, list and map state and
timers on event time.

Time is the events' own, moved on by the watermark, so a stream that is run again gives the same rows whatever its batches were. Events
at the watermark or behind it are dropped by Spark, which starts with 1970. Rows without a session, a number or a time are left out (`timed`). State of a session is
bounded: by what is younger than the limit (cache), by the number of turns (memory), by the lateness allowed (projection), and a timer
clears it. The state lives in RocksDB, which these operators need (`start`), so it may outgrow memory and survives lost executors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from .sessions import PROJECTION

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = {kind: name for kind, (name, _) in PROJECTION.items()}
CACHE_SCHEMA = "session_id long, cache_key string, message_id long, cached_ms long, change string"
MEMORY_SCHEMA = "session_id long, as_of_ms long, version long, n long, last_turn long, texts string, last_intent string"
PROJECTION_SCHEMA = "session_id long, seq long, sub int, event string"


def timed(events: DataFrame, late: str, *needed: str) -> DataFrame:
    """Events with at_ms, their time in milliseconds, and a watermark if they are a stream."""
    rows = events.dropna(subset=["session_id", "at", *needed]).withColumn("at_ms", F.unix_millis("at"))
    return rows.withWatermark("at", late) if rows.isStreaming else rows


def with_state(events: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return events.groupBy("session_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def frame(rows: list[tuple], schema: str) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


class MessageCache(StatefulProcessor):
    """The latest message of each cache key of a session. A message expires when it is as old as the limit; an event `invalidate`
    ends all messages of its session that are not younger. Each message put is ended once: replaced, invalidated or expired."""

    def __init__(self, seconds: int):
        self.limit = seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "cache_key string", "cached_ms long, message_id long")
        self.cleared = handle.getValueState("cleared", "at_ms long")

    def ended(self, key: tuple, until: int, change: str) -> list[tuple]:
        old = [(k, m) for k, m in self.entries.iterator() if m[0] <= until]
        for k, _ in old:
            self.entries.removeKey(k)
        return [(key[0], k[0], m[1], m[0], change) for k, m in sorted(old)]

    def handleInputRows(self, key, rows, timerValues):
        events = sorted(
            (int(t), kind != "invalidate", str(k or ""), int(m or 0)) for pdf in rows for t, kind, k, m in zip(pdf["at_ms"], pdf["kind"], pdf["cache_key"], pdf["message_id"])
        )
        out = []
        for at, put, cache_key, message in events:
            cleared = self.cleared.get()[0] if self.cleared.exists() else -1
            if not put:
                self.cleared.update((max(at, cleared),))
                out += self.ended(key, at, "invalidated")
                self.handle.registerTimer(at + self.limit)
                continue
            old = self.entries.getValue((cache_key,)) if self.entries.containsKey((cache_key,)) else None
            if at <= cleared or (old and tuple(old) >= (at, message)):
                continue
            if old:
                out.append((key[0], cache_key, old[1], old[0], "replaced"))
            self.entries.updateValue((cache_key,), (at, message))
            self.handle.registerTimer(at + self.limit)
            out.append((key[0], cache_key, message, at, "put"))
        return frame(out, CACHE_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs() - self.limit
        if self.cleared.exists() and self.cleared.get()[0] <= due:
            self.cleared.clear()
        return frame(self.ended(key, due, "expired"), CACHE_SCHEMA)


def message_cache(events: DataFrame, seconds: int = 180, late: str = "10 seconds") -> DataFrame:
    """Changes of the cache from events (session_id, at, kind 'put' or 'invalidate', cache_key, message_id)."""
    return with_state(timed(events, late, "kind").select("session_id", "at", "at_ms", "kind", "cache_key", F.coalesce("message_id", F.lit(0)).alias("message_id")), MessageCache(seconds), CACHE_SCHEMA)


def cached(changes: DataFrame) -> DataFrame:
    """What a log of changes leaves in the cache: messages put and not ended."""
    keys = ["session_id", "cache_key", "message_id", "cached_ms"]
    return changes.groupBy(*keys).agg(F.count_if(F.col("change") != "put").alias("ends")).filter("ends = 0").drop("ends")


def live_entries(events: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """What the same events leave at a time, as a batch."""
    rows = timed(events, "0 seconds", "kind")
    cleared = rows.filter("kind = 'invalidate'").groupBy("session_id").agg(F.max("at_ms").alias("cleared"))
    puts = rows.filter("kind <> 'invalidate'").join(cleared, "session_id", "left").filter(F.col("cleared").isNull() | (F.col("at_ms") > F.col("cleared")))
    best = puts.groupBy("session_id", F.coalesce("cache_key", F.lit("")).alias("cache_key")).agg(F.max(F.struct("at_ms", F.coalesce("message_id", F.lit(0)).alias("message_id"))).alias("m"))
    return best.filter(F.col("m.at_ms") > F.unix_millis(now) - seconds * 1000).select("session_id", "cache_key", "m.message_id", F.col("m.at_ms").alias("cached_ms"))


class SessionMemory(StatefulProcessor):
    """The last turns of a session and the last intent named in any turn so far; both forgotten after a pause as long as the limit."""

    def __init__(self, most_turns: int, seconds: int):
        self.most, self.limit = most_turns, seconds * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, text string")
        self.about = handle.getValueState("about", "intent_turn long, intent string, at_ms long, version long")

    def handleInputRows(self, key, rows, timerValues):
        kept = {t: x for t, x in self.turns.get()} if self.turns.exists() else {}
        intent_turn, intent, seen, version = self.about.get() if self.about.exists() else (-1, None, 0, 0)
        for pdf in rows:
            for at, turn, text, named in zip(pdf["at_ms"], pdf["turn"], pdf["text"], pdf["intent"]):
                seen = max(seen, int(at))
                kept[int(turn)] = max(kept.get(int(turn), ""), text or "")
                if named and (int(turn), named) > (intent_turn, intent or ""):
                    intent_turn, intent = int(turn), named
        last = sorted(kept.items())[-self.most :]
        self.turns.put(last)
        self.about.update((intent_turn, intent, seen, version + 1))
        self.handle.registerTimer(seen + self.limit)
        return frame([(key[0], seen, version + 1, len(last), last[-1][0], "|".join(x for _, x in last), intent)], MEMORY_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.about.exists():
            _, _, seen, version = self.about.get()
            if seen + self.limit <= expiredTimerInfo.getExpiryTimeInMs():
                self.turns.clear()
                self.about.clear()
                return frame([(key[0], seen + self.limit, version + 1, 0, None, "", None)], MEMORY_SCHEMA)
        return frame([], MEMORY_SCHEMA)


def session_memory(turns: DataFrame, most_turns: int = 3, seconds: int = 180, late: str = "10 seconds") -> DataFrame:
    """The memory of a session after each batch from turns (session_id, at, turn, text, intent); n is 0 when it has been
    forgotten. The greatest (as_of_ms, version) is the memory of today.
    A turn given again counts once; the greater text of two under one number stays."""
    return with_state(timed(turns, late, "turn").select("session_id", "at", "at_ms", "turn", "text", "intent"), SessionMemory(most_turns, seconds), MEMORY_SCHEMA)


class EventProjection(StatefulProcessor):
    """Events wait until the watermark has passed them, so each is projected in its place however it arrived; an event given again is
    projected once. A step that is open closes before the next step and at the end of the run, and a timer closes it after a pause."""

    def __init__(self, idle: int):
        self.idle = idle * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms long, seq long", "kind string")
        self.last = handle.getValueState("last", "at_ms long, seq long, subs int, open boolean")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for at, seq, kind in zip(pdf["at_ms"], pdf["seq"], pdf["kind"]):
                place = (int(at), int(seq))
                old = self.waiting.getValue(place) if self.waiting.containsKey(place) else None
                self.waiting.updateValue(place, (max(kind or "", old[0] if old else ""),))
                self.handle.registerTimer(place[0])
        return frame([], PROJECTION_SCHEMA)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()  # nothing older can come, so all that is due is settled at the first timer
        last_at, last_seq, subs, is_open = self.last.get() if self.last.exists() else (0, 0, 0, False)
        out = []
        for place, (kind,) in sorted((tuple(p), tuple(k)) for p, k in self.waiting.iterator() if p[0] <= now):
            self.waiting.removeKey(place)
            if is_open and place[0] - last_at >= self.idle:
                out.append((key[0], last_seq, subs, "STEP_FINISHED"))
                is_open = False
            subs = 0
            if is_open and kind in ("step", "end"):
                out.append((key[0], place[1], 0, "STEP_FINISHED"))
                subs = 1
            out.append((key[0], place[1], subs, NAMES.get(kind, "CUSTOM")))
            subs, (last_at, last_seq) = subs + 1, place
            is_open = kind == "step" or (is_open and kind != "end")
            if is_open:
                self.handle.registerTimer(last_at + self.idle)
        if is_open and now - last_at >= self.idle:
            out.append((key[0], last_seq, subs, "STEP_FINISHED"))
            is_open = False
        if is_open or any(True for _ in self.waiting.keys()):
            self.last.update((last_at, last_seq, subs, is_open))
        else:
            self.last.clear()
        return frame(out, PROJECTION_SCHEMA)


def event_projection(events: DataFrame, idle: int = 300, late: str = "10 seconds") -> DataFrame:
    """Events (session_id, at, seq, kind) as the interface gets them, in order of (at, seq)."""
    return with_state(timed(events, late, "seq").select("session_id", "at", "at_ms", "seq", "kind"), EventProjection(idle), PROJECTION_SCHEMA)


def projected_with_pauses(events: DataFrame, idle: int = 300) -> DataFrame:
    """What the same events give as a batch, after the last step has closed as well."""
    rows = timed(events, "0 seconds", "seq").groupBy("session_id", "at_ms", "seq").agg(F.max(F.coalesce("kind", F.lit(""))).alias("kind"))
    w = W.partitionBy("session_id").orderBy("at_ms", "seq")
    rows = rows.withColumn("pause", F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) >= idle * 1000, F.lit(True)))
    rows = rows.withColumn("part", F.sum(F.col("pause").cast("int")).over(w))
    p = W.partitionBy("session_id", "part").orderBy("at_ms", "seq")
    mark = F.when(F.col("kind").isin("step", "end"), F.col("kind"))
    rows = rows.withColumns({"before": F.last(mark, ignorenulls=True).over(p.rowsBetween(W.unboundedPreceding, -1)), "after": F.last(mark, ignorenulls=True).over(p.rowsBetween(W.unboundedPreceding, 0)), "ends": F.lead("seq").over(p).isNull()})
    closed = F.array(F.lit("STEP_FINISHED"))
    yes = lambda c, a: F.when(F.coalesce(c, F.lit(False)), a).otherwise(F.array().cast("array<string>"))
    name = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in NAMES.items()], F.lit("CUSTOM"))
    out = F.concat(yes(mark.isNotNull() & (F.col("before") == "step"), closed), F.array(name), yes(F.col("ends") & (F.col("after") == "step"), closed))
    return rows.select("session_id", "seq", F.posexplode(out).alias("sub", "event"))


def start(changes: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to Parquet files until all input there is has been read; the state is kept under checkpoint."""
    spark: SparkSession = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
