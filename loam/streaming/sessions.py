"""Sessions, caches and event streams: bounded memory, expiry, cumulative partials, projection, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live(messages: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """The latest message of each cache key that is younger than the limit; one as old as the limit has expired."""
    latest = messages.groupBy("cache_key").agg(F.max(F.struct("cached_at", "message_id")).alias("m"))
    return latest.select("cache_key", "m.*").filter(F.col("cached_at") > now - F.make_dt_interval(secs=F.lit(seconds)))


def last_turns(turns: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n turns of each session."""
    w = W.partitionBy(*keys).orderBy(F.desc("turn"))
    return turns.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def last_known(turns: DataFrame, keys: list[str], column: str) -> DataFrame:
    """For each turn the last value of the column so far that is not null."""
    w = W.partitionBy(*keys).orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn(f"last_{column}", F.last(column, ignorenulls=True).over(w))


def partials(chunks: DataFrame, channel: str = "answer") -> DataFrame:
    """Each chunk of the channel with all text of its session so far."""
    w = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return chunks.filter(F.col("channel") == channel).withColumn("partial", F.array_join(F.collect_list("text").over(w), ""))


#: Fixed: what each event of a run becomes, and whether it opens or closes a step.
PROJECTION = {"start": ("RUN_STARTED", 1), "step": ("STEP_STARTED", 1), "chunk": ("TEXT_MESSAGE_CONTENT", 0), "tool": ("TOOL_CALL_START", 0), "artifact": ("STATE_SNAPSHOT", 0), "end": ("RUN_FINISHED", -1)}


def projected(events: DataFrame) -> DataFrame:
    """Events as the interface gets them; a new step, or the end, first closes the step that is open."""
    w = W.partitionBy("session_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    open_step = F.last(F.when(F.col("kind").isin("step", "end"), F.col("kind")), ignorenulls=True).over(w)
    rows = events.withColumn("closes", F.col("kind").isin("step", "end") & (open_step == "step"))
    name = F.coalesce(*[F.when(F.col("kind") == k, n) for k, (n, _) in PROJECTION.items()], F.lit("CUSTOM"))
    out = F.when(F.coalesce("closes", F.lit(False)), F.array(F.lit("STEP_FINISHED"), name)).otherwise(F.array(name))
    return rows.select("session_id", "seq", F.posexplode(out).alias("sub", "event"))


def flattened(interactions: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n messages of each session as role and content; a turn's question before its answer; blank ones left out."""
    both = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("user_prompt").alias("content")), F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("agent_response").alias("content")))
    rows = interactions.select(*keys, "turn", F.inline(both)).filter(F.trim("content") != "")
    w = W.partitionBy(*keys).orderBy(F.desc("turn"), F.desc("part"))
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def last_user_message(messages: DataFrame, keys: list[str]) -> DataFrame:
    own = messages.filter((F.col("role") == "user") & (F.trim("text") != ""))
    return own.groupBy(*keys).agg(F.max(F.struct("turn", "text")).alias("m")).select(*keys, F.col("m.text").alias("query"))


def sanitised(text: Column) -> Column:
    """Escaped line breaks undone, inner words replaced, space at the ends gone."""
    out = F.regexp_replace(F.regexp_replace(text, r"\\r?\\n|\\n", "\n"), r"\\t", "\t")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?i)\bchunks?\b", "passage"), r"[ \t]{2,}", " "))


def finished(text: Column, titles: dict[str, str] | None = None) -> Column:
    """An answer without its list of sources; file names become titles, the longest first."""
    out = F.regexp_replace(text, r"(?is)\n+\s*sources?:.*\z", "")
    for name in sorted(titles or {}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(name), F.lit(titles[name]))
    return F.trim(out)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of events by window and type; the watermark bounds the state of a stream, and has no effect on a batch."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    out = e.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: sessions of each user that a gap ends."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    out = e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("string").alias("start"), "n")


def remembering(most_turns: int) -> Callable:
    """For applyInPandasWithState: keeps the last turns of a session and gives them out; its state never holds more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for pdf in batches:
            kept += list(zip(pdf["turn"].tolist(), pdf["text"].tolist()))
        kept = sorted(kept)[-most_turns:]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(kept)], "last_turn": [kept[-1][0]], "texts": ["|".join(x for _, x in kept)]})

    return step


def memory_stream(turns: DataFrame, most_turns: int = 3) -> DataFrame:
    """A stream of (session_id, turn, text) to the memory of each session after each batch."""
    return turns.groupBy("session_id").applyInPandasWithState(remembering(most_turns), "session_id long, n long, last_turn long, texts string", "turns array<bigint>, texts array<string>", "update", GroupStateTimeout.NoTimeout)


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Starts a query that hands every batch to each sink."""

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for sink in sinks.values():
            sink(batch, epoch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
