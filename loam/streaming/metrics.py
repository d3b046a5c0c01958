"""Counts of what goes through a pipeline's stages, kept in a table.

Batches are counted by `DataFrame.observe`, in the jobs that run anyway; streams by a listener of their progress. Each line of the table
is one stage of one run, or one micro-batch: run, stage, batch (null for a batch job), rows_in, rows, rejected, seconds, at.

Defined cases: a stage that no action has run has no line; a stage that is run again counts as the first time; rejected is null where
nobody says what that is. A listener's lines wait in memory, LINES at most, and are written when that many are there and at `close`."""

from __future__ import annotations

import datetime
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "run string, stage string, batch long, rows_in long, rows long, rejected long, seconds double, at timestamp"
LINES = 100


def append(spark: SparkSession, path: str, lines: list[tuple]) -> None:
    if lines:
        spark.createDataFrame(lines, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


class Stages:
    """The stages of one run of a batch pipeline."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None):
        self.spark, self.path, self.run = spark, path, run or uuid.uuid4().hex
        self.seen: list[tuple[str, Observation, bool, datetime.datetime]] = []

    def watched(self, df: DataFrame, stage: str, rejected: Column | None = None) -> DataFrame:
        """df, whose rows, and those for which `rejected` holds, are counted when an action runs it."""
        observation = Observation(f"{stage}-{uuid.uuid4().hex}")
        self.seen.append((stage, observation, rejected is not None, now()))
        counts = [F.count(F.lit(1)).alias("rows")] + ([F.count_if(F.coalesce(rejected, F.lit(False))).alias("rejected")] if rejected is not None else [])
        return df.observe(observation, *counts)

    def save(self, done: set[str]) -> None:
        """Writes a line for each stage named in `done`, those whose action has ended; rows_in is what the stage before gave."""
        lines, before = [], None
        for stage, observation, judged, began in self.seen:
            if stage in done:
                got = observation.get
                lines.append((self.run, stage, None, before, got["rows"], got["rejected"] if judged else None, (now() - began).total_seconds(), now()))
                before = got["rows"]
        append(self.spark, self.path, lines)


class StreamCounts(StreamingQueryListener):
    """A line for each micro-batch of every stream of the session that has rows. A stream counts what goes out, and what it rejects, by
    `df.observe(NAME, count(1) AS rows, count_if(...) AS rejected)`; without that only rows_in is known."""

    NAME = "counts"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lines: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        seen = (p.observedMetrics or {}).get(self.NAME)
        of = lambda name: seen[name] if seen is not None and name in seen.asDict() else None
        with self.lock:
            self.lines.append((str(p.runId), p.name or str(p.id), p.batchId, p.numInputRows, of("rows"), of("rejected"), p.batchDuration / 1000, now()))
            full = len(self.lines) >= LINES
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> None:
        with self.lock:
            lines, self.lines = self.lines, []
        append(self.spark, self.path, lines)

    def close(self) -> None:
        """Takes the listener off and writes what waits."""
        self.spark.streams.removeListener(self)
        self.flush()


def observed(stream: DataFrame, rejected: Column) -> DataFrame:
    """A stream whose rows, and those for which `rejected` holds, its listeners are told."""
    return stream.observe(StreamCounts.NAME, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(rejected, F.lit(False))).alias("rejected"))
