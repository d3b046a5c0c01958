"""Queries F25 and F33 as streams: the given table read as a stream, state that expires, the result read back from the files it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trees import stored
from ..sources.tables import checkpoint_dir, table
from ..streaming import stateful
from .intent_queries import KINDS
from .registry import query


def turns(spark, d) -> DataFrame:
    path = f"{d}/conversation[s].parquet"  # a pattern, since a stream takes a file, unlike a folder, by a pattern only
    rows = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(path)
    return rows.select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def finished(changes: DataFrame, name: str) -> DataFrame:
    """The rows of a stream that has read all there is; files and state in the shared folder."""
    spark, path = changes.sparkSession, f"{checkpoint_dir(changes.sparkSession)}/{name}-{uuid.uuid4().hex}"
    stateful.start(changes, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{path}/rows")


#: When all sessions start. Time begins after 1970: the first watermark stands there, and rows at a watermark are late.
START = 1_700_000_000

#: Sessions are forgotten 180 seconds after their last turn by a watermark 10 seconds behind the last turn of all.
MEMORY_SQL = """
WITH t AS (SELECT conv_id, turn, max(coalesce(text, '')) AS text, max(CASE WHEN role <> '' THEN role END) AS role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, max(turn) OVER (PARTITION BY conv_id) AS last, max(turn) OVER () AS now FROM t),
m AS (SELECT conv_id AS session_id, count(*) FILTER (k <= 3) AS n, max(turn) AS last_turn, md5(string_agg(text, '|' ORDER BY turn) FILTER (k <= 3)) AS digest, max_by(role, turn) AS last_intent, any_value(last) * 60 + 190 <= any_value(now) * 60 AS gone FROM r GROUP BY 1)
SELECT session_id, CASE WHEN gone THEN 0 ELSE n END AS n, CASE WHEN NOT gone THEN last_turn END AS last_turn, CASE WHEN gone THEN md5('') ELSE digest END AS digest, CASE WHEN NOT gone THEN last_intent END AS last_intent FROM m"""


@query("f25_session_memory_stream", MEMORY_SQL)
def f25_stream(spark, d):
    t = turns(spark, d).withColumns({"at": F.timestamp_seconds(F.expr(f"{START} + turn * 60")), "intent": F.col("role")})
    log = finished(stateful.session_memory(t, 3, 180, "10 seconds"), "memory")
    last = log.groupBy("session_id").agg(F.max_by(F.struct("n", "last_turn", F.md5("texts").alias("digest"), "last_intent"), F.struct("as_of_ms", "version")).alias("m"))
    return last.select("session_id", "m.*")


#: A pause of eleven minutes after every third turn.
AT = f"{START} + turn * 60 + turn div 3 * 600"
FLUSH = -1

PROJECTION_SQL = f"""
WITH e AS (SELECT DISTINCT conv_id AS session_id, turn AS seq, {AT.replace('div', '//')} AS ms, {KINDS} AS kind FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
g AS (SELECT *, CASE WHEN kind IN ('step', 'end') THEN kind END AS mark, CASE WHEN ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms, seq) >= 300 THEN 1 ELSE 0 END AS pause FROM e),
s AS (SELECT *, sum(pause) OVER (PARTITION BY session_id ORDER BY ms, seq) AS part FROM g),
o AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY session_id, part ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lead(seq) OVER (PARTITION BY session_id, part ORDER BY ms, seq) IS NULL AS ends FROM s),
n AS (SELECT session_id, seq, list_concat(list_concat(CASE WHEN mark IS NOT NULL AND before = 'step' THEN ['STEP_FINISHED'] ELSE [] END, [CASE kind WHEN 'start' THEN 'RUN_STARTED' WHEN 'step' THEN 'STEP_STARTED' ELSE 'RUN_FINISHED' END]), CASE WHEN ends AND coalesce(mark, before) = 'step' THEN ['STEP_FINISHED'] ELSE [] END) AS names FROM o)
SELECT session_id, seq, CAST(unnest(range(len(names))) AS INT) AS sub, unnest(names) AS event FROM n"""


@query("f33_event_projection_stream", PROJECTION_SQL)
def f33_stream(spark, d):
    kinds = turns(spark, d).select("session_id", F.timestamp_seconds(F.expr(AT)).alias("at"), F.col("turn").alias("seq"), F.expr(KINDS).alias("kind"))
    end = stored(spark.range(1).select(F.lit(FLUSH).cast("long").alias("session_id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("end").alias("kind")), "flush")
    flush = spark.readStream.schema(end.schema).parquet(end.inputFiles()[0].rsplit("/", 1)[0])
    out = finished(stateful.event_projection(kinds.unionByName(flush), 300, "10 seconds"), "projection")
    return out.filter(F.col("session_id") != FLUSH)
