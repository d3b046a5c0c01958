"""A full-text index that is kept up to date (C05): segments that never change, rows that say what has gone, and merges by size.

An index is a folder. Each change (`apply`) adds a segment: postings by bucket of their term, the chunks with their number of words,
and the ids of all chunks that it replaces or removes. A posting counts if no later segment names its chunk, so a change costs what it
holds, whatever the index holds. When FAN segments of about one size follow each other they become one, without what has gone
(`merged`): each posting is rewritten a logarithmic number of times.

What makes a change visible is one small file in `log`, numbered by version, that lists the segments and the corpus's counts; it is
created only if no one else has created it, after everything it lists is written. So the index outlives the application, readers never
see half a change, a lost executor's task is run again, and of two writers of one version one gets an error. A stream feeds the index
by `feed`; a batch that comes again is known by its number and left out.

Defined cases: within a change, of rows with one chunk_id one is taken (the largest text) and a null chunk_id is left out; a chunk that
is both changed and removed is changed; removing what isn't there does nothing; a null text is a chunk without words."""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import Index, bucket, postings
from .trees import stored

#: Segments of about one size (within a factor of FAN) that become one.
FAN = 4
#: Ids that come more than once in a change and are broadcast; more of them are joined by a shuffle.
OFTEN = 100_000


class State(NamedTuple):
    """version, segments ({"name", "chunks"}, the oldest first), batches applied (the last, by feed); of the chunks that count their
    number, how many have a text, and their words."""

    version: int
    segments: list
    batches: dict
    chunks: int
    texts: int
    words: int


def file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def state(spark: SparkSession, path: str) -> State:
    """The last version; version 0, without segments, where there is none."""
    fs, log = file_system(spark, f"{path}/log")
    if not fs.exists(log):
        return State(0, [], {}, 0, 0, 0)
    last = max(f.getPath().getName() for f in fs.listStatus(log) if f.getPath().getName().endswith(".json"))
    line = spark.read.text(f"{path}/log/{last}").first().value
    return State(**json.loads(line))


def commit(spark: SparkSession, path: str, new: State) -> None:
    """Makes a version visible; an error if it exists already."""
    fs, file = file_system(spark, f"{path}/log/{new.version:012d}.json")
    out = fs.create(file, False)
    out.write(bytearray((json.dumps(new._asdict()) + "\n").encode()))
    out.close()


def part(spark: SparkSession, path: str, segments: list, name: str, schema: str) -> DataFrame:
    """The rows of a part (postings, chunks, gone) of all segments, with seq: the segment's place."""
    out = spark.createDataFrame([], f"{schema}, seq int")
    for seq, s in enumerate(segments):  # few: FAN for each power of FAN
        out = out.unionByName(spark.read.schema(schema).parquet(f"{path}/{s['name']}/{name}").withColumn("seq", F.lit(seq)))
    return out


def alive(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (chunk_id, seq) that no later segment has replaced or removed."""
    since = gone.groupBy("chunk_id").agg(F.max("seq").alias("since"))
    return rows.join(since, "chunk_id", "left").filter(F.col("since").isNull() | (F.col("seq") >= F.col("since"))).drop("since")


def write_segment(path: str, name: str, terms: DataFrame, chunks: DataFrame, gone: DataFrame) -> None:
    by = ["bucket", "term", "chunk_id"]
    terms.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("bucket").parquet(f"{path}/{name}/postings")
    chunks.write.parquet(f"{path}/{name}/chunks")
    gone.write.parquet(f"{path}/{name}/gone")


SCHEMAS = {"postings": "term string, chunk_id {}, n long, tf long, bucket int", "chunks": "chunk_id {}, n long", "gone": "chunk_id {}"}


def parts(spark: SparkSession, path: str, segments: list, id_type: str) -> dict[str, DataFrame]:
    return {name: part(spark, path, segments, name, schema.format(id_type)) for name, schema in SCHEMAS.items()}


def apply(changed: DataFrame, path: str, removed: DataFrame | None = None, batch: int | None = None, feed_name: str = "") -> None:
    """One change: chunks (chunk_id, text) that come or change, and ids (chunk_id) that go. batch: a number that rises; one that isn't
    above the last is a repeat and does nothing."""
    spark = changed.sparkSession
    before = state(spark, path)
    if batch is not None and batch <= before.batches.get(feed_name, -1):
        return
    kind = dict(changed.dtypes)["chunk_id"]
    rows = changed.filter("chunk_id is not null").select("chunk_id", "text")
    # texts of ids that come once, nearly all, are not shuffled
    often = stored(rows.groupBy("chunk_id").agg(F.count("*").alias("k")).filter("k > 1").select("chunk_id"), "often")
    often = F.broadcast(often) if often.limit(OFTEN + 1).count() <= OFTEN else often
    new = rows.join(often, "chunk_id", "left_anti").unionByName(rows.join(often, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max("text").alias("text")))
    gone = rows.select("chunk_id").distinct()
    if removed is not None:
        gone = gone.unionByName(removed.filter("chunk_id is not null").select(F.col("chunk_id").cast(kind).alias("chunk_id"))).distinct()
    name = f"segment-{uuid.uuid4().hex}"
    terms = postings(new).withColumn("bucket", bucket(F.col("term")))
    write_segment(path, name, terms, new.select("chunk_id", F.when(F.col("text").isNotNull(), F.size(tokens(F.col("text")))).cast("long").alias("n")), gone)
    own = spark.read.schema(SCHEMAS["chunks"].format(kind)).parquet(f"{path}/{name}/chunks")
    totals = F.count("*"), F.count("n"), F.coalesce(F.sum("n"), F.lit(0))
    added, lost = own.agg(*totals).first(), (0, 0, 0)
    if before.segments:
        old = parts(spark, path, before.segments, kind)
        mine = spark.read.schema(SCHEMAS["gone"].format(kind)).parquet(f"{path}/{name}/gone")
        was = alive(old["chunks"].join(mine, "chunk_id", "left_semi"), old["gone"].join(mine, "chunk_id", "left_semi"))
        lost = was.agg(*totals).first()
    batches = before.batches | ({feed_name: batch} if batch is not None else {})
    counts = [b + a - x for b, a, x in zip(before[3:], added, lost)]
    now = State(before.version + 1, [*before.segments, {"name": name, "chunks": added[0]}], batches, *counts)
    commit(spark, path, now)
    merged(spark, path, kind)


def tier(segment: dict) -> int:
    return int(math.log(max(segment["chunks"], 1), FAN))


def merged(spark: SparkSession, path: str, id_type: str = "long") -> None:
    """Makes one of the last FAN segments while they are of one size, or each no larger than the next."""
    while True:
        now = state(spark, path)
        last = now.segments[-FAN:]
        if len(last) < FAN or tier(last[0]) > max(tier(s) for s in last[1:]):
            return
        found = parts(spark, path, last, id_type)
        name = f"segment-{uuid.uuid4().hex}"
        oldest = len(now.segments) == len(last)
        # what has gone still concerns older segments, if there are any
        gone = found["gone"].select("chunk_id").distinct()
        gone = gone.limit(0) if oldest else gone
        chunks = alive(found["chunks"], found["gone"]).drop("seq")
        write_segment(path, name, alive(found["postings"], found["gone"]).drop("seq"), chunks, gone)
        n = spark.read.schema(SCHEMAS["chunks"].format(id_type)).parquet(f"{path}/{name}/chunks").count()
        commit(spark, path, now._replace(version=now.version + 1, segments=[*now.segments[:-FAN], {"name": name, "chunks": n}]))


def open_index(spark: SparkSession, path: str, id_type: str = "long") -> Index | None:
    """The last version for `search.bm25_indexed`; None where there is no index."""
    now = state(spark, path)
    if not now.version:
        return None
    found = parts(spark, path, now.segments, id_type)
    size = spark.createDataFrame([(now.chunks, now.words / now.texts if now.texts else None)], "__n long, __mean double")
    rows = found["postings"].drop("seq") if len(now.segments) == 1 else alive(found["postings"], found["gone"]).drop("seq")
    return Index(rows, size)


def feed(changes: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """A stream of changes (chunk_id, text, removed: boolean) into the index, a segment for each micro-batch; the query that runs it. Of the
    rows of a batch with one chunk_id, the last by `at` (a rising number or time of the change) counts."""

    def step(rows: DataFrame, batch: int) -> None:
        last = rows.filter("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("text", "removed"), "at").alias("x")).select("chunk_id", "x.*")
        apply(last.filter("not coalesce(removed, false)").select("chunk_id", "text"), path, last.filter("removed").select("chunk_id"), batch, name)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
