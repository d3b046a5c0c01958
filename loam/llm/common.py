"""What the operators of this subpackage share: written intermediate tables, words, hashes, windows."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loam-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder; lineage ends there, and lost executors cost nothing before it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int, size: Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """df (already written) marked for broadcast if it has at most most_rows rows and, where rows vary in size (size: bytes of one),
    at most most_bytes; else as it is, and the join shuffles."""
    if df.limit(most_rows + 1).count() > most_rows:
        return df
    if size is not None and (df.agg(F.sum(size).alias("s")).first().s or 0) > most_bytes:
        return df
    return F.broadcast(df)


#: Keys that hold HOT_FROM rows or more are joined by broadcast, the HOT_KEYS most frequent of them; no other key holds more than
#: that many rows, or a HOT_KEYS-th of all.
HOT_FROM, HOT_KEYS = 1000, 20_000


def hot_keys(keyed: DataFrame, on: list[str]) -> DataFrame:
    """The hot keys of keyed (already written; unique in on; n: rows with the key), written: HOT_KEYS rows at most."""
    return written(keyed.filter(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), *on).limit(HOT_KEYS), "hot-keys")


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keyed (already written; unique in on; n: rows with the key), without n: hot keys by broadcast, the others by a
    shuffle, so that no task gets all rows of a hot key."""
    hot = hot_keys(keyed, on)
    light = keyed.join(F.broadcast(hot.select(on)), on, "left_anti").drop("n")
    there = F.broadcast(hot.drop("n"))
    return rows.join(there, on).unionByName(rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(light, on, how))


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names of our own, which no column of an operator has, and those names by the old ones."""
    own = {c: f"own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def worker_state(key, make: Callable):
    """What make() gave the first time in this process: tables that a Python worker keeps from task to task. The two used last stay."""
    kept = sys.modules.setdefault("_loam_worker_state", types.ModuleType("_loam_worker_state")).__dict__.setdefault("kept", {})
    found = kept.pop(key) if key in kept else make()
    kept[key] = found
    if len(kept) > 2:
        del kept[next(iter(kept))]
    return found


#: Rows that a function of map_arrow gets at once, so that what it holds stays small whatever the session's batches are.
ROWS_AT_ONCE = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def modest_batches(spark: SparkSession) -> None:
    """Long texts: batches of ROWS_AT_ONCE rows between JVM and Python, unless the session asks for fewer."""
    if int(spark.conf.get(BATCH_CONF)) > ROWS_AT_ONCE:
        spark.conf.set(BATCH_CONF, str(ROWS_AT_ONCE))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns by name."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    modest_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, ROWS_AT_ONCE):
                if (cols := f(b.slice(first, ROWS_AT_ONCE))) is not None:
                    yield record_batch(cols, arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, out)


def record_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(s.type) if isinstance(c := cols[s.name], pa.Array) else pa.array(c, s.type) for s in schema], schema=schema)


class WordHash(dict):
    """64-bit hash of a word (bytes), kept for words seen before; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def word_hashes(words: list[bytes], seen: WordHash) -> np.ndarray:
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of k words by one cumulative sum modulo 2**64: a polynomial in an odd base, times a power that makes it independent of the place."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.base, np.uint64)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, self.inverse, np.uint64)]), dtype=np.uint64)

    def __call__(self, w: np.ndarray, k: int) -> np.ndarray:
        n = len(w)
        if n < k:
            return np.zeros(0, np.uint64)
        self.grow(n + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(w * self.down[:n], dtype=np.uint64, out=s[1:])
            return mixed((s[k:] - s[:-k]) * self.up[: n - k + 1])


#: Odd bases of the two independent window hashes.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def list_array(values: np.ndarray, counts: list[int]) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
