"""An index of vectors on disk that answers exact nearest-neighbour questions.

Vectors are made unit vectors and put into the cells of PIVOTS pivots (vectors of the table, by hash of their id), each with its
distance to its cell's pivot. Rows are ranged by (cell, distance) and written by cell, so a large cell is many files, and a file's
statistics tell which distances it has. By the triangle inequality a vector v within r of a query q has |d(q, p) - d(v, p)| <= r for its
pivot p, so a search reads

* the query's home cell first, whose k nearest give a radius (before any is read, the sizes and widths of the cells give one);
* then of the other cells those whose distances can lie within the radius, and of those only that ring.

Both reads are exact: nothing within the radius is left out, and the answer has the rows of a scan. What is compared is counted for each
query (`compared`). Vectors that cluster leave most of the index unread; where all vectors are about as far from each other as from
any pivot, every ring is wide and a search reads nearly everything, as a scan would.

Queries go in blocks of about BLOCK, of one home cell or a few, so what is broadcast doesn't grow with the tables; a block's answers are a
table in the shared folder. Vectors that are null, of other lengths than the index, or of length 0 have no direction and aren't in it;
queries like that find nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import norm, normalised
from ..sources.tables import checkpoint_dir

PIVOTS, BLOCK = 64, 1024
#: Vectors that are held against a block of queries at once.
ROWS = 2000
#: What rounding may take off a distance.
SLACK = 1e-6


class VectorIndex(NamedTuple):
    rows: DataFrame
    cells: list


def units(vectors: DataFrame, dims: int, *keep: str) -> DataFrame:
    """keep and embedding (unit vectors) of the rows that have a direction."""
    return vectors.filter((F.size("embedding") == dims) & (norm(F.col("embedding")) > 0)).select(*keep, normalised(F.col("embedding")).alias("embedding"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)))


def with_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with cell (of the nearest pivot, the first among equals) and distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = apart(matrix(frame["embedding"]), shared.value)
                cell = d.argmin(1)
                yield frame.assign(cell=cell.astype(np.int32), distance=d[np.arange(len(d)), cell])

    kinds = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInPandas(run, f"{kinds}, cell int, distance double")


def write_vector_index(vectors: DataFrame, path: str, dims: int, pivots: int = PIVOTS) -> None:
    """Writes the index of vectors (id, unique, and embedding); the table of its cells comes last and says that it is whole."""
    spark = vectors.sparkSession
    rows = units(vectors, dims, "id")
    chosen = [r.embedding for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    placed = with_cells(rows, np.array(chosen, float).reshape(-1, dims))
    by = ["cell", "distance", "id"]
    placed.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    kind = dict(rows.dtypes)["id"]
    stored = spark.read.schema(f"id {kind}, embedding array<double>, distance double, cell int").parquet(f"{path}/vectors")
    spread = stored.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    names = spark.createDataFrame([(j, [float(x) for x in p]) for j, p in enumerate(chosen)], "cell int, pivot array<double>")
    spread.join(names, "cell").write.mode("overwrite").parquet(f"{path}/cells")


def open_vector_index(spark: SparkSession, path: str, id_type: str = "long") -> VectorIndex | None:
    """The index at path, or None where there is no whole one."""
    try:
        cells = spark.read.schema("cell int, n long, low double, high double, pivot array<double>").parquet(f"{path}/cells").orderBy("cell").collect()  # PIVOTS rows
        rows = spark.read.schema(f"id {id_type}, embedding array<double>, distance double, cell int").parquet(f"{path}/vectors")
    except AnalysisException:
        return None
    return VectorIndex(rows, cells)


def nearest_of(rows: DataFrame, queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """q (number of a query), id and apart of the k nearest of each query in each task, and in a row without an id how many vectors were
    compared; low and high: of each query and cell the distances to the pivot that are looked at."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, low, high))
    kind = dict(rows.dtypes)["id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, lo, hi = shared.value
        best_d, best_i = np.zeros((len(q), 0)), np.zeros((len(q), 0), object)
        compared = np.zeros(len(q), np.int64)
        for frame in (whole.iloc[at : at + ROWS] for whole in frames for at in range(0, len(whole), ROWS)):
            cell, distance, ids = frame["cell"].to_numpy(), frame["distance"].to_numpy(), frame["id"].to_numpy()
            x = matrix(frame["embedding"])
            seen = (distance[None, :] >= lo[:, cell]) & (distance[None, :] <= hi[:, cell])
            some = np.flatnonzero(seen.any(1))
            if not len(some):
                continue
            compared += seen.sum(1)
            d = np.full((len(q), len(ids)), np.inf)
            d[some] = np.where(seen[some], apart(q[some], x), np.inf)
            d = np.concatenate([best_d, d], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(ids.astype(object), (len(q), len(ids)))], axis=1)
            keep = min(d.shape[1], k)
            limit = np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep] + 1e-9  # of equals all stay for now
            d = np.where(d <= limit, d, np.inf)
            width = int(np.isfinite(d).sum(1).max())
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
        at, place = np.nonzero(np.isfinite(best_d))
        yield pd.DataFrame({"q": at.astype(np.int32), "id": best_i[at, place].astype(np.int64 if kind in ("bigint", "int") else object), "apart": best_d[at, place], "compared": 0})
        done = np.flatnonzero(compared)
        yield pd.DataFrame({"q": done.astype(np.int32), "id": pd.array([None] * len(done), "Int64") if kind in ("bigint", "int") else [None] * len(done), "apart": np.nan, "compared": compared[done]})

    return rows.select("id", "embedding", "distance", "cell").mapInPandas(run, f"q int, id {kind}, apart double, compared long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each q over all tasks, the smaller id among equals, with the sum of compared."""
    first = W.partitionBy("q").orderBy(F.round("apart", 9), "id")
    top = found.filter("id is not null").withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    seen = found.groupBy("q").agg(F.sum("compared").alias("compared"))
    return top.drop("compared").join(F.broadcast(seen), "q")  # a block of queries at most


def search(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank, apart (distance of the unit vectors), cosine and compared of the k nearest of each query (query_id, unique, and
    embedding)."""
    spark, kinds = queries.sparkSession, dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, id {dict(index.rows.dtypes)['id']}, rank int, apart double, compared long"
    out = f"{checkpoint_dir(spark)}/nearest-{uuid.uuid4().hex}"
    if index.cells:
        pivots = np.array([c.pivot for c in index.cells])
        number = np.array([c.cell for c in index.cells])
        placed = with_cells(units(queries, pivots.shape[1], "query_id"), pivots)
        homes = placed.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()  # PIVOTS rows
        blocks, size = {}, BLOCK + 1  # (first block, blocks) of each home cell: small cells share one, large ones have many
        count = 0
        for h in homes:
            many = h.n // BLOCK + 1
            if many > 1 or size + h.n > BLOCK:
                blocks[h.cell], count, size = (count, many), count + many, BLOCK if many > 1 else h.n
            else:
                blocks[h.cell], size = (count - 1, 1), size + h.n
        pick = lambda at: F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, b[at])])[F.col("cell")] if blocks else F.lit(1)
        placed.withColumn("block", pick(0) + F.pmod(F.xxhash64("query_id"), pick(1)).cast("int")).write.parquet(f"{out}-queries")
        placed = spark.read.parquet(f"{out}-queries")
        for b in range(count):
            if block := placed.filter(F.col("block") == b).collect():  # about BLOCK rows
                answered(index, pivots, number, block, k, schema).write.parquet(f"{out}/{b}")
    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    except AnalysisException:  # no index, or no queries
        rows = spark.createDataFrame([], schema)
    return rows.withColumn("cosine", 1 - F.col("apart") * F.col("apart") / 2)


def answered(index: VectorIndex, pivots: np.ndarray, number: np.ndarray, block: list, k: int, schema: str) -> DataFrame:
    """The answers of a block of queries; the home of each (cell) is a place in pivots."""
    spark = index.rows.sparkSession
    q = np.array([r.embedding for r in block], float)
    to, home = apart(q, pivots), np.array([r.cell for r in block])
    n, low, high = (np.array([c[x] for c in index.cells], float) for x in ("n", "low", "high"))
    # a radius from the cells alone: so many whole cells, and so wide, hold k vectors
    reach = to + high
    order = reach.argsort(1)
    enough = (n[order].cumsum(1) >= k).argmax(1)
    radius = np.where(n.sum() >= k, reach[np.arange(len(q)), order[np.arange(len(q)), enough]], np.inf)
    width = int(number.max()) + 1
    lo, hi = np.full((len(q), width), np.inf), np.full((len(q), width), -np.inf)

    def rings(near: np.ndarray) -> np.ndarray:
        """Sets the distances that each query looks at in the cells near it; those cells."""
        lo[:], hi[:] = np.inf, -np.inf
        lo[:, number] = np.where(near, to - radius[:, None] - SLACK, np.inf)
        hi[:, number] = np.where(near, to + radius[:, None] + SLACK, -np.inf)
        return np.flatnonzero(near.any(0))

    own = np.zeros((len(q), len(pivots)), bool)
    own[np.arange(len(q)), home] = True
    homes = [int(number[c]) for c in rings(own)]
    path = f"{checkpoint_dir(spark)}/nearest-home-{uuid.uuid4().hex}"
    nearest_of(index.rows.filter(F.col("cell").isin(homes)), q, lo.copy(), hi.copy(), k).write.parquet(path)
    first = spark.read.parquet(path)
    for r in best(first, k).filter(F.col("rank") == k).select("q", "apart").collect():
        radius[r.q] = min(radius[r.q], r.apart)
    near = (to - radius[:, None] - SLACK <= high) & (to + radius[:, None] + SLACK >= low)
    rest = rings(near & ~own)
    found = first
    if len(rest):
        ring = F.lit(False)
        for c in rest:  # PIVOTS conditions at most: folders by cell, row groups by distance
            a, b = float(lo[near[:, c], number[c]].min()), float(hi[near[:, c], number[c]].max())
            ring = ring | ((F.col("cell") == int(number[c])) & (F.col("distance") >= a) & (F.col("distance") <= b))
        found = first.unionByName(nearest_of(index.rows.filter(ring), q, lo.copy(), hi.copy(), k))
    kind = schema.split(",")[0].split(" ", 1)[1]
    names = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(block)], f"q int, query_id {kind}")
    return best(found, k).join(F.broadcast(names), "q").select("query_id", "id", F.col("rank").cast("int").alias("rank"), "apart", "compared")
