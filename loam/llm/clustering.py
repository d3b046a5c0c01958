"""Operator 12, centroid clustering: plain Lloyd rounds over integer vectors.

A vector is kept if it has exactly `dims` components, none null or not finite, and each becomes the integer floor(256 * x), which must fit
64 bits. Centroids start as the `k` kept vectors with the smallest SHA-256 of `2:<vec_id>`. Each round broadcasts the centroids (k of
them, whatever the table holds); `mapInPandas` computes the squared differences to each centroid in NumPy integers, takes the nearest,
the smaller number among equals, and gives one row of exact sums for each cluster and partition; a group by cluster adds those up, and a
centroid becomes floor(sum / count), an empty one stays. No vector is shuffled, so a cluster that holds most of them is no hot key.

Arithmetic is exact at any size: where components are under 2**27 everything fits 64 bits, else Python's integers are used.

Defined cases: vectors of another length, or with null, infinite or NaN components, or none, are left out; rows that share a vec_id are
vectors of their own, equal hashes start in the order of their components; a null vec_id starts last; fewer than k vectors give as
many centroids; a distance, or a sum of distances, beyond 64 bits is null; an empty table gives no rows; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, table, written

CLUSTERS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Components below this in both vector and centroid: squares of differences, and sums over 64 of them, fit 64 bits.
SMALL = 1 << 27


def scaled(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array<bigint>) of the vectors that are kept."""
    x = F.transform(F.col("embedding"), lambda e: e.cast("double") * scale)
    rows = embeddings.filter(F.size("embedding") == dims).select("vec_id", x.alias("x"))
    good = F.forall("x", lambda e: F.coalesce(F.abs(e) < F.lit(2.0**63), F.lit(False)))
    return rows.filter(good).select("vec_id", F.transform("x", lambda e: F.floor(e)).alias("v"))


def starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest hashes."""
    by = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in vectors.orderBy(by.asc_nulls_last(), "v").limit(k).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, and the squared distance: of 64 bits, or of Python's integers where they may be
    larger."""
    if max(np.abs(x.astype(float)).max(initial=0), np.abs(centroids.astype(float)).max(initial=0)) >= SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
    best, at = None, np.zeros(len(x), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        d = (d * d).sum(axis=1)
        if best is None:
            best = d
        else:
            closer = np.asarray(d < best, bool)
            best = np.where(closer, d, best)
            at[closer] = j
    return at, best


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def partial_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and sums (of each component) of each partition."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        k, dims = shared.value.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for frame in frames:
            if len(frame):
                x = matrix(frame["v"])
                at, _ = nearest(x, shared.value)
                large = np.abs(x.astype(float)).max() >= SMALL
                for j in np.unique(at):
                    own = x[at == j]
                    n[j] += len(own)
                    sums[j] += own.astype(object).sum(axis=0) if large else own.sum(axis=0).astype(object)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "sums": [[Decimal(int(s)) for s in sums[j]] for j in some]})

    return vectors.select("v").mapInPandas(run, "cluster int, n long, sums array<decimal(38,0)>")


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    dims = centroids.shape[1]
    parts = partial_sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in parts.collect():  # one row for each cluster
        out[r.cluster] = [int(s) // r.n for s in r[2:]]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at, distance = nearest(matrix(frame["v"]), shared.value)
                if distance.dtype == object:
                    distance = pd.array([int(d) if d < 1 << 63 else None for d in distance], "Int64")
                yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy(), "cluster": at.astype(np.int32), "distance": distance})

    kind = dict(vectors.dtypes)["vec_id"]
    return vectors.mapInPandas(run, f"vec_id {kind}, cluster int, distance long")


def total(column: str):
    """The sum of a column, null where a value is or where it doesn't fit 64 bits."""
    return F.when(F.count(column) == F.count("*"), F.sum(F.col(column).cast("decimal(38,0)"))).cast("decimal(38,0)")


def clustered(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that is kept."""
    spark = embeddings.sparkSession
    modest_batches(spark)
    vectors = written(scaled(embeddings, dims), "vectors")
    centroids = np.array(starts(vectors, k), np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    rows = written(assigned(vectors, centroids), "assigned")
    names = spark.createDataFrame([(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    inertias = rows.groupBy("cluster").agg(total("distance").alias("c"))
    whole = inertias.agg(F.when(F.count("c") == F.count("*"), F.sum("c")).alias("t"))
    each = inertias.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(whole))  # k rows and one
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", F.col("c").try_cast("long").alias("cluster_inertia"), F.col("t").try_cast("long").alias("inertia"), "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """DuckDB SQL for the same rows, a group of tables for each round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(e::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings
             WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT v, sha256('2:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, j, d FROM (SELECT vec_id, v, j, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, j) AS r
             FROM (SELECT vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i})) WHERE r = 1)""")
        if i < rounds:
            parts.append(f"""m{i} AS MATERIALIZED (SELECT j, list(m ORDER BY p) AS m FROM (SELECT j, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
             FROM (SELECT j, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY j, p)) GROUP BY j)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


SQL = sql()
