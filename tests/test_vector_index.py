"""The vector index against a scan by brute force, and what it leaves unread."""

import numpy as np
import pytest

from loam.operators import vector_index as m


def scan(rows, queries, k):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    good = [(i, unit(v)) for i, v in rows if v is not None and len(v) == len(rows[0][1]) and np.linalg.norm(v) > 0]
    out = {}
    for q, v in queries:
        if v is not None and len(v) == len(rows[0][1]) and np.linalg.norm(v) > 0:
            out[q] = [i for _, i in sorted((round(float(np.linalg.norm(unit(v) - x)), 9), i) for i, x in good)[:k]]
    return out


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("spread", [0.02, 3.0])
def test_rows_of_a_scan(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(m, "BLOCK", 6)
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + spread * rnd.normal(size=6)).tolist()) for i in range(600)]
    rows += [(5000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(6000, None), (6001, [0.0] * 6), (6002, [1.0, 2.0])]
    queries = [(i, v) for i, v in rows if i % 50 == 0] + [(9001, None), (9002, [0.0] * 6), (9003, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    m.write_vector_index(df, f"{tmp_path}/i", 6, pivots=8)
    index = m.open_vector_index(spark, f"{tmp_path}/i")
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    for k in (4, 40):
        found = m.search(index, q, k)
        assert answers(found) == scan(rows, queries, k)
    compared = m.search(index, q, 4).select("query_id", "compared").distinct().toPandas().compared
    assert compared.max() <= 630
    if spread < 1:
        assert compared.mean() < 0.35 * 630  # clusters leave most unread


def test_few_vectors_and_none(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [3.0, 1.0])], "query_id long, embedding array<double>")
    m.write_vector_index(df, f"{tmp_path}/two", 2)
    assert answers(m.search(m.open_vector_index(spark, f"{tmp_path}/two"), q, 5)) == {7: [1, 2]}
    assert m.search(m.open_vector_index(spark, f"{tmp_path}/two"), q.limit(0), 5).count() == 0
    m.write_vector_index(df.limit(0), f"{tmp_path}/none", 2)
    assert m.search(m.open_vector_index(spark, f"{tmp_path}/none"), q, 5).count() == 0
    assert m.open_vector_index(spark, f"{tmp_path}/absent") is None
