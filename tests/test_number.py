"""Rounding against DuckDB, on doubles whose printed decimals end in a half."""

import duckdb
from pyspark.sql import functions as F

from loam.functions.number import rounded


def test_rounded_as_sql_rounds(spark):
    values = [p / 100 * (1 - d / 100) * sign for p in range(90001, 90801) for d in range(0, 11) for sign in (1, -1)] + [1.005, 2.675, 0.0, 1e300, 1e308, 0.005, -0.005]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", rounded(F.col("x"), 2).alias("r")).orderBy("i").collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 2) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [values]).fetchall()]
    assert got == want


def test_what_is_no_number_stays(spark):
    rows = [(1, float("nan")), (2, float("inf")), (3, None)]
    got = {r.i: r.r for r in spark.createDataFrame(rows, "i int, x double").select("i", rounded(F.col("x"), 2).alias("r")).collect()}
    assert got[1] != got[1] and got[2] == float("inf") and got[3] is None
