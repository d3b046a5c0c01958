"""The flow over metric names against plain Python over all pairs, and ids of rows that are equal."""

from collections import Counter

import names_brute as brute
import pytest
from pyspark.sql import functions as F

from loam.functions import catalog
from loam.operators import extract, normalize
from loam.plans import normalize_queries
from loam.plans.all import QUERIES


@pytest.fixture(scope="module")
def rows(spark, small):
    return [r.asDict() for r in normalize_queries.named(spark, small).collect()]


def test_ids_of_named_rows(rows):
    assert len({r["id"] for r in rows}) == len(rows) and any(not r["id"].startswith("part/") for r in rows)


def test_pairs_and_clusters_of_all_names(spark, small, rows):
    pairs = brute.similar(rows)
    assert pairs and sorted(map(tuple, QUERIES["e06_similar_pairs"](spark, small).collect())) == sorted(pairs)
    assert dict(map(tuple, QUERIES["e07_components"](spark, small).collect())) == brute.clusters(pairs)


def test_refined_names_of_all_rows(spark, small, rows):
    want = sorted((r["id"], r["name"], r["rounds"]) for r in brute.refined(rows))
    assert sorted(map(tuple, QUERIES["e05_refined_names"](spark, small).collect())) == want and any(x[2] for x in want)


def test_verdicts_of_all_rows(spark, small, rows):
    entries = [(r["name"], r["unit"], r["aliases"]) for r in catalog.frame(spark).collect()]
    want = {x[0]: x[1:] for x in brute.verdicts(rows, entries)}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["e09_verdicts"](spark, small).collect()}
    near = lambda x: (*x[:4], pytest.approx(x[4], abs=2e-6), *x[5:])
    assert set(got) == set(want) and [k for k in want if got[k] != near(want[k])] == []
    assert {x[1] for x in want.values()} >= {"catalog_mapped", "cluster_review", "cluster_auto", "needs_review"}
    count = Counter((x[1], x[5]) for x in want.values())
    assert {(r.status, r.validation): r.n for r in QUERIES["e15_flow_summary"](spark, small).collect()} == count


def test_names_without_words_or_alike(spark):
    names = spark.createDataFrame([("%", []), ("%*", []), ("", []), ("é", []), ("Click Rate", ["count"]), ("click rates", ["count"]), ("Reach", [])], "name string, units array<string>").selectExpr("name", "units", "array() AS context")
    got = {(r.a, r.b) for r in normalize.similar_pairs(names.withColumn("context", F.array().cast("array<string>"))).collect()}
    assert ("%", "%*") in got and not any("" in x or "é" in x or "Reach" in x for x in got)


def test_a_long_chain_is_one_cluster(spark):
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)], "a string, b string")
    assert {r.cluster for r in normalize.clusters(pairs).collect()} == {"n000"}


def test_thresholds_that_words_need_not_meet(spark):
    with pytest.raises(ValueError):
        normalize.similar_pairs(spark.createDataFrame([], "name string, units array<string>, context array<string>"), 0.7)


def test_lines_that_are_equal_have_ids_of_their_own(spark, tmp_path):
    row = (7, 1, 2, 3, 0.05, 0.0, 100.0, 3.0, "N")
    spark.createDataFrame([row, row, row[:1] + (2,) + row[2:]], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["d19_text_links"](spark, str(tmp_path)).collect()
    assert sorted((r.id // 10**7, r.links) for r in got) == [(7, 9)] * 3 and len({r.id for r in got}) == 3


def test_notes_of_a_slide_that_has_several(spark):
    rows = spark.createDataFrame([(1, 1, "Flag: r!"), (2, 1, "other"), (3, 2, ""), (4, 3, None)], "id long, slide_id long, context string")
    notes = spark.createDataFrame([(1, "see flag r here"), (1, "more"), (1, "more"), (2, "x"), (3, "x")], "slide_id long, notes string")
    assert sorted(r.id for r in extract.without_leaks(rows, notes).collect()) == [2, 3, 4]
