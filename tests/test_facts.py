"""The star schema of four decks: facts, scopes, comparison, citations."""

import pytest
from pyspark.sql import functions as F

from loam.operators import facts as op
from loam.sources.star import star_view


@pytest.fixture(scope="module")
def star(spark):
    f = spark.createDataFrame
    clients = f([(1, "Client A"), (2, "Client B"), (3, "Client C")], "id long, name string")
    regions = f([(1, "US", "United States"), (2, "EMEA", "EMEA")], "id long, code string, name string")
    periods = f([(1, "Q1 2025", "quarter", 1, 2025, "2025-01-01", "2025-03-31"), (2, "Q2 2025", "quarter", 2, 2025, "2025-04-01", "2025-06-30"), (3, "Q3 2024", "quarter", 3, 2024, "2024-07-01", "2024-09-30")], "id long, period_label string, period_type string, period_number int, fiscal_year int, start_date string, end_date string")
    documents = f([(10, "a_q2", "/orders/10", 1, 1, "Q2 2025", 2), (11, "b_q2", "/orders/11", 2, 2, "Q2 2025", 2), (12, "c_q1", "/orders/12", 3, 1, "Q1 2025", 1), (13, "a_q1", "/orders/13", 1, 1, "Q1 2025", 1)], "id long, filename string, file_path string, client_id long, region_id long, report_period string, report_period_id long")
    slides = f([(3, 10, 3), (4, 10, 4), (6, 11, 6), (7, 11, 7), (2, 12, 2), (5, 13, 4)], "id long, document_id long, slide_number int")
    catalog = f([(1, "Cost per Acquisition", "cost_per_acquisition"), (2, "Click Through Rate", "click_through_rate"), (3, "Unique Reach", "unique_reach")], "id long, name string, slug string")
    metrics = f([(101, 3, 1, 12.0, "currency", 0.9, 2), (102, 5, 1, 10.0, "currency", 0.9, 1), (103, 6, 2, 1.2, "percent", 0.8, 2), (104, 7, 2, 1.0, "percent", 0.8, 3), (105, 2, 3, 120000.0, "count", 0.7, 1), (106, None, None, None, None, None, None)], "id long, slide_id long, metric_catalog_id long, normalized_value double, unit string, extraction_confidence double, period_id long")
    return star_view(metrics, slides, catalog, documents, clients, regions, periods).persist()


def test_dimensions_are_the_documents(star):
    r = {x.fact_id: x for x in star.collect()}
    assert (r[101].metric_id, r[101].client_name, r[101].region, r[101].period_label) == ("cost_per_acquisition", "Client A", "US", "Q2 2025")
    assert r[104].period_label == "Q2 2025"
    assert r[106].client_name is None and r[101].slide_title is None


def test_compare(star):
    rows = star.filter("metric_id = 'cost_per_acquisition' and client_name = 'Client A'")
    x = op.compare(rows, "metric_id").first()
    assert (x.first, x.second, x.delta, x.pct) == (10.0, 12.0, 2.0, 20.0)


def test_compare_with_zero_and_one_period(spark):
    f = spark.createDataFrame([("a", 0.0, "p1", "2025-01"), ("a", 5.0, "p2", "2025-02"), ("b", 1.0, "p1", "2025-01")], "k string, value double, period_label string, period_end string")
    r = {x.k: x for x in op.compare(f, "k").collect()}
    assert r["a"].pct is None and r["a"].delta == 5.0 and r["b"].first is None


def test_scope_keeps_only_slides_in_range(spark, star):
    ranges = spark.createDataFrame([(10, 3, 4)], "document_id long, start int, end int")
    docs = spark.createDataFrame([(10,)], "document_id long")
    assert [x.slide_id for x in op.in_scope(star, ranges, docs).collect()] == [3]


def test_overlap_is_closed_and_filters_add_up(star):
    hit = op.query_facts(star, period_ranges=[("2025-06-30", "2025-07-01")], client_name="client a")
    assert [x.fact_id for x in hit.collect()] == [101]
    assert op.query_facts(star, region=["NOWHERE"]).count() == 0


def test_relaxation_and_strictness(star):
    tiers = [F.col("client_name") == "Nobody", F.col("region") == "US"]
    assert {x.tier for x in op.relaxed(star, tiers).collect()} == {1}
    assert op.relaxed(star, tiers, strict=True).count() == 0


def test_overall_first(spark):
    f = spark.createDataFrame([(1, "2025-01", None), (2, "2025-01", "Overall"), (3, "2025-02", None)], "fact_id long, period_end string, baseline_type string")
    assert [x.fact_id for x in op.query_facts(f, overall_first=True).collect()] == [3, 2, 1]


def test_half_excludes_the_other_half(spark):
    f = spark.createDataFrame([("H1 2024", "2024-01-01", "2024-07-01"), ("H2 2024", "2024-07-01", "2024-12-31"), ("Q3 2024", "2024-07-01", "2024-09-30")], "period_label string, period_start string, period_end string")
    hit = f.filter(op.explicit_period("half", 2, 2024, "2024-07-01", "2024-12-31"))
    assert {x.period_label for x in hit.collect()} == {"H2 2024", "Q3 2024"}


def test_ambiguity_when_all_scores_are_equal(spark):
    f = spark.createDataFrame([(1, "k", 1), (2, "k", 2)], "fact_id long, k string, slide_number int")
    s = spark.createDataFrame([(1, 0.9), (2, 0.9)], "fact_id long, score double")
    assert {x.ambiguous for x in op.semantic_rerank(f, s, "k").collect()} == {True}


def test_slides_with_missing_or_reversed_ends(spark):
    c = spark.createDataFrame([(1, 10, 5, None), (2, 10, 7, 4), (3, 10, None, None)], "chunk_id long, document_id long, start_slide int, end_slide int")
    f = spark.createDataFrame([(10, 5)], "document_id long, slide_number int")
    assert {x.chunk_id for x in op.slide_overlap(c, f).collect()} == {1, 2}
