"""The document query API: dispatch, errors in the answer, counts before the limit, facets, tolerant columns."""

from pyspark.sql import functions as F

from loam.operators import catalog_info, docs_api
from loam.operators.facts import bounded
from loam.sources.tables import conformed, empty_to_null


def test_dispatch_counts_before_the_limit_and_reports_errors(spark):
    df = spark.createDataFrame([(i, f"n{i}", None if i % 3 else "x") for i in range(10)], "id int, name string, kind string")
    api = docs_api.QueryApi({"things": (df, "id")})
    got = api.execute({"query_type": "things", "filters": [("id", "gte", 2), ("kind", "is_null", None)], "sort": [("id", "desc")], "limit": 2, "offset": 1, "aggregate_by": "kind"})
    assert got["success"] and got["total_count"] == 5 and [r.id for r in got["rows"].collect()] == [7, 5]
    assert [(r.bucket, r.n) for r in got["buckets"].collect()] == [("unknown", 5)]
    for bad in ({"query_type": "nothing"}, {"query_type": "things", "filters": [("id", "no_such", 1)]}):
        answer = api.execute(bad)
        assert not answer["success"] and answer["error"]


def test_facets_and_within_or(spark):
    f = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "a", "z"), (3, "b", "y")], "document_id int, facet string, value string")
    assert [r.document_id for r in docs_api.by_facets(f, {"a": ["x", "z"], "b": ["y"]}).collect()] == [1, 3]


def test_lists_of_json_and_scalars(spark):
    s = spark.createDataFrame([(1, 1, '["a","b"]'), (1, 2, "c"), (1, 3, None), (1, 4, "  ")], "document_id int, slide_number int, items string")
    assert [(r.slide_number, r.item) for r in docs_api.roll_up(s, "items").orderBy("slide_number", "pos").collect()] == [(1, "a"), (1, "b"), (2, "c")]


def test_absent_columns_and_blank_dates(spark):
    df = spark.createDataFrame([(1, " ")], "id int, start string")
    out = conformed(empty_to_null(df, "start"), {"id": "long", "start": "string", "end": "string"}).first()
    assert (out.id, out.start, out.end) == (1, None, None)


def test_counts_with_a_default(spark):
    df = spark.createDataFrame([("a",), (" a ",), (None,), ("",)], "c string")
    assert [(r.name, r.n) for r in catalog_info.counts_by(df, F.col("c")).collect()] == [("Unknown", 2), ("a", 2)]


def test_a_broadcast_is_checked(spark):
    try:
        bounded(spark.range(5), 4, "rows")
    except ValueError as e:
        assert "4 rows" in str(e)
    else:
        raise AssertionError("five rows are more than four")


def test_tools_stand_on_operators():
    assert len(docs_api.TOOLS) == 17 and {n for n, _ in docs_api.TOOLS.values()} - {"charts"} <= set(dir(docs_api))
