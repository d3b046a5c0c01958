"""Pairs of neighbours come from one pass over the described boxes, and none twice in a box."""

from loam.operators import neighbours as nb
from test_box_passes import SCHEMA, frame, shuffles


def test_one_shuffle(spark):
    assert shuffles(nb.all_pairs(frame(spark, "Average cost by market", "$12", "US\n4%"))) == (1, 0)


def test_a_page_that_comes_twice(spark):
    rows = [(1, 1, i, t) for _ in range(2) for i, t in enumerate(["Average cost by market", "Reach: 4%"])]
    got = nb.all_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.idx, r.name, r.raw) for r in got] == [(1, "Reach", "4%")]


def test_cells_are_not_taken_for_repeated_pairs(spark):
    b = frame(spark, "[TABLE]\n | Reach | Reach\nUS | 4% | 4%\nUK | 4% | x")
    got = sorted((r.name, r.raw, r.country) for r in nb.with_pairs(b, cells=True).collect())
    assert got == [("Reach", "4%", "UK"), ("Reach", "4%", "US"), ("Reach", "4%", "US")]
