"""Pairs of boxes are found in one pass over the boxes: what is shuffled, and odd pages."""

from loam.operators import boxes as bx

SCHEMA = "deck_id long, page int, idx int, text string"


def shuffles(df) -> tuple[int, int]:
    """Exchanges and joins of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("Join")


def frame(spark, *texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], SCHEMA)


def test_pairs_shuffle_pairs_alone(spark):
    assert shuffles(bx.pairs(frame(spark, "Reach: 4%\nSpend\n$5"))) == (1, 0)
    assert shuffles(bx.table_pairs(frame(spark, "[TABLE]\n | CTR\nUS | 4%"))) == (0, 0)


def test_pairs_of_repeated_and_odd_lines(spark):
    got = sorted((r.idx, r.n, r.name, r.raw, r.pattern) for r in bx.pairs(frame(spark, "Reach: 4%\nReach: 4%", "$5\nSpend", None, "", "Spend\n$5\n$6", ": 5")).collect())
    assert got == [(0, 0, "Reach", "4%", "inline"), (1, 0, "Spend", "$5", "value_first"), (4, 0, "Spend", "$5", "stacked")]


def test_ragged_table(spark):
    rows = bx.table_pairs(frame(spark, "[TABLE]\n | Reach | CPA*\nUS | 7K | $3 | 9\n\nUK | | $4", "[TABLE]", "[TABLE]\n | Reach")).collect()
    assert sorted((r.idx, r.name, r.raw, r.series) for r in rows) == [(0, "CPA", "$3", "US"), (0, "CPA", "$4", "UK"), (0, "Reach", "7K", "US")]
