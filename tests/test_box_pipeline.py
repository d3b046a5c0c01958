"""What a name is worth is computed once a kind of pair and broadcast: no task gets all rows of a frequent name."""

from loam.operators import neighbours as nb

BAR = "\n- - - - -\n"


def test_frequent_names_are_not_dealt_to_one_task(spark):
    page = f"<!-- PAGE 1 -->{BAR}Click rate: 4%{BAR}x{BAR}[TABLE]\n | Reach | CPA\nUS | 7K | $3{BAR}"
    out = nb.extracted(spark.createDataFrame([(i, page) for i in range(3)], "deck_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted((r.deck_id, r.name, r.value, r.unit, r.series) for r in out.collect()) == sorted((i, *x) for i in range(3) for x in (("Click rate", 4.0, "percent", None), ("Reach", 7000.0, "count", "US"), ("CPA", 3.0, "currency", "US")))


def test_more_kinds_than_are_broadcast(spark, monkeypatch):
    decks = spark.createDataFrame([(1, f"<!-- PAGE 1 -->{BAR}Click rate: 4%\nSpend: $5{BAR}")], "deck_id long, text string")
    want = sorted(map(tuple, nb.extracted(decks).collect()))
    monkeypatch.setattr(nb, "FEW", 1)
    assert sorted(map(tuple, nb.extracted(decks).collect())) == want and len(want) == 2
