"""Links of labels and values: what Python functions make of texts is never broadcast, since the planner can't know how much it is."""

from pyspark.sql import functions as F

from loam.operators import extract as op


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_links_are_not_broadcast(spark):
    # a range: the planner knows that it is small
    t = spark.range(1, 4).select("id", F.expr("element_at(array('CTR 5% and Reach: 7K', 'CTR 6%', null), cast(id as int))").alias("text"))
    links = op.text_links(op.label_spans(t), op.value_spans(t), t)
    assert "Broadcast" not in plan_of(links)
    assert sorted((r.id, r.metric_id, r.value) for r in links.collect()) == [(1, "click_through_rate", "5%"), (1, "click_through_rate", "7K"), (1, "reach", "5%"), (1, "reach", "7K"), (2, "click_through_rate", "6%")]


def test_mentions_are_not_broadcast(spark):
    t = spark.range(1, 3).select("id", F.expr("element_at(array('CTR 5% and 7%', 'CTR 9'), cast(id as int))").alias("text"))
    mentions = op.label_spans(t).select("id", F.col("label").alias("metric_id"), F.col("start").alias("at"), F.lit("percent").alias("expected"))
    values = op.value_spans(t).select("id", "raw", F.col("start").alias("value_at"), op.unit_of(F.col("raw")).alias("unit"))
    found = op.scanned(mentions, values)
    assert "Broadcast" not in plan_of(found)
    assert [(r.id, r.raw) for r in found.collect()] == [(1, "5%")]
