"""Extraction, boxes and names on small cases, against plain Python where SQL can't say it."""

import difflib
import itertools

from pyspark.sql import functions as F

from loam.operators import boxes, extract, intent, normalize, similar


def test_values_of_a_line(spark):
    t = spark.createDataFrame([(1, "CTR: 2.5% | Spend $1.2M in 2024"), (2, "Reach 120K, Impressions 3.4M, Budget $2B"), (3, None)], "id long, text string")
    v = extract.value_spans(t).select("id", extract.parsed_number(F.col("raw")).alias("v"), extract.unit_of(F.col("raw")).alias("u"), "raw")
    got = {(r.id, r.v, r.u) for r in v.filter(~extract.noise(F.col("raw"), F.lit(""))).collect()}
    assert got == {(1, 2.5, "percent"), (1, 1.2e6, "currency"), (2, 120000.0, "count"), (2, 3.4e6, "count"), (2, 2e9, "currency")}


def test_labels_of_a_line(spark):
    t = spark.createDataFrame([(1, "CTR and conversion rate")], "id long, text string")
    assert {r.label for r in extract.label_spans(t).collect()} == {"click_through_rate", "conversion_rate"}


def test_resolution_prefers_confidence_then_source(spark):
    rows = [(1, 1, "reach", 5.0, "count", "", 0.5, "table", "unique people"), (2, 1, "unique_reach", 5.0, "count", "", 0.5, "slide", ""), (3, 1, "reach", 5.0, "count", "", 0.9, "notes", "all"), (4, 1, "spend", 1.0, "currency", "", 0.4, "notes", ""), (5, 1, "spend", 1.0, "currency", "", 0.4, "slide", "")]
    f = spark.createDataFrame(rows, "fact_id long, slide int, metric_id string, value double, unit string, quals string, confidence double, source string, snippet string")
    assert {r.fact_id for r in extract.resolved(f).collect()} == {1, 5}


def test_table_orientation(spark):
    got = boxes.table_pairs(boxes.boxes(spark.createDataFrame([(1, "<!-- PAGE 2 -->\n- - - -\n[TABLE]\n | Rate | CostX*\nGroup 1 | 0.57% | $20.5\n- - - -\n")], "deck_id long, text string"))).collect()
    assert {(r.name, r.raw, r.series) for r in got} == {("Rate", "0.57%", "Group 1"), ("CostX", "$20.5", "Group 1")}


def test_greedy_alignment(spark):
    left = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "alpha beta")], "deck int, n int, text string")
    right = spark.createDataFrame([(1, 7, "alpha beta"), (1, 8, "gamma delta")], "deck int, n int, text string")
    assert {(r.page, r.slide) for r in extract.aligned(left, right, "deck").collect()} == {(1, 7)} | set()


def test_maps_merge(spark):
    x = spark.createDataFrame([({"geo": "US", "platform": "iOS"}, {"geo": "EMEA", "audience": ""})], "a map<string,string>, b map<string,string>")
    assert x.select(extract.merged_maps(F.col("a"), F.col("b")).alias("m")).first().m == {"geo": "EMEA", "platform": "iOS"}


def test_similarity_is_the_formula(spark):
    names = ["Click Rate", "click rates", "Cost per Click", "ROS Reach", "Reach"]
    pairs = spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string")
    none = F.array().cast("array<string>")
    got = {(r.a, r.b): r.s for r in pairs.select("a", "b", normalize.similarity(F.col("a"), F.col("b"), none, none, none, none).alias("s")).collect()}

    def plain(a, b):
        a, b = a.lower(), b.lower()
        x, y = set(a.split()), set(b.split())
        s = 0.55 * difflib.SequenceMatcher(a=a, b=b).ratio() + 0.45 * len(x & y) / len(x | y)
        hint = all(any(h in w for h in ("rate", "click", "reach")) for w in (a, b))
        return max(0, min(1, s + 0.03 * hint - 0.22 * (("ros" in x) != ("ros" in y)) + (0.05 if len(x) == len(y) == 1 and a[:3] == b[:3] else 0)))

    assert all(abs(got[k] - plain(*k)) < 1e-9 for k in got)


def test_components_against_union_find(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("m", "n"), ("n", "o"), ("c", "m")]
    got = {r.name: r.cluster for r in normalize.clusters(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**dict.fromkeys("abcmno", "a"), **dict.fromkeys("xy", "x")}


def test_refinement_reaches_a_fixed_point(spark):
    rows = spark.createDataFrame([(1, "d", "Click rate: 12%", ""), (2, "d", "2025", "Win rate: 5%"), (3, "e", "Reach", "")], "id int, deck string, name string, context string")
    assert {r.id: r.name for r in normalize.refined(rows).collect()} == {1: "Click rate", 2: "Win rate", 3: "Reach"}


def test_fuzzy_needs_a_lead(spark):
    x = spark.createDataFrame([("unqiue reach",), ("xyz",), (None,)], "t string").withColumn("c", F.array(F.lit("unique reach"), F.lit("spend")))
    assert [r.b.choice if r.b else None for r in x.select(intent.fuzzy_best("t", "c").alias("b")).collect()] == ["unique reach", None, None]


def test_intents_of_empty_and_null_questions(spark):
    q = spark.createDataFrame([(1, None), (2, ""), (3, "top 5 clicks for Client A in the US by region, Q1 2025")], "qid int, text string")
    aliases = spark.createDataFrame([("clicks", "clicks", 2)], "metric_id string, alias string, priority int")
    clients = spark.createDataFrame([("Client A",)], "client string")
    anchor = F.lit("2025-06-30").cast("date")
    found = intent.resolved(q, aliases, clients, anchor)
    rows = [(r.metric_ids, r.client, r.region, r.period and str(r.period.start), r.aggregation, r.grouping, r.top) for r in found.orderBy("qid").collect()]
    assert rows == [([], None, None, None, None, None, None)] * 2 + [(["clicks"], "Client A", "US", "2024-10-01", None, "by_region", 5)]
    none = found.limit(0)
    assert [(r.client, r.assumptions) for r in intent.overridden(none, found).orderBy("qid").collect()] == [(None, []), (None, []), ("Client A", [])]
    words = spark.createDataFrame([(1, None, ["client a", None], ["US"], [])], "qid int, metrics array<string>, clients array<string>, regions array<string>, periods array<string>")
    done = intent.completed(found, q, words, aliases, clients, anchor).orderBy("qid").collect()
    assert [(r.clients, r.assumptions, r.unresolved) for r in done] == [
        (["Client A"], ["client"], ["metric", "region", "period"]), (None, [], ["metric", "client", "region", "period"]), (["Client A"], [], []),
    ]


def test_cache_forgets_the_oldest():
    c = intent.Cache(2)
    for k in "abac":
        c.get(k) or c.put(k, k)
    assert [c.get(k) for k in "abc"] == ["a", None, "c"]


def test_ratio(spark):
    x = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in x.select(similar.sequence_ratio("a", "b")).collect()] == [difflib.SequenceMatcher(a="abcd", b="bcde").ratio(), 1.0, None]
