"""Queries without SQL take every row of their tables, whatever its id."""

import re
from collections import defaultdict

from loam.operators import extract
from loam.plans import extract_queries
from loam.plans.all import QUERIES


def lineitem(spark, path, orders) -> str:
    rows = [(o, 1, o % 7 + 1, 2, 0.05, 0.0, 100.0 + o, 3.0, "N") for o in orders]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_boxes_of_all_orders(spark, tmp_path):
    orders = [1, 201, 1501, 150_000]
    d = lineitem(spark, tmp_path, orders)
    for name in ("d31_descriptor_resolution", "d34_raw_context", "d47_box_pipeline"):
        assert {r.deck_id // 10**7 for r in QUERIES[name](spark, d).collect()} == set(orders), name


def test_batches_of_all_documents(spark, monkeypatch):
    rows = [(d, 2 * d + i, "count", 1.0) for d in (1, 200, 201, 90_000) for i in (0, 1)]
    monkeypatch.setattr(extract_queries, "facts", lambda spark, d: spark.createDataFrame(rows, "document_id long, fact_id long, unit string, value double"))
    assert {r.fact_id for r in QUERIES["d44_batched_client"](spark, "").collect()} == {2, 400, 402, 180_000}


def test_a_frequent_key_is_dealt_to_buckets(spark, monkeypatch):
    monkeypatch.setattr(extract, "BATCHES", 2)
    rows = [(i, ("a" if i % 3 else None) if i < 90 else "b", [i]) for i in range(100)]
    sizes = spark.sparkContext.accumulator(0)

    def client(batch):
        assert 0 < len(batch) <= 5 and len({r["unit"] for r in batch}) == 1
        sizes.add(1)
        return [i for i, r in enumerate(batch) if r["fact_id"] % 2]

    got = extract.in_batches(spark.createDataFrame(rows, "fact_id long, unit string, batch array<long>"), ["unit"], client, 5)
    assert sorted((r.fact_id, r.unit, r.batch) for r in got.collect()) == [r for r in rows if r[0] % 2]
    assert sizes.value >= 20
    assert extract.in_batches(spark.createDataFrame([], "fact_id long, unit string"), ["unit"], client).collect() == []


def test_alignment_against_all_pairs(spark, small):
    words = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2}
    decks = defaultdict(lambda: ([], []))
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        n = r.doc_id % 500 // 50
        decks[r.doc_id // 500 * 50 + r.doc_id % 50][n >= 5].append((n % 5, words(r.text or "")))
    want = []
    for deck, (pages, slides) in decks.items():
        pairs = sorted((-len(p & s), i, j) for i, p in pages for j, s in slides if p & s)
        while pairs:
            n, i, j = pairs[0]
            want.append((deck, i, j, -n))
            pairs = [x for x in pairs if x[1] != i and x[2] != j]
    assert sorted(map(tuple, QUERIES["d10_page_alignment"](spark, small).collect())) == sorted(want)


def test_alignment_of_all_documents(spark, tmp_path):
    rows = [(3, "alpha beta"), (253, "beta alpha"), (1003, "gamma delta"), (1253, "delta gamma"), (1303, "other words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["d10_page_alignment"](spark, str(tmp_path)).collect())) == [(3, 0, 0, 2), (103, 0, 0, 2)]


def test_mmr_candidates_are_the_nearest_of_all(spark, tmp_path):
    near = {0, 1003, 2001}
    rows = [(i, [1.0, 0.01 * (i % 7)] if i in near else [0.0, 1.0]) for i in [*range(300), 1003, 2001]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    first = {r.query_id: r.chunk_id for r in QUERIES["c15_mmr"](spark, str(tmp_path)).collect() if r.rank == 1}
    assert (first[0], first[1], first[3]) == (0, 2001, 1003)
