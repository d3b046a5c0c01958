"""Retrieval: golden order, brute force for the greedy step, edge cases of vectors."""

import numpy as np
from pyspark.sql import functions as F

from loam.functions.vector import cosine
from loam.operators import search as op
from loam.operators import vector_index


def test_rerank_and_cap_give_the_golden_order(spark):
    chunks = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 20)], "chunk_id long, document_id long")
    text = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.8), (4, 0.7)], "chunk_id long, score double")
    vector = spark.createDataFrame([(1, 0.95), (2, 0.9), (3, 0.85), (4, 0.8)], "chunk_id long, score double")
    other = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.9), (4, 0.8)], "chunk_id long, score double")
    both = op.fused(text, vector).join(chunks, "chunk_id")
    assert [r.chunk_id for r in op.document_cap(op.reranked(both, other), 3, 2).orderBy("position").collect()] == [3, 4, 2]
    assert [r.chunk_id for r in op.reranked(both, None).orderBy("position").collect()] == [1, 2, 3, 4]
    assert [r.chunk_id for r in op.reranked(both, other.limit(2)).orderBy("position").collect()] == [1, 2, 3, 4]


def test_bm25_needs_all_words(spark):
    c = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha"), (3, "beta beta beta"), (4, None)], "chunk_id long, text string")
    assert [r.chunk_id for r in op.bm25(c, "alpha beta").collect()] == [1]
    assert [r.chunk_id for r in op.text_rank(c, "the alphas").collect()] in ([1, 2], [2, 1])


def test_index_gives_the_rows_of_the_scan_from_its_terms_buckets(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(words[j % 4] for j in range(i % 7)) + (" rare" if i % 11 == 0 else "")) for i in range(60)] + [(60, None), (61, ""), (62, "alpha " * 500)]
    c = spark.createDataFrame(rows, "chunk_id long, text string")
    op.write_index(c, f"{tmp_path}/index")
    index = op.read_index(spark, f"{tmp_path}/index")
    for query in ("alpha", "beta alpha", "alpha rare", "Alpha alpha BETA", "none", "alpha none"):
        seen = [(r.chunk_id, round(r.score, 9)) for r in op.bm25_indexed(index, query, 10).collect()]
        assert seen == [(r.chunk_id, round(r.score, 9)) for r in op.bm25(c, query, 10).collect()]
        assert bool(seen) == ("none" not in query)
    assert op.bm25_indexed(index, " ").count() == 0
    plan = op.bm25_indexed(index, "alpha rare")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,alpha)" in plan


def test_index_of_no_chunks(spark, tmp_path):
    op.write_index(spark.createDataFrame([(1, None)], "chunk_id long, text string"), f"{tmp_path}/null")
    assert op.bm25_indexed(op.read_index(spark, f"{tmp_path}/null"), "alpha").count() == 0
    op.write_index(spark.createDataFrame([], "chunk_id long, text string"), f"{tmp_path}/none")
    assert op.bm25_indexed(op.read_index(spark, f"{tmp_path}/none"), "alpha").count() == 0


def test_cosine_edges(spark):
    v = spark.createDataFrame([([0.1, 0.2, 0.3], [0.1, 0.2, 0.3]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def greedy(v, q, k, trade):
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    v, q, picked = unit(v), unit(q), []
    while len(picked) < k:
        left = [i for i in range(len(v)) if i not in picked]
        picked.append(max(left, key=lambda i: (round(trade * (v[i] @ q) - (1 - trade) * max((v[i] @ v[j] for j in picked), default=0.0), 12), -i)))
    return picked


def test_diversity_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(30, 8)), rng.normal(size=8)
    rows = spark.createDataFrame([(1, i, v[i].tolist(), q.tolist(), i) for i in range(30)], "k int, chunk_id long, embedding array<double>, q array<double>, position long")
    got = [r.chunk_id for r in op.diverse(rows, "k", 6, 0.7).orderBy("rank").collect()]
    assert got == greedy(v, q, 6, 0.7)
    holes = rows.withColumn("embedding", F.when(F.col("chunk_id") != 3, F.col("embedding")))
    assert [r.chunk_id for r in op.diverse(holes, "k", 3).orderBy("rank").collect()] == [0, 1, 2]


def test_refresh_changes_only_what_changed(spark):
    f = spark.createDataFrame([(1, "same"), (2, "new")], "id long, text string")
    first = op.refreshed(f.withColumn("text", F.lit("same")), spark.createDataFrame([], "id long, embedding array<double>, embedding_model string, text_hash string"))
    assert [r.id for r in op.stale(f, first, "hash-256").collect()] == [2]
    assert op.refreshed(f, first).count() == 2


def test_vectors_without_a_chunk_take_no_place(spark):
    chunks = spark.createDataFrame([(2, 1, "x"), (3, 1, "y")], "chunk_id long, document_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, embedding array<double>")
    query = spark.createDataFrame([([1.0, 0.0],)], "q array<double>")
    assert {r.chunk_id for r in op.vector_only(chunks, vectors, query, 2).collect()} == {2, 3}


def test_matches_from_an_index(spark, tmp_path):
    catalog = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)] + [(10, [2.0, 0.4])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(5)] + [(9, [-1.0, -1.0])], "query_id long, embedding array<double>")
    vector_index.write_vector_index(catalog, f"{tmp_path}/i", 2, pivots=3)
    got = op.embedding_match(queries, vector_index.open_vector_index(spark, f"{tmp_path}/i"))
    assert sorted((q, m) for q, m, _ in got.collect()) == [(i, i) for i in range(5)]  # 4 and 10 are equal


def covers(words, terms):
    """0.1 / (1 + other words) of each stretch with all terms that holds no shorter one, by trying all."""
    n, out = len(words), []
    holds = lambda a, b: set(terms) <= set(words[a : b + 1])
    for a in range(n):
        for b in range(a, n):
            if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1):
                out.append(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])))
    return sum(out)


def test_rank_by_all_covers(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x", "y"], rng.integers(0, 14))) for _ in range(120)] + ["alpha beta", "alpha x x x x x x x alpha beta", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    for query in ("alpha beta", "the gammas", "alpha gamma beta alpha", "the"):
        terms = sorted({w.rstrip("s") for w in query.split()} - {"the"})
        want = {i: round(covers((t or "").split(), terms), 9) for i, t in enumerate(texts) if terms and set(terms) <= set((t or "").split())}
        got = {r.chunk_id: round(r.score, 9) for r in op.text_rank(df, query, 1000).collect()}
        assert got == want
    best = op.text_rank(df, "alpha beta", 1000).filter("chunk_id = 121").first()
    assert round(best.score, 6) == round(0.1 + 0.0, 6)  # of the second alpha and beta alone: the first alpha's stretch holds it
