import math
from collections import Counter

import duckdb
import numpy as np

from loam.llm import topk_search as m


def brute(rows, k):
    docs = [(d, Counter((t or "").encode().lower().split())) for d, t in rows]
    df = Counter(w for _, c in docs for w in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in docs) / len(docs)
    out = {}
    for q, words in docs:
        if q is not None and q % 50 == 0:
            scores = []
            for d, c in docs:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in words if w in c)
                if s:
                    scores.append((-round(s, 6), d))
            out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, m.query(spark, small).collect())) == sorted(con.execute(m.SQL).fetchall())


def test_small_shards_and_chunks(spark, monkeypatch):
    for k, v in {"SHARD": 7, "CHUNK": 2}.items():
        monkeypatch.setattr(m, k, v)
    rows = [(i, " ".join(f"t{(i * j) % 17}" for j in range(1, 2 + i % 9))) for i in range(230)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for r in m.search(df, df.filter("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == brute(rows, 4)


def test_blocks_are_skipped_unread():
    rnd = np.random.default_rng(3)
    idf = np.concatenate([np.full(20, 6.0), np.full(40, 0.3)])
    rows = []
    for d in range(4096):
        rare = rnd.choice(20, 2, replace=False) if d % 64 == 0 else np.zeros(0, np.int64)
        term = np.unique(np.concatenate([rare, 20 + rnd.choice(40, 20, replace=False)])).astype(np.int64)
        rows.append((d, term, rnd.integers(1, 4, len(term)), 30))
    shard = m.Shard(rows, idf, 30.0)
    words = np.array([0, 1, 2, 30, 31, 32])
    best, tally = m.Best(1, 5), {}
    shard.search(0, words, best, tally)
    norm = m.K1
    full = sorted(((-round(sum(idf[t] * c * 2.2 / (c + norm) for t, c in zip(term.tolist(), tf.tolist()) if t in words), 6), d) for d, term, tf, _ in rows))[:5]
    assert [(-s, d) for s, d in full] == [(float(s), int(d)) for s, d in zip(best.score[0], best.doc[0])]
    assert tally["read"] < tally["all"] / 2 and tally["pivots"] < tally["blocks"] / 2


def test_odd_rows(odd, none):
    q = odd.selectExpr("doc_id AS query_id", "text").filter("query_id IN (3, 4, 8)").distinct()
    got = [(r.query_id, r.doc_id) for r in m.search(odd, q, 5).orderBy("query_id", "rank").collect()]
    assert got == [(8, 8), (8, 9)]
    assert m.search(none, none.selectExpr("doc_id AS query_id", "text")).count() == 0
    # rows with one query_id are one query, and a null one is none
    both = odd.sparkSession.createDataFrame([(1, "one"), (1, "two"), (None, "one")], "query_id long, text string")
    assert [(r.query_id, r.doc_id) for r in m.search(odd, both, 5).orderBy("query_id", "rank").collect()] == [(1, 8), (1, 9)]


def test_limits_from_first_documents(spark, monkeypatch):
    for name, v in {"SHARD": 16, "FIRST": 20, "SHARE": 4, "OFTEN": 3, "MOST": 16, "AT_ONCE": 3}.items():
        monkeypatch.setattr(m, name, v)
    seen = []
    limits = m.first_limits
    monkeypatch.setattr(m, "first_limits", lambda *a: seen.append(limits(*a)) or seen[-1])
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{x}" for x in rnd.zipf(1.3, 1 + i % 40) if x < 300)) for i in range(400)]
    rows += [(i + 400, rows[i % 50][1]) for i in range(100)]  # copies tie
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for r in m.search(df, df.filter("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "text"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert got == {q: x for q, x in brute(rows, 4).items() if x}
    assert len(seen) == 1 and np.isfinite(seen[0].value).any()


def test_few_documents_of_a_whole_document_query_are_read():
    # 40 topics of 200 words, and 30 words that all documents take from
    rnd = np.random.default_rng(4)
    idf = np.concatenate([np.full(8000, 4.0), np.full(30, 0.5)])
    rows = []
    for d in range(4096):
        term = np.sort(np.concatenate([d % 40 * 200 + rnd.choice(200, 40, replace=False), 8000 + rnd.choice(30, 20, replace=False)]))
        rows.append((d, term, np.ones(60, np.int64), 60))
    shard, words = m.Shard(rows, idf, 60.0), rows[7][1]
    full = m.Best(1, 10)
    shard.search(0, words, full)
    tally: dict = {}
    best = m.Best(1, 10, full.score[:, -1] - 1)
    shard.search(0, words, best, tally)
    assert (best.doc == full.doc).all() and (best.score == full.score).all()
    assert tally["pivots"] < tally["blocks"] / 10 and tally["read"] < tally["all"] / 2
