import hashlib
import random

import numpy as np
import pytest

from loam.llm import common, passages, substring_dedup, suffix_dedup


def texts(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(400)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 90)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(shared)
        rows.append((i, " ".join(w)))
    cut = [*shared[3][:60], *[word() for _ in range(10)], *shared[3][30:]]
    return rows + [(60, rows[3][1]), (61, rows[3][1] + " z"), (62, " ".join(["r"] * 200)), (63, " ".join(["r"] * 120)), (64, " ".join(cut))]


def wanted(rows):
    return sorted((d is not None, d or 0, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()) for d, w, g in passages.brute(rows))


def by_sketch(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(df).collect())


def by_suffixes(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, sum(s["to"] - s["from"] for s in r.spans)) for r in suffix_dedup.spans(df).collect())


@pytest.mark.parametrize("seed, hot", [(1, 1000), (2, 3)])
def test_both_against_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(common, "HOT_FROM", hot)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = wanted(rows)
    assert by_sketch(df) == want
    assert by_suffixes(df) == [x[:4] for x in want]


def test_queries_over_documents_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = {x[1]: x[2:] for x in wanted(rows)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.query(spark, small).collect()} == want
    assert {r.doc_id: (r.n_words, r.n_removed) for r in suffix_dedup.query(spark, small).collect()} == {d: x[:2] for d, x in want.items()}


def test_the_sketch_overestimates_windows(spark):
    rows = texts(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counters = np.zeros(1 << 17, np.uint8)
    for r in substring_dedup.sketch(df, 16).filter("kind = 0").collect():
        counters[r.block << 16 : (r.block + 1) << 16] = np.frombuffer(r.counters, np.uint8)
    seen, a, _ = passages.tools()
    h = np.concatenate([a(common.word_hashes(t.encode().split(), seen), 50) for _, t in rows])
    every, counts = np.unique(h, return_counts=True)
    estimates = counters[substring_dedup.cells(every, 16)].min(0)
    assert (estimates >= counts).all() and (estimates == counts).mean() > 0.95 and counts.max() > 2


def test_a_full_sketch_loses_nothing(spark):
    rows = texts(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in substring_dedup.removals(df, max_log2=4).collect()}
    assert gone == {d for d, _, g in passages.brute(rows) if any(g)}


def test_neighbours_extend_to_both_sides(spark):
    rnd = random.Random(9)
    word = lambda: f"v{rnd.randrange(10**6)}"
    shared = [word() for _ in range(200)]
    rows = [(i, " ".join([*[word() for _ in range(60)], *shared, *[word() for _ in range(60)]])) for i in range(6)]
    known = suffix_dedup.classes(df := spark.createDataFrame(rows, "doc_id long, text string"))
    reps = suffix_dedup.representatives(df, known)
    reached = suffix_dedup.reaches(suffix_dedup.suffixes(reps)).selectExpr("*", "0 AS salt")
    got = suffix_dedup.extended(suffix_dedup.contexts(reps, reached)).collect()
    spans = {(r.doc_id, r["first"], r["last"]) for r in got if r.h1 is None}
    for d in range(1, 6):  # the whole passage is found by matches alone
        assert min(a for x, a, _ in spans if x == d) == 60 and max(b for x, _, b in spans if x == d) == 210
    # what is left for the exact step: the first document's windows
    assert {r.doc_id for r in got if r.h1 is not None and 60 <= r["first"] and r["last"] <= 210} == {0}


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = wanted(rows)
    assert by_sketch(odd) == want
    assert by_suffixes(odd) == [x[:4] for x in want]
    for m in (substring_dedup, suffix_dedup):
        out = m.deduplicated(odd)
        assert out.columns == odd.columns and out.count() == odd.count() and m.deduplicated(none).count() == 0
        assert next(r.text for r in out.collect() if r.doc_id is None) is not None


def test_rows_that_share_a_doc_id_but_not_a_text(spark):
    text = lambda c, n=70: " ".join(f"{c}{i}" for i in range(n))
    rows = [(3, text("p")), (5, text("p")), (5, text("q")), (11, text("q") + " more"), (5, text("u")), (5, text("u")), (7, text("u", 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = wanted(rows)
    assert by_sketch(df) == want and by_suffixes(df) == [x[:4] for x in want]
    for m in (substring_dedup, suffix_dedup):
        kept = sorted((r.doc_id, len(r.text)) for r in m.deduplicated(df).collect())
        assert kept == [(3, len(text("p"))), (5, 0), (5, len(text("q"))), (5, len(text("u"))), (5, len(text("u"))), (7, 0), (11, 4)]
