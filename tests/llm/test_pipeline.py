import hashlib

import corpus_pipeline
from loam.llm import bpe, decontaminate, jaccard_join, quality
from loam.llm.common import written
from test_line_dedup import plain


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, bench = docs.columns, [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    before = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, small), "stage")
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "quality classifier":
            # too few labels of bad documents here, so nothing is learnt, and only documents without words go
            assert {r.doc_id for r in docs.collect()} == {d for d, t in rows if (t or "").split()}
        elif name == "line dedup":
            assert {r.doc_id: r.text for r in docs.collect()} == dict(rows) | plain(rows)
        elif name == "n-gram Jaccard join":
            want = jaccard_join.brute(rows, 5, 80)
            assert {r.doc_id for r in docs.collect()} == {d for d, (_, c) in want.items() if c == d}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert not any(x[-1] for x in decontaminate.brute(rows, bench).values())
    mine = bpe.Encoder(bpe.vocabulary())
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {d: hashlib.sha256(mine.encode(t)).hexdigest() for d, t in rows}


def test_quality_stage_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).select("doc_id").collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()  # most of them learnt from: tests of quality hold some back
    right = [(r.doc_id in kept) == (r.quality == 1 and r.toxic == 0) for r in labels]
    assert sum(right) >= 0.95 * len(right)
    assert all(r.doc_id in kept for r in labels if r.quality == 1 and r.toxic == 0)


def test_odd_rows_in_every_stage(spark, odd, small):
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = texts(odd)
    named = [x for x in rows if x[0] is not None]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, odd, small), "odd")
        got = texts(out)
        assert out.columns == odd.columns, name
        if name == "quality classifier":
            keep = {(r.doc_id, r.text): r.own for r in quality.scored(odd, spark.read.parquet(f"{small}/labels.parquet")).selectExpr("doc_id", "text", "`keep` AS own").collect()}
            assert got == [x for x in rows if keep[x]] and not any((t or "").strip() == "" for _, t in got)
        elif name == "line dedup":
            assert [x for x in got if x[0] is not None] == sorted(((d, (plain(named) | {3: None})[d]) for d, _ in named), key=str)
        elif name == "n-gram Jaccard join":
            want = jaccard_join.brute(named, 5, 80)
            assert got == [x for x in rows if x[0] is None or want[x[0]][1] == x[0]]
        else:
            assert [d for d, _ in got] == [d for d, _ in rows] and (3, None) in got
    last = corpus_pipeline.STAGES[-1][1](spark, odd, small)
    mine = bpe.Encoder(bpe.vocabulary())
    assert sorted(((r.doc_id, r.ids_sha256) for r in last.collect()), key=str) == sorted(((d, hashlib.sha256(mine.encode(t or "")).hexdigest()) for d, t in rows), key=str)


def test_no_rows_in_every_stage(spark, none, small):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, small).count() == 0, name
