"""The kept index against one built afresh, by changes, by a stream, and after merges."""

import random

import pytest

from loam.operators import search as op
from loam.operators import segments as m

WORDS = ["alpha", "beta", "gamma", "delta", "rare"]


def rows_of(spark, path):
    return sorted(map(tuple, m.open_index(spark, path).postings.select("term", "chunk_id", "n", "tf").collect()))


def fresh(spark, texts):
    return sorted(map(tuple, op.postings(spark.createDataFrame(list(texts.items()) or [(None, None)], "chunk_id long, text string")).select("term", "chunk_id", "n", "tf").collect()))


def same(spark, path, texts):
    index = m.open_index(spark, path)
    assert rows_of(spark, path) == fresh(spark, texts)
    now = m.state(spark, path)
    assert (now.chunks, now.texts, now.words) == (len(texts), sum(t is not None for t in texts.values()), sum(len((t or "").split()) for t in texts.values()))
    df = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    for query in ("alpha", "beta alpha"):
        assert [(r.chunk_id, round(r.score, 9)) for r in op.bm25_indexed(index, query, 10).collect()] == [(r.chunk_id, round(r.score, 9)) for r in op.bm25(df, query, 10).collect()]


def test_changes_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "FAN", 2)
    rnd, texts, path, seen = random.Random(8), {}, f"{tmp_path}/index", []
    for step, size in enumerate((12, 2, 3, 5)):
        changed = {rnd.randrange(20): rnd.choice([None, " ".join(rnd.choices(WORDS, k=rnd.randrange(6)))]) for _ in range(size)}
        gone = [] if step == 0 else rnd.sample(range(25), 3)
        for c in gone:
            if c not in changed:
                texts.pop(c, None)
        texts |= changed
        m.apply(spark.createDataFrame([*changed.items(), (None, "nobody's")], "chunk_id long, text string"), path, spark.createDataFrame([(c,) for c in gone] + [(None,)], "chunk_id long"))
        seen.append(len(m.state(spark, path).segments))
    same(spark, path, texts)
    assert max(seen) <= 3 and m.state(spark, path).version > 4  # some were merged


def test_repeated_batch_and_two_writers(spark, tmp_path):
    path, one = f"{tmp_path}/index", spark.createDataFrame([(1, "alpha alpha"), (1, "alpha")], "chunk_id long, text string")
    assert m.open_index(spark, path) is None
    m.apply(one, path, batch=0)
    m.apply(one.withColumn("chunk_id", one.chunk_id + 1), path, batch=0)
    assert rows_of(spark, path) == [("alpha", 1, 2, 2)]
    with pytest.raises(Exception, match="exists"):
        m.commit(spark, path, m.state(spark, path))


def test_a_stream_equals_a_fresh_build(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/index"
    batches = [[(1, "alpha beta", False, 1), (2, "alpha", False, 1)], [(1, "beta beta", False, 2), (3, "gamma", False, 2), (3, "delta", False, 3)], [(2, None, True, 4), (9, None, True, 4), (4, "alpha rare", False, 5)]]
    schema = "chunk_id long, text string, removed boolean, at long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # a second run finds nothing new
            stream = spark.readStream.schema(schema).parquet(source)
            q = m.feed(stream, path, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
    same(spark, path, {1: "beta beta", 3: "delta", 4: "alpha rare"})
