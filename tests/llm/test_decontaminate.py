import random

from loam.llm import decontaminate as m


def case(seed: int):
    rnd = random.Random(seed)
    word = lambda: f"k{rnd.randrange(12)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 9, 10, 11, 25])))) for i in range(2, 14)] + [(0, None), (1, "..."), (20, "K1, k2! K3"), (21, "k1 k2 k3")]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(0, 80)))) for i in range(80)]
    docs += [(100 + i, "pre " + t.upper() + ", post") for i, (_, t) in enumerate(items) if t]
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = case(seed)
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        want = {k: (v[0], v[1], v[2]) for k, v in m.brute(docs, items).items()}
        for words in (10_000, 20):  # one shard, and many
            got = {r.doc_id: (r.n_words, sum(y - x for x, y in zip(r.hits[::2], r.hits[1::2])), len(r.item_ids)) for r in m.hits(d, b, shard_words=words).collect()}
            assert got == want


def test_query_against_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in m.query(spark, small).collect()} == m.brute(docs, items)


def test_cleaned(spark, odd, none):
    b = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(20, 40))), (2, None)], "item_id long, text string")
    out = m.cleaned(odd, b)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == odd.columns and out.count() == odd.count()
    assert "p30 " not in got[1] and got[1].startswith("p0 p1") and got[2].endswith("tail") and got[3] is None and got[4] == ""
    assert m.hits(out, b).filter("size(hits) > 0").count() == 0
    assert m.cleaned(none, b).count() == 0 and m.cleaned(odd, b.limit(0)).count() == odd.count()
    whole = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(20, 40)) + " x", 99)], "doc_id long, text string, n_chars long")
    assert [(r.text, r.n_chars) for r in m.cleaned(whole, b).collect()] == [("", 0)]
