import numpy as np
import pytest

from loam.llm import quality as m


@pytest.mark.parametrize("target", ["quality", "toxic"])
def test_labels_go_both_ways(spark, target):
    d = "/root/testdata/sf0.01"
    got = m.models(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))[target]["exchanged"]
    assert len(got) == m.ROUNDS
    text_one, text_zero, meta_one, meta_zero = map(sum, zip(*got))
    assert min(text_one, text_zero, meta_one, meta_zero) > 0


def brute(views, y, rounds, each):
    """The rounds of co-training for two classes of equal share, document by document: the labels that each view ends up with."""
    known = [i for i in range(len(y)) if not np.isnan(y[i])]
    scaled = [(v - v[known].mean(0)) / (v[known].std(0) + 1e-3) for v in views]
    labels = [{i: y[i] for i in known} for _ in views]
    models = [m.fitted(v[known], y[known], np.ones(len(known))) for v in scaled]
    for _ in range(rounds):
        for one, other in ((0, 1), (1, 0)):
            p = [1 / (1 + np.exp(-(x @ models[one][:-1] + models[one][-1]))) for x in scaled[one]]
            for c in (1, 0):
                free = sorted((i for i in range(len(y)) if i not in labels[other]), key=lambda i: (-p[i] if c else p[i], i))
                for i in free[:each]:
                    if (p[i] >= 0.5) if c else (p[i] <= 0.5):
                        labels[other][i] = c
        for k, v in enumerate(scaled):
            on = sorted(labels[k])
            models[k] = m.fitted(v[on], np.array([labels[k][i] for i in on], float), np.array([1.0 if i in known else m.PSEUDO for i in on]))
    return models


def test_rounds_against_brute_force(monkeypatch):
    monkeypatch.setattr(m, "EXCHANGE", 8)
    rnd = np.random.default_rng(7)
    truth = np.arange(120) % 2
    views = [truth[:, None] * 8.0 + rnd.normal(size=(120, n)) for n in (3, 2)]
    y = np.where(np.arange(120) < 20, truth, np.nan).astype(float)
    got = m.co_trained(views, y, np.zeros(120, bool), (10, 10))
    for mine, want in zip(got["weights"], brute(views, y, m.ROUNDS, 4)):
        assert np.allclose(mine, want, atol=1e-6)
    assert got["exchanged"] == [[4, 4, 4, 4]] * m.ROUNDS


def test_rare_labels_are_found_in_large_tables(spark, monkeypatch):
    monkeypatch.setattr(m, "LABELLED", 240)
    rows = [(i, "vile words here " * 9 if i % 97 == 0 else f"good plain words {i} " * 9, "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 97 == 0)) for i in range(4000)] + [(i, 1, 0) for i in range(9000, 9500)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in m.kept(docs, labels).collect()}
    assert kept == {i for i in range(4000) if i % 97}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    hidden = labels.filter("doc_id % 3 = 0")
    got = m.scored(docs, labels.filter("doc_id % 3 <> 0")).join(hidden, "doc_id").collect()
    assert len(got) > 80
    right = sum((r.quality_score >= 0.5) == (r.quality == 1) for r in got)
    assert right / len(got) >= 0.95
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(r.keep for r in clean) / len(clean) >= 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = m.kept(odd, labels)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, 6, 7, None, 8, 9, 10, 11}
    assert m.kept(none, labels).count() == 0 and m.scored(odd, labels.limit(0)).count() == odd.count()


def test_same_scores_again(spark, small):
    a, b = (sorted(map(tuple, m.query(spark, small).collect())) for _ in range(2))
    assert a == b
