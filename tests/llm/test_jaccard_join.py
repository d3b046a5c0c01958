import random

import numpy as np
import pytest

from loam.llm import jaccard_join as j


def crowd(n: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(60)}"
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(rnd.choice(base) for _ in range(60))) for i in range(20)]
    return rows + [(n + 50, rows[3][1]), (n + 51, rows[3][1].upper())]


def found(df, *a):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in j.components_of(df, *a).collect() if r.doc_id is not None}


def test_cells_give_the_links():
    rnd = random.Random(4)
    base = [np.unique(np.array([rnd.randrange(1 << 60) for _ in range(100)], np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(120):
        s = rnd.choice(base).copy()
        s[rnd.sample(range(100), rnd.randint(0, 14))] = [rnd.randrange(1 << 60) for _ in range(1)][0] + rnd.randrange(1000)
        sets.append(np.unique(s))
    tally: dict = {}
    got = j.divided(sets, 85, tally)
    assert tally["cells"] > 6 and tally["pairs"] < 120 * 119 / 4
    linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    assert all(linked(sets[a], sets[b]) for a, b in got)
    mine, all_ = j.Forest(120), j.Forest(120)
    for a, b in got:
        mine.connect(a, b)
    for a in range(120):
        for b in range(a):
            if linked(sets[a], sets[b]):
                all_.connect(a, b)
    same = lambda f: {frozenset(i for i in range(120) if f.top(i) == t) for t in {f.top(i) for i in range(120)}}
    assert same(mine) == same(all_)


def test_windows_hold_what_the_triangle_inequality_allows():
    # a chain: each links with the next alone, so links cross the borders of cells
    sets = [np.arange(i * 8, i * 8 + 100, dtype=np.uint64) for i in range(40)]
    tally: dict = {}
    forest = j.Forest(40)
    for a, b in j.divided(sets, 85, tally):
        forest.connect(a, b)
    assert len({forest.top(i) for i in range(40)}) == 1 and tally["cells"] > 4 and tally["replicas"] > 0


@pytest.mark.parametrize("leaf, levels, hot, compared", [(512, 2, 64, 4096), (16, 2, 64, 4096), (16, 1, 8, 20)])
def test_crowded_copies_against_brute_force(spark, monkeypatch, leaf, levels, hot, compared):
    for k, v in {"LEAF": leaf, "LEVELS": levels, "HOT_FROM": hot, "COMPARED": compared}.items():
        monkeypatch.setattr(j, k, v)
    rows = crowd(150, 3)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == j.brute(rows)


def test_documents_against_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == j.brute(rows)
    assert found(df, 5, 80) == j.brute(rows, 5, 80)


def test_odd_rows(odd, none, pairs):
    assert found(odd) == j.brute(pairs)
    assert j.components_of(odd).count() == odd.count()
    assert j.components_of(none).count() == 0
    kept = j.one_of_each(odd)
    assert kept.columns == odd.columns and sum(r.doc_id is None for r in kept.collect()) == 1


def test_boundary_of_the_limit(spark):
    words = [f"a{i}" for i in range(103)]  # 100 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:88])), (3, " ".join(words[:87]))]  # 85 and 84 of 100
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == j.brute(rows) and got[2][1] == 1
