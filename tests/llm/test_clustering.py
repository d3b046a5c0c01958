import hashlib
import math
import random

import compare

from loam.llm import clustering as m


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(256 * x) < 2**63 for x in v)]
    by = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=by)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    fits = lambda x: x if x is not None and x < 2**63 else None
    each = {j: [fits(d) for _, c, d in found if c == j] for j in {c for _, c, _ in found}}
    sums = {j: None if None in x else sum(x) for j, x in each.items()}
    whole = None if None in sums.values() else sum(sums.values())
    return sorted(((i, j, fits(d), fits(sums[j]), fits(whole), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([rnd.gauss(i % 4, 0.3), float(rnd.randrange(-2, 3))]) for _ in range(4)]) for i in range(200)]
    rows += [(200, [1.0] * 3), (201, None), (202, [1.0, None, 1.0, 1.0]), (203, [math.nan] * 4), (204, [math.inf, 0.0, 0.0, 0.0]), (205, []), (5, [0.0] * 4), (5, [0.5] * 4), (None, [0.25] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1, 2, [3]) for i, v in rows], "vec_id long, embedding array<double>, label string, cluster int, distance long, v array<int>")
    for k, rounds in ((6, 5), (6, 0), (1, 2), (500, 2)):
        assert got(m.clustered(df.repartition(7), k, rounds, 4)) == brute(rows, k, rounds, 4)
    assert m.clustered(df.limit(0), 3, 2, 4).count() == 0
    assert m.clustered(df.filter("vec_id = 203"), 3, 2, 4).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [s * 2.0**e, float(i)]) for i, (s, e) in enumerate([(1, 18), (-1, 18.9), (1, 19.1), (-1, 25), (1, 40), (1, 54), (-1, 54.5), (1, 0), (1, 60)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 3, 8):
        assert got(m.clustered(df, k, 3, 2)) == brute(rows, k, 3, 2)


def test_equal_vectors_take_the_first_centroid_and_leave_others_empty(spark):
    df = spark.createDataFrame([(i, [1.0] * 64) for i in range(100)], "vec_id long, embedding array<float>")
    rows = m.clustered(df).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in rows} == {(0, 0, 0)} and len(rows) == 100


def test_query_equals_sql(spark, small):
    assert compare.differences(spark, compare.connect(small), m.query, m.SQL, small) == ""
