"""Trees of JSON and of rows, against plain walks."""

import json
import random

from pyspark.sql import functions as F

from loam.operators import trees


def walked(x, path="$"):
    if isinstance(x, dict):
        yield path, x
        for k, v in x.items():
            yield from walked(v, f"{path}.{k}")
    elif isinstance(x, list):
        yield path, x
        for i, v in enumerate(x):
            yield from walked(v, f"{path}[{i}]")


def made(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return rnd.choice([1, "text", None, True, {}, []])
    if rnd.random() < 0.4:
        return [made(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    out = {k: made(rnd, depth - 1) for k in rnd.sample("abcd", rnd.randrange(4))}
    if rnd.random() < 0.5:
        out |= {k: rnd.randrange(40) for k in rnd.sample(["sheetId", *trees.BOUNDS], rnd.randrange(6))}
    return out


def test_ranges_at_any_depth(spark):
    rnd = random.Random(3)
    docs = [(i, made(rnd, i % 9)) for i in range(150)]
    deep = {"sheetId": 7, "endRowIndex": 3}
    for _ in range(40):
        deep = {"x": [deep]}
    docs += [(200, deep), (201, {"sheetId": 1}), (202, {"startRowIndex": 4}), (203, {"sheetId": 2, "startRowIndex": 5, "inner": {"sheetId": 3, "startColumnIndex": 1}})]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in docs] + [(300, "no json {"), (301, None), (302, "5"), (303, "")], "id long, chart string")
    got = sorted(map(tuple, trees.grid_ranges(df, "chart", "id").collect()))
    want = []
    for i, x in docs:
        for path, g in walked(x):
            if isinstance(g, dict) and "sheetId" in g and any(b in g for b in trees.BOUNDS):
                r, c = g.get("startRowIndex", 0), g.get("startColumnIndex", 0)
                want.append((i, path, g["sheetId"], r, g.get("endRowIndex", r + 1), c, g.get("endColumnIndex", c + 1)))
    assert got == sorted(want) and len(got) > 50
    assert trees.grid_ranges(df.limit(0), "chart", "id").count() == 0


def test_letters_and_ranges(spark):
    def letters(i):
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    numbers = [0, 25, 26, 51, 701, 702, 703, 18277, 18278, 475253, 475254, 2**31 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", trees.column_letters(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in rows} == {n: letters(n) for n in numbers}
    one = spark.range(1).select(trees.a1(F.lit("it's"), *[F.lit(x) for x in (2, 2, 30, 30)]).alias("x")).first().x
    assert one == "'it''s'!AE3:AE3"


def test_ancestry(spark):
    rnd = random.Random(4)
    parent = {i: rnd.choice([None, rnd.randrange(-3, i) if i else None]) for i in range(120)} | {200 + i: 199 + i for i in range(1, 70)} | {200: None, 300: 301, 301: 300, 302: 301, 303: 303}
    rows = [*parent.items(), (None, 5)]
    got = {r.n: (r.root, r.depth) for r in trees.ancestry(spark.createDataFrame(rows, "n long, p long"), "n", "p").collect()}

    def root(n):
        seen, d = set(), 0
        while parent[n] in parent:
            if n in seen:
                return None, None
            seen.add(n)
            n, d = parent[n], d + 1
        return n, d

    assert got == {n: root(n) for n in parent}
    assert trees.ancestry(spark.createDataFrame([], "n long, p long"), "n", "p").count() == 0
