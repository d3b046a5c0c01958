"""Similar names against all pairs by brute force."""

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loam.operators import similar as m


def alike(a, b):
    wa, wb = set(a.split(" ")) - {""}, set(b.split(" ")) - {""}
    share = len(wa & wb) / len(wa | wb) if wa | wb else 0
    return share >= m.SHARE or a in b or b in a or difflib.SequenceMatcher(a=a, b=b).ratio() >= m.RATIO


def made(rnd):
    words = ["impression", "impressions", "click", "clicks", "rate", "rates", "cost", "per", "view", "a", "b", "x1"]
    out = set()
    while len(out) < 220:
        name = " ".join(rnd.choices(words, k=rnd.randrange(1, 4)))
        if rnd.random() < 0.5 and len(name) > 1:
            i = rnd.randrange(len(name))
            name = name[:i] + rnd.choice(["", "s", "q", name[i] * 2]) + name[i + 1 :]
        if name.strip():
            out.add(name.strip())
    out |= {"".join(rnd.choices("abc", k=rnd.randrange(1, 9))) for _ in range(120)} | {"click rate", "clicks rates", "ab" * 60, "ab" * 60 + "c", "é日本", "é日"}
    return sorted(out)


def test_equals_all_pairs(spark):
    names = made(random.Random(11))
    got = {tuple(r) for r in m.similar_pairs(spark.createDataFrame([(n,) for n in names], "a string")).collect()}
    want = {(a, b) for a in names for b in names if a != b and alike(a, b)}
    assert got == want and ("click rate", "clicks rates") in got


@settings(max_examples=3000, deadline=None)
@given(st.text("abcd ", min_size=1, max_size=14), st.text("abcd ", min_size=1, max_size=14))
def test_the_bound_on_pairs_of_characters(a, b):
    """Whatever has the ratio shares the pairs of characters that candidates are drawn from."""
    from collections import Counter

    n = len(a) + len(b)
    if difflib.SequenceMatcher(a=a, b=b).ratio() >= m.RATIO:
        two = lambda x: Counter(x[i : i + 2] for i in range(len(x) - 1))
        assert sum((two(a) & two(b)).values()) >= m.SLOPE * n - 1 - 1e-9


def test_no_names(spark):
    assert m.similar_pairs(spark.createDataFrame([], "a string")).count() == 0


def test_support_of_the_names_of_a_table(spark, small):
    from collections import Counter

    from loam.plans.all import QUERIES

    n = Counter(" ".join(r.p_type.lower().split()) for r in spark.read.parquet(f"{small}/part.parquet").select("p_type").collect())
    want = {a: n[a] + sum(k for b, k in n.items() if a != b and alike(a, b)) for a in n}
    assert {r.name: r.support for r in QUERIES["d33_name_support"](spark, small).collect()} == want
