"""The automaton against one pattern for each label, and what it says of places."""

import random
import re

from loam.functions import catalog
from loam.operators import dictionary as m


def by_patterns(text, phrases):
    """label, start, end by a pattern of all phrases of a label, the longest first."""
    own = {}
    for label, phrase in phrases:
        own.setdefault(label, []).append(phrase)
    out = []
    for label, some in own.items():
        parts = [r"[\s\-]+".join(map(re.escape, re.split(r"[\s\-]+", p.strip()))) for p in sorted(some, key=len, reverse=True)]
        out += [(label, x.start(), x.end()) for x in re.finditer(r"(?i)\b(?:" + "|".join(parts) + r")\b", text)]
    return sorted(out)


def test_same_spans_as_patterns(spark, small):
    phrases = [(e[0], a) for e in catalog.entries() for a in e[4]]
    rnd = random.Random(9)
    words = [w for _, a in phrases for w in a.split()] + ["x", "_", "Rate", "CTR", "-", "  ", "\n", "é", "İ", "cost-per", "12%"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "", "-", "  ", "\n"]) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    machine = m.Phrases(phrases)
    for t in texts:
        assert sorted((label, a, b) for label, _, a, b in machine.spans(t)) == by_patterns(t, phrases), t
    for name in ("documents", "conversations"):
        rows = [r.text for r in spark.read.parquet(f"{small}/{name}.parquet").select("text").collect()]
        joined = [t[:400] + " Click-Through  Rate " + t[400:900] + " cpm" for t in rows if t][:150]
        for t in joined:
            assert sorted((label, a, b) for label, _, a, b in machine.spans(t)) == by_patterns(t, phrases)


def test_scan_as_a_plan(spark):
    df = spark.createDataFrame([(1, "the unique-reach of REACH"), (2, None), (3, ""), (4, "overreach")], "id long, text string")
    got = sorted(tuple(r) for r in m.scanned(df, "id", [("r", "reach"), ("u", "unique reach"), ("r", "unique reach")]).collect())
    assert got == [(1, "r", "reach", "REACH", 20, 25), (1, "r", "unique reach", "unique-reach", 4, 16), (1, "u", "unique reach", "unique-reach", 4, 16)]
    assert m.scanned(df, "id", []).count() == 0


def test_many_phrases_and_size(spark, monkeypatch):
    machine = m.Phrases([(str(i), f"name {i}") for i in range(50_000)])
    assert [x[0] for x in machine.spans("a name 77, name 12345 and name 5000000")] == ["77", "12345"]
    names = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "n string")
    assert sorted(m.phrases_of(names, "n")) == [("a", "a"), ("b", "b")]
    monkeypatch.setattr(m, "MOST", 1)
    try:
        m.phrases_of(names, "n")
    except ValueError:
        return
    raise AssertionError
