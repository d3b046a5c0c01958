"""Titles, lone values and narrow tables against plain Python."""

import random

from pyspark.sql import functions as F

from loam.operators import neighbours as nb

TITLES = ["Average cost by market", "Reach", "Q", "Audience segment", "A long title that says very little about any number at all here", "Click rate - ", "Notes: plan", "Total spend by team and region"]
OTHERS = ["$12.50", "US\n4%", "Source: team", "[TABLE]\nCTR | 4%", "Cost: 12", "", "Spend\n$4"]


def weights(spark, texts):
    x = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.col("text")
    ok = ~nb.is_table(t) & ~nb.is_source(t) & nb.is_descriptor(t) & (nb.title_of(t) != "")
    return {r[0]: (r[1], r[2]) for r in x.select("text", nb.title_of(t), nb.title_weight(nb.title_of(t))).filter(ok).collect()}


def best(page, i, known):
    """The rule as it is told: rings of growing radius, the earlier box of a ring first; then the page from its start."""
    ranked = []
    for radius in range(1, nb.WITHIN + 1):
        for j in (i - radius, i + radius):
            if 0 <= j < len(page) and page[j] in known:
                title, weight = known[page[j]]
                ranked.append((round(weight + max(0.0, nb.NEAR - nb.A_BOX * radius), 6), title))
    for options in (ranked, [(round(known[t][1] + nb.NEAR, 6), known[t][0]) for t in page if t in known]):
        top = max(options, key=lambda o: o[0], default=(-1, None))
        if top[0] >= nb.LEAST:
            return top[1]
    return None


def test_described_equals_rings(spark):
    rng = random.Random(5)
    pages = {(d, p): [rng.choice(TITLES if rng.random() < 0.2 else OTHERS) for _ in range(rng.choice([1, 5, 30]))] for d in range(6) for p in range(3)}
    known = weights(spark, TITLES + OTHERS)
    assert set(known) == set(TITLES)
    rows = [(d, p, i, t) for (d, p), page in pages.items() for i, t in enumerate(page)]
    got = nb.described(spark.createDataFrame(rows, "deck_id long, page int, idx int, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.described_by == best(pages[r.deck_id, r.page], r.idx, known), r
    assert any(r.described_by for r in got) and any(r.described_by is None for r in got)


def test_weights_of_titles(spark):
    got = {t: round(w, 6) for _, (t, w) in weights(spark, TITLES).items()}
    assert got["Average cost"] == 0.24 and got["Click rate"] == 0.5 and got["Q"] == -0.39 and got["Audience segment"] == -0.14


def pairs_of(spark, *texts):
    rows = [(1, 1, i, t) for i, t in enumerate(texts)]
    out = nb.all_pairs(spark.createDataFrame(rows, "deck_id long, page int, idx int, text string"))
    return sorted((r.idx, r.name, r.raw, r.pattern, r.country) for r in out.collect())


def test_patterns(spark):
    assert pairs_of(spark, "Average cost by market", "$12", "US\n4%") == [(1, "Average cost", "$12", "cross_box", None), (2, "Average cost", "4%", "stacked", "US")]
    assert pairs_of(spark, "Source: team", "$12", "US\n4%") == [(2, "US", "4%", "stacked", None)]
    assert pairs_of(spark, "Uplift - grew by 4.5% over 3 weeks") == [(0, "Uplift", "4.5%", "inline_partial", None)]
    assert pairs_of(spark, "[TABLE]\nCTR | 4%\n7% | Open rate\n9% | \n | Win rate") == [(0, "CTR", "4%", "table_pipe", None), (0, "Open rate", "7%", "table_pipe", None), (0, "Win rate", "9%", "table_stacked", None)]


def test_empty_null_and_repeated(spark):
    assert pairs_of(spark, None, "", "x" * 50_000, "Source: $4") == []
    assert pairs_of(spark, "Reach: 4%\nReach: 4%", "Cost: about 5\nCost: 5") == [(0, "Reach", "4%", "inline", None), (1, "Cost", "5", "inline_partial", None)]
    schema = "deck_id long, page int, idx int, text string"
    assert nb.all_pairs(spark.createDataFrame([], schema)).count() == 0
