"""Labels before values against plain Python."""

import random
import re
from collections import Counter

from loam.operators import labels

SCHEMA = "id long, text string"


def brute(texts, known, least):
    seen = [(i, m) for i, t in texts for part in re.split(r"[\n|;]+", t or "") for m in runs(part)]
    n = Counter(k for _, k in seen)
    n = {k: c for k, c in n.items() if c >= least}
    covered = {k.split(" ", 1)[1] for k in n if " " in k and n.get(k.split(" ", 1)[1]) == n[k]}
    ids = {k: {i for i, x in seen if x == k} for k in n}
    return {k: (c, len(ids[k])) for k, c in n.items() if k not in covered and k not in known and 4 <= len(k) <= 80 and len(re.sub("[^a-z]", "", k)) >= 3 and not re.match(labels.NO_LABEL, k)}


def runs(part):
    words = [w for w in re.split(r"[ \t]+", part) if w and not re.fullmatch(r"[:=-]+", w)]
    for i in range(1, len(words)):
        if re.match(labels.VALUE_WORD, words[i]):
            for k in range(1, min(i, labels.LONGEST) + 1):
                g = " ".join(words[i - k : i])
                if re.match(labels.LABEL_WORDS, g):
                    yield re.sub(r"[:=]+$", "", g).lower()


def test_equal_to_brute_force_and_planted_labels_found(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "of", "the", "x9", "12", "7%", "$3.50", "q1", "FY24", ":", "-", "|", "\n", "ende.", "été"]
    texts = []
    for i in range(300):
        parts = [rng.choice(words) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), f"{rng.choice(words)} click open rate: {rng.randrange(90)}%")
        texts.append((i, " ".join(parts)))
    texts += [(7, texts[7][1]), (400, None), (401, ""), (402, "word " * 20_000 + "cost 5")]
    known = spark.createDataFrame([(" Alpha ",), (None,)], "name string")
    got = {r.key: (r.n, r.texts) for r in labels.discovered(spark.createDataFrame(texts, SCHEMA), known).collect()}
    assert got == brute(texts, {"alpha"}, 2)
    assert "click open rate" in got and "open rate" not in got and "alpha" not in got


def test_hint_and_empty(spark):
    rows = [(1, "Click rate: 5 and tall tower 7"), (2, "click rate 6; tall tower 8")]
    none = spark.createDataFrame([], "name string")
    got = labels.discovered(spark.createDataFrame(rows, SCHEMA), none, hint=True).collect()
    assert [tuple(r) for r in got] == [("click rate", 2, 2, "5", "6")]
    assert labels.discovered(spark.createDataFrame([], SCHEMA), none).count() == 0
