import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loam.llm import packing as m

LIBRARY = Tokenizer.from_file(m.vocabulary())
LIBRARY.no_truncation()
LIBRARY.no_padding()
MINE = m.Ids(m.vocabulary())
TEXTS = st.text(st.characters(max_codepoint=0x24F) | st.sampled_from("'’…中文αΣİıẞ́   <|>endoftxs"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_ids_as_the_library(texts):
    texts = [x for t in texts for x in (t, t + "<|endoftext|>" + t)]
    assert MINE.encode(texts) == [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_small_tables(monkeypatch):
    monkeypatch.setattr(m, "WORDS", 5)
    coder, texts = m.Ids(m.vocabulary()), ["one two three, four", "five six seven eight one", "日本 語 日本", None, "one"] * 3
    assert coder.encode(texts) == [np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def held(plan, capacity):
    out = Counter()
    for n, pattern in plan:
        assert n > 0 and sum(x * t for x, t in pattern) <= capacity
        for x, t in pattern:
            out[x] += n * t
    return out


def total(plan):
    return sum(n for n, _ in plan)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 40), max_size=30))
def test_every_piece_once(counts):
    plan = m.planned(counts, 100)
    assert held(plan, 100) == Counter(counts)
    where = m.runs(plan)
    seen = defaultdict(list)
    for x, n in counts.items():
        for number in range(n):
            row = where[x][np.searchsorted(where[x][:, 0], number, side="right") - 1]
            own = number - row[0]
            seen[int(row[1] + own // row[2])].append((int(row[3] + own % row[2] * x), x))
    assert sorted(seen) == list(range(total(plan)))
    for parts in seen.values():
        at = 0
        for offset, x in sorted(parts):
            assert offset == at
            at += x


def test_program_beats_best_fit_where_order_misleads():
    for counts in ({1366: 1000, 1365: 1200, 2049: 900, 700: 1000, 683: 900}, {1500: 1000, 1100: 1000, 900: 1000}):
        assert total(m.planned(counts)) < total(m.fitted([], counts, m.CAPACITY))


def test_close_to_the_bound_and_few_kinds():
    rnd = np.random.default_rng(4)
    lengths = np.minimum(rnd.lognormal(6.3, 1, 200_000).astype(int) + 1, 4096)
    counts = Counter(lengths.tolist())
    plan = m.planned(counts)
    assert held(plan, m.CAPACITY) == counts
    assert total(plan) <= 1.004 * math.ceil(lengths.sum() / m.CAPACITY)
    assert len(plan) < 2 * m.CAPACITY  # bounded by lengths and configurations, not by pieces


def test_knapsack_against_all_choices():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        sizes, profit, most = rnd.integers(1, 12, 3), rnd.random(3), rnd.integers(0, 5, 3)
        found = m.knapsack(sizes, profit, most, 20)
        best = max(a * profit[0] + b * profit[1] + c * profit[2] for a in range(most[0] + 1) for b in range(most[1] + 1) for c in range(most[2] + 1) if a * sizes[0] + b * sizes[1] + c * sizes[2] <= 20)
        assert (found <= most).all() and found @ sizes <= 20 and abs(found @ profit - best) < 1e-9


def check(rows, documents, capacity):
    """rows: of the query; documents: (doc_id, text)."""
    want = []
    for d, t in documents:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for parts in own.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(own)


def test_odd_rows(odd, none, monkeypatch):
    documents = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    monkeypatch.setattr(m, "BUCKET", 3)
    for capacity in (64, 4096):
        check(m.pack(odd, m.vocabulary(), capacity).collect(), documents, capacity)
    assert m.pack(none, m.vocabulary()).count() == 0
    whole = m.sequences(m.pack(odd, m.vocabulary(), 64, with_ids=True)).collect()
    assert all(len(r.ids) <= 64 and sum(p.length for p in r.docs) == len(r.ids) for r in whole)
    long = next(r for r in whole if r.docs[0].doc_id == 6 and r.docs[0].piece == 0)
    assert long.ids == LIBRARY.encode(dict(documents)[6], add_special_tokens=False).ids[:64]


def test_hot_length(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('w ', id), 'a b c') AS text")
    assert check(m.pack(df, m.vocabulary(), 100).collect(), [tuple(r) for r in df.collect()], 100) > 0


def test_query_over_documents(spark, small):
    documents = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = m.query(spark, small).collect()
    n = check(rows, documents, 4096)
    assert n <= 1.01 * math.ceil(sum(r.length for r in rows) / 4096) + 1
