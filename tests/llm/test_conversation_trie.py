import hashlib
import random
import zlib
from collections import defaultdict

import compare

from loam.llm import conversation_trie as m


def brute(convs: dict) -> list[tuple]:
    """convs: conv_id -> [(role, text), ...]; rows of the trie."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in own if len(convs[c]) == len(path))
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(children[path]), sum(not children[p] for p in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def in_order(rows) -> dict:
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}


def start_shared(own: dict) -> dict:
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed: int, n: int, words: int):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([f"w{rnd.randrange(words)}", "é日", "", None])) for c in rnd.sample(range(3 * n), n) for t in range(rnd.randrange(1, 9))]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_brute_force(spark, monkeypatch):
    rows = made(1, 60, 2) + [(7000, None, "user", "first"), (7000, 1, "user", "second"), (None, 1, "user", "nobody's"), (8001, 1, "user", "no base")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(in_order(rows))
    assert got(m.trie(m.original(df))) == want
    assert got(m.trie(m.rebuilt(df))) == brute(start_shared(in_order(rows)))
    monkeypatch.setattr(m, "BLOCK", 2)
    monkeypatch.setattr("loam.llm.common.HOT_FROM", 2)
    assert got(m.trie(m.original(df))) == want


def test_hot_turn_and_many_copies(spark):
    rows = [(c, t, "user", "hi" if t < 2 or c % 3 else f"own {c}") for c in range(900) for t in range(3)]
    assert got(m.trie(m.original(spark.createDataFrame(rows, SCHEMA)))) == brute(in_order(rows))


def test_ties_repeats_and_odd_columns(spark):
    """Turns with one number follow each other in one order in all conversations; equal rows are turns of their own."""
    rows = [(c, 1, "user", x) for c in (1, 2) for x in ("a", "b", "b")] + [(3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "b"), (4, 2**40, None, None)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA + ", h1 string, depth int, k int, n int, `group` int, own_from int")
    nodes = {(r.conv_id, r.depth): r for r in m.trie(m.original(df)).collect()}
    assert {k for k in nodes} == {(1, 0), (1, 1), (1, 2), (1, 3), (4, 1)}
    assert nodes[1, 3].n_convs == 3 and nodes[1, 3].ends_sha256 == hashlib.sha256(b"1,2,3").hexdigest()
    assert nodes[1, 0].saved_tokens == 6 and nodes[4, 1].saved_tokens == 0
    assert m.trie(m.original(df.limit(0))).count() == 0 and m.trie(m.rebuilt(df.limit(0))).count() == 0


def test_long_conversation(spark):
    rows = [(5, t, "user", "x" * (t % 7)) for t in range(5000)] + [(6, 0, "user", "")]
    r = m.trie(m.original(spark.createDataFrame(rows, SCHEMA)))
    assert r.count() == 5001 and r.filter("n_convs = 2").count() == 2


def test_query_equals_sql(spark, small):
    assert compare.differences(spark, compare.connect(small), m.query, m.SQL, small) == ""
