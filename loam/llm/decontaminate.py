"""Operator 9, benchmark decontamination: a generalised suffix automaton of the normalised test items, through which every document's words run.

Words: A-Z in lower case, then runs of characters that are not ASCII punctuation, white space or control. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any occurrence of any
window is hit.

Defined cases: a null or wordless text has 0 words and no hit; a null, empty or wordless item has no window; equal items, or items
that share a window, are all named; a null item_id takes part in hits but is not named; an empty benchmark hits nothing, and an empty
`documents` gives no rows. Repeated rows, and rows with one doc_id, are judged each by its own text; a null doc_id stays. Columns of
`documents` other than doc_id and text are ignored by `hits` and kept by `cleaned`.

A very long text is one row of a task, with a few numbers of 8 bytes for each of its words.

The benchmark goes to the executors by broadcast in shards of at most `shard_words` words (or one item), as coded words; each worker
builds a shard's automaton once, in flat arrays of about 100 bytes a word. The driver reads the benchmark shard by shard and holds one.
Each shard beyond the first is one more pass of the same map, over a table that the pass before has written. Documents are never
shuffled.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, list_array, map_arrow, raw_texts, table, worker_state, written

#: Fixed by the contract: bytes that end a word (every byte of a non-ASCII character belongs to a word).
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHARD_WORDS = 10, 500_000
SCHEMA = "n_words long, hits array<int>, item_ids array<string>"


class Automaton:
    """Suffix automaton of several items. A state has a suffix link, its longest length, and its transitions: the first of them in two
    flat arrays, for most states have one only, the others in a table by (state, word). `own` has, for the states that hold windows,
    their lengths and items; `via` leads from a state to the nearest of its suffixes that does."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.word, self.to, self.more, self.branches = array("i", [-1]), array("i", [-1]), {}, {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        self.n_words = max(len(self.vocab), 1)
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self.extend(last, c)
        self.own: dict[int, list[tuple[int, list]]] = {}
        for name, codes in coded:
            size = min(window, len(codes))
            at = matched = 0
            for i, c in enumerate(codes):
                at, matched = self.step(at, matched, c)
                if i + 1 >= size:
                    self.hold(self.holding(at, size), size, name)
        self.via = array("i", [0]) * len(self.link)
        for v in np.argsort(np.array(self.length), kind="stable").tolist():
            self.via[v] = v if v in self.own else self.via[self.link[v]] if v else 0
        self.least = min((min(window, len(c)) for _, c in coded), default=0)
        self.pairs = np.unique(np.array([a * self.n_words + b for _, c in coded for a, b in zip(c, c[1:])] or [-1], np.int64))

    def hold(self, state: int, size: int, name: str | None) -> None:
        for k, names in (held := self.own.setdefault(state, [])):
            if k == size:
                if name not in names[-1:]:
                    names.append(name)
                return
        held.append((size, [name]))

    def after(self, state: int, c: int) -> int:
        """The state that follows, or -1."""
        return self.to[state] if self.word[state] == c else self.more.get(state * self.n_words + c, -1) if self.more else -1

    def lead(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (c, -1):
            self.word[state], self.to[state] = c, to
        else:
            self.more[state * self.n_words + c] = to
            self.branches.setdefault(state, []).append(c)

    def new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.to.append(-1)
        return len(self.link) - 1

    def split(self, p: int, q: int, c: int) -> int:
        """A state for the suffixes of q up to one longer than p, which takes over their transitions."""
        copy = self.new(self.length[p] + 1, self.link[q])
        for w in [x for x in (self.word[q], *self.branches.get(q, ())) if x != -1]:
            self.lead(copy, w, self.after(q, w))
        self.link[q] = copy
        while p != -1 and self.after(p, c) == q:
            self.replace(p, c, copy)
            p = self.link[p]
        return copy

    def replace(self, state: int, c: int, to: int) -> None:
        if self.word[state] == c:
            self.to[state] = to
        else:
            self.more[state * self.n_words + c] = to

    def extend(self, last: int, c: int) -> int:
        q = self.after(last, c)
        if q != -1:
            return q if self.length[q] == self.length[last] + 1 else self.split(last, q, c)
        state, p = self.new(self.length[last] + 1, 0), last
        while p != -1 and self.after(p, c) == -1:
            self.lead(p, c, state)
            p = self.link[p]
        if p != -1:
            q = self.after(p, c)
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self.split(p, q, c)
        return state

    def step(self, at: int, matched: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix read so far that occurs in an item."""
        while (to := self.after(at, c)) == -1 and at:
            at = self.link[at]
            matched = self.length[at]
        return (to, matched + 1) if to != -1 else (0, 0)

    def holding(self, at: int, size: int) -> int:
        while self.length[self.link[at]] >= size:
            at = self.link[at]
        return at

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [from, to) of window occurrences in order of their ends, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if not self.least or len(words) < self.least:
            return spans, items
        get = self.vocab.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        known = codes >= 0
        if self.least > 1:  # a window needs least - 1 adjacent pairs that occur in items
            joined = codes[:-1] * self.n_words + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, joined), len(self.pairs) - 1)
            known = (self.pairs[at] == joined) & known[:-1] & known[1:]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            b += self.least > 1
            if b - a < self.least:
                continue
            state = matched = 0
            for i, c in enumerate(codes[a:b].tolist(), a):
                state, matched = self.step(state, matched, c)
                v = self.via[state]
                while v:
                    for size, names in self.own[v]:
                        if size <= matched:
                            spans.append((i + 1 - size, i + 1))
                            items.update(names)
                    v = self.via[self.link[v]]
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_words(text: str | None) -> list[bytes]:
    return re.findall(WORD, (text or "").encode().lower())


def shards(benchmark: DataFrame, shard_words: int):
    """The items in groups of at most shard_words words (or one item), one group after the other; one without items if there are none."""
    held: list = []
    size, none = 0, True
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = item_words(row.text)
        if words:
            if held and size + len(words) > shard_words:
                yield held
                held, size, none = [], 0, False
            held.append((row.item_id, words))
            size += len(words)
    if held or none:
        yield held


def matcher(spark: SparkSession, items: list, window: int, word: bytes = WORD):
    """From batches with text and what shards before found to the same with this shard's added."""
    sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        machine = worker_state(("automaton", key), lambda: Automaton(sent.value, window))
        find = re.compile(word).findall
        n_words, hits, counts, names = [], [], [], []
        for text, before, also in zip(raw_texts(batch), batch.column("hits").to_pylist(), batch.column("item_ids").to_pylist()):
            words = find(text.lower()) if text else []
            spans, items = machine.match(words)
            spans = merged(spans + list(zip(before[::2], before[1::2])))
            n_words.append(len(words))
            counts.append(2 * len(spans))
            hits += [x for s in spans for x in s]
            names.append(sorted(items.union(also) - {None}))
        return {"n_words": n_words, "hits": list_array(np.array(hits, np.int32), counts), "item_ids": names} | {c: batch.column(c) for c in batch.schema.names if c not in ("n_words", "hits", "item_ids")}

    return run


def found_in(rows: DataFrame, benchmark: DataFrame, window: int, shard_words: int) -> DataFrame:
    """rows (text and more) with n_words, hits and item_ids: a map for each shard, over what the one before has written."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    out = rows.select("*", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("item_ids"))
    for i, items in enumerate(shards(benchmark, shard_words)):
        out = map_arrow(written(out, "matched") if i else out, matcher(rows.sparkSession, items, window), f"{kinds}, {SCHEMA}")
    return out


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, hits (merged spans of hit words as from, to, from, to ...) and item_ids (sorted as strings)."""
    return found_in(documents.select("doc_id", "text"), benchmark, window, shard_words).drop("text")


def cut(text: bytes | None, n_words: int, spans: list[int], max_coverage: float) -> bytes | None:
    """text without the spans of words (from, to, from, to ...); empty if they hold more than max_coverage of its words."""
    if not spans:
        return text
    if sum(b - a for a, b in zip(spans[::2], spans[1::2])) > max_coverage * n_words:
        return b""
    at, kept, last = [m.span() for m in re.finditer(WORD, text.lower())], [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


def cleaned(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """documents with the hit spans cut out of their texts, in the same columns; a text whose words are hit by more than max_coverage becomes empty.

    What is cut reaches from a span's first word to its last word; all other characters stay. n_chars, where there is one, follows the text."""
    own, names = apart(documents)
    found = found_in(own.withColumnRenamed(names["text"], "text"), benchmark, window, shard_words)

    def run(batch: pa.RecordBatch) -> dict:
        texts = [cut(t, n, h, max_coverage) for t, n, h in zip(raw_texts(batch), batch.column("n_words").to_pylist(), batch.column("hits").to_pylist())]
        return {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(texts, pa.binary()).cast(pa.string())}

    out = map_arrow(found, run, ", ".join(f"`{c}` {t}" for c, t in found.dtypes)).withColumnRenamed("text", names["text"])
    if n := names.get("n_chars"):
        out = out.withColumn(n, F.when(F.size("hits") > 0, F.length(names["text"]).cast(dict(own.dtypes)[n])).otherwise(F.col(n)))
    return out.select(*own.columns).toDF(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(sequence(0, size(hits) - 1, 2), 0L, (s, i) -> s + hits[i + 1] - hits[i])")
    n_hit = F.when(F.size("hits") == 0, F.lit(0).cast("long")).otherwise(n_hit)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def brute(documents: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> dict:
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated), by trying every window at every place."""
    wanted: dict[tuple, set] = {}
    for name, text in benchmark:
        words = tuple(item_words(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            wanted.setdefault(words[i : i + size], set()).add(str(name))
    out = {}
    for doc_id, text in documents:
        words, hit, items = tuple(item_words(text)), set(), set()
        for size in {len(w) for w in wanted}:
            for i in range(len(words) - size + 1):
                if (found := wanted.get(words[i : i + size])) is not None:
                    hit |= set(range(i, i + size))
                    items |= found
        out[doc_id] = (len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out
