"""Operator 3, exact top-k search: BM25 over an inverted index with block-max WAND pruning, shard by shard, merged exactly.

Words: A-Z in lower case, runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return. A query
is the set of a text's words; the score of a document is the sum over the query's words of
idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean length)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)), with N, df and the
mean length over all documents. Scores are rounded to DIGITS decimals; equal scores rank by doc_id. Documents that share no word
with the query are no results.

Texts are read once, into a written index of terms, counts and lengths by document. A shard is SHARD documents of a task's part of it.
Of the words that occur in queries its inverted index holds: of the most frequent ones (OFTEN at most) the impacts by document, and
the largest impact in each block of BLOCK documents; of the others the postings. The bounds of all blocks for AT_ONCE queries are the
product of their frequent words and the block maxima, and the sum of the other words' postings. A query then goes through the blocks in
the order of documents. The next pivot is the first block from where the cursor stands whose bound can reach the query's limit; the
cursor (one for all words of the query, since it moves by whole blocks) goes there, and the frequent words' impacts of the blocks
before it are never read. STEP pivots are read at a time, twice as many in each next step up to MOST, and the documents whose sum in
single precision comes near the limit are scored.

The limit is the k-th best score so far of the task. It starts from that of a SHARE-th of the documents, spread over all, which is
searched before all documents are (and before it a SHARE-th of that, and so on), so that no task begins from nothing; it only rises, so
what is skipped has no place among the k best. Every task yields at most k results a query, those that reach the limit alone, and the
k best of all tasks are the k best of all documents. `tally` counts postings read and
those of the queries' words, pivots and the blocks that hold a word of the query.

Document frequencies are reduced by Spark to a table of all words; the words of queries are joined with it there. Queries go to the
executors in chunks of about CHUNK, as hashes of words and weights, one chunk after another; each is one pass over the index.

Defined cases: a null or blank text matches nothing and, as a query, has no result; rows with one doc_id are documents of their own
with the same name; rows with one query_id are one query with the words of all; rows with a null doc_id are found, last among equals,
but are no queries; a very long text is a set of distinct words of one row; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHash, list_array, map_arrow, modest_batches, ranges, raw_texts, signed, table, word_hashes, worker_state, written

K1, B, K, DIGITS = 1.2, 0.75, 10, 6
SHARD, BLOCK, STEP, CHUNK = 4096, 2, 8, 4096
#: Documents of the first search for limits at least, and its tasks; how many times more the next one has; words of a shard that have
#: block maxima; pivots of a step at most; queries whose bounds are computed at once.
FIRST, FIRST_TASKS, SHARE, OFTEN, MOST, AT_ONCE = 2048, 4, 8, 512, 64, 64
LAST = 1 << 62


def seen_words() -> WordHash:
    return worker_state("search-words", WordHash)


def terms_of(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct word hashes ascending, their counts, and the number of words."""
    words = text.lower().split() if text else []
    every, tf = np.unique(word_hashes(words, seen_words()), return_counts=True)
    return every, tf, len(words)


class Queries:
    """The words of a chunk of queries: all hashes ascending (vocab) with their weights, and for each query the numbers of its words."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], idf: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        flat = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        self.vocab, first, number = np.unique(flat, return_index=True, return_inverse=True)
        self.idf = (np.concatenate(idf) if idf else np.zeros(0))[first]
        self.words = np.split(number, np.cumsum([len(t) for t in terms])[:-1]) if terms else []

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms occur in queries, and their numbers."""
        if not len(self.vocab):
            return np.zeros(len(terms), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, terms), len(self.vocab) - 1)
        found = self.vocab[at] == terms
        return found, at[found]


def indexed(documents: DataFrame) -> DataFrame:
    """doc_id, distinct terms ascending, their counts and the number of words of each document; written, so texts are read once."""

    def run(batch: pa.RecordBatch) -> dict:
        every = [terms_of(text) for text in raw_texts(batch)]
        counts = [len(x[0]) for x in every]
        join = lambda i, kind: list_array(np.concatenate([x[i] for x in every]).astype(kind, copy=False), counts)
        return {"doc_id": batch.column("doc_id"), "terms": list_array(signed(np.concatenate([x[0] for x in every])), counts), "tf": join(1, np.int32), "n": pa.array([x[2] for x in every], pa.int64())}

    return written(map_arrow(documents, run, "doc_id long, terms array<long>, tf array<int>, n long"), "index")


def frequencies(index: DataFrame) -> DataFrame:
    """term, df and words of all documents; the row of a null term has the number of documents, and of all their words; written."""

    def run(batch: pa.RecordBatch) -> dict:
        term, df = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
        words = int(batch.column("n").to_numpy().sum())
        return {"term": pa.array([*term.tolist(), None], pa.int64()), "df": np.append(df, batch.num_rows), "words": np.append(np.zeros(len(term), np.int64), words)}

    return written(map_arrow(index.select("terms", "n"), run, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "frequencies")


def weighted(query_rows: DataFrame, known: DataFrame, n_docs: int) -> DataFrame:
    """query_id, terms and idf of each query that has words; written."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"query_id": batch.column("query_id"), "term": [signed(terms_of(t)[0]) for t in raw_texts(batch)]}

    terms = map_arrow(query_rows.select(F.col("query_id").cast("long").alias("query_id"), "text"), run, "query_id long, term array<long>").select("query_id", F.explode("term").alias("term")).distinct()
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = terms.join(known.filter("term is not null"), "term").select("query_id", F.struct("term", idf.alias("idf")).alias("t"))
    every = one.groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return written(every.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")), "queries")


class Best:
    """The k best results of each query so far. least: a score that k documents reach for certain, by query."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.score, self.doc = k, np.full((n, k), -np.inf), np.full((n, k), LAST, np.int64)
        self.least = np.full(n, -np.inf) if least is None else least

    def limit(self, q: int) -> float:
        return max(self.score[q, -1], self.least[q])

    def add(self, q: int, scores: np.ndarray, docs: np.ndarray) -> None:
        s, d = np.concatenate([self.score[q], scores]), np.concatenate([self.doc[q], docs])
        order = np.lexsort((d, -s))[: self.k]
        self.score[q], self.doc[q] = s[order], d[order]


class Shard:
    """The inverted index of some documents (doc_id, numbers of query words, counts, length), in the order given."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, int]], idf: np.ndarray, mean: float):
        self.docs = np.array([x[0] for x in rows], np.int64)
        column = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x[1]) for x in rows])
        term, tf = np.concatenate([x[1] for x in rows]), np.concatenate([x[2] for x in rows])
        norm = K1 * (1 - B + B * np.array([x[3] for x in rows]) / max(mean, 1e-9))
        self.n_blocks = -(-len(rows) // BLOCK)
        self.count = np.bincount(term, minlength=len(idf))
        # the most frequent words, OFTEN at most: their impacts by document, and the largest of each block
        often = np.flatnonzero(self.count > len(rows) // 16)
        often = often[np.argsort(-self.count[often], kind="stable")[:OFTEN]]
        self.slot = np.full(len(idf), -1, np.int32)
        self.slot[often] = np.arange(len(often))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[column])
        slot = self.slot[term]
        at = np.flatnonzero(slot >= 0)
        self.often = np.zeros((self.n_blocks * BLOCK, len(often)))
        self.often[column[at], slot[at]] = impact[at]
        self.rough = self.often.astype(np.float32)
        peak = self.often.reshape(self.n_blocks, BLOCK, len(often)).max(1)
        self.peak = np.ascontiguousarray(np.nextafter(peak.astype(np.float32), np.float32(np.inf), where=peak > 0, out=np.zeros(peak.shape, np.float32)).T)
        # of the others the postings in order of documents
        at = np.flatnonzero(slot < 0)
        at = at[np.argsort(term[at], kind="stable")]
        self.column, self.impact = column[at], impact[at]
        seldom = np.where(self.slot < 0, self.count, 0)
        self.length, self.start = seldom, np.cumsum(seldom) - seldom

    def search(self, q: int, words: np.ndarray, best: Best, tally: dict | None = None) -> None:
        """Adds what the shard has for query q."""
        self.search_all(q, [words], best, tally)

    def search_all(self, first: int, words: list[np.ndarray], best: Best, tally: dict | None = None) -> None:
        """Adds what the shard has for the queries first, first + 1, ... of these words."""
        n, term = len(words), np.concatenate(words)
        row = np.repeat(np.arange(n), [len(w) for w in words])
        slot = self.slot[term]
        asked = np.zeros((n, len(self.peak)), np.float32)
        asked[row[slot >= 0], slot[slot >= 0]] = 1
        posting = ranges(self.start[term], self.length[term])
        seldom = np.bincount(self.column[posting] + np.repeat(row * len(self.often), self.length[term]), self.impact[posting], n * len(self.often)).reshape(n, -1)
        bounds = (asked @ self.peak + reduce(np.maximum, [seldom[:, i::BLOCK] for i in range(BLOCK)])) * (1 + 1e-4)
        if tally is not None:
            for name, x in {"read": len(posting), "blocks": (bounds > 0).sum(), "all": self.count[term].sum()}.items():
                tally[name] = tally.get(name, 0) + int(x)
        for i in np.flatnonzero(bounds.max(1) > 0).tolist():
            self.follow(first + i, bounds[i], asked[i], seldom[i], best, tally)

    def follow(self, q: int, bound: np.ndarray, asked: np.ndarray, seldom: np.ndarray, best: Best, tally: dict | None) -> None:
        """The cursor of one query: from pivot to pivot, until no block is left that can reach the limit."""
        cursor, step = 0, STEP
        while cursor < self.n_blocks:
            limit = best.limit(q)
            pivots = cursor + np.flatnonzero((bound[cursor:] > 0) & (bound[cursor:] >= limit - 1e-5))[:step]
            if not len(pivots):
                break
            cursor, step = int(pivots[-1]) + 1, min(2 * step, MOST)
            docs = (pivots[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rough = self.rough[docs]
            if tally is not None:
                tally["read"] += int(np.count_nonzero(rough * asked))
                tally["pivots"] = tally.get("pivots", 0) + len(pivots)
            docs = docs[(rough @ asked + seldom[docs]) * (1 + 1e-4) >= limit - 1e-5]
            score = np.round(self.often[docs] @ asked.astype(np.float64) + seldom[docs], DIGITS)
            hit = np.flatnonzero((score >= limit) & (score > 0))
            if len(hit) > 8 * best.k:  # no more than k, and what ties with the last of them
                hit = hit[score[hit] >= np.partition(score[hit], len(hit) - best.k)[len(hit) - best.k]]
            if len(hit):
                best.add(q, score[hit], self.docs[docs[hit]])


def found_in(index: DataFrame, queries: Broadcast, mean: float, k: int, least: Broadcast | None = None) -> DataFrame:
    """query_id, doc_id (LAST - 1: null) and score of the k best documents of each task for the queries; of those alone that reach
    least."""

    def run(batches):
        q = queries.value
        best, held = Best(len(q.ids), k, None if least is None else least.value), []

        def done():
            shard = Shard(held, q.idf, mean)
            for first in range(0, len(q.words), AT_ONCE):
                shard.search_all(first, q.words[first : first + AT_ONCE], best)
            held.clear()

        for batch in batches:
            terms, tf = batch.column("terms"), batch.column("tf")
            at = terms.offsets.to_numpy()
            known, number = q.known(terms.values.to_numpy()[at[0] : at[-1]].view(np.uint64))
            counts = tf.values.to_numpy()[tf.offsets[0].as_py() : tf.offsets[-1].as_py()][known]
            ends = np.append(0, np.cumsum(known))[at - at[0]].tolist()
            for doc_id, n, first, last in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), ends, ends[1:]):
                if first < last:
                    held.append((LAST - 1 if doc_id is None else doc_id, number[first:last], counts[first:last], n))
                if len(held) == SHARD:
                    done()
        if held:
            done()
        at = best.doc != LAST
        for first in range(0, len(q.ids), 1000):
            rows = at[first : first + 1000]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(q.ids[first : first + 1000], rows.sum(1))), "doc_id": pa.array(best.doc[first : first + 1000][rows]), "score": pa.array(best.score[first : first + 1000][rows])})

    return index.mapInArrow(run, "query_id long, doc_id long, score double")


def first_limits(index: DataFrame, n_docs: int, queries: Broadcast, mean: float, k: int) -> Broadcast | None:
    """For each query a score that k documents reach: that of the k-th best of a SHARE-th of the documents, which is searched before all
    with the limits of a SHARE-th of its own, and so on down to FIRST documents. So each search finds about SHARE * k results a query,
    however many tasks it has. Scores are sums of doubles in any order, so what the last digit may lose is taken off."""
    share, least, ids = 1, None, queries.value.ids
    while n_docs // (share * SHARE) >= FIRST:
        share *= SHARE
    at = np.argsort(ids)
    while share > 1:
        part = index.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(share)) == 0)
        part = part.repartition(FIRST_TASKS) if least is None else part
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        got = found_in(part, queries, mean, k, least).withColumn("place", place).filter(F.col("place") == k).select("query_id", "score").toArrow()  # a row for each of CHUNK queries or so
        reached = np.full(len(ids), -np.inf)
        reached[at[np.searchsorted(ids, got["query_id"].to_numpy(), sorter=at)]] = got["score"].to_numpy() - 2 * 10.0**-DIGITS
        least = index.sparkSession.sparkContext.broadcast(reached if least is None else np.maximum(reached, least.value))
        share //= SHARE
    return least


def search(documents: DataFrame, query_rows: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the k best documents for each row (query_id, text) of query_rows."""
    spark = documents.sparkSession
    modest_batches(spark)
    index = indexed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    known = frequencies(index)
    total = known.filter("term is null").first()
    n_docs, n_words = (total.df, total.words) if total else (0, 0)
    mean = n_words / max(n_docs, 1)
    every = weighted(query_rows.filter("query_id is not null"), known, n_docs)
    n_chunks = max(1, -(-every.count() // CHUNK))
    out = None
    for chunk in range(n_chunks):
        got = every.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_chunks)) == chunk).toArrow()  # CHUNK queries or so
        lists = lambda c: [np.asarray(x.values) for x in got[c]]
        made = Queries(got["query_id"].to_pylist(), [x.view(np.uint64) for x in lists("terms")], lists("idf"))
        queries = spark.sparkContext.broadcast(made)
        part = written(found_in(index, queries, mean, k, first_limits(index, n_docs, queries, mean, k)), "found")
        queries.unpersist()
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    found = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.when(F.col("doc_id") < LAST - 1, F.col("doc_id")).alias("doc_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return search(documents, documents.filter("doc_id % 50 = 0").select(F.col("doc_id").cast("long").alias("query_id"), "text"))


SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
l AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
g AS (SELECT count(*) AS n_docs, (SELECT sum(n) FROM l) / count(*) AS mean FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT p.doc_id, p.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / mean)) AS impact
      FROM p JOIN d USING (term) JOIN l USING (doc_id) CROSS JOIN g),
s AS (SELECT q.doc_id AS query_id, i.doc_id, round(sum(impact), 6) AS score
      FROM p q JOIN i USING (term) WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, i.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
