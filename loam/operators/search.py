"""Retrieval: full-text, LIKE and vector search, fusion, reranking, diversity, caps (families C and A18)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import plain_tokens, tokens
from ..functions.vector import cosine, distance, doubles, dot, hash_embedding, norm, normalised
from .facts import any_of, first_by
from .vector_index import VectorIndex
from .vector_index import search as search_index

K1, B = 1.2, 0.75
#: Folders of a full-text index.
BUCKETS = 64
#: Fixed: words that full-text search leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf and n (words of the chunk): the full-text index. Each row is counted by itself, from its words in order, so
    nothing is shuffled; chunk_id is unique."""
    words = chunks.select("chunk_id", F.array_sort(tokens(F.col("text"))).alias("w"))
    begins = F.filter(F.transform("w", lambda x, i: i), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    rows = words.select("chunk_id", F.size("w").cast("long").alias("n"), "w", begins.alias("at")).filter("n > 0")
    runs = F.transform("at", lambda a, i: F.struct(F.get("w", a).alias("term"), (F.coalesce(F.get("at", i + 1), F.col("n").cast("int")) - a).cast("long").alias("tf")))
    return rows.select("chunk_id", "n", F.inline(runs)).select("term", "chunk_id", "n", "tf")


class Index(NamedTuple):
    """A full-text index that was written: postings by bucket of their term, and one row with the chunks' number and mean length."""

    postings: DataFrame
    size: DataFrame


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(chunks: DataFrame, path: str) -> None:
    """Writes the index of chunks (chunk_id, unique, and text; a null text has no words). Postings are ranged over tasks by bucket, term
    and chunk, so a word that most chunks have is spread over many files, and sorted, so a file's statistics tell which terms it has."""
    by = ["bucket", "term", "chunk_id"]
    rows = postings(chunks).withColumn("bucket", bucket(F.col("term")))
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy("bucket").parquet(f"{path}/postings")
    size = F.size(tokens(F.col("text")))
    chunks.agg(F.count("*").alias("__n"), F.avg(size).alias("__mean")).write.parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str, id_type: str = "long") -> Index:
    """The index as written; id_type: of chunk_id (an index without postings has no file that tells)."""
    rows = spark.read.schema(f"term string, chunk_id {id_type}, n long, tf long, bucket int").parquet(f"{path}/postings")
    return Index(rows, spark.read.schema("__n long, __mean double").parquet(f"{path}/size"))


def occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def query_terms(query: str) -> list[str]:
    return sorted({t for t in query.lower().split() if t})


def bm25_score(hit: DataFrame, terms: list[str], limit: int | None) -> DataFrame:
    """chunk_id and score of rows with t0, t1 ... (counts of the terms), n, and the corpus's __n, __mean, df0, df1 ..."""
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("__n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score += idf * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("n") / F.col("__mean")))
    out = hit.select("chunk_id", score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "chunk_id").limit(limit)


def bm25(chunks: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """chunk_id and score of the chunks that have all words of the query, best first, without an index: one pass over the texts, and the
    corpus statistics and the counts of the query's words come from the same rows."""
    terms = query_terms(query)
    w = tokens(F.col("text"))
    rows = chunks.select("chunk_id", F.size(w).alias("n"), *[occurrences(w, t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count("*").alias("__n"), F.avg("n").alias("__mean"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    hit = rows
    for i in range(len(terms)):
        hit = hit.filter(F.col(f"t{i}") > 0)
    return bm25_score(hit.join(F.broadcast(stats)), terms, limit)


def bm25_indexed(index: Index, query: str, limit: int | None = None) -> DataFrame:
    """The rows of bm25 from the postings of the query's words alone: their buckets are all that is read, and what is shuffled is a row
    for each chunk that has one of them. A query without words finds nothing."""
    terms = query_terms(query)
    hit = index.postings.filter(any_of([(F.col("bucket") == bucket(F.lit(t))) & (F.col("term") == t) for t in terms] or [F.lit(False)]))
    stats = hit.agg(*[F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)]) if terms else None
    rows = hit.groupBy("chunk_id", "n").agg(F.count("*").alias("words"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = rows.filter(F.col("words") == len(terms)).join(F.broadcast(index.size))
    return bm25_score(rows if stats is None else rows.join(F.broadcast(stats)), terms, limit)


def stemmed(words: Column) -> Column:
    """Words without stop words and plural endings."""
    return F.transform(F.filter(words, lambda x: ~x.isin(STOP_WORDS)), stem)


def stem(word: Column) -> Column:
    """A word without a plural ending."""
    return F.regexp_replace(word, "(?<=[a-z]{3})(es|s)$", "")


def cover_density(words: Column, terms: Column) -> Column:
    """0.1 for each cover divided by one more than the other words in it. words: stems in their places; terms: distinct stems.

    A cover is a stretch that holds all terms and has no shorter one within it. One pass over the places of terms keeps the last place of
    each; where all have one, the earliest of these and the present place bound a cover, unless the last cover began there too."""
    m = F.size(terms)
    spot = lambda at, nth: F.struct(at.cast("int").alias("at"), nth.cast("int").alias("nth"))
    places = F.transform(words, lambda w, i: F.struct(F.array_position(terms, w).cast("int").alias("t"), i.alias("at")))
    hits = F.transform(F.filter(places, lambda p: p["t"] > 0), lambda p, i: F.struct(p["t"].alias("t"), p["at"].alias("at"), i.alias("nth")))
    start = F.struct(F.transform(F.sequence(F.lit(1), m), lambda i: spot(F.lit(-1), F.lit(-1))).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("score"))

    def step(s, h):
        last = F.transform(s["last"], lambda x, i: F.when(i + 1 == h["t"], spot(h["at"], h["nth"])).otherwise(x))
        first = F.array_min(last)
        others = (h["at"] - first["at"]) - (h["nth"] - first["nth"])
        new = (first["at"] >= 0) & (first["at"] > s["begun"])
        return F.struct(last.alias("last"), F.when(new, first["at"]).otherwise(s["begun"]).alias("begun"), (s["score"] + F.when(new, 0.1 / (1 + others)).otherwise(0.0)).alias("score"))

    return F.when(m > 0, F.aggregate(hits, start, step)["score"]).otherwise(0.0)


def text_rank(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Chunks with all stems of the query, by cover density: more covers, and shorter ones, are better. Stop words keep their places but
    are no terms; a query of stop words alone finds nothing."""
    want = chunks.sparkSession.range(1).select(F.array_distinct(stemmed(tokens(F.lit(query)))).alias("q"))
    rows = chunks.join(F.broadcast(want)).select("chunk_id", "q", F.transform(tokens(F.col("text")), stem).alias("w"))
    rows = rows.filter((F.size("q") > 0) & (F.size(F.array_except("q", "w")) == 0))
    return rows.select("chunk_id", cover_density(F.col("w"), F.col("q")).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)


def like(chunks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first chunks, by id, that contain any of the words; score: how many different ones."""
    terms = sorted(set(query.lower().split()))
    has = [F.col("text").ilike(f"%{t}%") for t in terms]
    hit = chunks.filter(any_of(has)).orderBy("chunk_id").limit(limit)
    return hit.select("chunk_id", sum((F.when(h, 1).otherwise(0) for h in has), F.lit(0)).cast("double").alias("score"))


BACKENDS = {"bm25": bm25, "rank": text_rank, "like": like}


def text_search(chunks: DataFrame, query: str, limit: int = 20, chain: tuple[str, ...] = ("bm25", "like"), index: Index | None = None) -> DataFrame:
    """The results of the first backend of the chain that has any, in one plan; bm25 from the index of chunks, where there is one."""
    found = [bm25_indexed(index, query, limit) if b == "bm25" and index else BACKENDS[b](chunks, query, limit) for b in chain]
    parts = [rows.withColumn("tier", F.lit(i)) for i, rows in enumerate(found)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.agg(F.min("tier").alias("best"))
    return out.join(F.broadcast(best), F.col("tier") == F.col("best")).select("chunk_id", "score", F.element_at(F.array(*[F.lit(b) for b in chain]), F.col("tier") + 1).alias("backend"))


def with_query(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vectors with the one query vector (column q) beside each: one row is all that is broadcast."""
    return vectors.join(F.broadcast(query.select("q").limit(1)))


def vector_search(vectors: DataFrame, query: DataFrame, k: int, measure: str = "cosine", min_score: float | None = None, condition: Column | None = None) -> DataFrame:
    """id and score of the k nearest, filters before the limit. measure: cosine; clamped (to 0..1); ip (of normalised vectors);
    l2 (1 / (1 + distance))."""
    rows = with_query(vectors if condition is None else vectors.filter(condition), query)
    c = cosine(F.col("embedding"), F.col("q"))
    score = {"cosine": c, "clamped": F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), "ip": c, "l2": 1 / (1 + distance(F.col("embedding"), F.col("q")))}[measure]
    rows = rows.select("id", score.alias("score"))
    rows = rows if min_score is None else rows.filter(F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), "id").limit(k)


def vector_index(vectors: DataFrame) -> DataFrame:
    """id and the normalised vector, of all vectors that have one."""
    return vectors.filter(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0)).select("id", normalised(F.col("embedding")).alias("embedding"))


def fact_text(*columns: str) -> Column:
    """What is embedded of a fact: its parts, as far as there are any."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns])


def stale(facts: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Facts (id, text) whose text has no stored embedding of the model with its hash."""
    hashed = facts.withColumns({"text_hash": F.sha2("text", 256), "embedding_model": F.lit(model)})
    return hashed.join(stored.select("id", "text_hash", "embedding_model"), ["id", "text_hash", "embedding_model"], "left_anti")


def refreshed(facts: DataFrame, stored: DataFrame, model: str = "hash-256") -> DataFrame:
    """stored with new rows for changed facts in place of their old ones."""
    new = stale(facts, stored, model).select("id", hash_embedding(F.col("text")).alias("embedding"), "embedding_model", "text_hash")
    return stored.join(new.select("id"), "id", "left_anti").select("id", doubles(F.col("embedding")).alias("embedding"), "embedding_model", "text_hash").unionByName(new)


def filled(chunks: DataFrame) -> DataFrame:
    """chunks with an embedding where there was none."""
    return chunks.withColumn("embedding", F.coalesce(doubles(F.col("embedding")), hash_embedding(F.col("text"))))


def fused(text: DataFrame, vector: DataFrame, weight: float = 0.6) -> DataFrame:
    """Both candidate lists (chunk_id, score), each divided by its best score, weighted and added; an absent score is 0."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        top = df.agg(F.max("score").alias("top"))
        return df.join(F.broadcast(top)).select("chunk_id", F.when(F.col("top") != 0, F.col("score") / F.col("top")).otherwise(0.0).alias(name))

    both = scaled(text, "t").join(scaled(vector, "v"), "chunk_id", "full_outer")
    return both.select("chunk_id", (weight * F.coalesce("t", F.lit(0.0)) + (1 - weight) * F.coalesce("v", F.lit(0.0))).alias("score"))


def reranked(candidates: DataFrame, scores: DataFrame | None, top: int = 20) -> DataFrame:
    """candidates with position (from 1): the first `top` in order of the other scores, the rest as they were. Without scores, or
    with too few of them, the order stays."""
    w = W.orderBy(F.desc("score"), "chunk_id")
    rows = candidates.withColumn("position", F.row_number().over(w))
    if scores is None:
        return rows
    rows = rows.join(scores.select("chunk_id", F.col("score").alias("other")), "chunk_id", "left")
    whole = rows.filter(F.col("position") <= top).agg((F.count("other") == F.count("*")).alias("whole"))
    rows = rows.join(F.broadcast(whole))
    use = (F.col("position") <= top) & F.col("whole")
    out = rows.withColumns({"score": F.when(use, F.col("other")).otherwise(F.col("score")), "position": F.row_number().over(W.orderBy(F.when(F.col("position") <= top, 0).otherwise(1), F.when(use, -F.col("other")), "position"))})
    return out.drop("other", "whole")


def diverse(candidates: DataFrame, key: str, k: int, trade: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: per key, of its candidates (chunk_id, embedding, q) picks k in turn by
    trade * sim(query) - (1 - trade) * max sim(picked). A key with an embedding missing keeps its order. Groups are candidate lists,
    bounded by the limit that made them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position").reset_index(drop=True)
        if pdf["embedding"].isna().any():
            picked = list(range(min(k, len(pdf))))
        else:
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
            v, q = unit(np.array(pdf["embedding"].tolist(), float)), unit(np.array(pdf["q"].iloc[0], float))
            near, most, picked = v @ q, np.zeros(len(v)), []
            free = np.ones(len(v), bool)
            while len(picked) < min(k, len(v)):
                gain = np.where(free, np.round(trade * near - (1 - trade) * most, 12), -np.inf)
                best = int(gain.argmax())
                picked.append(best)
                free[best] = False
                sim = v @ v[best]
                most = sim if len(picked) == 1 else np.maximum(most, sim)
        return pd.DataFrame({key: pdf[key].iloc[picked], "chunk_id": pdf["chunk_id"].iloc[picked], "rank": range(1, len(picked) + 1)})

    kind = dict(candidates.dtypes)
    return candidates.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, chunk_id {kind['chunk_id']}, rank long")


def document_cap(candidates: DataFrame, k: int, per_document: int = 3) -> DataFrame:
    """The first k by position with at most per_document of each document."""
    w = W.partitionBy("document_id").orderBy("position")
    return candidates.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_document).drop("__r").orderBy("position").limit(k)


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, k: int = 5, min_score: float = 0.0, per_document: int = 3, rerank_scores: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """Text and vector search of max(4 k, k) candidates each, fused, reranked and capped."""
    n = max(4 * k, k)
    text = text_search(chunks, query, n, index=index).select("chunk_id", "score")
    vector = vector_only(chunks, vectors, query_vector, n).select("chunk_id", "score")
    both = fused(text, vector).filter(F.col("score") >= min_score).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return document_cap(reranked(both, rerank_scores), k, per_document)


def vector_only(chunks: DataFrame, vectors: DataFrame, query: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """chunk_id, document_id and score of the k nearest of the chunks that have a vector: a vector without a chunk takes no place."""
    mine = vectors.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    hits = vector_search(mine, query, k, min_score=min_score).withColumnRenamed("id", "chunk_id")
    return chunks.select("chunk_id", "document_id").join(F.broadcast(hits), "chunk_id")


def slide_range(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.lit("")).when(end.isNull() | (start == end), F.concat(F.lit("slide "), start.cast("string"))).otherwise(F.concat(F.lit("slides "), start.cast("string"), F.lit("-"), end.cast("string")))


def context_blocks(chunks: DataFrame) -> DataFrame:
    """Numbered blocks of text for an answer: [n] file (slides) text."""
    w = W.orderBy("position")
    label = F.concat(F.lit("["), F.row_number().over(w).cast("string"), F.lit("] "), F.col("file"), F.when(F.col("start_slide").isNotNull(), F.concat(F.lit(" ("), slide_range(F.col("start_slide"), F.col("end_slide")), F.lit(")"))).otherwise(""))
    return chunks.select("position", F.concat(label, F.lit("\n"), F.col("text")).alias("block"))


def two_stage(hits: DataFrame, documents: int = 3, per_document: int = 3) -> DataFrame:
    """The best documents by the sum of their hits' scores, and the best hits of each."""
    best = hits.groupBy("document_id").agg(F.round(F.sum("score"), 6).alias("total")).orderBy(F.desc("total"), "document_id").limit(documents)
    w = W.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return hits.join(F.broadcast(best.select("document_id")), "document_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_document)


def per_document_search(hits: DataFrame, k: int, per_document: int) -> DataFrame:
    """The best hits of each document, then the best max(k, per_document) of all."""
    w = W.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_document).drop("__r").orderBy(F.desc("score"), "chunk_id").limit(max(k, per_document))


def ambiguous(documents: DataFrame, most: int = 6) -> DataFrame:
    """Whether more than `most` documents are left, looking at one more than that at most."""
    return documents.limit(most + 1).agg(F.count("*").alias("seen"), (F.count("*") > most).alias("ask"))


def match_boost(client: Column, region: Column, period: Column, want: dict[str, list[str]]) -> Column:
    """0.25 for the client, 0.20 each for region and period where tokens are shared; null where a wanted one is contradicted."""
    parts, against = F.lit(0.0), F.lit(False)
    for column, name, gain in ((client, "client", 0.25), (region, "region", 0.2), (period, "period", 0.2)):
        if want.get(name):
            hit = F.arrays_overlap(plain_tokens(column), F.array(*[F.lit(x) for x in want[name]]))
            known = F.size(plain_tokens(column)) > 0
            parts = parts + F.when(hit, gain).otherwise(0.0)
            against = against | (known & ~hit)
    return F.when(~against, parts)


def other_region(text: Column, region: str) -> Column:
    """Whether a text speaks of the other region and not of this one; US only in capitals."""
    us, emea = text.rlike(r"\bUS\b|(?i:\bUnited States\b|\bdomestic\b)"), text.rlike(r"(?i)\bEMEA\b|\bEurope\b")
    return emea & ~us if region == "US" else us & ~emea


def chunk_metadata(chunks: DataFrame, slides: DataFrame) -> DataFrame:
    """Chunks with the title of their first slide, by one join on the composite key."""
    s = first_by(slides, ["document_id", "slide_number"], ["slide_id"]).select(F.col("document_id").alias("__d"), F.col("slide_number").alias("__s"), "title")
    return chunks.join(s, (F.col("document_id") == F.col("__d")) & (F.col("start_slide") == F.col("__s")), "left").drop("__d", "__s")


def embedding_match(queries: DataFrame, catalog: VectorIndex, least: float = 0.7, nearest: int = 4) -> DataFrame:
    """The nearest catalogue entry of each query (query_id, embedding), if it is near enough; of equal ones (to six places) the smallest
    metric_id. The catalogue is an index on disk; `nearest` entries are looked at, so that equal ones meet."""
    rows = search_index(catalog, queries, nearest).select("query_id", F.col("id").alias("metric_id"), F.round("cosine", 6).alias("score"))
    best = rows.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("metric_id")).alias("m"))).alias("b"))
    return best.filter(F.col("b.score") >= least).select("query_id", (-F.col("b.m")).alias("metric_id"), F.col("b.score").alias("score"))


def trace(candidates: DataFrame, stage: str, most: int = 20) -> DataFrame:
    """One row that tells what a stage of retrieval had: the first candidates, as text."""
    top = candidates.orderBy(F.desc("score"), "chunk_id").limit(most)
    rows = top.agg(F.sort_array(F.collect_list(F.struct(F.round("score", 6).alias("score"), (-F.col("chunk_id")).alias("i"))), asc=False).alias("c"))
    return rows.select(F.lit(stage).alias("stage"), F.array_join(F.transform("c", lambda x: (-x["i"]).cast("string")), ",").alias("ids"), F.size("c").cast("long").alias("n"))
