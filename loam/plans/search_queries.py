"""Queries C01 to C27 and A18: documents as chunks, embeddings as their vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as op
from ..operators import segments, vector_index
from ..functions.vector import cosine, hash_embedding
from ..sources.star import LINES_SQL, numbered_lines
from ..sources.tables import checkpoint_dir, conformed, table
from .registry import query

TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')"
CH = "WITH ch AS (SELECT doc_id AS chunk_id, doc_id // 4 AS document_id, text, CAST(doc_id % 4 + 1 AS INT) AS start_slide, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 4 + 1 AS INT) ELSE 5 END AS end_slide, lang, source FROM documents)"
V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT e AS qe FROM v WHERE id = 0)"
COS = "list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)))"


def chunks(spark, d):
    x = table(spark, d, "documents")
    s = (F.col("doc_id") % 4 + 1).cast("int")
    return x.select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 4").alias("document_id"), "text", s.alias("start_slide"), F.when(F.col("doc_id") % 3 == 0, s).otherwise(5).alias("end_slide"), "lang", "source")


def version(spark, d, name: str) -> str:
    """Tells a version of a table by its files, their sizes and times."""
    files = table(spark, d, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("*")))), 256)).first()[0][:32]


def text_index(spark, d):
    """The full-text index of all documents, built once for each version of the table in the shared folder, for all applications."""
    path = f"{checkpoint_dir(spark)}/text-segments-{version(spark, d, 'documents')}"
    if (found := segments.open_index(spark, path)) is None:
        segments.apply(chunks(spark, d), path, batch=0)
        found = segments.open_index(spark, path)
    return found


DIMS = 64


def index_of_vectors(spark, d):
    """The same for the index of all embeddings."""
    path = f"{checkpoint_dir(spark)}/vector-index-{version(spark, d, 'embeddings')}"
    if (found := vector_index.open_vector_index(spark, path)) is None:
        vector_index.write_vector_index(vectors(spark, d), path, DIMS)
        found = vector_index.open_vector_index(spark, path)
    return found


def vectors(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


def query_vector(spark, d):
    return vectors(spark, d).filter("id = 0").select(F.col("embedding").alias("q"))


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("a18_embedding_match", "WITH " + V + ", r AS (SELECT a.id AS query_id, b.id AS metric_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score FROM (SELECT id, list_reverse(e) AS e FROM v WHERE id % 50 = 0) a, v b), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, metric_id) AS n FROM r) SELECT query_id, metric_id, score FROM k WHERE n = 1 AND score >= 0.1")
def a18(spark, d):
    # queries are the vectors of the query rows turned round, so that no query is its own answer
    queries = vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.reverse("embedding").alias("embedding"))
    return op.embedding_match(queries, index_of_vectors(spark, d), 0.1)


def bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (nd - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return f", w AS (SELECT chunk_id, document_id, {TOK} AS w FROM ch), bmr AS (SELECT chunk_id, len(w) AS n, {tf} FROM w), st AS (SELECT count(*) AS nd, avg(n) AS mean, {df} FROM bmr), bm AS (SELECT chunk_id, {score} AS score FROM bmr, st WHERE {' AND '.join(f't{i} > 0' for i in range(len(terms)))})"


@query("c01_bm25", CH + bm25_sql(["heti", "the"]) + " SELECT chunk_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, chunk_id LIMIT 20")
def c01(spark, d):
    return rounded(op.bm25_indexed(text_index(spark, d), "the heti", 20))


#: Two stems: every two neighbouring places of different ones bound a cover.
ALL_STEMS = f"list_transform({TOK}, lambda x: regexp_replace(x, '([a-z]{{3}})(es|s)$', '\\1'))"


@query("c02_text_rank", CH + f", w AS (SELECT chunk_id, {ALL_STEMS} AS w FROM ch), u AS (SELECT chunk_id, unnest(w) AS t, unnest(range(len(w))) AS pos FROM w), h AS (SELECT chunk_id, t, pos, lag(t) OVER o AS t0, lag(pos) OVER o AS pos0 FROM u WHERE t IN ('en', 'que') WINDOW o AS (PARTITION BY chunk_id ORDER BY pos)), r AS (SELECT chunk_id, sum(0.1::DOUBLE / (pos - pos0)) AS score FROM h WHERE t <> t0 GROUP BY 1) SELECT chunk_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, chunk_id LIMIT 20")
def c02(spark, d):
    return rounded(op.text_rank(chunks(spark, d), "the en ques"))


@query("c03_like_score", CH + " SELECT chunk_id, CAST((text ILIKE '%heti%')::INT + (text ILIKE '%wh%')::INT AS DOUBLE) AS score FROM ch WHERE text ILIKE '%heti%' OR text ILIKE '%wh%' ORDER BY chunk_id LIMIT 20")
def c03(spark, d):
    return op.like(chunks(spark, d), "heti wh")


@query("c04_backend_fallback", CH + " SELECT chunk_id, CAST((text ILIKE '%hetixyz%')::INT + (text ILIKE '%wh%')::INT AS DOUBLE) AS score, 'like' AS backend FROM ch WHERE text ILIKE '%hetixyz%' OR text ILIKE '%wh%' ORDER BY chunk_id LIMIT 20")
def c04(spark, d):
    return op.text_search(chunks(spark, d), "hetixyz wh", index=text_index(spark, d))


@query("c05_postings", CH + f", w AS (SELECT chunk_id, {TOK} AS w FROM ch WHERE chunk_id % 3 <> 1), u AS (SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM w) SELECT term, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT term, chunk_id, n, count(*) AS tf FROM u GROUP BY ALL) GROUP BY 1")
def c05(spark, d):
    """Half of the texts are stale, others are to go: a change replaces the ones and removes the others."""
    c, path = chunks(spark, d), f"{checkpoint_dir(spark)}/text-index-kept-{uuid.uuid4().hex}"
    segments.apply(c.filter("chunk_id % 3 <> 2").withColumn("text", F.when(F.col("chunk_id") % 3 == 0, F.lit("old words")).otherwise(F.col("text"))), path)
    segments.apply(c.filter("chunk_id % 3 <> 1"), path, c.filter("chunk_id % 3 = 1"))
    now = segments.open_index(spark, path)
    return now.postings.groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("occurrences"))


@query("c06_cosine_topk", "WITH " + V + f" SELECT id, round({COS}, 6) AS score FROM v, q WHERE label <> 3 ORDER BY {COS} DESC, id LIMIT 10")
def c06(spark, d):
    return rounded(op.vector_search(vectors(spark, d), query_vector(spark, d), 10, condition=F.col("label") != 3))


@query("c07_clamped_topk", "WITH " + V + f", r AS (SELECT id, greatest(0, least(1, {COS})) AS s FROM v, q) SELECT id, round(s, 6) AS score FROM r WHERE s >= 0.2 ORDER BY s DESC, id LIMIT 15")
def c07(spark, d):
    return rounded(op.vector_search(vectors(spark, d), query_vector(spark, d), 15, "clamped", 0.2))


@query("c08_flat_l2", "WITH " + V + " SELECT id, round(1 / (1 + list_distance(e, qe)), 6) AS score FROM v, q ORDER BY list_distance(e, qe), id LIMIT 10")
def c08(spark, d):
    query = query_vector(spark, d).select(F.lit(0).alias("query_id"), F.col("q").alias("embedding"))
    return rounded(vector_index.search(index_of_vectors(spark, d), query, 10).select("id", (1 / (1 + F.col("apart"))).alias("score")))


@query("s06_vector_index_search", "WITH " + V + ", r AS (SELECT a.id AS query_id, v.id, list_dot_product(v.e, a.qe) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(a.qe, a.qe))) AS s FROM (SELECT id, e AS qe FROM v WHERE id % 50 = 0) a, v), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS n FROM r) SELECT query_id, id, round(s, 6) AS score FROM k WHERE n <= 5")
def s06(spark, d):
    """The five nearest of each vector whose id is divisible by 50, among all, from the index."""
    queries = vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    return vector_index.search(index_of_vectors(spark, d), queries, 5).select("query_id", "id", F.round("cosine", 6).alias("score"))


@query("c09_index_build", "WITH " + V + " SELECT id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(list_sum(e) / sqrt(list_dot_product(e, e)), 4) AS total FROM v")
def c09(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return op.vector_index(vectors(spark, d)).select("id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(total, 4).alias("total"))


@query("c10_stale_embeddings", "SELECT p_partkey AS id, sha256(concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(p_brand), ''), CAST(p_size AS VARCHAR))) AS text_hash FROM part WHERE p_partkey % 5 IN (0, 1)")
def c10(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), op.fact_text("p_name", "p_brand", "p_size").alias("text"))
    text = F.when(F.col("id") % 5 == 0, F.lit("before")).otherwise(F.col("text"))
    stored = p.filter("id % 5 <> 1").select("id", F.sha2(text, 256).alias("text_hash"), F.lit("hash-256").alias("embedding_model"))
    return op.stale(p, stored, "hash-256").select("id", "text_hash")


@query("c11_hash_embedding", "SELECT doc_id, round(('0x' || substr(sha256(text), 1, 2))::INT / 255.0 - 0.5, 6) AS first, round(('0x' || substr(sha256(text), 63, 2))::INT / 255.0 - 0.5, 6) AS last, CAST(256 AS BIGINT) AS dims FROM documents")
def c11(spark, d):
    e = hash_embedding(F.col("text"))
    return table(spark, d, "documents").select("doc_id", e.alias("e")).select("doc_id", F.round(F.col("e")[0], 6).alias("first"), F.round(F.col("e")[255], 6).alias("last"), F.size("e").cast("long").alias("dims"))


@query("c12_fill_missing", "SELECT doc_id AS chunk_id, CAST(CASE WHEN vec_id IS NULL THEN 256 ELSE len(embedding) END AS BIGINT) AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def c12(spark, d):
    c = chunks(spark, d).join(vectors(spark, d), F.col("chunk_id") == F.col("id"), "left")
    return op.filled(c).select("chunk_id", F.size("embedding").cast("long").alias("dims"))


FUSE = ", t AS (SELECT chunk_id, score FROM bm ORDER BY score DESC, chunk_id LIMIT 20), vv AS (SELECT id AS chunk_id, " + COS + " AS score FROM v JOIN ch ON id = chunk_id, q ORDER BY 2 DESC, 1 LIMIT 20), f AS (SELECT chunk_id, 0.6 * coalesce(t.score / (SELECT max(score) FROM t), 0) + 0.4 * coalesce(vv.score / (SELECT max(score) FROM vv), 0) AS score FROM t FULL OUTER JOIN vv USING (chunk_id))"
FUSED = CH + bm25_sql(["the"]) + ", " + V + FUSE


def fused(spark, d):
    v = op.vector_only(chunks(spark, d), vectors(spark, d), query_vector(spark, d), 20).select("chunk_id", "score")
    return op.fused(op.bm25_indexed(text_index(spark, d), "the", 20), v)


@query("c13_fusion", FUSED + " SELECT chunk_id, round(score, 6) AS score FROM f")
def c13(spark, d):
    return rounded(fused(spark, d))


RERANK = ", p AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS p0, (chunk_id * 37 % 101) / 101.0 AS o FROM f), p2 AS (SELECT chunk_id, CASE WHEN p0 <= 20 THEN o ELSE score END AS score, row_number() OVER (ORDER BY CASE WHEN p0 <= 20 THEN 0 ELSE 1 END, CASE WHEN p0 <= 20 THEN -o END, p0) AS position FROM p)"


@query("c14_rerank", FUSED + RERANK + " SELECT chunk_id, round(score, 6) AS score, position FROM p2")
def c14(spark, d):
    other = chunks(spark, d).select("chunk_id", (F.col("chunk_id") * 37 % 101 / 101.0).alias("score"))
    return rounded(op.reranked(fused(spark, d), other)).withColumn("position", F.col("position").cast("long"))


@query("c15_mmr")
def c15(spark, d):
    v = op.with_query(vectors(spark, d), query_vector(spark, d)).select((F.col("id") % 5).alias("query_id"), F.col("id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("q").cast("array<double>").alias("q"))
    best = Window.partitionBy("query_id").orderBy(F.desc(cosine(F.col("embedding"), F.col("q"))), "chunk_id")
    rows = v.withColumn("position", F.row_number().over(best)).filter("position <= 40")
    return op.diverse(rows, "query_id", 5)


@query("c16_document_cap", FUSED + ", p AS (SELECT f.chunk_id, document_id, row_number() OVER (ORDER BY score DESC, f.chunk_id) AS position FROM f JOIN ch USING (chunk_id)), c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position) AS k FROM p) SELECT chunk_id, document_id, position FROM c WHERE k <= 1 ORDER BY position LIMIT 8")
def c16(spark, d):
    both = op.reranked(fused(spark, d).join(chunks(spark, d).select("chunk_id", "document_id"), "chunk_id"), None)
    return op.document_cap(both, 8, 1).select("chunk_id", "document_id", F.col("position").cast("long").alias("position"))


@query("c17_vector_search", CH + ", " + V + f" SELECT id AS chunk_id, document_id, round({COS}, 6) AS score FROM v JOIN ch ON id = chunk_id, q ORDER BY {COS} DESC, id LIMIT 5")
def c17(spark, d):
    return rounded(op.vector_only(chunks(spark, d), vectors(spark, d), query_vector(spark, d), 5))


@query("c18_hybrid_search", FUSED + ", p AS (SELECT f.chunk_id, document_id, score, row_number() OVER (ORDER BY score DESC, f.chunk_id) AS position FROM f JOIN ch USING (chunk_id)), c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position) AS k FROM p) SELECT chunk_id, document_id, round(score, 6) AS score, position FROM c WHERE k <= 3 ORDER BY position LIMIT 5")
def c18(spark, d):
    out = op.hybrid(chunks(spark, d), vectors(spark, d), "the", query_vector(spark, d), index=text_index(spark, d))
    return rounded(out.select("chunk_id", "document_id", "score", F.col("position").cast("long").alias("position")))


HITS = CH + bm25_sql(["the"]) + ", h AS (SELECT bm.chunk_id, document_id, round(score, 6) AS score FROM bm JOIN ch USING (chunk_id))"


def hits(spark, d):
    return rounded(op.bm25_indexed(text_index(spark, d), "the")).join(chunks(spark, d).select("chunk_id", "document_id"), "chunk_id")


@query("c19_context_blocks", HITS + ", t AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS position FROM h ORDER BY position LIMIT 20) SELECT position, '[' || position || '] ' || source || ' (' || CASE WHEN start_slide = end_slide THEN 'slide ' || start_slide ELSE 'slides ' || start_slide || '-' || end_slide END || ')' || chr(10) || text AS block FROM t JOIN ch USING (chunk_id)")
def c19(spark, d):
    top = op.reranked(hits(spark, d).orderBy(F.desc("score"), "chunk_id").limit(20), None).select("chunk_id", F.col("position").cast("long").alias("position"))
    return op.context_blocks(chunks(spark, d).join(F.broadcast(top), "chunk_id").withColumn("file", F.col("source")))


@query("c20_two_stage", HITS + ", b AS (SELECT document_id FROM h GROUP BY 1 ORDER BY round(sum(score), 6) DESC, document_id LIMIT 3), r AS (SELECT h.*, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS rank FROM h JOIN b USING (document_id)) SELECT document_id, chunk_id, rank FROM r WHERE rank <= 3")
def c20(spark, d):
    return op.two_stage(hits(spark, d)).select("document_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("c21_prefiltered_search", HITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS k FROM h WHERE document_id % 2 = 0) SELECT chunk_id, document_id, score FROM r WHERE k <= 2 ORDER BY score DESC, chunk_id LIMIT 12")
def c21(spark, d):
    return op.per_document_search(hits(spark, d).filter("document_id % 2 = 0"), 12, 2)


@query("c22_ambiguity_gate", "SELECT least(count(*), 7) AS seen, count(*) > 6 AS ask FROM documents WHERE lang = 'de'")
def c22(spark, d):
    return op.ambiguous(table(spark, d, "documents").filter("lang = 'de'"))


@query("c23_match_boost", "SELECT doc_id, 0.25 * (lang = 'en')::INT + 0.2 * (source IN ('src1', 'src2'))::INT AS boost FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def c23(spark, d):
    b = op.match_boost(F.col("lang"), F.col("source"), F.lit(None).cast("string"), {"client": ["en"], "region": ["src1", "src2"], "period": ["q1"]})
    return table(spark, d, "documents").select("doc_id", b.alias("boost")).filter("boost is not null")


@query("c24_region_exclusion", "WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' in the US' WHEN 1 THEN ' across emea' WHEN 2 THEN ' for us' ELSE ' US and Europe' END AS text FROM part) SELECT p_partkey FROM t WHERE NOT (regexp_matches(text, '(?i)\\bEMEA\\b|\\bEurope\\b') AND NOT regexp_matches(text, '\\bUS\\b|(?i:\\bUnited States\\b|\\bdomestic\\b)'))")
def c24(spark, d):
    k = F.col("p_partkey") % 4
    text = F.concat("p_name", F.when(k == 0, " in the US").when(k == 1, " across emea").when(k == 2, " for us").otherwise(" US and Europe"))
    return table(spark, d, "part").filter(~op.other_region(text, "US")).select("p_partkey")


@query("c25_chunk_metadata", CH + ", s AS (SELECT l_orderkey, l_linenumber, min_by(l_returnflag, line_id) AS title FROM " + LINES_SQL + " GROUP BY 1, 2) SELECT chunk_id, title FROM ch LEFT JOIN s ON document_id = l_orderkey AND start_slide = l_linenumber")
def c25(spark, d):
    s = numbered_lines(spark, d).select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("slide_number"), F.col("line_id").alias("slide_id"), F.col("l_returnflag").alias("title"))
    return op.chunk_metadata(chunks(spark, d), s).select("chunk_id", "title")


@query("c26_tolerant_documents", "SELECT doc_id AS id, CAST(NULL AS VARCHAR) AS client, lang FROM documents WHERE source ILIKE '%RC1%' AND lang IN ('fr', 'es')")
def c26(spark, d):
    x = table(spark, d, "documents").filter(F.col("source").ilike("%RC1%") & F.col("lang").isin("fr", "es")).withColumnRenamed("doc_id", "id")
    return conformed(x, {"id": "long", "client": "string", "lang": "string"})


@query("c27_retrieval_trace", HITS + ", t AS (SELECT * FROM h ORDER BY score DESC, chunk_id LIMIT 20) SELECT 'text' AS stage, string_agg(chunk_id, ',' ORDER BY score DESC, chunk_id) AS ids, count(*) AS n FROM t")
def c27(spark, d):
    return op.trace(hits(spark, d), "text")
