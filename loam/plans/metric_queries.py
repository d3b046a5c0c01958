"""Queries A01 to A35: structured questions over order facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as op
from ..sources.star import FACT_SQL, SCHEMA, order_facts
from ..sources.tables import conformed, table
from .registry import query

W = "WITH " + FACT_SQL
R = [("1996-10-01", "1997-03-31"), ("1998-01-01", "1998-03-31")]
IN_R = "((period_end >= '1996-10-01' AND period_start <= '1997-03-31') OR (period_end >= '1998-01-01' AND period_start <= '1998-03-31'))"
CHUNK_SQL = """, chunk AS (SELECT o_orderkey * 10 + k AS chunk_id, o_orderkey AS document_id, k AS start_slide, CASE k WHEN 1 THEN 1 ELSE 4 END AS end_slide, o_orderpriority || ' ' || o_orderstatus AS text,
 ((o_orderkey * 10 + k) * 7919 % 1000) / 1000.0 AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'url' || o_orderkey END AS url FROM orders, (SELECT unnest([1, 2]) AS k))
"""


def facts(spark, d):
    return order_facts(spark, d)


def chunks(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    i = F.col("o_orderkey") * 10 + F.col("k")
    return o.select(i.alias("chunk_id"), F.col("o_orderkey").alias("document_id"), F.col("k").alias("start_slide"), F.when(F.col("k") == 1, 1).otherwise(4).alias("end_slide"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), (i * 7919 % 1000 / 1000.0).alias("score"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("url"), F.col("o_orderkey").cast("string"))).alias("url"))


@query("a01_star_view", W + "SELECT fact_id, document_id, metric_id, client_name, region, country, period_label, period_start, period_end, unit, round(value, 4) AS value FROM fact")
def a01(spark, d):
    return facts(spark, d).select("fact_id", "document_id", "metric_id", "client_name", "region", "country", "period_label", "period_start", "period_end", "unit", F.round("value", 4).alias("value"))


@query("a02_schema_adaptive_view", W + "SELECT fact_id, CAST(NULL AS VARCHAR) AS raw_value, metric_id, CAST(NULL AS VARCHAR) AS context, slide_number FROM fact WHERE slide_number = 1")
def a02(spark, d):
    narrow = facts(spark, d).drop("raw_value", "context")
    return conformed(narrow, SCHEMA).filter("slide_number = 1").select("fact_id", "raw_value", "metric_id", "context", "slide_number")


@query("a03_fact_filter_overlap", W + f"SELECT fact_id, metric_id, client_name, region, period_end FROM fact WHERE metric_id IN ('Brand#11', 'Brand#22', 'Brand#13', 'Brand#2', 'Brand#3', 'Brand#1') AND client_name ILIKE '%mach%' AND region IN ('ASIA', 'EUROPE') AND {IN_R} ORDER BY period_end DESC NULLS LAST, fact_id LIMIT 200")
def a03(spark, d):
    return op.query_facts(facts(spark, d), metric_ids=["Brand#11", "Brand#22", "Brand#13", "Brand#2", "Brand#3", "Brand#1"], client_name="mach", region=["ASIA", "EUROPE"], period_ranges=R).select("fact_id", "metric_id", "client_name", "region", "period_end")


@query("a04_document_filter_exists", W + "SELECT DISTINCT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM fact WHERE document_id = o_orderkey AND metric_id IN ('Brand#1', 'Brand#11')) ORDER BY 1 LIMIT 100")
def a04(spark, d):
    docs = table(spark, d, "orders").withColumnRenamed("o_orderkey", "document_id")
    return op.query_document_ids(docs, facts(spark, d), F.col("o_orderstatus") == "F", ["Brand#1", "Brand#11"])


@query("a05_period_condition", W + "SELECT period_label, count(*) AS n FROM fact WHERE (contains(upper(coalesce(period_label, '')), 'Q2') AND (contains(period_label, '1997') OR contains(period_label, 'FY97') OR fiscal_year = 1997)) OR (contains(period_label, '1999') OR contains(period_label, 'FY99') OR fiscal_year = 1999) GROUP BY 1")
def a05(spark, d):
    specs = [{"kind": "quarter", "number": 2, "years": [1997]}, {"kind": "year", "years": [1999]}]
    return facts(spark, d).filter(op.period_condition(specs, F.col("period_label"), F.col("fiscal_year"))).groupBy("period_label").agg(F.count("*").alias("n"))


RANGES = [(1, 2, None), (3, None, 2), (5, 1, 3), (6, None, None), (7, 4, 4)]
RANGES_SQL = "(VALUES (1, 2, NULL), (3, NULL, 2), (5, 1, 3), (6, NULL, NULL), (7, 4, 4)) r(document_id, s, e)"


def ranges(spark):
    return spark.createDataFrame(RANGES, "document_id long, start int, end int")


@query("a06_slide_ranges", W + f"SELECT DISTINCT slide_id FROM fact JOIN {RANGES_SQL} USING (document_id) WHERE (s IS NULL OR slide_number >= s) AND (e IS NULL OR slide_number <= e) ORDER BY 1 LIMIT 5000")
def a06(spark, d):
    return op.slides_in_ranges(facts(spark, d), ranges(spark))


@query("a07_document_names", W + "SELECT document_id, max(document_name) AS document_name FROM fact GROUP BY 1")
def a07(spark, d):
    return op.document_names(facts(spark, d))


@query("a08_document_regions", W + "SELECT document_id, upper(max(region)) AS region FROM fact GROUP BY 1")
def a08(spark, d):
    return op.document_regions(facts(spark, d))


@query("a09_anchor_date", W + "SELECT max(period_end) AS anchor, max(CASE WHEN period_type = 'half' THEN period_end END) AS half_anchor FROM fact")
def a09(spark, d):
    f = facts(spark, d)
    return f.agg(F.max("period_end").alias("anchor"), F.max(F.when(F.col("period_type") == "half", F.col("period_end"))).alias("half_anchor"))


@query("a10_catalog_aliases", "WITH c AS (SELECT DISTINCT p_brand AS metric_id FROM part), a AS (SELECT DISTINCT p_brand, p_type FROM part) SELECT metric_id, coalesce(string_agg(p_type, '|' ORDER BY length(p_type) DESC, p_type), '') AS aliases, count(p_type) AS n FROM c LEFT JOIN a ON p_brand = metric_id GROUP BY 1")
def a10(spark, d):
    p = table(spark, d, "part")
    aliases = p.select(F.col("p_brand").alias("metric_id"), F.col("p_type").alias("alias")).distinct().withColumn("priority", F.length("alias"))
    out = op.catalog_with_aliases(p.select(F.col("p_brand").alias("metric_id"), F.col("p_brand").alias("name")).distinct(), aliases)
    return out.select("metric_id", F.array_join("aliases", "|").alias("aliases"), F.size("aliases").cast("long").alias("n"))


BY_Q = ", q AS (SELECT client_name, period_label, period_start, period_end, round(sum(value), 2) AS value FROM fact WHERE region = 'ASIA' GROUP BY ALL)"


def by_quarter(spark, d):
    return facts(spark, d).filter("region = 'ASIA'").groupBy("client_name", "period_label", "period_start", "period_end").agg(F.round(F.sum("value"), 2).alias("value"))


@query("a11_trend", W + "SELECT fact_id, period_end, round(value, 4) AS value FROM fact WHERE metric_id = 'Brand#11' ORDER BY period_end NULLS FIRST, period_label NULLS FIRST, fact_id")
def a11(spark, d):
    return op.trend(facts(spark, d).filter("metric_id = 'Brand#11'")).select("fact_id", "period_end", F.round("value", 4).alias("value"))


@query("a12_latest", W + ", r AS (SELECT *, rank() OVER (PARTITION BY metric_id ORDER BY period_end DESC NULLS LAST, period_label DESC NULLS LAST) AS k FROM fact) SELECT metric_id, fact_id, period_label FROM r WHERE k = 1")
def a12(spark, d):
    return op.latest(facts(spark, d), "metric_id").select("metric_id", "fact_id", "period_label")


@query("a13_compare_delta", W + BY_Q + ", r AS (SELECT *, lag(value) OVER w AS first, lag(period_label) OVER w AS first_period, row_number() OVER (PARTITION BY client_name ORDER BY period_end DESC NULLS LAST) AS k FROM q WINDOW w AS (PARTITION BY client_name ORDER BY period_end)) SELECT client_name, first_period, period_label AS second_period, first, value AS second, round(value - first, 2) AS delta, round(CASE WHEN first <> 0 THEN (value - first) / first * 100 END, 4) AS pct FROM r WHERE k = 1")
def a13(spark, d):
    return op.compare(by_quarter(spark, d), "client_name").withColumns({"delta": F.round("delta", 2), "pct": F.round("pct", 4)})


@query("a14_aggregate", W + "SELECT metric_id, round(avg(value), 2) AS average, round(sum(value), 2) AS total, round(min(value), 4) AS lowest, round(max(value), 4) AS highest, count(value) AS n FROM fact WHERE value IS NOT NULL GROUP BY 1")
def a14(spark, d):
    return op.aggregate(facts(spark, d), "metric_id").withColumns({"average": F.round("average", 2), "total": F.round("total", 2), "lowest": F.round("lowest", 4), "highest": F.round("highest", 4)})


@query("a15_citation_dedupe", W + ", r AS (SELECT *, row_number() OVER (PARTITION BY document_id, slide_number ORDER BY fact_id) AS k FROM fact) SELECT document_id, slide_number, document_name, file_path || '#slide=' || slide_number AS link, regexp_extract(file_path, '/orders/(\\d+)', 1) AS deck_id FROM r WHERE k = 1")
def a15(spark, d):
    return op.citations(facts(spark, d))


@query("a16_confidence", W + "SELECT metric_id, round(avg(coalesce((semantic_score + confidence) / 2, semantic_score, confidence)), 6) AS confidence FROM fact GROUP BY 1")
def a16(spark, d):
    return facts(spark, d).groupBy("metric_id").agg(F.round(F.avg(op.row_confidence()), 6).alias("confidence"))


@query("a17_semantic_rerank", W + ", r AS (SELECT client_name, fact_id, slide_number, coalesce(CASE WHEN fact_id % 3 <> 0 THEN (fact_id * 31 % 997) / 997.0 END, 0) AS score FROM fact), w AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nx FROM r WINDOW w AS (PARTITION BY client_name ORDER BY score DESC, fact_id)), b AS (SELECT client_name, coalesce(score < 0.6 OR score - nx < 0.05, false) AS ambiguous FROM w WHERE rank = 1) SELECT client_name, fact_id, slide_number, round(score, 6) AS score, rank, ambiguous FROM w JOIN b USING (client_name) WHERE rank <= 5")
def a17(spark, d):
    f = facts(spark, d)
    scores = f.filter("fact_id % 3 <> 0").select("fact_id", (F.col("fact_id") * 31 % 997 / 997.0).alias("score"))
    return op.semantic_rerank(f, scores, "client_name").withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@query("a19_comparison_fan_out", W + ", s AS (SELECT * FROM (VALUES ('ASIA', 1), ('EUROPE', 2), ('ASIA', 3)) s(region, scope)) SELECT scope, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT fact_id, scope, value, row_number() OVER (PARTITION BY fact_id ORDER BY scope) AS k FROM fact JOIN s USING (region)) WHERE k = 1 GROUP BY 1")
def a19(spark, d):
    scopes = spark.createDataFrame([("ASIA", 1), ("EUROPE", 2), ("ASIA", 3)], "region string, scope int")
    return op.fan_out(facts(spark, d), scopes, ["region"]).groupBy("scope").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("a20_scope_filter", W + ", r AS (SELECT * FROM (VALUES (1, 1, 2), (3, 2, 3)) r(document_id, s, e)) SELECT fact_id FROM fact f JOIN orders ON o_orderkey = document_id WHERE o_orderpriority = '1-URGENT' AND (NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = f.document_id) OR EXISTS (SELECT 1 FROM r WHERE r.document_id = f.document_id AND slide_number BETWEEN s AND e))")
def a20(spark, d):
    r = spark.createDataFrame([(1, 1, 2), (3, 2, 3)], "document_id long, start int, end int")
    docs = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("document_id"))
    return op.in_scope(facts(spark, d), r, docs).select("fact_id")


@query("a21_relaxation", W + ", t AS (SELECT fact_id, CASE WHEN metric_id = 'Brand#11' AND client_name = 'NOBODY' AND region = 'ASIA' THEN 0 WHEN metric_id = 'Brand#11' AND region = 'ASIA' THEN 1 WHEN metric_id = 'Brand#11' THEN 2 END AS tier FROM fact) SELECT fact_id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)")
def a21(spark, d):
    m, r = F.col("metric_id") == "Brand#11", F.col("region") == "ASIA"
    return op.relaxed(facts(spark, d), [m & (F.col("client_name") == "NOBODY") & r, m & r, m]).select("fact_id", "tier")


@query("a22_overall_first", W + "SELECT fact_id, period_end, baseline_type FROM fact WHERE region = 'AFRICA' ORDER BY period_end DESC NULLS LAST, CASE WHEN lower(baseline_type) = 'overall' THEN 0 ELSE 1 END, fact_id LIMIT 200")
def a22(spark, d):
    return op.query_facts(facts(spark, d), overall_first=True, region=["AFRICA"]).select("fact_id", "period_end", "baseline_type")


@query("a23_context_signal", W + CHUNK_SQL + ", t AS (SELECT unnest(['urgent', 'LOW', 'absent']) AS term), h AS (SELECT term, chunk_id, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, chunk_id) AS k FROM chunk JOIN t ON contains(lower(text), lower(term))) SELECT term, chunk_id, round(score, 6) AS score, score >= 0.35 AS confident FROM h WHERE k = 1")
def a23(spark, d):
    return op.context_signal(chunks(spark, d), spark.createDataFrame([("urgent",), ("LOW",), ("absent",)], "term string")).withColumn("score", F.round("score", 6))


@query("a24_explicit_period", W + "SELECT fact_id FROM fact WHERE regexp_matches(upper(period_label), 'Q[12]') AND contains(period_label, '1998') AND period_end >= '1997-10-01' AND period_start <= '1998-03-31'")
def a24(spark, d):
    return facts(spark, d).filter(op.explicit_period("half", 1, 1998, "1997-10-01", "1998-03-31")).select("fact_id")


@query("a25_definition", "SELECT p_partkey AS metric_id, concat_ws(' ', trim(p_name) || '.', CASE WHEN p_size % 2 = 0 THEN trim(p_type) || '.' END, 'Unit: ' || trim(p_brand) || '.') AS answer FROM part")
def a25(spark, d):
    p = table(spark, d, "part")
    return op.definition(p.select(F.col("p_partkey").alias("metric_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"), F.lit(None).cast("string").alias("formula"), F.col("p_brand").alias("default_unit")))


@query("a26_clarification_options", "SELECT string_agg(n || '. ' || s, '; ' ORDER BY n) AS options FROM (SELECT s, row_number() OVER (ORDER BY s) AS n FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)) WHERE n <= 5")
def a26(spark, d):
    return op.options(table(spark, d, "customer"), "c_mktsegment")


@query("a27_formatted_values", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN printf('%.2f%%', l_extendedprice) WHEN 1 THEN '$' || format('{:,.2f}', l_extendedprice) ELSE format('{:,.2f}', l_extendedprice) END AS text FROM lineitem")
def a27(spark, d):
    unit = F.when(F.col("l_linenumber") % 3 == 0, "percent").when(F.col("l_linenumber") % 3 == 1, "currency").otherwise("count")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.formatted(F.col("l_extendedprice"), unit).alias("text"))


@query("a28_answer_grid", W + ", r AS (SELECT document_id, slide_number, fact_id, metric_id || '=' || printf('%.4f', round(value, 4)) AS t, row_number() OVER (PARTITION BY document_id, slide_number ORDER BY fact_id, value) AS n FROM fact) SELECT document_id, slide_number, string_agg(t, '; ' ORDER BY n) AS \"values\", count(*) AS n_values FROM r WHERE n <= 4 GROUP BY 1, 2")
def a28(spark, d):
    return op.grid(facts(spark, d))


@query("a29_overall_fallback", W + ", t AS (SELECT client_name, fact_id, CASE WHEN baseline_type = 'overall' AND period_label = 'Q1 FY2050' THEN 0 WHEN baseline_type = 'overall' THEN 1 ELSE 2 END AS tier FROM fact WHERE metric_id = 'Brand#13'), r AS (SELECT *, dense_rank() OVER (PARTITION BY client_name ORDER BY tier) AS k FROM t) SELECT client_name, tier, count(*) AS n FROM r WHERE k = 1 GROUP BY 1, 2")
def a29(spark, d):
    overall = F.col("baseline_type") == "overall"
    t = facts(spark, d).filter("metric_id = 'Brand#13'").withColumn("tier", F.when(overall & (F.col("period_label") == "Q1 FY2050"), 0).when(overall, 1).otherwise(2))
    best = t.groupBy("client_name").agg(F.min("tier").alias("tier"))
    return t.join(best, ["client_name", "tier"]).groupBy("client_name", "tier").agg(F.count("*").alias("n"))


@query("a30_slide_overlap", W + CHUNK_SQL + "SELECT chunk_id FROM chunk c WHERE EXISTS (SELECT 1 FROM fact f WHERE f.document_id = c.document_id AND f.metric_id = 'Brand#11' AND f.slide_number BETWEEN least(start_slide, end_slide) AND greatest(start_slide, end_slide))")
def a30(spark, d):
    return op.slide_overlap(chunks(spark, d), facts(spark, d).filter("metric_id = 'Brand#11'")).select("chunk_id")


BUDGET_SQL = ", b AS (SELECT chunk_id, o_custkey % 50 AS document_id, score FROM chunk JOIN orders ON document_id = o_orderkey)"


def customer_chunks(spark, d):
    c = chunks(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("document_id") == F.col("o_orderkey"))
    return c.withColumn("document_id", F.col("o_custkey") % 50)


@query("a31_progressive_budget", W + CHUNK_SQL + BUDGET_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS k FROM b) SELECT document_id, chunk_id FROM r WHERE k <= (SELECT greatest(3, 400 // greatest(count(DISTINCT document_id), 1)) FROM b)")
def a31(spark, d):
    return op.budget(customer_chunks(spark, d), 400, 3).select("document_id", "chunk_id")


@query("a32_capped_candidates", W + CHUNK_SQL + BUDGET_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS k FROM b), c AS (SELECT * FROM r WHERE k <= 10 ORDER BY score DESC, chunk_id LIMIT 40) SELECT document_id, count(*) AS hits, round(max(score), 6) AS best FROM c GROUP BY 1")
def a32(spark, d):
    return op.capped(customer_chunks(spark, d)).groupBy("document_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))


@query("a33_metric_chunk_links", W + CHUNK_SQL + "SELECT fact_id, chunk_id, CASE WHEN start_slide = slide_number AND end_slide = slide_number THEN 'exact' ELSE 'range_overlap' END AS relation FROM fact JOIN chunk USING (document_id) WHERE slide_number BETWEEN start_slide AND end_slide")
def a33(spark, d):
    return op.linked_chunks(facts(spark, d), chunks(spark, d))


@query("a34_evidence", W + CHUNK_SQL + ", l AS (SELECT fact_id, chunk_id, text FROM fact JOIN chunk USING (document_id) WHERE slide_number BETWEEN start_slide AND end_slide), g AS (SELECT fact_id, count(*) AS n, min_by(text, chunk_id) AS t FROM l GROUP BY 1) SELECT fact_id, metric_id, coalesce(n, 0) AS n_chunks, CASE WHEN length(t) > 8 THEN rtrim(substring(t, 1, 7)) || '…' ELSE t END AS snippet FROM fact LEFT JOIN g USING (fact_id) WHERE region = 'EUROPE'")
def a34(spark, d):
    f, c = facts(spark, d).filter("region = 'EUROPE'"), chunks(spark, d)
    return op.evidence(f, op.linked_chunks(f, c), c, 8)


@query("a35_cited_context", W + CHUNK_SQL + ", c AS (SELECT DISTINCT document_id, slide_number, file_path || '#slide=' || slide_number AS link FROM fact WHERE metric_id = 'Brand#11'), j AS (SELECT chunk_id, c.document_id, slide_number, coalesce(url, link) AS url, score, row_number() OVER (PARTITION BY c.document_id, slide_number ORDER BY score DESC, chunk_id) AS k FROM chunk JOIN c ON chunk.document_id = c.document_id AND start_slide = slide_number) SELECT chunk_id, document_id, slide_number, url FROM j WHERE k <= 2 ORDER BY score DESC, chunk_id LIMIT 20")
def a35(spark, d):
    cited = op.citations(facts(spark, d).filter("metric_id = 'Brand#11'"))
    return op.cited_context(chunks(spark, d).withColumnRenamed("start_slide", "slide_number"), cited)
