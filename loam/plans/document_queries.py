"""Queries B01 to B21, X01 and X02: orders as documents, their lines as slides and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docs_api as op
from ..sources.star import FACT_SQL
from ..sources.tables import table
from .metric_queries import facts
from .registry import query

W = "WITH " + FACT_SQL
DOC_SQL = "doc AS (SELECT o_orderkey AS document_id, o_orderstatus AS status, o_orderdate AS created_at, c_name AS client_name, c_mktsegment, o_orderpriority FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"


def documents(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("c_name").alias("client_name"), "c_mktsegment", "o_orderpriority")


@query("b01_list_documents", "WITH " + DOC_SQL + " SELECT document_id, status, client_name FROM doc WHERE status = 'O' AND client_name ILIKE '%customer%1%' AND created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1999-12-31' ORDER BY created_at DESC NULLS LAST, document_id LIMIT 50 OFFSET 25")
def b01(spark, d):
    return op.list_documents(documents(spark, d), "O", "customer%1", "1996-01-01", "1999-12-31", 50, 25).select("document_id", "status", "client_name")


@query("b02_document_detail", "WITH " + DOC_SQL + ", m AS (SELECT l_orderkey AS document_id, count(*) AS metrics, count(*) FILTER (WHERE l_discount > 0.05) AS charts FROM lineitem GROUP BY 1) SELECT document_id, status, coalesce(metrics, 0) AS metrics, coalesce(CASE WHEN charts > 0 THEN charts END, 0) AS charts FROM doc LEFT JOIN m USING (document_id)")
def b02(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    return op.counts_by(documents(spark, d).select("document_id", "status"), {"metrics": lines, "charts": lines.filter("l_discount > 0.05")})


@query("b03_document_summary", W + ", r AS (SELECT document_id, metric_name, row_number() OVER (PARTITION BY document_id ORDER BY value DESC NULLS LAST, fact_id) AS n FROM fact), t AS (SELECT document_id, string_agg(metric_name, '|' ORDER BY n) AS top FROM r WHERE n <= 5 GROUP BY 1), i AS (SELECT document_id, string_agg(x, '|' ORDER BY slide_number, fact_id, p) AS items FROM (SELECT document_id, slide_number, fact_id, unnest([context, unit]) AS x, unnest([0, 1]) AS p FROM fact WHERE slide_number = 1) GROUP BY 1) SELECT document_id, top FROM (SELECT o_orderkey AS document_id FROM orders) LEFT JOIN t USING (document_id)")
def b03(spark, d):
    f = facts(spark, d)
    slides = f.filter("slide_number = 1").withColumn("todo", F.to_json(F.array("context", "unit")))
    docs = documents(spark, d).select("document_id")
    return op.summary(docs, f, slides, "todo").select("document_id", F.array_join("top", "|").alias("top"))


@query("b04_metrics_nulls_last", W + "SELECT fact_id, category, round(value, 4) AS value FROM fact WHERE category = 'R' AND metric_name ILIKE '%e%' AND value >= 1000 AND value <= 90000 ORDER BY value DESC NULLS LAST, fact_id LIMIT 100")
def b04(spark, d):
    return op.metrics(facts(spark, d), "R", "e", 1000, 90000, categories=("A", "N", "R")).select("fact_id", "category", F.round("value", 4).alias("value"))


@query("b05_metrics_by_category", W + "SELECT document_id, coalesce(CASE WHEN category <> 'N' THEN category END, 'uncategorized') AS category, count(*) AS n, string_agg(fact_id, ',' ORDER BY fact_id) AS ids FROM fact GROUP BY 1, 2")
def b05(spark, d):
    f = facts(spark, d).withColumn("category", F.when(F.col("category") != "N", F.col("category")))
    return op.grouped(f, "category", "uncategorized", ["fact_id"], "m").select("document_id", "category", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["fact_id"].cast("string")), ",").alias("ids"))


@query("b06_top_metrics", W + "SELECT fact_id, round(value, 4) AS value FROM fact ORDER BY value DESC NULLS LAST, fact_id LIMIT 10")
def b06(spark, d):
    return op.top_metrics(facts(spark, d)).select("fact_id", F.round("value", 4).alias("value"))


@query("b07_compare_across_documents", W + "SELECT document_id, fact_id, metric_name FROM fact WHERE metric_name ILIKE '%st%' AND document_id IN (1, 2, 3, 5, 8, 13, 21, 34)")
def b07(spark, d):
    return op.compare_across(facts(spark, d), "st", [1, 2, 3, 5, 8, 13, 21, 34]).select("document_id", "fact_id", "metric_name")


def lines(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slide_id"), F.col("l_returnflag").alias("slide_type"), "l_discount", "l_orderkey", "l_linenumber")


@query("b08_slides_with_charts", "SELECT l_orderkey * 10 + l_linenumber AS slide_id FROM lineitem a WHERE l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_discount > 0.07 AND b.l_orderkey * 10 + b.l_linenumber = a.l_orderkey * 10 + a.l_linenumber)")
def b08_semi(spark, d):
    s = lines(spark, d)
    return op.slides(s, s.filter("l_discount > 0.07"), "R", True).select("slide_id")


@query("b08_slides_without_charts", "SELECT l_orderkey * 10 + l_linenumber AS slide_id FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_discount > 0.07 AND b.l_orderkey * 10 + b.l_linenumber = a.l_orderkey * 10 + a.l_linenumber)")
def b08_anti(spark, d):
    s = lines(spark, d)
    return op.slides(s, s.filter("l_discount > 0.07"), "R", False).select("slide_id")


@query("b09_slides_by_type", "SELECT coalesce(nullif(l_returnflag, 'A'), 'unknown') AS slide_type, count(*) AS n, max(l_orderkey * 10 + l_linenumber) AS last FROM lineitem GROUP BY 1")
def b09(spark, d):
    s = lines(spark, d).withColumn("slide_type", F.coalesce(F.nullif("slide_type", F.lit("A")), F.lit("unknown")))
    return s.groupBy("slide_type").agg(F.count("*").alias("n"), F.max("slide_id").alias("last"))


@query("b10_slide_detail", W + "SELECT slide_id, count(*) AS n_entities, string_agg(metric_id, ',' ORDER BY metric_id, fact_id) AS entities, sum(CASE WHEN baseline_type = 'overall' THEN 1 END) AS n_charts FROM fact GROUP BY 1")
def b10(spark, d):
    f = facts(spark, d)
    out = op.slide_detail(f.select("slide_id").distinct(), {"e": (f, ["metric_id", "fact_id"]), "c": (f.filter("baseline_type = 'overall'"), ["fact_id"])})
    return out.select("slide_id", F.size("e").cast("long").alias("n_entities"), F.array_join(F.transform("e", lambda x: x["metric_id"]), ",").alias("entities"), F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("n_charts"))


@query("b11_entities", "SELECT p_brand AS name, count(*) AS mention_count FROM part WHERE p_brand ILIKE '%brand%' GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 50")
def b11(spark, d):
    e = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("mention_count")).withColumn("entity_type", F.lit("brand"))
    return op.entities(e, "brand", "brand", 2).select("name", "mention_count")


@query("b12_entity_neighbours", "WITH r AS (SELECT 'nation' AS relation, n_regionkey AS source_id, n_nationkey + 100 AS target_id FROM nation UNION ALL SELECT 'supplier', s_nationkey + 100, s_suppkey + 1000 FROM supplier) SELECT 'outgoing' AS direction, relation, source_id AS entity_id, target_id AS other_id FROM r WHERE source_id = 107 UNION ALL SELECT 'incoming', relation, target_id, source_id FROM r WHERE target_id = 107")
def b12(spark, d):
    n = table(spark, d, "nation").select(F.lit("nation").alias("relation"), F.col("n_regionkey").cast("long").alias("source_id"), (F.col("n_nationkey") + 100).cast("long").alias("target_id"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("relation"), (F.col("s_nationkey") + 100).cast("long").alias("source_id"), (F.col("s_suppkey") + 1000).alias("target_id"))
    return op.neighbourhood(n.unionByName(s), F.lit(107))


FACETS_SQL = "f AS (SELECT doc_id AS document_id, 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)"


def facet_rows(spark, d):
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("document_id"), F.lit("lang").alias("facet"), F.col("lang").alias("value")).unionByName(x.select(F.col("doc_id").alias("document_id"), F.lit("source").alias("facet"), F.col("source").alias("value")))


@query("b13_facet_catalogue", "WITH " + FACETS_SQL + " SELECT n AS facet, coalesce(string_agg(DISTINCT value, ',' ORDER BY value), '') AS \"values\" FROM (SELECT unnest(['lang', 'source', 'unused']) AS n) LEFT JOIN f ON facet = n GROUP BY 1")
def b13(spark, d):
    return op.facet_catalogue(spark.createDataFrame([("lang",), ("source",), ("unused",)], "facet string"), facet_rows(spark, d)).select("facet", F.array_join("values", ",").alias("values"))


@query("b14_facets_and_or", "SELECT doc_id AS document_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2') ORDER BY 1 LIMIT 50")
def b14(spark, d):
    return op.by_facets(facet_rows(spark, d), {"lang": ["en", "de"], "source": ["src1", "src2"]})


@query("b15_content_search", "SELECT doc_id AS chunk_id, substring(text, 1, 500) AS text, length(text) AS length FROM documents WHERE text ILIKE '%heti%' OR text ILIKE '%önn%' ORDER BY doc_id LIMIT 20")
def b15(spark, d):
    return op.content_search(table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id"), "heti önn")


@query("b16_keywords", "WITH k AS (SELECT p_type AS keyword, round(avg(p_retailprice), 2) AS score FROM part GROUP BY 1) SELECT * FROM k WHERE score >= 900 ORDER BY score DESC NULLS LAST, keyword LIMIT 30")
def b16(spark, d):
    return op.keywords(table(spark, d, "part").groupBy(F.col("p_type").alias("keyword")).agg(F.round(F.avg("p_retailprice"), 2).alias("score")), 900)


def insight_rows(spark, d):
    f = facts(spark, d)
    return f.withColumn("insights", F.when(F.col("slide_number") % 2 == 0, F.to_json(F.array("metric_id", "unit"))).when(F.col("slide_number") == 1, F.col("context")))


@query("b17_insight_roll_up", W + ", s AS (SELECT document_id, CASE WHEN slide_number % 2 = 0 THEN [metric_id, unit] WHEN slide_number = 1 THEN [context] ELSE [] END AS l FROM fact) SELECT document_id, unnest(l) AS item FROM s")
def b17(spark, d):
    return op.roll_up(insight_rows(spark, d), "insights").select("document_id", "item")


@query("b18_action_items", W + "SELECT document_id, slide_number, unnest([metric_id, unit]) AS item, unnest([0, 1]) AS pos FROM fact WHERE slide_number % 2 = 0")
def b18(spark, d):
    return op.roll_up(insight_rows(spark, d).filter("slide_number % 2 = 0"), "insights").select("document_id", "slide_number", "item", "pos")


API_FILTERS = [("unit", "in", ["currency", "count"]), ("metric_id", "not_in", ["Brand#11"]), ("slide_number", "between", (1, 4)), ("client_name", "starts_with", "M"), ("metric_name", "contains", "E"), ("period_label", "ends_with", "1998"), ("value", "gt", 1000.0), ("value", "lte", 90000.0), ("baseline_type", "is_null", None), ("context", "is_not_null", None), ("category", "ne", "R"), ("region", "eq", "ASIA"), ("slide_number", "gte", 1), ("slide_number", "lt", 9)]
API_WHERE = "unit IN ('currency', 'count') AND metric_id NOT IN ('Brand#11') AND slide_number BETWEEN 1 AND 4 AND starts_with(client_name, 'M') AND contains(metric_name, 'E') AND ends_with(period_label, '1998') AND value > 1000 AND value <= 90000 AND baseline_type IS NULL AND context IS NOT NULL AND category <> 'R' AND region = 'ASIA' AND slide_number >= 1 AND slide_number < 9"


@query("b19_dispatch_filter_language", W + f"SELECT fact_id, metric_id, round(value, 4) AS value FROM fact WHERE {API_WHERE} ORDER BY value DESC NULLS LAST, fact_id LIMIT 40 OFFSET 5")
def b19(spark, d):
    api = op.QueryApi({"metrics": (facts(spark, d), "fact_id")})
    answer = api.execute({"query_type": "metrics", "filters": API_FILTERS, "sort": [("value", "desc")], "limit": 40, "offset": 5, "count": False})
    return answer["rows"].select("fact_id", "metric_id", F.round("value", 4).alias("value"))


@query("b20_tool_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{o}', '{','.join(p)}')" for n, (o, p) in op.TOOLS.items()) + ") t(tool, operator, parameters)")
def b20(spark, d):
    return spark.createDataFrame([(n, o, ",".join(p)) for n, (o, p) in op.TOOLS.items()], "tool string, operator string, parameters string")


@query("b21_export_rows", "SELECT o_orderkey AS document_id, '{\"document_id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def b21(spark, d):
    x = documents(spark, d)
    return x.select("document_id", F.to_json(F.struct("document_id", "status")).alias("json"))


@query("x01_filter_each_operator", W + "SELECT 'gt' AS op, count(*) AS n FROM fact WHERE value > 5000 UNION ALL SELECT 'in', count(*) FROM fact WHERE unit IN ('percent') UNION ALL SELECT 'ends_with', count(*) FROM fact WHERE ends_with(metric_id, '1') UNION ALL SELECT 'is_null', count(*) FROM fact WHERE baseline_type IS NULL")
def x01(spark, d):
    f = facts(spark, d)
    parts = [("gt", ("value", "gt", 5000)), ("in", ("unit", "in", ["percent"])), ("ends_with", ("metric_id", "ends_with", "1")), ("is_null", ("baseline_type", "is_null", None))]
    flags = f.select(*[op.OPERATORS[o](F.col(c), v).cast("int").alias(n) for n, (c, o, v) in parts])
    return flags.agg(*[F.sum(n).alias(n) for n, _ in parts]).unpivot([], [n for n, _ in parts], "op", "n")


@query("x02_facet_buckets", W + "SELECT coalesce(baseline_type, 'unknown') AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fact GROUP BY 1")
def x02(spark, d):
    return op.buckets(facts(spark, d), "baseline_type").withColumn("share", F.round("share", 6))
