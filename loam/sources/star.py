"""The star view: metric facts with their slide, catalogue entry, document, client, region and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.fiscal import fiscal_quarter, fiscal_year, quarter_bounds
from .tables import col_or_null, table

SCHEMA = {
    "fact_id": "long", "slide_id": "long", "slide_number": "int", "document_id": "long", "document_name": "string", "file_path": "string", "metric_id": "string", "metric_name": "string", "category": "string",
    "raw_value": "string", "value": "double", "unit": "string", "scale": "string", "client_name": "string", "region": "string", "country": "string", "period_label": "string", "period_type": "string", "period_number": "int",
    "fiscal_year": "int", "period_start": "string", "period_end": "string", "confidence": "double", "baseline_type": "string", "context": "string", "semantic_score": "double",
}


def star_view(metrics: DataFrame, slides: DataFrame, catalog: DataFrame, documents: DataFrame, clients: DataFrame, regions: DataFrame, periods: DataFrame) -> DataFrame:
    """Facts LEFT JOIN all dimensions. Client, region and period are the document's. Columns that a source lacks are null, whichever
    they are; the small dimensions are left to the planner, which broadcasts what is under its threshold."""
    m = metrics.select(col_or_null(metrics, "id", "long").alias("fact_id"), col_or_null(metrics, "slide_id", "long"), col_or_null(metrics, "metric_catalog_id", "long").alias("__m"), col_or_null(metrics, "name", "string").alias("raw_name"), col_or_null(metrics, "raw_value", "string"), col_or_null(metrics, "normalized_value", "double").alias("value"), col_or_null(metrics, "unit", "string"), F.lit("ones").alias("scale"), col_or_null(metrics, "category", "string"), col_or_null(metrics, "country", "string"), col_or_null(metrics, "extraction_confidence", "double").alias("confidence"), col_or_null(metrics, "baseline_type", "string"), F.coalesce(col_or_null(metrics, "llm_context_label", "string"), col_or_null(metrics, "raw_context", "string")).alias("context"))
    s = slides.select(F.col("id").alias("__s"), col_or_null(slides, "document_id", "long"), col_or_null(slides, "slide_number", "int"), col_or_null(slides, "title", "string").alias("slide_title"))
    k = catalog.select(F.col("id").alias("__k"), F.coalesce(col_or_null(catalog, "slug", "string"), col_or_null(catalog, "name", "string")).alias("metric_id"), F.col("name").alias("metric_name"))
    d = documents.select(F.col("id").alias("__d"), col_or_null(documents, "filename", "string").alias("document_name"), col_or_null(documents, "file_path", "string"), col_or_null(documents, "client_id", "long").alias("__c"), col_or_null(documents, "region_id", "long").alias("__r"), col_or_null(documents, "report_period_id", "long").alias("__p"), col_or_null(documents, "report_period", "string"))
    c = clients.select(F.col("id").alias("__cid"), F.col("name").alias("client_name"))
    r = regions.select(F.col("id").alias("__rid"), F.col("code").alias("region"))
    p = periods.select(F.col("id").alias("__pid"), *[col_or_null(periods, n, t) for n, t in (("period_label", "string"), ("period_type", "string"), ("period_number", "int"), ("fiscal_year", "int"))], col_or_null(periods, "start_date", "string").alias("period_start"), col_or_null(periods, "end_date", "string").alias("period_end"))
    out = m.join(s, F.col("slide_id") == F.col("__s"), "left").join(k, F.col("__m") == F.col("__k"), "left").join(d, F.col("document_id") == F.col("__d"), "left")
    out = out.join(c, F.col("__c") == F.col("__cid"), "left").join(r, F.col("__r") == F.col("__rid"), "left").join(p, F.col("__p") == F.col("__pid"), "left")
    out = out.withColumn("period_label", F.coalesce("period_label", "report_period")).withColumn("metric_id", F.coalesce("metric_id", "raw_name")).withColumn("metric_name", F.coalesce("metric_name", "raw_name")).withColumn("semantic_score", F.lit(None).cast("double"))
    return out.select(*[F.col(n).cast(t).alias(n) for n, t in SCHEMA.items()], "slide_title")


#: What tells lines of one order and number apart; lines that are equal in all of it are interchangeable.
LINE_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_quantity"]


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with line_id, a key even where order and number don't make one, and line_no, the place among those that share both."""
    no = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER))
    rows = table(spark, sf_dir, "lineitem").withColumn("line_no", no)
    return rows.withColumn("line_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("line_no"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns from order lines: an order is a document, a line a slide, a part the catalogue entry, its customer's segment
    the client, and the fiscal quarter of the order its period."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    year, quarter = fiscal_year(F.col("day")), fiscal_quarter(F.col("day"))
    begin, end = quarter_bounds(year, quarter)
    orders = orders.select("o_orderkey", "o_custkey", "o_orderpriority", year.alias("fiscal_year"), quarter.alias("period_number"), begin.cast("string").alias("period_start"), end.cast("string").alias("period_end"))
    out = numbered_lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    out = out.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(t("part").select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select(
        F.col("line_id").alias("fact_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("slide_id"),
        F.col("l_linenumber").alias("slide_number"),
        F.col("l_orderkey").alias("document_id"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("document_name"),
        F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("file_path"),
        F.col("p_brand").alias("metric_id"),
        F.col("p_type").alias("metric_name"),
        F.col("l_returnflag").alias("category"),
        F.col("l_extendedprice").cast("string").alias("raw_value"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
        F.when(F.col("p_size") % 3 == 0, "currency").when(F.col("p_size") % 3 == 1, "percent").otherwise("count").alias("unit"),
        F.lit("ones").alias("scale"),
        F.col("c_mktsegment").alias("client_name"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("Q"), F.col("period_number").cast("string"), F.lit(" FY"), F.col("fiscal_year").cast("string")).alias("period_label"),
        F.lit("quarter").alias("period_type"),
        F.col("period_number"),
        F.col("fiscal_year"),
        F.col("period_start"),
        F.col("period_end"),
        (F.lit(0.5) + F.col("l_tax") * 5).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "overall").alias("baseline_type"),
        F.col("o_orderpriority").alias("context"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 10).alias("semantic_score"),
    )


#: numbered_lines and order_facts for DuckDB.
LINES_SQL = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY " + ", ".join(LINE_ORDER) + ") AS line_no, (l_orderkey * 10 + l_linenumber) * 1000000 + line_no AS line_id FROM lineitem)"
FACT_SQL = f"""
fact AS (SELECT line_id AS fact_id, l_orderkey * 10 + l_linenumber AS slide_id, l_linenumber AS slide_number, l_orderkey AS document_id,
  'order ' || l_orderkey AS document_name, '/orders/' || l_orderkey AS file_path, p_brand AS metric_id, p_type AS metric_name, l_returnflag AS category,
  l_extendedprice * (1 - l_discount) AS value, CASE p_size % 3 WHEN 0 THEN 'currency' WHEN 1 THEN 'percent' ELSE 'count' END AS unit, 'ones' AS scale,
  c_mktsegment AS client_name, r_name AS region, n_name AS country, 'Q' || quarter(o_orderdate + INTERVAL 3 MONTH) || ' FY' || year(o_orderdate + INTERVAL 3 MONTH) AS period_label,
  'quarter' AS period_type, CAST(quarter(o_orderdate + INTERVAL 3 MONTH) AS INT) AS period_number, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INT) AS fiscal_year,
  strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period_start, strftime(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH), '%Y-%m-%d') AS period_end,
  0.5 + l_tax * 5 AS confidence, CASE WHEN l_returnflag = 'R' THEN 'overall' END AS baseline_type, o_orderpriority AS context,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 10 END AS semantic_score
 FROM {LINES_SQL} LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey)
"""
