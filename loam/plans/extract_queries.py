"""Queries D01 to D54: decks made of order lines, and real texts where they serve."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..functions.number import rounded
from ..functions.text import chunked, window_around
from ..operators import boxes as bx
from ..operators import extract as op
from ..operators import neighbours as nb
from ..operators import trees
from ..operators.facts import first_by
from ..sources.star import FACT_SQL, LINES_SQL, numbered_lines
from ..sources.tables import table
from .metric_queries import facts
from .registry import query

W = "WITH " + FACT_SQL
LINE = "l AS (SELECT l_orderkey AS deck_id, l_linenumber AS page, line_no AS tie, line_id AS id, 'Discount rate: ' || CAST(round(l_discount * 100) AS INT) || '%' || chr(10) || 'Price $' || CAST(l_extendedprice AS DECIMAL(12, 2)) AS body, 'flag ' || l_returnflag AS note, l_discount, l_extendedprice, l_quantity, l_returnflag FROM " + LINES_SQL + ")"
DECK = LINE + ", d AS (SELECT deck_id, string_agg('<!-- PAGE ' || page || ' -->' || chr(10) || body || chr(10) || '### Notes:' || chr(10) || note, chr(10) ORDER BY page, tie) AS text FROM l GROUP BY 1)"


def lines(spark, d):
    x = numbered_lines(spark, d)
    body = F.concat(F.lit("Discount rate: "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%\nPrice $"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return x.select(F.col("l_orderkey").alias("deck_id"), F.col("l_linenumber").alias("page"), F.col("line_no").alias("tie"), F.col("line_id").alias("id"), body.alias("body"), F.concat(F.lit("flag "), "l_returnflag").alias("note"), "l_discount", "l_extendedprice", "l_quantity", "l_returnflag")


def decks(spark, d):
    text = F.concat(F.lit("<!-- PAGE "), F.col("page").cast("string"), F.lit(" -->\n"), "body", F.lit("\n### Notes:\n"), "note")
    return lines(spark, d).groupBy("deck_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "tie", text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


@query("d01_page_split", "WITH " + LINE + " SELECT deck_id, page, body, note AS notes, CAST(0 AS BIGINT) AS images FROM l")
def d01(spark, d):
    return op.pages(decks(spark, d))


@query("d02_notes_removal", "WITH " + DECK + " SELECT deck_id, regexp_replace(text, '(?s)### Notes:.*?(<!-- PAGE|\\z)', '\\1', 'g') AS text FROM d")
def d02(spark, d):
    return decks(spark, d).select("deck_id", op.without_notes(F.col("text")).alias("text"))


@query("d03_number_scan", "WITH " + DECK + " SELECT deck_id, 'percent' AS kind, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%')) AS raw FROM d UNION ALL SELECT deck_id, 'currency', unnest(regexp_extract_all(text, '\\$\\d[\\d,]*(?:\\.\\d+)?')) FROM d")
def d03(spark, d):
    return op.numbers(decks(spark, d), "deck_id")


@query("d04_chart_heuristics", "WITH " + DECK + ", c AS (SELECT deck_id, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?%')) AS percentages, least(10, len(regexp_extract_all(text, '(?m)^[^:\\n]+:[ \\t]*[^\\n]+$'))) AS rows FROM d) SELECT *, percentages >= 3 AS comparison, rows >= 3 AS \"table\" FROM c WHERE percentages >= 3 OR rows >= 3")
def d04(spark, d):
    return op.charts(decks(spark, d), "deck_id")


@query("d05_business_terms", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(of|heti|anen|the)\\b')) AS t FROM documents WHERE lang = 'en') SELECT DISTINCT doc_id, CASE WHEN length(t) <= 4 THEN upper(t) ELSE upper(t[1]) || lower(t[2:]) END AS term FROM t")
def d05(spark, d):
    return op.business_terms(table(spark, d, "documents").filter("lang = 'en'"), ["of", "heti", "anen", "the"], "doc_id")


@query("d06_chunks", "WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 1300)) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(start // 1300 AS INT) AS chunk_index, CAST(start AS INT) AS start, CAST(least(start + 1500, length(text)) AS INT) AS \"end\", md5(substring(text, start + 1, 1500)) AS digest FROM s WHERE start = 0 OR start + 200 < length(text)")
def d06(spark, d):
    return chunked(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "start", "end", F.md5("chunk").alias("digest"))


@query("d07_chunk_slide_range", "WITH " + DECK + " SELECT deck_id, list_min(list_transform(regexp_extract_all(text, '<!-- PAGE (\\d+) -->', 1), lambda x: x::INT)) AS first, list_max(list_transform(regexp_extract_all(text, '<!-- PAGE (\\d+) -->', 1), lambda x: x::INT)) AS last FROM d")
def d07(spark, d):
    a, b = op.slide_range_of(F.col("text"))
    return decks(spark, d).select("deck_id", a.alias("first"), b.alias("last"))


@query("d08_range_merge", "WITH r AS (SELECT o_custkey % 40 AS k, CAST(o_orderkey % 97 AS INT) AS s, CAST(o_orderkey % 97 + o_custkey % 3 AS INT) AS e FROM orders), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT k, min(s) AS start, max(e) AS \"end\" FROM i GROUP BY k, island")
def d08(spark, d):
    s = (F.col("o_orderkey") % 97).cast("int")
    r = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("k"), s.alias("start"), (s + (F.col("o_custkey") % 3).cast("int")).alias("end"))
    return op.merged_ranges(r, "k")


SPECS = [(1, "1-3, 7, 9:12"), (2, "0-2,5-4,x"), (3, " 4 "), (4, "2 - 2,-1")]


@query("d09_range_parser", "SELECT * FROM (VALUES (1, 1, 3), (1, 7, 7), (1, 9, 12), (3, 4, 4), (4, 2, 2)) t(id, start, \"end\")")
def d09(spark, d):
    return op.parsed_ranges(spark.createDataFrame(SPECS, "id int, spec string")).select("id", "start", "end")


@query("d10_page_alignment")
def d10(spark, d):
    # fifty decks of five pages and five slides from each 500 documents
    x = table(spark, d, "documents").select(F.expr("doc_id div 500 * 50 + doc_id % 50").alias("deck"), F.expr("cast(doc_id % 500 div 50 as int)").alias("n"), "text")
    return op.aligned(x.filter("n < 5"), x.filter("n >= 5").withColumn("n", F.col("n") - 5), "deck")


HTML = "'<table><tr><th>Metric</th><th>Value</th></tr><tr><td>' || p_brand || '</td><td><b>' || p_size || '</b>%</td></tr></table>'"


@query("d11_html_tables", "SELECT p_partkey, 0 AS table_no, 0 AS row, 0 AS col, 'Metric' AS text FROM part UNION ALL SELECT p_partkey, 0, 0, 1, 'Value' FROM part UNION ALL SELECT p_partkey, 0, 1, 0, p_brand FROM part UNION ALL SELECT p_partkey, 0, 1, 1, p_size || ' %' FROM part")
def d11(spark, d):
    return op.html_cells(table(spark, d, "part").select("p_partkey", F.expr(HTML).alias("html")), "p_partkey")


@query("d12_content_hash", "SELECT page_id, sha256(html) AS sha256 FROM pages")
def d12(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


TABLE_SQL = r"""WITH j AS (SELECT p_partkey, '[["Metric","Value"],["' || p_brand || '","' || p_size || '"]]' AS j FROM part),
k AS (SELECT p_partkey, sha256(j) AS k FROM j),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(k)) AS h FROM k)
SELECT p_partkey, k, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][CAST(instr('0123456789abcdef', h[17]) - 1 AS INT) % 4 + 1] || h[18:20] || '-' || h[21:32] AS table_id FROM h"""


@query("d13_table_identity", TABLE_SQL)
def d13(spark, d):
    rows = F.array(F.array(F.lit(" Metric "), F.lit("Value")), F.array(F.lit(""), F.lit(" ")), F.array("p_brand", F.col("p_size").cast("string")))
    k = table(spark, d, "part").select("p_partkey", op.table_key(op.normal_rows(rows)).alias("k"))
    return k.select("p_partkey", "k", op.table_uuid("k").alias("table_id"))


def labelled_texts(spark, d):
    return lines(spark, d).select("id", F.concat(F.lit("CTR "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% and Reach: "), F.col("l_quantity").cast("int").cast("string"), F.lit("K; spend = $"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("text"))


LABELLED = LINE + ", t AS (SELECT id, 'CTR ' || CAST(round(l_discount * 100) AS INT) || '% and Reach: ' || CAST(l_quantity AS INT) || 'K; spend = $' || CAST(l_extendedprice AS DECIMAL(12, 2)) AS text FROM l)"


@query("d14_label_scan", "WITH " + LABELLED + " SELECT id, m AS label, n AS raw, CAST(instr(text, n) - 1 AS INT) AS start, CAST(instr(text, n) - 1 + length(n) AS INT) AS \"end\" FROM t, (VALUES ('click_through_rate', 'CTR'), ('reach', 'Reach'), ('spend', 'spend')) v(m, n)")
def d14(spark, d):
    return op.label_spans(labelled_texts(spark, d))


@query("d15_value_scan", "WITH " + LABELLED + ", v AS (SELECT id, text, unnest(regexp_extract_all(text, '\\$?\\d+(?:\\.\\d+)?[K%]?')) AS raw FROM t) SELECT id, raw, CAST(CASE WHEN contains(raw, 'K') THEN 1000 ELSE 1 END * CAST(regexp_replace(raw, '[$K%]', '', 'g') AS DOUBLE) AS DOUBLE) AS value, CASE WHEN contains(raw, '%') THEN 'percent' WHEN contains(raw, '$') THEN 'currency' ELSE 'count' END AS unit FROM v")
def d15(spark, d):
    v = op.value_spans(labelled_texts(spark, d))
    return v.select("id", "raw", op.parsed_number(F.col("raw")).alias("value"), op.unit_of(F.col("raw")).alias("unit"))


NOISE = [("2024", "in 2024"), ("12", "Jan 12 was"), ("7%", "page 7%"), ("1.2K", "reach 1.2K"), ("25", "FY 25"), ("5%", "5% of May"), ("300", "300 users"), ("1999", "$ 1999")]


@query("d16_noise_filter", "SELECT * FROM (VALUES ('2024', true), ('12', true), ('7%', true), ('1.2K', false), ('25', true), ('5%', false), ('300', false), ('1999', true)) t(raw, noise)")
def d16(spark, d):
    x = spark.createDataFrame(NOISE, "raw string, context string")
    return x.select("raw", op.noise(F.col("raw"), F.col("context")).alias("noise"))


@query("d17_qualifiers", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'EMEA' END AS geo, CASE WHEN p_size % 2 = 0 THEN 'Android' END AS platform, 'Q' AS timeframe FROM part")
def d17(spark, d):
    k = F.col("p_size")
    text = F.concat(F.when(k % 3 == 0, "US reach ").when(k % 3 == 1, "emea reach ").otherwise("focus "), F.when(k % 2 == 0, "on android ").otherwise("on tv "), F.lit("in Q2"))
    q = op.qualifiers(text)
    return table(spark, d, "part").select("p_partkey", q["geo"].alias("geo"), q["platform"].alias("platform"), q["timeframe"].alias("timeframe"))


@query("d18_context_window", "SELECT doc_id, trim(substring(text, 21, 160), ' ') AS context FROM documents WHERE length(text) > 300")
def d18(spark, d):
    return table(spark, d, "documents").filter(F.length("text") > 300).select("doc_id", window_around(F.col("text"), F.lit(100), F.lit(100), 80).alias("context"))


def links(spark, d):
    t = labelled_texts(spark, d)
    return op.text_links(op.label_spans(t), op.value_spans(t), t)


@query("d19_text_links", "WITH " + LABELLED + " SELECT id, count(*) * 9 AS links FROM t GROUP BY 1")
def d19(spark, d):
    return links(spark, d).groupBy("id").agg(F.count("*").alias("links"))


CELLS_SQL = ", c AS (SELECT id, 0 AS row, 0 AS col, 'CTR' AS text FROM l UNION ALL SELECT id, 0, 1, CAST(round(l_discount * 100) AS INT) || '%' FROM l UNION ALL SELECT id, 1, 0, 'Spend' FROM l UNION ALL SELECT id, 1, 1, '$' || CAST(l_quantity AS INT) FROM l UNION ALL SELECT id, 0, 2, 'Goal' FROM l UNION ALL SELECT id, 1, 2, '9%' FROM l)"


def cells(spark, d):
    x = lines(spark, d)
    cell = lambda r, c, t: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text"))
    return x.select("id", F.inline(F.array(cell(0, 0, F.lit("CTR")), cell(0, 1, F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))), cell(1, 0, F.lit("Spend")), cell(1, 1, F.concat(F.lit("$"), F.col("l_quantity").cast("int").cast("string"))), cell(0, 2, F.lit("Goal")), cell(1, 2, F.lit("9%")))))


@query("d20_table_links", "WITH " + LINE + CELLS_SQL + ", l2 AS (SELECT * FROM c WHERE NOT regexp_matches(text, '\\d')), v2 AS (SELECT * FROM c WHERE regexp_matches(text, '\\d')), ab AS (SELECT a.id, a.text AS label, b.text AS value, true AS same_row, b.col - a.col AS dist FROM l2 a JOIN v2 b ON a.id = b.id AND a.row = b.row WHERE b.col > a.col UNION ALL SELECT a.id, a.text, b.text, false, b.row - a.row FROM l2 a JOIN v2 b ON a.id = b.id AND a.col = b.col WHERE b.row > a.row) SELECT id, label, value, CASE WHEN same_row THEN 'table_row_right' ELSE 'table_col_down' END AS relation, dist AS distance FROM ab")
def d20(spark, d):
    return op.table_links(cells(spark, d)).select("id", "label", "value", "relation", "distance")


@query("d21_link_score", "WITH " + LINE + CELLS_SQL + ", l2 AS (SELECT * FROM c WHERE NOT regexp_matches(text, '\\d')), v2 AS (SELECT * FROM c WHERE regexp_matches(text, '\\d')), ab AS (SELECT a.id, a.text AS label, b.text AS value, true AS same_row, b.col - a.col AS dist FROM l2 a JOIN v2 b ON a.id = b.id AND a.row = b.row WHERE b.col > a.col UNION ALL SELECT a.id, a.text, b.text, false, b.row - a.row FROM l2 a JOIN v2 b ON a.id = b.id AND a.col = b.col WHERE b.row > a.row), k AS (SELECT id, label, value, CASE WHEN same_row THEN 0.25 ELSE 0.18 END AS r, dist FROM ab) SELECT id, label, value, round(greatest(0, least(1, 0.35 + CASE WHEN label = 'Goal' THEN 0 WHEN (label = 'CTR') = contains(value, '%') THEN 0.25 ELSE -0.25 END + r + (1 - dist / 160.0) * 0.18 + 0.06)), 6) AS score FROM k")
def d21(spark, d):
    expected = F.when(F.col("label") == "CTR", "percent").when(F.col("label") == "Spend", "currency").otherwise("")
    score = op.link_score(F.col("relation"), F.col("distance"), F.lit(0), F.lit(0), expected, op.unit_of(F.col("value")), F.lit(2), F.lit(""))
    return op.table_links(cells(spark, d)).select("id", "label", "value", F.round(score, 6).alias("score"))


@query("d22_link_selection", W + ", k AS (SELECT document_id, metric_id, fact_id, round((fact_id * 31 % 1009) / 1009.0, 6) AS score FROM fact), r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nx FROM k WINDOW w AS (PARTITION BY document_id ORDER BY score DESC, fact_id)) SELECT document_id, fact_id, score < 0.36 OR coalesce(score - nx <= 0.08, false) AS adjudicate FROM r WHERE n = 1")
def d22(spark, d):
    k = facts(spark, d).select("document_id", "metric_id", "fact_id", F.round(F.col("fact_id") * 31 % 1009 / 1009.0, 6).alias("score"))
    return op.selected_links(k, ["document_id"], ["fact_id"]).select("document_id", "fact_id", "adjudicate")


REQUESTS_SQL = """WITH r AS (SELECT DISTINCT p_brand, '{"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}' AS request FROM part)
SELECT sha256(request) AS key, CASE WHEN p_brand = 'Brand#11' THEN 'known' ELSE 'first of ' || length(request) END AS answer, p_brand = 'Brand#11' AS cached FROM r"""


@query("d23_adjudication_cache", REQUESTS_SQL)
def d23(spark, d):
    r = table(spark, d, "part").select("p_brand", "p_type")
    known = r.filter("p_brand = 'Brand#11'").select(op.request_key("p_brand", "p_type").alias("key"), F.lit("known").alias("answer")).distinct()
    return op.adjudicated(r, known, lambda request: f"first of {len(request)}", ["p_brand", "p_type"])


RES = ", f AS (SELECT document_id AS slide, CASE fact_id % 3 WHEN 0 THEN 'reach' WHEN 1 THEN 'unique_reach' ELSE 'spend' END AS m, CAST(fact_id % 5 AS DOUBLE) AS value, CASE WHEN fact_id % 7 = 0 THEN 'unduplicated audience' ELSE 'audience' END AS snippet, fact_id, round(confidence, 6) AS confidence, CASE fact_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'slide' WHEN 2 THEN 'notes' ELSE 'other' END AS source FROM fact), g AS (SELECT *, CASE WHEN m = 'reach' AND snippet LIKE 'undup%' THEN 'unique_reach' ELSE m END AS metric_id FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY slide, metric_id, value ORDER BY confidence DESC, CASE source WHEN 'table' THEN 3 WHEN 'slide' THEN 2 WHEN 'notes' THEN 1 ELSE 0 END DESC, fact_id) AS n FROM g)"


@query("d24_resolution", W + RES + " SELECT fact_id, metric_id FROM h WHERE n = 1 AND NOT (metric_id = 'reach' AND EXISTS (SELECT 1 FROM h u WHERE u.n = 1 AND u.metric_id = 'unique_reach' AND u.slide = h.slide AND u.value = h.value))")
def d24(spark, d):
    i = F.col("fact_id")
    f = facts(spark, d).select(F.col("document_id").alias("slide"), F.when(i % 3 == 0, "reach").when(i % 3 == 1, "unique_reach").otherwise("spend").alias("metric_id"), (i % 5).cast("double").alias("value"), F.lit("count").alias("unit"), F.lit("").alias("quals"), F.round("confidence", 6).alias("confidence"), F.when(i % 4 == 0, "table").when(i % 4 == 1, "slide").when(i % 4 == 2, "notes").otherwise("other").alias("source"), F.when(i % 7 == 0, "unduplicated audience").otherwise("audience").alias("snippet"), "fact_id")
    return op.resolved(f).select("fact_id", "metric_id")


@query("d25_first_wins", W + ", r AS (SELECT fact_id, row_number() OVER (PARTITION BY lower(metric_name), round(value, 2), unit ORDER BY fact_id) AS n FROM fact) SELECT fact_id FROM r WHERE n = 1")
def d25(spark, d):
    f = facts(spark, d).withColumns({"k": F.lower("metric_name"), "v": rounded(F.col("value"), 2)})
    return first_by(f, ["k", "v", "unit"], ["fact_id"]).select("fact_id")


@query("d26_dictionary_scanner", "WITH " + LABELLED + ", e AS (SELECT id, regexp_extract(text, '(\\d+)%') AS p, regexp_extract(text, '\\d+K') AS k, regexp_extract(text, '\\$[\\d.]+') AS c FROM t) SELECT id, 'click_through_rate' AS metric_id, p AS raw FROM e UNION ALL SELECT id, 'reach', k FROM e UNION ALL SELECT id, 'spend', c FROM e")
def d26(spark, d):
    t = labelled_texts(spark, d)
    units = catalog.frame(spark).select(F.col("metric_id").alias("label"), F.col("unit").alias("expected"))
    m = op.label_spans(t).join(F.broadcast(units), "label").select("id", F.col("label").alias("metric_id"), F.col("start").alias("at"), "expected")
    v = op.value_spans(t).select("id", "raw", F.col("start").alias("value_at"), op.unit_of(F.col("raw")).alias("unit"))
    return op.scanned(m, v).select("id", "metric_id", "raw")


@query("d27_numeric_parse", "SELECT * FROM (VALUES ('$1,234.50', 1234.5, 'currency'), ('12%', 12.0, 'percent'), ('3.5x', 3.5, 'ratio'), ('2 hours', 120.0, 'time'), ('90 secs', 1.5, 'time'), ('1.2M', 1200000.0, 'count'), ('5', 5.0, 'count'), ('none', NULL, NULL)) t(raw, value, unit)")
def d27(spark, d):
    x = spark.createDataFrame([(r,) for r in ("$1,234.50", "12%", "3.5x", "2 hours", "90 secs", "1.2M", "5", "none")], "raw string")
    return x.select("raw", op.parsed_number(F.col("raw")).alias("value"), op.unit_of(F.col("raw")).alias("unit"))


def box_decks(x):
    bar = "\n- - - - -\n"
    s = lambda c: F.col(c).cast("int").cast("string")
    text = F.concat(F.lit("<!-- PAGE "), s("page"), F.lit(f" -->{bar}Results by market{bar}ignored{bar}Click rate: "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(f"%{bar}ignored{bar}Total spend\n$"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit(f"{bar}ignored{bar}[TABLE]\n | Reach | CPA*\nUS | "), s("l_quantity"), F.lit("K | $"), s("l_quantity"), F.lit(bar))
    return x.select(F.col("id").alias("deck_id"), text.alias("text"))


@query("d28_box_parser", "WITH " + LINE + " SELECT id AS deck_id, page, i AS idx, count(*) AS n FROM l, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY ALL")
def d28(spark, d):
    return bx.boxes(box_decks(lines(spark, d))).groupBy("deck_id", "page", "idx").agg(F.count("*").alias("n"))


@query("d29_pair_extraction", "WITH " + LINE + " SELECT DISTINCT id AS deck_id, page, 'Click rate' AS name, CAST(round(l_discount * 100) AS INT) || '%' AS raw, 'inline' AS pattern FROM l UNION SELECT id, page, 'Total spend', '$' || CAST(l_extendedprice AS DECIMAL(12, 2)), 'stacked' FROM l")
def d29(spark, d):
    return bx.pairs(bx.boxes(box_decks(lines(spark, d)))).select("deck_id", "page", "name", "raw", "pattern").distinct()


ONE_TABLE = "<!-- PAGE 1 -->\n- - - - -\n[TABLE]\n | S1 | S2\nCTR | 0.11% | 0.14%\n- - - - -\nx\n- - - - -\n[TABLE]\n | Rate | CostX*\nGroup 1 | 0.57% | $20.5\n- - - - -\n"


@query("d30_table_unpivot", "SELECT * FROM (VALUES (0, 'CTR', '0.11%', 'S1', 'table_matrix_row_metric'), (0, 'CTR', '0.14%', 'S2', 'table_matrix_row_metric'), (1, 'Rate', '0.57%', 'Group 1', 'table_matrix_column_metric'), (1, 'CostX', '$20.5', 'Group 1', 'table_matrix_column_metric')) t(idx, name, raw, series, pattern)")
def d30(spark, d):
    return bx.table_pairs(bx.boxes(spark.createDataFrame([(1, ONE_TABLE)], "deck_id long, text string"))).select("idx", "name", "raw", "series", "pattern")


@query("d31_descriptor_resolution")
def d31(spark, d):
    return bx.descriptors(bx.boxes(box_decks(lines(spark, d)))).select("deck_id", "page", "name", "raw", "descriptor", "score")


@query("d32_pair_and_name_scores", "SELECT * FROM (VALUES ('inline', 'Click rate', 1.0, 0.84, 0.96), ('stacked', 'A long sentence like label that goes on and on.', 0.85, 0.01, 0.56), ('value_first', 'CPA', 0.87, 1.0, 0.9025)) t(pattern, name, pair, name_score, blend)")
def d32(spark, d):
    x = spark.createDataFrame([("inline", "Click rate", 2, 2), ("stacked", "A long sentence like label that goes on and on.", 1, 1), ("value_first", "CPA", 5, 6)], "pattern string, name string, n int, support int")
    unit = F.when(F.col("name") == "A long sentence like label that goes on and on.", "count").otherwise("percent")
    p = bx.pair_score(F.col("pattern"), F.col("name"), unit, F.lit(False))
    s = bx.name_score(F.col("name"), F.col("n"), F.col("support"))
    return x.select("pattern", "name", F.round(p, 6).alias("pair"), F.round(s, 6).alias("name_score"), F.round(bx.blended(p, s, F.col("name")), 6).alias("blend"))


@query("d33_name_support")
def d33(spark, d):
    return bx.name_support(table(spark, d, "part").select(F.col("p_type").alias("name")))


@query("d34_raw_context")
def d34(spark, d):
    return bx.raw_context(bx.boxes(box_decks(lines(spark, d))))


PREDICATES = ["12.5%", "$1,200", "Click rate", "2025", "FY25", "US", "France", "90 mins", "Reach", "a", "CPA*", "Total spend:"]


@query("d35_predicates", "SELECT * FROM (VALUES ('12.5%', true, false, false, '12.5%'), ('$1,200', true, false, false, '$1,200'), ('Click rate', false, true, false, 'Click rate'), ('2025', true, false, false, '2025'), ('FY25', false, false, false, 'FY25'), ('US', false, true, true, 'US'), ('France', false, true, true, 'France'), ('90 mins', true, true, false, '90 mins'), ('Reach', false, true, false, 'Reach'), ('a', false, false, false, 'a'), ('CPA*', false, true, false, 'CPA'), ('Total spend:', false, true, false, 'Total spend')) t(text, is_value, is_label, is_country, clean)")
def d35(spark, d):
    x = spark.createDataFrame([(p,) for p in PREDICATES], "text string")
    t = F.col("text")
    return x.select("text", bx.is_value(t).alias("is_value"), bx.is_label(t).alias("is_label"), bx.is_country(t).alias("is_country"), bx.clean_name(t).alias("clean"))


@query("d36_context_strategies", W + "SELECT fact_id, coalesce(baseline_type, CASE WHEN fact_id % 2 = 0 THEN unit END, context) AS label, CASE WHEN baseline_type IS NOT NULL THEN '' WHEN fact_id % 2 = 0 THEN 'llm:label' ELSE 'rule:label' END AS trace FROM fact")
def d36(spark, d):
    f = facts(spark, d).withColumn("label", F.col("baseline_type"))
    llm = f.filter("fact_id % 2 = 0").select("fact_id", F.col("unit").alias("label"))
    rule = f.select("fact_id", F.col("context").alias("label"))
    return op.contextual(f.select("fact_id", "label"), ["label"], [("llm", llm), ("rule", rule)], "fact_id").select("fact_id", "label", F.array_join("trace", ",").alias("trace"))


TEXTS = ["Reach in H1 FY25 vs last year", "Q2 2025 against target", "FY24 plan", "monthly, compared to control", "nothing"]


@query("d37_period_and_baseline", "SELECT * FROM (VALUES ('Reach in H1 FY25 vs last year', 'H1 FY25', '2024-10-01', '2025-03-31', 'yoy'), ('Q2 2025 against target', 'Q2 2025', '2025-01-01', '2025-03-31', 'target'), ('FY24 plan', 'FY24', '2023-10-01', '2024-09-30', 'plan'), ('monthly, compared to control', NULL, NULL, NULL, 'control'), ('nothing', NULL, NULL, NULL, NULL)) t(text, label, start, \"end\", baseline)")
def d37(spark, d):
    x = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("p", op.period_of(F.col("text")))
    return x.select("text", "p.label", "p.start", "p.end", op.baseline_type(F.col("text")).alias("baseline"))


@query("d38_overall_slides", W + "SELECT fact_id, CASE WHEN regexp_matches(context, '(?i)\\burgent\\b') THEN 'overall' ELSE baseline_type END AS baseline_type FROM fact")
def d38(spark, d):
    overall = F.coalesce(F.col("context").rlike(r"(?i)\burgent\b"), F.lit(False))
    return facts(spark, d).select("fact_id", F.when(overall, "overall").otherwise(F.col("baseline_type")).alias("baseline_type"))


@query("d39_period_default", W + "SELECT fact_id, 'Q1 FY1997' AS period FROM fact WHERE slide_number = 1 OR period_label = 'Q1 FY1997'")
def d39(spark, d):
    f = facts(spark, d).select("fact_id", F.when(F.col("slide_number") != 1, F.col("period_label")).alias("period"))
    return op.with_period_default(f, F.lit("Q1 FY1997"))


@query("d40_catalog_mapping", "SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'click_through_rate' WHEN 1 THEN 'roas' WHEN 2 THEN 'spend' END AS metric_id FROM nation")
def d40(spark, d):
    k = F.col("n_nationkey") % 4
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(k == 0, "ctr").when(k == 1, "ROAS").when(k == 2, " Total Spend ").otherwise("other").alias("name"))
    return op.mapped(n, catalog.frame(spark).select("metric_id", F.col("name"), "aliases")).select("id", "metric_id")


@query("d40_upserts", "WITH k AS (SELECT c_mktsegment AS name, row_number() OVER (ORDER BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')) SELECT 7 AS id, 'BUILDING' AS name UNION ALL SELECT 7 + n, name FROM k")
def d40u(spark, d):
    known = spark.createDataFrame([(7, "BUILDING")], "id long, name string")
    return op.upserted(known, table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")), "name")


@query("d41_notes_leak", "WITH " + LINE + " SELECT id FROM l WHERE l_returnflag <> 'R'")
def d41(spark, d):
    x = lines(spark, d)
    rows = x.select("id", F.col("id").alias("slide_id"), F.when(F.col("l_returnflag") == "R", "Flag:  r!").otherwise("other text").alias("context"))
    return op.without_leaks(rows, x.select(F.col("id").alias("slide_id"), F.concat(F.lit("see "), "note", F.lit(" here")).alias("notes"))).select("id")


@query("d42_client_from_filename", "WITH f AS (SELECT DISTINCT 'deck_' || lower(c_mktsegment) || '_' || c_nationkey || '.pptx' AS filename FROM customer), n AS (SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT 'BUILD') SELECT filename, name FROM (SELECT filename, name, row_number() OVER (PARTITION BY filename ORDER BY length(name) DESC NULLS LAST, name) AS k FROM f LEFT JOIN n ON contains(filename, lower(name))) WHERE k = 1")
def d42(spark, d):
    c = table(spark, d, "customer")
    files = c.select(F.concat(F.lit("deck_"), F.lower("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".pptx")).alias("filename")).distinct()
    return op.inferred(files, c.select(F.col("c_mktsegment").alias("name")).unionByName(spark.createDataFrame([("BUILD",)], "name string")).distinct())


@query("d43_refine_selection", W + ", v AS (SELECT slide_id, metric_name, count(DISTINCT round(value, 4)) AS n FROM fact GROUP BY 1, 2) SELECT fact_id, concat_ws(',', CASE WHEN unit <> 'currency' THEN 'unit' END, CASE WHEN n > 1 THEN 'conflict' END) AS reasons FROM fact JOIN v USING (slide_id, metric_name) WHERE unit <> 'currency' OR n > 1")
def d43(spark, d):
    f = facts(spark, d).select("fact_id", "slide_id", F.col("metric_name").alias("name"), F.round("value", 4).alias("value"), "unit", F.lit("currency").alias("expected"), F.lit("slide").alias("source"))
    return op.to_refine(f).select("fact_id", "reasons")


@query("d44_batched_client", W + " SELECT unit, fact_id, round(value, 6) AS value FROM fact WHERE fact_id % 2 = 0")
def d44(spark, d):
    f = facts(spark, d).select("unit", "fact_id", F.round("value", 6).alias("value"))
    return op.in_batches(f, ["unit"], lambda rows: [i for i, r in enumerate(rows) if r["fact_id"] % 2 == 0])


@query("d45_enhancement_stage", "SELECT p_partkey, upper(p_type) AS summary FROM part")
def d45(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_type")
    return op.enhanced(rows, "slides", lambda r: {"summary": r["p_type"].upper()}).select("p_partkey", "summary")


@query("d46_slide_titles", W + ", s AS (SELECT document_id AS slide_id, metric_name AS text, slide_number * 40 AS top, fact_id % 50 AS font, CASE WHEN fact_id % 5 = 0 THEN 100 ELSE 0 END AS p FROM fact), r AS (SELECT *, p + least(font, 60) + CASE WHEN top < 100 THEN 20 ELSE 0 END AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY score DESC, top, text) AS n FROM r) SELECT slide_id, text AS title, score FROM k WHERE n = 1")
def d46(spark, d):
    f = facts(spark, d)
    s = f.select(F.col("document_id").alias("slide_id"), F.col("metric_name").alias("text"), (F.col("slide_number") * 40).alias("top"), (F.col("fact_id") % 50).alias("font_size"), F.when(F.col("fact_id") % 5 == 0, "title").otherwise("body").alias("placeholder"))
    return op.slide_titles(s)


@query("d47_box_pipeline")
def d47(spark, d):
    return nb.extracted(box_decks(lines(spark, d)))


@query("d48_duplicate_context", W + ", n AS (SELECT metric_name, unit, count(DISTINCT slide_number) AS n FROM fact GROUP BY 1, 2) SELECT fact_id, CASE WHEN n > 1 THEN 'slide ' || slide_number || ': ' || region || ' ' || f.context ELSE f.context END AS context FROM fact f JOIN n USING (metric_name, unit)")
def d48(spark, d):
    f = facts(spark, d).select("fact_id", F.col("metric_name").alias("name"), F.col("unit").alias("value"), "slide_number", F.col("region").alias("title"), "context")
    return op.with_duplicate_context(f).select("fact_id", "context")


@query("d49_number_masking", "SELECT * FROM (VALUES ('12% of 2024', '14% of 2025'), ('1,500 and 007', '1,545 and 008'), ('$99.50', '$102.50'), ('5 to 150', '6 to 157'), ('none', 'none')) t(text, masked)")
def d49(spark, d):
    x = spark.createDataFrame([(t,) for t in ("12% of 2024", "1,500 and 007", "$99.50", "5 to 150", "none")], "text string")
    return x.select("text", op.masked("text").alias("masked"))


#: Charts drawn from orders and their lines: ranges in nested lists and objects, with bounds left out by turns; one in seven has none.
RANGE_SQL = "SELECT o_orderkey, path, sheet_id, sr, CASE WHEN er IS NULL THEN sr + 1 ELSE er END AS er, sc, CASE WHEN ec IS NULL THEN sc + 1 ELSE ec END AS ec FROM r"
COLUMN_SQL = "CASE WHEN {0} < 26 THEN chr(CAST(65 + {0} AS INT)) WHEN {0} < 702 THEN chr(CAST(64 + {0} // 26 AS INT)) || chr(CAST(65 + {0} % 26 AS INT)) ELSE chr(CAST(65 + ({0} - 702) // 676 AS INT)) || chr(CAST(65 + ({0} - 702) // 26 % 26 AS INT)) || chr(CAST(65 + ({0} - 702) % 26 AS INT)) END"


@query(
    "d50_chart_ranges",
    "WITH m AS (SELECT l_orderkey, count(*) AS n, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey, o_orderkey % 5 AS k, n, q FROM orders JOIN m ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0), "
    "r AS (SELECT o_orderkey, '$.spec.basic.series[0].data.sources[0]' AS path, k AS sheet_id, n AS sr, n + q AS er, CAST(0 AS BIGINT) AS sc, CAST(NULL AS BIGINT) AS ec FROM b "
    "UNION ALL SELECT o_orderkey, '$.spec.basic.domains[0][1]', k, 0, NULL, q * 20, q * 20 + n FROM b), "
    "d AS (" + RANGE_SQL + ") SELECT o_orderkey, path, '''sheet ' || sheet_id || '''!' || " + COLUMN_SQL.format("sc") + " || (sr + 1) || ':' || " + COLUMN_SQL.format("(ec - 1)") + " || er AS a1 FROM d".replace("\\'", "''"),
)
def d50(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").cast("long").alias("q"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    source = F.struct((F.col("o_orderkey") % 5).alias("sheetId"), F.col("n").alias("startRowIndex"), (F.col("n") + F.col("q")).alias("endRowIndex"), F.struct(F.lit("kept").alias("note")).alias("format"))
    domain = F.struct((F.col("o_orderkey") % 5).alias("sheetId"), (F.col("q") * 20).alias("startColumnIndex"), (F.col("q") * 20 + F.col("n")).alias("endColumnIndex"))
    none = F.lit(None).cast("long")  # an absent field
    bare = F.struct(F.lit(1).cast("long").alias("sheetId"), none.alias("startColumnIndex"), none.alias("endColumnIndex"))
    series = F.array(F.struct(F.struct(F.array(source).alias("sources")).alias("data")))
    whole = F.to_json(F.struct(F.struct(F.struct(series.alias("series"), F.array(F.array(bare, domain)).alias("domains")).alias("basic"), F.lit("t").alias("title")).alias("spec")))
    chart = rows.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, whole).otherwise(F.lit("no chart {")).alias("chart"))
    g = trees.grid_ranges(chart, "chart", "o_orderkey")
    sheet = F.concat(F.lit("sheet "), F.col("sheet_id").cast("string"))
    return g.select("o_orderkey", "path", trees.a1(sheet, F.col("start_row"), F.col("end_row"), F.col("start_column"), F.col("end_column")).alias("a1"))


@query("s28_section_tree", "WITH RECURSIVE t AS (SELECT p_partkey, p_partkey AS root, CAST(0 AS BIGINT) AS depth FROM part WHERE p_partkey % 97 = 0 OR p_partkey // 3 + p_size // 10 = p_partkey OR p_partkey // 3 + p_size // 10 NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT p.p_partkey, t.root, t.depth + 1 FROM t JOIN part p ON p.p_partkey // 3 + p.p_size // 10 = t.p_partkey AND p.p_partkey % 97 <> 0 AND p.p_partkey // 3 + p.p_size // 10 <> p.p_partkey) SELECT p_partkey, max(root) AS root, max(depth) AS depth FROM (SELECT * FROM t UNION ALL SELECT p_partkey, NULL, NULL FROM part) GROUP BY 1")
def s28(spark, d):
    """Sections that name the section above them: a forest drawn from the keys and sizes of parts, some without a parent."""
    parent = F.expr("p_partkey div 3 + p_size div 10")
    rows = table(spark, d, "part").select("p_partkey", F.when((F.col("p_partkey") % 97 != 0) & (parent != F.col("p_partkey")), parent).alias("parent"))
    return trees.ancestry(rows, "p_partkey", "parent")


@query("d51_deck_mapping", "SELECT 'f' || p_partkey AS filename, CASE WHEN p_partkey % 2 = 0 THEN 'url' || p_size ELSE '/in/' || p_partkey END AS url FROM part")
def d51(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    m = p.filter("p_partkey % 2 = 0").select(name.alias("filename"), F.concat(F.lit("url"), F.col("p_size").cast("string")).alias("url"))
    return op.deck_links(p.select(name.alias("filename"), F.concat(F.lit("/in/"), F.col("p_partkey").cast("string")).alias("path")), m)


@query("d52_review_context", "WITH " + LINE + " SELECT id, 'ctx | ' || CASE WHEN p > 1 THEN replace(body, chr(10), ' ') ELSE replace(body, chr(10), ' ') END AS review FROM (SELECT *, 2 AS p FROM l)")
def d52(spark, d):
    x = lines(spark, d).select("id", F.col("body").alias("text"), F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("raw"), F.lit("ctx").alias("context"))
    return op.review_context(x).select("id", "review")


@query("d53_builtin_catalog", "SELECT * FROM (VALUES ('count', 23), ('currency', 9), ('percent', 13), ('ratio', 1), ('time', 1)) t(unit, n)")
def d53(spark, d):
    return catalog.frame(spark).groupBy("unit").agg(F.count("*").alias("n"))


@query("d54_manifest", "SELECT 'orders' AS task, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem")
def d54(spark, d):
    return op.manifest({"orders": table(spark, d, "orders"), "lines": table(spark, d, "lineitem")})


def loose_decks(x):
    """Pages of lone values, countries, partial lines and narrow tables; every other quantity has a title, twelve boxes from the last."""
    bar = "\n- - - - -\n"
    n = F.col("l_quantity").cast("int").cast("string")
    boxes = [
        F.when(F.col("l_quantity").cast("int") % 2 == 0, "Average cost by market").otherwise("Source: team"),
        F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")),
        F.concat(F.lit("US\n"), n, F.lit("%")),
        F.concat(F.lit("Uplift: grew "), n, F.lit("% over plan")),
        F.concat(F.lit("[TABLE]\nClick rate | "), n, F.lit("%\n"), n, F.lit(" | Open rate")),
        F.concat(F.lit("[TABLE]\n | "), n, F.lit("x\nWin rate | ")),
        *[F.lit("Source: team")] * 6,
        F.concat(F.lit("France\n"), n, F.lit("%")),
    ]
    text = F.concat(F.lit("<!-- PAGE "), F.col("page").cast("int").cast("string"), F.lit(f" -->{bar}"), F.concat_ws(f"{bar}ignored{bar}", *boxes), F.lit(bar))
    return x.select(F.col("id").alias("deck_id"), text.alias("text"))


@query(
    "d29_neighbour_pairs",
    "WITH "
    + LINE
    + """, q AS (SELECT id AS deck_id, CAST(page AS INT) AS page, CAST(l_quantity AS INT) AS n, CAST(l_quantity AS INT) % 2 = 0 AS titled, '$' || CAST(l_extendedprice AS DECIMAL(12, 2)) AS price FROM l)
SELECT deck_id, page, 1 AS idx, 'Average cost' AS name, price AS raw, 'cross_box' AS pattern, NULL AS country FROM q WHERE titled
UNION ALL SELECT deck_id, page, 2, CASE WHEN titled THEN 'Average cost' ELSE 'US' END, n || '%', 'stacked', CASE WHEN titled THEN 'US' END FROM q
UNION ALL SELECT deck_id, page, 3, 'Uplift', n || '%', 'inline_partial', NULL FROM q
UNION ALL SELECT deck_id, page, 4, 'Click rate', n || '%', 'table_pipe', NULL FROM q
UNION ALL SELECT deck_id, page, 4, 'Open rate', n || '', 'table_pipe', NULL FROM q
UNION ALL SELECT deck_id, page, 5, 'Win rate', n || 'x', 'table_stacked', NULL FROM q
UNION ALL SELECT deck_id, page, 12, CASE WHEN titled THEN 'Average cost' ELSE 'France' END, n || '%', 'stacked', CASE WHEN titled THEN 'France' END FROM q""",
)
def d29_neighbours(spark, d):
    return nb.all_pairs(bx.boxes(loose_decks(lines(spark, d)))).drop("n")
