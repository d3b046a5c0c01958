"""Queries E01 to E15: names of parts and of values in documents as metric names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog
from ..operators import labels
from ..operators import normalize as op
from ..operators.extract import metric_words
from ..sources.tables import table
from .registry import query

def named(spark, d):
    """Rows (id, deck, name, unit, category, context, extraction_confidence): names of parts as decks write them (plurals, marks, notes,
    glued words, values and periods in place of names), and what stands before the values in all texts of documents."""
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    title = F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n)))
    made = [
        F.concat(title, F.lit(" Rate")),
        F.concat(n, F.lit(" rates")),
        F.concat(title, F.lit("  Rate*")),
        F.concat(F.when(F.col("p_size") > 40, "ROS ").otherwise(""), "p_type", F.lit(" "), n, F.lit(" Reach")),
        F.concat(title, F.lit(" Reach: "), size, F.lit("%")),
        F.concat(F.lit("FY"), (F.col("p_size") + 10).cast("string")),
        F.concat(F.lit("Cost per "), n, F.lit(" ("), size, F.lit(")")),
        size,
        F.lit("CTR"),
        F.concat(F.replace(n, F.lit(" "), F.lit("")), F.lit("Cost")),
    ]
    name = F.element_at(F.array(*made), (F.col("p_size") % len(made) + 1).cast("int"))
    parts = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("deck"), name.alias("name"), F.when(F.col("p_partkey") % 5 == 0, "count").otherwise("percent").alias("unit"), F.col("p_type").alias("category"), F.concat(title, F.lit(" rate: "), size, F.lit("%")).alias("context"), (0.5 + 0.1 * (F.col("p_partkey") % 5)).alias("extraction_confidence"))
    texts = table(spark, d, "documents").select(F.struct("doc_id", "source", "lang").alias("id"), "text")
    said = labels.before_values(texts).select("id.*", "value", F.array_join("left", " ").alias("name"))
    unit = F.when(F.contains("value", F.lit("%")), "percent").otherwise("count")
    said = said.select(F.concat_ws("/", "doc_id", "name", "value").alias("id"), F.col("source").alias("deck"), "name", unit.alias("unit"), F.col("lang").alias("category"), F.concat("name", F.lit(": "), "value").alias("context"), F.lit(0.7).alias("extraction_confidence"))
    return parts.unionByName(said.distinct())


#: Runs of words before values (LABELS_SQL), and the rows of named.
VALUES_SQL = r"""s AS (SELECT id, unnest(string_split_regex(text, '[\n|;]+')) AS part FROM t),
w AS (SELECT id, [x FOR x IN string_split_regex(part, '[ \t]+') IF x <> '' AND NOT regexp_full_match(x, '[:=-]+')] AS w FROM s WHERE regexp_matches(part, '[0-9]')),
v AS (SELECT id, w, unnest(range(2, len(w) + 1)) AS i FROM w),
p AS (SELECT id, w[i] AS value, w[greatest(1, i - 5):i - 1] AS l FROM v WHERE regexp_full_match(w[i], '[$]?[+-]?[0-9][0-9,.]*[%xKMB]?[.,;:)]*'))"""
NAMED = (
    "t AS (SELECT {'doc_id': doc_id, 'source': source, 'lang': lang} AS id, text FROM documents), "
    + VALUES_SQL
    + r""",
m AS (SELECT *, upper(p_name[1]) || p_name[2:] AS title FROM part),
r AS (SELECT 'part/' || p_partkey AS id, p_brand AS deck, [title || ' Rate', p_name || ' rates', title || '  Rate*', CASE WHEN p_size > 40 THEN 'ROS ' ELSE '' END || p_type || ' ' || p_name || ' Reach', title || ' Reach: ' || p_size || '%', 'FY' || (p_size + 10), 'Cost per ' || p_name || ' (' || p_size || ')', CAST(p_size AS VARCHAR), 'CTR', replace(p_name, ' ', '') || 'Cost'][CAST(p_size % 10 + 1 AS INT)] AS name, CASE WHEN p_partkey % 5 = 0 THEN 'count' ELSE 'percent' END AS unit, p_type AS category FROM m
UNION ALL SELECT DISTINCT concat_ws('/', id.doc_id, array_to_string(l, ' '), value), id.source, array_to_string(l, ' '), CASE WHEN contains(value, '%') THEN 'percent' ELSE 'count' END, id.lang FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(rtrim(trim(regexp_replace(name, '[ \t\n\x0B\f\r]+', ' ', 'g')), '*†‡ '), ' *\[[0-9]+\]+$', ''), ' *\([0-9]+\)+$', '') AS cut FROM r),
n AS (SELECT * EXCLUDE (cut), rtrim(cut, ' :;,.|/-') AS clean, regexp_replace(regexp_replace(regexp_replace(lower(rtrim(cut, ' :;,.|/-')), '[^a-z0-9%/+& -]+', ' ', 'g'), ' +', ' ', 'g'), '^[ :,.-]+|[ :,.-]+$', '', 'g') AS normalized FROM b)"""
)


@query("e01_json_ingest", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def e01(spark, d):
    x = table(spark, d, "events").withColumn("p", F.from_json("props", "k int", {"mode": "PERMISSIVE"}))
    return x.select("event_id", "p.k").filter("k is not null")


@query("e02_normalised_names", "WITH " + NAMED + " SELECT DISTINCT name, normalized FROM n")
def e02(spark, d):
    return named(spark, d).select("name", op.normalized(F.col("name")).alias("normalized")).distinct()


@query("e03_catalog_keys", "SELECT 'code' AS source, count(*) AS n FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'table', count(*) FROM part WHERE p_partkey % 3 = 0")
def e03(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    both = p.withColumns({"source": F.lit("code"), "priority": F.lit(2)}).unionByName(p.filter("key % 3 = 0").withColumns({"source": F.lit("table"), "priority": F.lit(1)}))
    return op.first_by(both, ["key"], ["priority"]).groupBy("source").agg(F.count("*").alias("n"))


QUALITY_SQL = (
    "WITH "
    + NAMED
    + r""",
c AS (SELECT name, clean, normalized, count(*) AS n, count(DISTINCT deck) AS decks FROM n GROUP BY ALL)
SELECT name, CASE WHEN clean = '' THEN 0.0 ELSE round(greatest(0, least(1, 0.78
 - CASE WHEN regexp_full_match(clean, '[0-9.+% -]+') THEN 0.55 ELSE 0 END
 - CASE WHEN regexp_full_match(lower(clean), 'fy[0-9]{2,4}|q[1-4]|h[12]|[0-9]{4}') THEN 0.5 ELSE 0 END
 - CASE WHEN regexp_matches(lower(clean), '[:=][ \t]*[$]?[+-]?[0-9]|\b[0-9]+([.][0-9]+)?[ \t]*(%|x\b|(min|minute|hr|hour|sec|second)s?\b)') THEN 0.38 ELSE 0 END
 - CASE WHEN regexp_matches(lower(clean), '\b(CONTEXT)\b') THEN 0.14 ELSE 0 END
 - CASE WHEN regexp_matches(name, '[a-z][A-Z]') THEN 0.08 ELSE 0 END
 - CASE WHEN length(clean) > 48 THEN 0.24 ELSE 0 END
 - CASE WHEN len(list_filter(string_split_regex(normalized, '[^a-z0-9]+'), lambda x: x <> '')) > 8 THEN 0.18 ELSE 0 END
 - CASE WHEN regexp_matches(lower(clean), '(^|[^a-z0-9])(WORDS)(e?s)?([^a-z0-9]|$)') THEN 0 ELSE 0.06 END
 - CASE WHEN n = 1 THEN 0.1 ELSE 0 END - CASE WHEN decks = 1 THEN 0.06 ELSE 0 END)), 6) END AS quality FROM c"""
).replace("CONTEXT", "|".join(op.CONTEXT)).replace("WORDS", "|".join(metric_words()))


@query("e04_name_quality", QUALITY_SQL)
def e04(spark, d):
    c = op.counted(named(spark, d))
    q, _ = op.quality(F.col("name"), F.col("occurrences"), F.col("decks"))
    return c.select("name", F.round(q, 6).alias("quality"))


@query("e05_refined_names")
def e05(spark, d):
    return op.refined(named(spark, d).select("id", "deck", "name", "context")).select("id", "name", "rounds")


def name_sets(spark, d):
    return named(spark, d).groupBy("name").agg(F.collect_set("unit").alias("units")).withColumn("context", F.array().cast("array<string>"))


@query("e06_similar_pairs")
def e06(spark, d):
    return op.similar_pairs(name_sets(spark, d))


@query("e07_components")
def e07(spark, d):
    return op.clusters(op.similar_pairs(name_sets(spark, d)))


@query("e08_canonical", "WITH c AS (SELECT p_brand AS cluster, p_type AS name, count(*) AS occurrences FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY occurrences DESC, length(name), lower(name)) AS k FROM c) SELECT cluster, name AS canonical FROM r WHERE k = 1")
def e08(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster"), F.col("p_type").alias("name")).agg(F.count("*").alias("occurrences"))
    return op.canonical(m)


@query("e09_verdicts")
def e09(spark, d):
    return op.run(named(spark, d), catalog.frame(spark)).select("id", "name", "status", "method", "canonical_name", F.round("combined", 6).alias("combined"), "validation", "validation_reasons")


@query("e10_report", "WITH v AS (SELECT CASE WHEN p_size < 10 THEN 'a' ELSE 'b' END AS status, CASE WHEN p_size % 2 = 0 THEN 'pass' ELSE 'warn' END AS validation FROM part) SELECT status, validation, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY 1, 2")
def e10(spark, d):
    v = table(spark, d, "part").select(F.when(F.col("p_size") < 10, "a").otherwise("b").alias("status"), F.when(F.col("p_size") % 2 == 0, "pass").otherwise("warn").alias("validation"))
    return op.report(v)


@query("e11_inventory", "WITH " + NAMED + " SELECT name, count(*) AS occurrences, string_agg(DISTINCT unit, '|' ORDER BY unit) AS units, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, count(DISTINCT deck) AS decks FROM r GROUP BY 1")
def e11(spark, d):
    return op.inventory(named(spark, d))


@query("e12_unknown_labels", "SELECT lower(p_type) AS key, count(*) AS n, count(DISTINCT p_brand) AS decks, array_to_string(list_sort(list(DISTINCT p_name))[1:3], '|') AS samples FROM part WHERE p_type <> (SELECT min(p_type) FROM part) GROUP BY 1 HAVING count(*) >= 2")
def e12(spark, d):
    p = table(spark, d, "part")
    known = p.agg(F.min("p_type").alias("name"))
    return op.unknown_labels(p.select(F.col("p_type").alias("label"), F.col("p_brand").alias("deck"), F.col("p_name").alias("sample")), known)


LABELS_SQL = r"""
WITH t AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - p_partkey, p_brand || ' ' || p_type || ': ' || p_size FROM part),
VALUES,
g AS (SELECT id, value, array_to_string(l[len(l) - k + 1:], ' ') AS g FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE k <= len(l)),
f AS (SELECT id, value, lower(regexp_replace(g, '[:=]+$', '')) AS key FROM g WHERE regexp_full_match(g, '[A-Za-z][A-Za-z0-9/&+%-]*( [A-Za-z][A-Za-z0-9/&+%-]*)*[:=]*')),
c AS (SELECT key, CASE WHEN contains(key, ' ') THEN regexp_replace(key, '^[^ ]+ ', '') END AS shorter, count(*) AS n, count(DISTINCT id) AS texts, min(struct_pack(id := id, value := value)).value AS first_value, max(struct_pack(id := id, value := value)).value AS last_value FROM f GROUP BY 1 HAVING count(*) >= 2)
SELECT key, n, texts, first_value, last_value FROM c LEFT JOIN (SELECT shorter AS k, max(n) AS most FROM c WHERE shorter IS NOT NULL GROUP BY 1) ON k = key
WHERE (most IS NULL OR most < n) AND length(key) BETWEEN 4 AND 80 AND length(regexp_replace(key, '[^a-z]', '', 'g')) >= 3 AND NOT regexp_full_match(key, 'fy ?[0-9]{2,4}|q[1-4]|h[12]|source|slide|notes?|page') AND key <> (SELECT lower(min(p_type)) FROM part)""".replace("VALUES", VALUES_SQL)


@query("e12_labels_in_texts", LABELS_SQL)
def e12_labels(spark, d):
    p = table(spark, d, "part")
    said = p.select((-1 - F.col("p_partkey")).alias("id"), F.concat("p_brand", F.lit(" "), "p_type", F.lit(": "), F.col("p_size").cast("string")).alias("text"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(said)
    return labels.discovered(texts, p.agg(F.min("p_type").alias("name")))


@query("e13_unknown_histogram", "WITH t AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3) SELECT n, count(*) AS labels FROM t GROUP BY 1")
def e13(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")).filter("n >= 3").groupBy("n").agg(F.count("*").alias("labels"))


@query("e14_alias_sync", "SELECT * FROM (VALUES ('roas', 'ad return'), ('spend', 'media cost')) t(metric_id, alias)")
def e14(spark, d):
    s = spark.createDataFrame([("roas", "ad return"), ("roas", "ROAS"), ("spend", "media cost"), ("spend", "both"), ("reach", "both"), ("reach", "re.*ch"), ("nobody", "someone")], "metric_id string, alias string")
    return op.alias_changes(s, catalog.aliases(spark).select("alias"), catalog.frame(spark))


@query("e15_flow_summary")
def e15(spark, d):
    return op.report(op.run(named(spark, d), catalog.frame(spark)))
