"""Document queries: lists, details, metrics, slides, entities, facets, content search, and the dispatcher (families B, X01, X02)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .facts import any_of

CATEGORIES = ("cost", "reach", "engagement", "performance", "other")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page of df; the order must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def nested(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Children as one sorted list of structs a key."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def list_documents(documents: DataFrame, status: str | None = None, client_name: str | None = None, date_from: str | None = None, date_to: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, of a status, of clients whose name contains the text (any case), created within [from, to]."""
    out = documents
    if status is not None:
        out = out.filter(F.col("status") == status)
    if client_name:
        out = out.filter(F.col("client_name").ilike(f"%{client_name}%"))
    if date_from:
        out = out.filter(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        out = out.filter(F.col("created_at") <= F.lit(date_to).cast("timestamp_ntz"))
    return page(out, [F.desc_nulls_last("created_at"), "document_id"], limit, offset)


def counts_by(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """documents with a count of each kind of child, 0 where there is none."""
    out = documents
    for name, df in children.items():
        out = out.join(df.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def metrics(df: DataFrame, category: str | None = None, name_contains: str | None = None, min_value: float | None = None, max_value: float | None = None, limit: int = 100, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Metrics by value, largest first, nulls last. A category that doesn't exist is ignored."""
    out = df
    if category in categories:
        out = out.filter(F.col("category") == category)
    if name_contains:
        out = out.filter(F.col("metric_name").ilike(f"%{name_contains}%"))
    if min_value is not None:
        out = out.filter(F.col("value") >= min_value)
    if max_value is not None:
        out = out.filter(F.col("value") <= max_value)
    return page(out, [F.desc_nulls_last("value"), "fact_id"], limit)


def top_metrics(df: DataFrame, limit: int = 10) -> DataFrame:
    return metrics(df, limit=limit)


def grouped(df: DataFrame, by: str, default: str, columns: list[str], name: str) -> DataFrame:
    """Metrics of each document by category, the default where there is none: a list is no longer than its document."""
    return nested(df.withColumn(by, F.coalesce(by, F.lit(default))), ["document_id", by], columns, name)


def compare_across(df: DataFrame, name: str, documents: list[int]) -> DataFrame:
    return df.filter(F.col("metric_name").ilike(f"%{name}%") & F.col("document_id").isin(documents)).orderBy("document_id", "fact_id")


def slides(df: DataFrame, charts: DataFrame, slide_type: str | None = None, has_charts: bool | None = None) -> DataFrame:
    """Slides of a type, with (semi-join) or without (anti-join) charts."""
    out = df.filter(F.col("slide_type") == slide_type) if slide_type is not None else df
    return out if has_charts is None else out.join(charts.select("slide_id"), "slide_id", "left_semi" if has_charts else "left_anti")


def neighbourhood(relations: DataFrame, entity: Column) -> DataFrame:
    """Relations from the entity (outgoing) and to it (incoming)."""
    out = relations.filter(F.col("source_id") == entity).select(F.lit("outgoing").alias("direction"), "relation", F.col("source_id").alias("entity_id"), F.col("target_id").alias("other_id"))
    into = relations.filter(F.col("target_id") == entity).select(F.lit("incoming").alias("direction"), "relation", F.col("target_id").alias("entity_id"), F.col("source_id").alias("other_id"))
    return out.unionByName(into)


def facet_catalogue(facets: DataFrame, values: DataFrame) -> DataFrame:
    """Each facet with its values; a facet without any has an empty list."""
    v = values.groupBy("facet").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return facets.join(v, "facet", "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def by_facets(document_facets: DataFrame, filters: dict[str, list[str]], limit: int = 50) -> DataFrame:
    """Documents that have, for every facet of the filters, one of its values: one pass, and a count of the facets met."""
    hit = document_facets.filter(any_of([(F.col("facet") == f) & F.col("value").isin(v) for f, v in filters.items()]))
    return hit.groupBy("document_id").agg(F.count_distinct("facet").alias("n")).filter(F.col("n") == len(filters)).select("document_id").orderBy("document_id").limit(limit)


def content_search(chunks: DataFrame, text: str, limit: int = 20, shown: int = 500) -> DataFrame:
    """Chunks that contain any of the words of text, any case; their texts cut to `shown` characters."""
    hit = any_of([F.col("text").ilike(f"%{t}%") for t in text.split()])
    return chunks.filter(hit).orderBy("chunk_id").limit(limit).select("chunk_id", F.substring("text", 1, shown).alias("text"), F.length("text").cast("long").alias("length"))


def keywords(df: DataFrame, min_score: float | None = None, limit: int = 30) -> DataFrame:
    out = df if min_score is None else df.filter(F.col("score") >= min_score)
    return page(out, [F.desc_nulls_last("score"), "keyword"], limit)


def json_list(text: Column) -> Column:
    """The items of a JSON array of strings, or a scalar as the only item; null and empty give none."""
    t = F.trim(text)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def roll_up(slides: DataFrame, column: str) -> DataFrame:
    """document_id, slide_number and item of each item of the slides' lists."""
    return slides.select("document_id", "slide_number", F.posexplode(json_list(F.col(column))).alias("pos", "item"))


#: The filter language: operator -> condition on a column and its argument.
OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "not_in": lambda c, v: ~c.isin(v),
    "contains": lambda c, v: c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "between": lambda c, v: c.between(*v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def filtered(df: DataFrame, filters: list[tuple]) -> DataFrame:
    """Rows that meet all (column, operator, argument)."""
    return df.filter(reduce(lambda a, b: a & b, [OPERATORS[o](F.col(c), v) for c, o, v in filters], F.lit(True)))


def sorted_by(df: DataFrame, sort: list[tuple[str, str]], tie: str) -> list:
    return [F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in sort] + [F.asc(tie)]


def buckets(df: DataFrame, by: str) -> DataFrame:
    """Counts and shares of each value of a column."""
    n = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("bucket")).agg(F.count("*").alias("n"))
    return n.select("bucket", "n", (F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("share"))


class QueryApi:
    """Queries by type; a request is a dict: query_type, filters, sort, limit, offset. Answers have the rows, the count before the
    limit and, instead of raising, the error."""

    def __init__(self, builders: dict[str, tuple[DataFrame, str]]):
        self.builders = builders

    def execute(self, request: dict) -> dict:
        try:
            df, tie = self.builders[request["query_type"]]
            hit = filtered(df, request.get("filters", []))
            rows = page(hit, sorted_by(hit, request.get("sort", []), tie), request.get("limit", 100), request.get("offset", 0))
            total = hit.count() if request.get("count", True) else None
            return {"success": True, "rows": rows, "total_count": total, "error": None, "buckets": buckets(hit, request["aggregate_by"]) if "aggregate_by" in request else None}
        except Exception as e:  # noqa: BLE001  the contract is an answer, whatever went wrong
            return {"success": False, "rows": None, "total_count": 0, "error": f"{type(e).__name__}: {e}", "buckets": None}


#: The tools by name, with the operator each one stands on and its parameters.
TOOLS: dict[str, tuple[str, list[str]]] = {
    "list_documents": ("list_documents", ["status", "client_name", "limit"]),
    "get_document_summary": ("summary", ["document_id"]),
    "get_metrics_by_category": ("grouped", ["document_id"]),
    "get_top_metrics": ("top_metrics", ["document_id", "limit"]),
    "search_metrics": ("metrics", ["category", "name_contains", "min_value", "max_value", "limit"]),
    "get_slides_by_type": ("grouped", ["document_id"]),
    "get_slide_content": ("slide_detail", ["slide_id"]),
    "get_recommendations": ("roll_up", ["document_id"]),
    "get_action_items": ("roll_up", ["document_id"]),
    "get_key_insights": ("roll_up", ["document_id"]),
    "get_entities": ("entities", ["document_id", "entity_type"]),
    "search_entities": ("entities", ["name_contains"]),
    "search_content": ("content_search", ["text", "limit"]),
    "get_charts": ("charts", ["document_id"]),
    "get_available_facets": ("facet_catalogue", []),
    "filter_by_facets": ("by_facets", ["filters", "limit"]),
    "compare_metric_across_documents": ("compare_across", ["name", "documents"]),
}


def with_count(df: DataFrame) -> dict:
    """A tool's answer: its rows and how many there are."""
    return {"count": df.count(), "rows": df}


def entities(df: DataFrame, entity_type: str | None = None, name_contains: str | None = None, min_mentions: int | None = None, limit: int = 50) -> DataFrame:
    out = df if entity_type is None else df.filter(F.col("entity_type") == entity_type)
    out = out.filter(F.col("name").ilike(f"%{name_contains}%")) if name_contains else out
    out = out.filter(F.col("mention_count") >= min_mentions) if min_mentions is not None else out
    return page(out, [F.desc_nulls_last("mention_count"), "name"], limit)


def slide_detail(slides: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Slides with one list of structs for each kind of child."""
    out = slides
    for name, (df, columns) in children.items():
        out = out.join(nested(df, ["slide_id"], columns, name), "slide_id", "left")
    return out


def summary(documents: DataFrame, facts: DataFrame, slides: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Documents with their k largest metrics and the action items of their slides."""
    w = W.partitionBy("document_id").orderBy(F.desc_nulls_last("value"), "fact_id")
    top = facts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
    tops = nested(top, ["document_id"], ["n", "metric_name"], "top").withColumn("top", F.transform("top", lambda x: x["metric_name"]))
    items = roll_up(slides, column).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slide_number", "pos", "item"))), lambda x: x["item"]).alias("items"))
    return documents.join(tops, "document_id", "left").join(items, "document_id", "left")
