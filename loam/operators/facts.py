"""Structured questions over the star view: filters, scopes, relaxation, aggregation, citations (families A01 to A35)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fiscal import overlaps


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, marked for broadcast once its size is known to be small; an error if it isn't."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most:,} {what}")
    return F.broadcast(df)


def fact_filter(metric_ids: list[str] | None = None, client_name: str | None = None, region: list[str] | None = None, period_ranges: list[tuple[str, str]] | None = None) -> Column:
    """A condition on facts: metric among the ids, client contains (any case), region among, and overlap with any range."""
    out = F.lit(True)
    if metric_ids:
        out &= F.col("metric_id").isin(metric_ids)
    if client_name:
        out &= F.col("client_name").ilike(f"%{client_name}%")
    if region:
        out &= F.col("region").isin(region)
    if period_ranges:
        out &= any_of([overlaps(F.col("period_start"), F.col("period_end"), a, b) for a, b in period_ranges])
    return out


def query_facts(facts: DataFrame, limit: int = 200, overall_first: bool = False, **filters) -> DataFrame:
    """Filtered facts, latest period first; with overall_first, those of an overall baseline before others of the period."""
    first = [F.when(F.lower("baseline_type") == "overall", 0).otherwise(1)] if overall_first else []
    return facts.filter(fact_filter(**filters)).orderBy(F.desc_nulls_last("period_end"), *first, "fact_id").limit(limit)


def query_document_ids(documents: DataFrame, facts: DataFrame, condition: Column, metric_ids: list[str], limit: int = 100) -> DataFrame:
    """Documents that meet the condition and have a fact of one of the metrics (EXISTS as a semi-join)."""
    have = facts.filter(F.col("metric_id").isin(metric_ids)).select("document_id")
    return documents.filter(condition).join(have, "document_id", "left_semi").select("document_id").distinct().orderBy("document_id").limit(limit)


def period_condition(specs: list[dict], label: Column, year: Column) -> Column:
    """Any of the specs {kind: quarter | half | year, number, years: [...]}: the label names the part of the year, and a candidate year."""
    label, out = F.upper(F.coalesce(label, F.lit(""))), []
    for s in specs:
        named = {"quarter": f"Q{s.get('number')}", "half": f"H{s.get('number')}"}.get(s["kind"])
        in_year = any_of([label.contains(str(y)) | label.contains(f"FY{y % 100:02d}") | (year == y) for y in s["years"]])
        out.append((label.contains(named) if named else F.lit(True)) & in_year)
    return any_of(out)


def slides_in_ranges(slides: DataFrame, ranges: DataFrame, limit: int = 5000) -> DataFrame:
    """slide_ids whose number is in a range (document_id, start, end) of their document; an open end is null."""
    hit = slides.join(ranges, "document_id").filter((F.col("start").isNull() | (F.col("slide_number") >= F.col("start"))) & (F.col("end").isNull() | (F.col("slide_number") <= F.col("end"))))
    return hit.select("slide_id").distinct().orderBy("slide_id").limit(limit)


def document_names(facts: DataFrame) -> DataFrame:
    return facts.groupBy("document_id").agg(F.max("document_name").alias("document_name"))


def document_regions(facts: DataFrame) -> DataFrame:
    return facts.groupBy("document_id").agg(F.upper(F.max("region")).alias("region"))


def latest_period_end(facts: DataFrame, period_type: str | None = None) -> DataFrame:
    """The anchor date; of one granularity if asked for."""
    end = F.col("period_end") if period_type is None else F.when(F.col("period_type") == period_type, F.col("period_end"))
    return facts.agg(F.max(end).alias("anchor"))


def catalog_with_aliases(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """metric_id, name and its aliases by priority and name; entries without any keep an empty list."""
    a = aliases.groupBy("metric_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "alias"))).alias("a"))
    return catalog.join(a, "metric_id", "left").select("metric_id", "name", F.coalesce(F.transform("a", lambda x: x["alias"]), F.array().cast("array<string>")).alias("aliases"))


def trend(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.asc_nulls_first("period_end"), F.asc_nulls_first("period_label"), "fact_id")


def latest(facts: DataFrame, *keys: str) -> DataFrame:
    """All facts of the latest (period_end, period_label) within the keys."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last("period_end"), F.desc_nulls_last("period_label"))
    return facts.withColumn("__r", F.rank().over(w)).filter("__r = 1").drop("__r")


def compare(by_period: DataFrame, key: str) -> DataFrame:
    """The last two periods of each key: first, second, delta, and pct (null where the first value is null or 0)."""
    w = W.partitionBy(key).orderBy("period_end")
    back = W.partitionBy(key).orderBy(F.desc_nulls_last("period_end"))
    rows = by_period.withColumns({"first": F.lag("value").over(w), "first_period": F.lag("period_label").over(w), "__n": F.row_number().over(back)}).filter("__n = 1")
    delta = F.col("value") - F.col("first")
    return rows.select(key, "first_period", F.col("period_label").alias("second_period"), "first", F.col("value").alias("second"), delta.alias("delta"), F.when(F.col("first") != 0, delta / F.col("first") * 100).alias("pct"))


def aggregate(facts: DataFrame, *keys: str) -> DataFrame:
    known = facts.filter(F.col("value").isNotNull())
    return known.groupBy(*keys).agg(F.avg("value").alias("average"), F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("value").alias("n"))


def sample_rows(facts: DataFrame, n: int = 5) -> DataFrame:
    return facts.filter(F.col("value").isNotNull()).orderBy("fact_id").limit(n)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given, which must be total."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def citations(facts: DataFrame) -> DataFrame:
    """One citation a (document, slide), the first fact's, with a link to the slide."""
    return first_by(facts, ["document_id", "slide_number"], ["fact_id"]).select("document_id", "slide_number", "document_name", F.concat(F.col("file_path"), F.lit("#slide="), F.col("slide_number").cast("string")).alias("link"), F.regexp_extract("file_path", r"/orders/(\d+)", 1).alias("deck_id"))


def row_confidence() -> Column:
    """Mean of semantic and extraction score, or the one there is."""
    return F.coalesce((F.col("semantic_score") + F.col("confidence")) / 2, F.col("semantic_score"), F.col("confidence"))


def semantic_rerank(facts: DataFrame, scores: DataFrame, key: str, top: int = 5, sure: float = 0.6, gap: float = 0.05) -> DataFrame:
    """The best facts of each key by score (0 where there is none), in slide order; ambiguous if the best is below sure or leads by less than gap."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "fact_id")
    rows = facts.join(scores, "fact_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rows = rows.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w)})
    best = rows.filter("rank = 1").select(F.col(key).alias("__k"), ((F.col("score") < sure) | (F.col("score") - F.col("next") < gap)).alias("ambiguous"))
    out = rows.filter(F.col("rank") <= top).join(best, F.col(key) == F.col("__k"))
    return out.select(key, "fact_id", "slide_number", "score", "rank", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def fan_out(facts: DataFrame, scopes: DataFrame, on: list[str]) -> DataFrame:
    """Facts of each scope (scope: its order; on: equality columns), in one join; a fact in several scopes stays in the first."""
    return first_by(facts.join(scopes, on), ["fact_id"], ["scope"])


def in_scope(chunks: DataFrame, ranges: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Rows (document_id, slide_number) of the documents, and within a range of their document if it has any."""
    if documents is not None:
        chunks = chunks.join(documents, "document_id", "left_semi")
    limited = ranges.select("document_id").distinct()
    inside = chunks.join(ranges, (chunks.document_id == ranges.document_id) & chunks.slide_number.between(ranges.start, ranges.end), "left_semi")
    return inside.unionByName(chunks.join(limited, "document_id", "left_anti"))


def relaxed(facts: DataFrame, tiers: list[Column], strict: bool = False) -> DataFrame:
    """Facts of the first tier that has any, in one pass: each fact's lowest tier, then the lowest of all. strict: the first tier only."""
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers[:1] if strict else tiers)])
    tagged = facts.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = tagged.agg(F.min("tier").alias("best"))
    return tagged.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def context_signal(chunks: DataFrame, terms: DataFrame, sure: float = 0.35) -> DataFrame:
    """For each term the best-scoring chunk that contains it, and whether that is sure."""
    hit = chunks.join(bounded(terms, 1000, "terms"), F.lower(chunks.text).contains(F.lower(terms.term)))
    best = hit.groupBy("term").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("i"))).alias("b"))
    return best.select("term", (-F.col("b.i")).alias("chunk_id"), F.col("b.score").alias("score"), (F.col("b.score") >= sure).alias("confident"))


def explicit_period(kind: str, number: int | None, year: int, low: str, high: str) -> Column:
    """Facts whose label is compatible with a named period and whose dates overlap it."""
    label = F.upper(F.coalesce("period_label", F.lit("")))
    part, named = F.regexp_extract(label, "([QH])([1-4])", 1), F.regexp_extract(label, "([QH])([1-4])", 2)
    fits = (part == "Q") & (named == str(number)) if kind == "quarter" else (part == "H") & (named == str(number)) if kind == "half" else (part == "")
    within = F.when(F.lit(kind) == "half", (part == "Q") & F.ceil(F.when(part == "Q", named.try_cast("int")) / 2).eqNullSafe(F.lit(number))).when(F.lit(kind) == "year", F.lit(True)).otherwise(F.lit(False))
    return (fits | within) & label.contains(str(year)) & overlaps(F.col("period_start"), F.col("period_end"), low, high)


def definition(catalog: DataFrame) -> DataFrame:
    """A sentence for each entry: name, description, formula and unit, as far as there are any."""
    part = lambda label, c: F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.concat(F.lit(label), F.trim(c), F.lit(".")))
    return catalog.select("metric_id", F.concat_ws(" ", part("", "name"), part("", "description"), part("Formula: ", "formula"), part("Unit: ", "default_unit")).alias("answer"))


def options(df: DataFrame, column: str, most: int = 5) -> DataFrame:
    """The first distinct values, numbered and joined, to ask which was meant."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most)
    rows = rows.withColumn("n", F.row_number().over(W.orderBy(column)))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", column))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x[column])), "; ").alias("options"))


def formatted(value: Column, unit: Column) -> Column:
    """12.50% for percent, $1,234.50 for currency, 1,234.50 for others; null stays null."""
    text = F.format_number(value, 2)
    return F.when(unit == "percent", F.concat(F.round(value, 2).cast("decimal(20,2)").cast("string"), F.lit("%"))).when(unit == "currency", F.concat(F.lit("$"), text)).otherwise(text)


def grid(facts: DataFrame, most: int = 4) -> DataFrame:
    """For each document and slide, the first values in order of their facts, joined."""
    w = W.partitionBy("document_id", "slide_number").orderBy("fact_id", "value")
    rows = facts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    return rows.groupBy("document_id", "slide_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws("=", "metric_id", F.round("value", 4).cast("decimal(20,4)").cast("string")).alias("t")))), lambda x: x["t"]), "; ").alias("values"), F.count("*").alias("n_values"))


def slide_overlap(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Chunks that a fact's slide falls into; a missing end is the other end, and reversed ends are exchanged."""
    low = F.least(F.coalesce("start_slide", "end_slide"), F.coalesce("end_slide", "start_slide"))
    high = F.greatest(F.coalesce("start_slide", "end_slide"), F.coalesce("end_slide", "start_slide"))
    c = chunks.withColumns({"__low": low, "__high": high})
    f = facts.select("document_id", "slide_number").distinct()
    return c.join(f, (c.document_id == f.document_id) & f.slide_number.between(c["__low"], c["__high"]), "left_semi").drop("__low", "__high")


def budget(chunks: DataFrame, total: int, least: int) -> DataFrame:
    """The best chunks of each document, as many as an equal share of total, but least at least."""
    n = chunks.agg(F.greatest(F.lit(least), F.floor(F.lit(total) / F.greatest(F.count_distinct("document_id"), F.lit(1)))).alias("__k"))
    w = W.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return chunks.withColumn("__r", F.row_number().over(w)).join(F.broadcast(n)).filter(F.col("__r") <= F.col("__k")).drop("__r", "__k")


def capped(chunks: DataFrame, per_document: int = 10, overall: int = 40) -> DataFrame:
    """Best first: at most per_document of each document, then at most overall."""
    w = W.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return chunks.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_document).drop("__r").orderBy(F.desc("score"), "chunk_id").limit(overall)


def linked_chunks(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """fact_id, chunk_id and relation: exact for a chunk of that slide alone, else range_overlap."""
    hit = facts.join(chunks, "document_id").filter(F.col("slide_number").between(F.col("start_slide"), F.col("end_slide")))
    return hit.select("fact_id", "chunk_id", F.when((F.col("start_slide") == F.col("slide_number")) & (F.col("end_slide") == F.col("slide_number")), "exact").otherwise("range_overlap").alias("relation"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def evidence(facts: DataFrame, links: DataFrame, chunks: DataFrame, n: int = 400) -> DataFrame:
    """Facts with their linked chunks' ids and the shortened text of the first."""
    c = links.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("fact_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"), F.min(F.struct("chunk_id", "text")).alias("first"))
    return facts.join(c, "fact_id", "left").select("fact_id", "metric_id", F.size(F.coalesce("ids", F.array().cast("array<bigint>"))).cast("long").alias("n_chunks"), truncated(F.col("first.text"), n).alias("snippet"))


def cited_context(chunks: DataFrame, cited: DataFrame, per_slide: int = 2, overall: int = 20) -> DataFrame:
    """Chunks on cited slides, the best of each slide, then of all; the document's link where a chunk has none."""
    rows = chunks.join(cited.select("document_id", "slide_number", "link"), ["document_id", "slide_number"])
    w = W.partitionBy("document_id", "slide_number").orderBy(F.desc("score"), "chunk_id")
    rows = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_slide).orderBy(F.desc("score"), "chunk_id").limit(overall)
    return rows.select("chunk_id", "document_id", "slide_number", F.coalesce("url", "link").alias("url"))
