"""From text to facts: pages, labels, values, links, scores, resolution, context (families D01 to D27 and D35 to D54)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalog
from ..functions.fiscal import half_bounds, quarter_bounds, year_bounds
from ..functions.text import plain, plain_tokens, squeezed
from . import dictionary
from .facts import any_of, bounded, first_by

PAGE = r"<!-- PAGE (\d+) -->"
#: Fixed: a number as it is written, with what says its unit.
NUMBER = r"\$?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*[KMBkmb]\b)?%?"


def metric_words() -> list[str]:
    """What the names of metrics end in, and their abbreviations, in the singular: from the catalogue."""
    names = [n.lower() for _, name, _, _, aliases, *_ in catalog.entries() for n in (name, *aliases)]
    last = {n.split()[-1] for n in names} | {n for n in names if " " not in n}
    singular = {w[:-1] if w.endswith("s") and len(w) > 3 and not w.endswith("ss") else w for w in last if w.isalpha()}
    return sorted(w for w in singular if len(w) > 2 and w != "ups")


#: Matches a text with one of those words, in the singular or the plural.
HINT = r"(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, metric_words())) + r")(?:e?s)?(?![a-z0-9])"
FISCAL_WORDS = r"(?i)\b(?:FY\d{2,4}|Q[1-4]|H[12]|20\d{2})\b"


def pages(decks: DataFrame) -> DataFrame:
    """deck_id, page, body, notes and image count of each page of a text with page markers; what precedes the first is no page."""
    parts = decks.select("deck_id", F.explode(F.slice(F.split("text", r"(?=<!-- PAGE \d+ -->)"), 1, 1_000_000)).alias("part")).filter(F.col("part").rlike("^" + PAGE))
    body = F.regexp_replace("part", "^" + PAGE, "")
    cut = F.split(body, "### Notes:", 2)
    return parts.select("deck_id", F.regexp_extract("part", PAGE, 1).cast("int").alias("page"), F.trim(F.regexp_replace(cut[0], r"^\s+|\s+$", "")).alias("body"), F.regexp_replace(F.get(cut, F.lit(1)), r"^\s+|\s+$", "").alias("notes"), F.regexp_count("part", F.lit(r"!\[[^\]]*\]\(")).cast("long").alias("images"))


def without_notes(text: Column) -> Column:
    """The text without what stands from a notes heading to the next page."""
    return F.regexp_replace(text, r"(?s)### Notes:.*?(<!-- PAGE|\z)", "$1")


def numbers(df: DataFrame, *keep: str) -> DataFrame:
    """Numbers as they stand in text, by what they are: percent, currency, or a rate (x)."""
    kinds = {"percent": r"\d+(?:\.\d+)?%", "currency": r"\$\d[\d,]*(?:\.\d+)?", "rate": r"\d+(?:\.\d+)?x\b"}
    parts = [df.select(*keep, F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(f"({p})"), 1)).alias("raw")) for k, p in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def charts(df: DataFrame, *keep: str) -> DataFrame:
    """Pages that look like a chart: three percentages or more compare; three `key: value` lines or more are a table of at most ten."""
    pct = F.regexp_count("text", F.lit(r"\d+(?:\.\d+)?%"))
    rows = F.slice(F.regexp_extract_all("text", F.lit(r"(?m)^([^:\n]+:[ \t]*[^\n]+)$"), 1), 1, 10)
    return df.select(*keep, pct.cast("long").alias("percentages"), F.size(rows).cast("long").alias("rows"), (pct >= 3).alias("comparison"), (F.size(rows) >= 3).alias("table")).filter("comparison or table")


def business_terms(df: DataFrame, terms: list[str], *keep: str) -> DataFrame:
    """Distinct terms of a dictionary in each row's text; up to four letters in capitals, else each word's first."""
    pattern = r"(?i)\b(" + "|".join(map(re.escape, terms)) + r")\b"
    found = df.select(*keep, F.explode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("t"))
    return found.select(*keep, F.when(F.length("t") <= 4, F.upper("t")).otherwise(F.initcap("t")).alias("term")).distinct()


def slide_range_of(text: Column) -> tuple[Column, Column]:
    """The smallest and largest page marked in a text; null where there is none."""
    at = F.transform(F.regexp_extract_all(text, F.lit(PAGE), 1), lambda x: x.cast("int"))
    return F.array_min(at), F.array_max(at)


def merged_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges (start, end) of each key with overlapping and adjacent ones made one."""
    w = W.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.withColumn("new", F.when(F.col("start") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def parsed_ranges(df: DataFrame, spec: str = "spec") -> DataFrame:
    """Ranges of a text such as "1-3, 7, 9:12"; those that are reversed or reach below 1 are left out."""
    rows = df.withColumn("part", F.explode(F.split(spec, ","))).withColumn("ends", F.split(F.trim("part"), r"\s*[-:]\s*"))
    start = F.get("ends", F.lit(0)).try_cast("int")
    end = F.coalesce(F.get("ends", F.lit(1)), F.get("ends", F.lit(0))).try_cast("int")
    return rows.withColumns({"start": start, "end": end}).filter("start >= 1 and end >= start").drop("part", "ends")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Greedy alignment of a deck's pages to its slides by shared words of more than two letters: the best pair first, each once.

    Candidates come from an equi-join on words; a deck's candidates are no more than its pages times its slides."""
    words = lambda df, name: df.select(key, F.col("n").alias(name), F.explode(F.filter(plain_tokens(F.col("text")), lambda x: F.length(x) > 2)).alias("w"))
    both = words(left, "page").join(words(right, "slide"), [key, "w"]).groupBy(key, "page", "slide").agg(F.count("*").alias("shared"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pages, slides, out = set(), set(), []
        for r in pdf.sort_values(["shared", "page", "slide"], ascending=[False, True, True]).itertuples():
            if r.page not in pages and r.slide not in slides:
                pages.add(r.page)
                slides.add(r.slide)
                out.append((getattr(r, key), r.page, r.slide, r.shared))
        return pd.DataFrame(out, columns=[key, "page", "slide", "shared"])

    return both.groupBy(key).applyInPandas(run, both.schema)


def html_cells(df: DataFrame, *keep: str) -> DataFrame:
    """row and col (from 0) and text of the cells of HTML tables."""
    tables = df.select(*keep, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("table_no", "t"))
    rows = tables.select(*keep, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "r"))
    cells = rows.select(*keep, "table_no", "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)).alias("col", "c"))
    return cells.select(*keep, "table_no", "row", "col", squeezed(F.regexp_replace("c", "<[^>]*>", " ")).alias("text"))


def normal_rows(rows: Column) -> Column:
    """An array of rows of cells with white space collapsed and rows without any text left out."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: squeezed(F.coalesce(c, F.lit("")))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


def table_key(rows: Column) -> Column:
    return F.sha2(F.to_json(rows), 256)


@F.pandas_udf(T.StringType())
def table_uuid(keys: pd.Series) -> pd.Series:
    """The name-based UUID (version 5) of a key."""
    return keys.map(lambda k: str(uuid.uuid5(uuid.NAMESPACE_URL, k)), na_action="ignore")


def spans(pattern_groups: dict[str, str], text: str = "text"):
    """A mapInPandas function from rows (id, text) to (id, label, raw, start, end) of all matches of named patterns."""
    compiled = {k: re.compile(p) for k, p in pattern_groups.items()}

    def run(batches):
        for pdf in batches:
            out = [(i, k, m.group(0), m.start(), m.end()) for i, t in zip(pdf["id"], pdf[text]) if t for k, p in compiled.items() for m in p.finditer(t)]
            yield pd.DataFrame(out, columns=["id", "label", "raw", "start", "end"])

    return run


SPAN_SCHEMA = "id long, label string, raw string, start int, end int"


def label_spans(texts: DataFrame, entries: list[tuple] | None = None) -> DataFrame:
    """id, label (metric_id), raw, start and end of the catalogue's aliases in texts (id, text): per metric the leftmost, longest ones."""
    phrases = [(metric_id, alias) for metric_id, _, _, _, aliases, _ in entries or catalog.entries() for alias in aliases]
    return dictionary.scanned(texts, "id", phrases).select("id", "label", "raw", "start", "end")


def value_spans(texts: DataFrame) -> DataFrame:
    """Numbers with their places; no number begins or ends within a word or another number."""
    return texts.select("id", "text").mapInPandas(spans({"value": r"(?<![\w.])" + NUMBER + r"\+?(?!\w)"}), SPAN_SCHEMA)


def parsed_number(raw: Column) -> Column:
    """The number, times a thousand, a million or a billion by its suffix; minutes for times; null where there is none."""
    digits = F.regexp_replace(F.regexp_extract(raw, r"([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)", 1), ",", "").try_cast("double")
    suffix = F.lower(F.regexp_extract(raw, r"\d\s*([KMBkmb])(?![A-Za-z])", 1))
    time = F.lower(F.regexp_extract(raw, r"(?i)\d\s*(seconds|secs|s|minutes|mins|min|hours|hrs|h)\b", 1))
    scale = F.when(time.isin("h", "hrs", "hours"), 60.0).when(time.isin("s", "secs", "seconds"), 1 / 60).when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    return digits * scale


def unit_of(raw: Column) -> Column:
    return (
        F.when(raw.isNull() | ~raw.rlike(r"\d"), F.lit(None).cast("string"))
        .when(raw.rlike(r"(?i)\d\s*(seconds|secs|s|minutes|mins|min|hours|hrs|h)\b"), "time")
        .when(raw.rlike(r"(?i)\d\s*x\b"), "ratio")
        .when(raw.contains("%"), "percent")
        .when(raw.contains("$"), "currency")
        .otherwise("count")
    )


def noise(raw: Column, context: Column) -> Column:
    """Whether a number is a year, a page, or part of a date rather than a value."""
    unit, year = raw.rlike("[%$KMBkmb]"), raw.rlike(r"^(19|20)\d{2}$")
    return (
        (year & ~unit)
        | F.lower(context).contains("slide")
        | F.lower(context).contains("page")
        | (context.rlike(r"\b(19|20)\d{2}\b") & (F.length(raw) == 4) & ~unit)
        | (context.rlike(r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\b") & ~unit)
        | (context.rlike(r"(?i)\b(FY|Q\d|H\d)\b") & (F.length(raw) <= 2))
    )


def qualifiers(text: Column) -> Column:
    """A map of what a text says about geo, platform, audience and time frame; only what it says."""
    has = lambda p: text.rlike(p)
    geo = F.when(has(r"(?i)\bUS\b|\bUnited States\b|\bDomestic\b"), "US").when(has(r"(?i)\bGlobal\b|\bWorldwide\b"), "Global").when(has(r"(?i)\bEMEA\b"), "EMEA").when(has(r"(?i)\bAPAC\b"), "APAC").when(has(r"(?i)\bLATAM\b"), "LATAM")
    platform = F.when(has(r"(?i)\biOS\b"), "iOS").when(has(r"(?i)\bAndroid\b"), "Android").when(has(r"(?i)\bwebOS\b"), "webOS")
    audience = F.when(has(r"(?i)\blapsed\b"), "lapsed").when(has(r"(?i)\bnew\b.*\busers\b"), "new_users")
    frame = F.when(has(r"(?i)\bH[12]\b"), "H").when(has(r"(?i)\bQ[1-4]\b"), "Q").when(has(r"(?i)\bFY\s*\d{2,4}\b"), "FY")
    every = F.create_map(F.lit("geo"), geo, F.lit("platform"), platform, F.lit("audience"), audience, F.lit("timeframe"), frame)
    return F.map_filter(every, lambda k, v: v.isNotNull())


def merged_maps(a: Column, b: Column) -> Column:
    """b's entries over a's; entries that are empty count for nothing."""
    full = lambda m: F.filter(F.map_entries(m), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    mine = F.filter(full(a), lambda e: ~F.array_contains(F.map_keys(F.map_from_entries(full(b))), e["key"]))
    return F.map_from_entries(F.concat(mine, full(b)))


def text_links(labels: DataFrame, values: DataFrame, texts: DataFrame, most: int = 160) -> DataFrame:
    """Labels with the values of their block (id, unique in texts): distance, whether on one line, whether a separator stands between.

    The planner can't know how many rows Python functions make of a text, and broadcasts too many; so these joins shuffle."""
    l = labels.select("id", F.col("label").alias("metric_id"), F.col("start").alias("ls"), F.col("end").alias("le"))  # noqa: E741
    v = values.select("id", F.col("raw").alias("value"), F.col("start").alias("vs"), F.col("end").alias("ve"))
    low, high = F.least("le", "ve"), F.greatest("ls", "vs")
    rows = l.join(v.hint("merge"), "id").filter((F.col("ve") <= F.col("ls")) | (F.col("vs") >= F.col("le"))).join(texts.select("id", "text").hint("merge"), "id").withColumn("between", F.expr("substring(text, least(le, ve) + 1, greatest(ls, vs) - least(le, ve))"))
    return rows.select("id", "metric_id", "ls", "le", "value", "vs", F.lit("same_block").alias("relation"), (high - low).alias("distance"), (~F.col("between").contains("\n")).cast("int").alias("same_line"), F.col("between").rlike("[:=|-]").cast("int").alias("separator")).filter(F.col("distance") <= most)


def table_links(cells: DataFrame) -> DataFrame:
    """Label cells with the value cells to their right and below, by two equi-joins."""
    label = cells.filter(~F.col("text").rlike(r"\d")).select("id", F.col("row").alias("lr"), F.col("col").alias("lc"), F.col("text").alias("label"))
    value = cells.filter(F.col("text").rlike(r"\d")).select("id", "row", "col", F.col("text").alias("value"))
    right = label.join(value, (label.id == value.id) & (F.col("lr") == F.col("row")) & (F.col("col") > F.col("lc"))).select(label.id, "label", "value", "lr", "lc", F.lit("table_row_right").alias("relation"), (F.col("col") - F.col("lc")).alias("distance"))
    down = label.join(value, (label.id == value.id) & (F.col("lc") == F.col("col")) & (F.col("row") > F.col("lr"))).select(label.id, "label", "value", "lr", "lc", F.lit("table_col_down").alias("relation"), (F.col("row") - F.col("lr")).alias("distance"))
    return right.unionByName(down)


#: Fixed weights of a link's score.
WEIGHTS = {"base": 0.35, "unit_match": 0.25, "unit_mismatch": -0.25, "same_block": 0.10, "table_row": 0.25, "table_col": 0.18, "same_line": 0.08, "separator": 0.06, "proximity": 0.18, "priority": 0.03, "date": -0.20}


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def link_score(relation: Column, distance: Column, same_line: Column, separator: Column, expected: Column, unit: Column, priority: Column, context: Column) -> Column:
    w = WEIGHTS
    units = F.when((expected != "") & (unit != ""), F.when(expected == unit, w["unit_match"]).otherwise(w["unit_mismatch"])).otherwise(0.0)
    kind = F.when(relation == "same_block", w["same_block"]).when(relation == "table_row_right", w["table_row"]).when(relation == "table_col_down", w["table_col"]).otherwise(0.0)
    near = F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(distance, F.lit(160)) / 160) * w["proximity"], F.lit(0.0))
    date = F.when(context.rlike(FISCAL_WORDS) & (unit == "count"), w["date"]).otherwise(0.0)
    return clamp(w["base"] + units + kind + near + F.coalesce(same_line, F.lit(0)) * w["same_line"] + F.coalesce(separator, F.lit(0)) * w["separator"] + F.coalesce(priority, F.lit(0)) * w["priority"] + date)


def selected_links(links: DataFrame, keys: list[str], order: list, low: float = 0.36, margin: float = 0.08, unclear: tuple[str, ...] = ("reach", "unique_reach")) -> DataFrame:
    """The best link of each label, and whether it needs a second look: weak, nearly tied, or of a metric that is easily confused."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), *order)
    rows = links.withColumns({"__r": F.row_number().over(w), "__next": F.lead("score").over(w)}).filter("__r = 1")
    check = (F.col("score") < low) | F.coalesce(F.col("score") - F.col("__next") <= margin, F.lit(False)) | F.col("metric_id").isin(*unclear)
    return rows.withColumn("adjudicate", check).drop("__r", "__next")


def request_key(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def adjudicated(requests: DataFrame, cache: DataFrame, client: Callable[[str], str], columns: list[str]) -> DataFrame:
    """Answers (key, answer) from the cache, or from the client for the keys that it lacks; cached says which."""
    keyed = requests.select(request_key(*columns).alias("key"), F.to_json(F.struct(*columns)).alias("request")).distinct()
    known = keyed.join(cache, "key").select("key", "answer", F.lit(True).alias("cached"))

    def ask(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "answer": pdf["request"].map(client), "cached": False})

    return known.unionByName(keyed.join(cache, "key", "left_anti").mapInPandas(ask, "key string, answer string, cached boolean"))


#: Fixed: which source of a fact is believed first.
SOURCE_PRIORITY = {"table": 3, "slide": 2, "notes": 1}


def resolved(facts: DataFrame) -> DataFrame:
    """Facts (slide, metric_id, value, unit, quals, confidence, source, snippet, fact_id): reach that a text calls unique is unique
    reach; equal facts keep the most confident, then the best source; reach beside equal unique reach goes."""
    words = "|".join(next(e[5] for e in catalog.entries() if e[0] == "unique_reach"))
    df = facts.withColumn("metric_id", F.when((F.col("metric_id") == "reach") & F.lower("snippet").rlike(words), "unique_reach").otherwise(F.col("metric_id")))
    rank = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in SOURCE_PRIORITY.items()], F.lit(0))
    df = first_by(df, ["slide", "metric_id", "value", "unit", "quals"], [F.desc("confidence"), F.desc(rank), "fact_id"])
    unique = df.filter("metric_id = 'unique_reach'").select("slide", "value", "unit").distinct()
    return df.filter("metric_id <> 'reach'").unionByName(df.filter("metric_id = 'reach'").join(unique, ["slide", "value", "unit"], "left_anti").select(df.columns))


def scanned(mentions: DataFrame, values: DataFrame, within: int = 120) -> DataFrame:
    """Each mention's (id, metric_id, at; unique) nearest value within reach whose unit fits; for counts one with K, M or B before others."""
    rows = mentions.join(values.hint("merge"), "id").withColumn("distance", F.abs(F.col("value_at") - F.col("at"))).filter((F.col("distance") <= within) & ((F.col("expected") == F.col("unit")) | (F.col("expected") == "")))
    large = F.when((F.col("expected") == "count") & F.col("raw").rlike(r"(?i)\d\s*[KMB]\b"), 0).otherwise(1)
    return first_by(rows.withColumn("large", large), ["id", "metric_id", "at"], ["large", "distance", "value_at"]).drop("large")


def baseline_type(text: Column) -> Column:
    t = F.lower(text)
    has = lambda *w: any_of([t.contains(x) for x in w])
    return F.when(has("yoy", "year over year", "last year", "prior year"), "yoy").when(has("qoq", "quarter over quarter", "last quarter"), "qoq").when(has("mom", "month over month", "last month"), "mom").when(has("ytd"), "ytd").when(has("target"), "target").when(has("plan"), "plan").when(has("benchmark"), "benchmark").when(has("control"), "control").when(has("baseline", "vs", "versus", "compared to"), "baseline")


def period_of(text: Column) -> Column:
    """The first of a half, a quarter or a fiscal year that a text names: struct(label, start, end), or null."""
    year = lambda y: F.when(F.length(y) == 2, F.lit(2000) + y.try_cast("int")).otherwise(y.try_cast("int"))
    x = lambda p, g: F.regexp_extract(text, p, g)
    half, quarter, fiscal = r"(?i)\bH([12])\s*(?:FY\s*)?'?(\d{4}|\d{2})\b", r"(?i)\bQ([1-4])\s*(?:FY\s*)?'?(\d{4}|\d{2})\b", r"(?i)\bFY\s*'?(\d{4}|\d{2})\b"
    out = []
    for pattern, bounds, label in ((half, half_bounds, lambda n, y: F.concat(F.lit("H"), n, F.lit(" FY"), F.substring(y.cast("string"), 3, 2))), (quarter, quarter_bounds, lambda n, y: F.concat(F.lit("Q"), n, F.lit(" "), y.cast("string")))):
        n, y = x(pattern, 1), year(x(pattern, 2))
        a, b = bounds(y, n.try_cast("int"))
        out.append(F.when(text.rlike(pattern), F.struct(label(n, y).alias("label"), a.cast("string").alias("start"), b.cast("string").alias("end"))))
    y = year(x(fiscal, 1))
    a, b = year_bounds(y)
    out.append(F.when(text.rlike(fiscal), F.struct(F.concat(F.lit("FY"), F.substring(y.cast("string"), 3, 2)).alias("label"), a.cast("string").alias("start"), b.cast("string").alias("end"))))
    return F.coalesce(*out)


def contextual(rows: DataFrame, columns: list[str], strategies: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Columns filled from the strategies in order (each a frame with the key and the columns); only nulls are filled; trace tells who filled what."""
    out = rows.withColumn("trace", F.array().cast("array<string>"))
    for name, df in strategies:
        out = out.join(df.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
        filled = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"__{c}").isNotNull(), F.lit(f"{name}:{c}")) for c in columns]))
        out = out.withColumn("trace", F.concat("trace", filled)).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])
    return out


def with_period_default(rows: DataFrame, default: Column) -> DataFrame:
    """Rows without a period take the document's; those with another one go."""
    return rows.withColumn("period", F.coalesce("period", default)).filter(default.isNull() | F.col("period").eqNullSafe(default))


def mapped(names: DataFrame, entries: DataFrame) -> DataFrame:
    """metric_id of each name by name or alias, any case; null where there is none."""
    keys = entries.select("metric_id", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("aliases", lambda a: F.lower(a))))).alias("key"))
    keys = first_by(keys, ["key"], ["metric_id"])
    return names.join(keys, F.lower(F.trim("name")) == F.col("key"), "left").drop("key")


def upserted(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """known rows, and new ones for keys (strings) not yet known, with ids that follow in the keys' order. Keys are numbered within
    their first two characters and those counts added up, so no task has all of them."""
    new = seen.select(key).filter(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = new.withColumn("__p", F.substring(key, 1, 2))
    counts = new.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__p").alias("__q"), (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    numbered = new.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(key))).join(before, F.col("__p") == F.col("__q"))
    return known.select("id", key).unionByName(numbered.join(F.broadcast(last)).select((F.col("last") + F.col("__before") + F.col("__r")).alias("id"), key))


def without_leaks(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows whose context is not part of any of their slide's notes, both without differences of case, punctuation and space."""
    n = notes.select(F.col("slide_id").alias("__s"), plain(F.col("notes")).alias("__n"))
    c = plain(F.col("context"))
    return rows.join(n, (F.col("slide_id") == F.col("__s")) & (c != "") & F.col("__n").contains(c), "left_anti")


def inferred(files: DataFrame, names: DataFrame) -> DataFrame:
    """The longest name that each file name contains, any case; names are a dimension, and checked to be small."""
    hit = files.join(bounded(names, 10_000, "names"), F.contains(F.lower("filename"), F.lower("name")), "left")
    return first_by(hit, ["filename"], [F.desc_nulls_last(F.length("name")), "name"]).select("filename", "name")


def to_refine(rows: DataFrame) -> DataFrame:
    """Facts that need a second look: wrong unit, several values of a name on a slide, an unclear metric, or a weak source."""
    several = rows.groupBy("slide_id", "name").agg(F.count_distinct("value").alias("values"))
    out = rows.join(several, ["slide_id", "name"])
    why = F.array_compact(F.array(F.when(F.col("unit") != F.col("expected"), "unit"), F.when(F.col("values") > 1, "conflict"), F.when(F.col("name").isin("reach", "unique_reach"), "unclear"), F.when(F.col("source") == "notes", "source")))
    return out.withColumn("reasons", F.array_join(why, ",")).filter("reasons <> ''").drop("values")


#: Batches that one task numbers, and keys (the most frequent) that are split; no other key holds more than an MOST_KEYS-th of all rows.
BATCHES, MOST_KEYS = 100, 20_000


def in_batches(rows: DataFrame, keys: list[str], client: Callable[[list[dict]], list[int]], size: int = 60) -> DataFrame:
    """Rows that the client keeps of each batch of a key (the positions it returns); a batch has size rows at most.

    A frequent key is dealt by fact_id to buckets of about BATCHES batches, and batches are numbered within a bucket, so no task gets all
    rows of a key; only the last batch of a bucket may be short. Null keys are a key of their own."""
    often = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > size * BATCHES).orderBy(F.desc("__n"), *keys).limit(MOST_KEYS)
    often = F.broadcast(often.toDF(*[f"__k{i}" for i in range(len(keys))], "__n"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    buckets = F.coalesce(F.ceil(F.col("__n") / (size * BATCHES)), F.lit(1))
    dealt = rows.join(often, same, "left").withColumn("__b", F.pmod(F.xxhash64("fact_id"), buckets)).select(*rows.columns, "__b")
    w = W.partitionBy(*keys, "__b").orderBy("fact_id")
    batched = dealt.withColumn("__batch", F.floor((F.row_number().over(w) - 1) / size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fact_id").reset_index(drop=True)
        return pdf.iloc[client(pdf.to_dict("records"))]

    return batched.groupBy(*keys, "__b", "__batch").applyInPandas(run, batched.schema).drop("__b", "__batch")


def slide_titles(shapes: DataFrame) -> DataFrame:
    """The best title of each slide: a title placeholder, large, high up, short; without shapes none."""
    score = F.when(F.col("placeholder") == "title", 100).otherwise(0) + F.least(F.col("font_size"), F.lit(60)) + F.when(F.col("top") < 100, 20).otherwise(0) - F.when(F.length("text") > 120, 40).otherwise(0)
    rows = shapes.filter(F.trim("text") != "").withColumn("score", score)
    return first_by(rows, ["slide_id"], [F.desc("score"), "top", "text"]).select("slide_id", F.trim("text").alias("title"), "score")


def title_of_text(text: Column) -> Column:
    """The first line with letters that is no marker."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"\p{L}") & ~x.startswith("<!--") & ~x.startswith("#")), F.lit(0))


def with_duplicate_context(rows: DataFrame) -> DataFrame:
    """A name and value on several slides: their contexts begin with the slide's number and title."""
    n = rows.groupBy("name", "value").agg(F.count_distinct("slide_number").alias("__n"))
    out = rows.join(n, ["name", "value"])
    return out.withColumn("context", F.when(F.col("__n") > 1, F.concat_ws(" ", F.concat(F.lit("slide "), F.col("slide_number").cast("string"), F.lit(":")), "title", "context")).otherwise(F.col("context"))).drop("__n")


def masked_number(match: re.Match) -> str:
    """A number moved by a fixed rule, written as it was: commas, leading zeros, decimals."""
    raw, percent = match.group(1), match.group(2)
    whole, _, part = raw.replace(",", "").partition(".")
    value = float(f"{whole}.{part or 0}")
    for fits, moved in ((percent and value <= 1000, value + 2), (not part and 2000 <= value <= 2035, value + 1), (value >= 1000, value * 1.03), (value >= 100, value + 7), (value >= 10, value + 3), (True, value + 1)):
        if fits:
            break
    text = format(moved if part else int(round(moved)), f"{',' if ',' in raw else ''}{f'.{len(part)}f' if part else ''}")
    return (text.zfill(len(whole)) if whole.startswith("0") and len(whole) > 1 and not part else text) + percent


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series) -> pd.Series:
    pattern = re.compile(r"(\d[\d,]*(?:\.\d+)?)(%?)")
    return texts.map(lambda t: pattern.sub(masked_number, t), na_action="ignore")


def deck_links(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """url of each file from the mapping (file names are unique in it), or its path."""
    return files.join(mapping, "filename", "left").select("filename", F.coalesce("url", "path").alias("url"))


def review_context(rows: DataFrame, most: int = 320) -> DataFrame:
    """The line around a fact's raw value (and those before and after), cut to most characters; else the raw context."""
    lines = F.split("text", "\n")
    at = F.expr("array_position(transform(split(text, '\\n'), x -> contains(x, raw)), true)")
    around = F.array_join(F.slice(lines, F.greatest(at.cast("int") - 1, F.lit(1)), F.when(at > 1, 3).otherwise(2)), " ")
    return rows.withColumn("review", F.substring(F.when(at > 0, F.concat_ws(" | ", "context", squeezed(around))).otherwise(F.col("context")), 1, most))


def manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    """task and count of each data set."""
    out = None
    for name, df in datasets.items():
        row = df.agg(F.lit(name).alias("task"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def as_json(row) -> str:
    return json.dumps(row.asDict(recursive=True), sort_keys=True)


#: The stages of model-made additions, in order, and the columns each fills; the model is the caller's.
ENHANCEMENTS = {"slides": ["summary"], "metrics": ["label", "category", "baseline", "period"], "charts": ["description"], "document": ["summary"], "entities": ["entities"], "images": ["description"], "sections": ["section"]}


def enhanced(rows: DataFrame, stage: str, client: Callable[[dict], dict]) -> DataFrame:
    """rows with the stage's columns from the client, a row at a time in batches; what the client leaves out is null."""
    columns = ENHANCEMENTS[stage]
    base = rows.drop(*columns)
    kinds = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)

    def run(batches):
        for pdf in batches:
            answers = [client(r) for r in pdf.to_dict("records")]
            yield pdf.assign(**{c: [a.get(c) for a in answers] for c in columns})

    return base.mapInPandas(run, kinds + "".join(f", `{c}` string" for c in columns))
