"""From a question to an intent: metrics, clients, regions, periods, aggregation; routing and guards (families F09 to F22, F26, F27, F34)."""

from __future__ import annotations

import difflib
import hashlib
import json
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fiscal import half_bounds, quarter_bounds, year_bounds
from ..functions.text import plain_tokens
from . import dictionary
from .facts import any_of, bounded

#: Fixed: words too general to choose a metric by themselves.
GENERIC = ["spend", "spending", "investment", "cost", "revenue", "value", "total"]
#: Names of regions, and words for aggregations and groupings.
REGION_ALIASES = {"us": "US", "u.s.": "US", "usa": "US", "united states": "US", "domestic": "US", "emea": "EMEA", "europe": "EMEA", "global": "GLOBAL", "worldwide": "GLOBAL"}
AGGREGATIONS = [("latest", ["latest", "most recent", "current", "this quarter", "this month"]), ("average", ["average", "avg", "mean"]), ("sum", ["total", "sum"]), ("min", ["minimum", "lowest", "min"]), ("max", ["maximum", "highest", "max"]), ("trend", ["trend", "over time", "history", "past"]), ("compare", ["compare", "vs", "versus", "difference", "delta"])]
GROUPINGS = [("by_period", ["by quarter", "by period", "by month", "by year"]), ("by_region", ["by region", "by market"]), ("by_client", ["by client", "by advertiser", "by brand"])]
#: Cues of a comparison, of a question about decks, and of a follow-up.
COMPARISON_CUES = ["compare", "comparison", "versus", "vs ", "difference", "delta", "between", "across", "relative to", "year over year", "yoy", "quarter over quarter", "qoq", "month over month", "mom", "prior period", "trend across", "vs."]
DECK_CUES = ["deck", "presentation", "pptx", ".pptx", "slides from"]
FOLLOW_UPS = ["and", "also", "compare", "vs", "versus", "what about", "same", "that", "those", "it"]
#: Greetings.
GREETINGS = ["hi", "hello", "hey", "hiya", "yo", "sup", "good morning", "good afternoon", "good evening"]
#: Pairs of word lists: a question with a word of both asks to be let out of the rules, or to see what is hidden.
ATTACKS = [
    (["ignore", "disregard", "forget", "override", "bypass", "circumvent"], ["instruction", "instructions", "rules", "guidelines", "guardrails", "restrictions", "safety", "policy"]),
    (["reveal", "print", "leak", "repeat", "show"], ["prompt", "hidden", "internal", "confidential"]),
    (["pretend", "act", "roleplay", "behave"], ["unrestricted", "unfiltered", "jailbroken", "limitless", "developer"]),
    (["jailbreak", "injection"], ["jailbreak", "prompt"]),
]


def quoted(word: Column) -> Column:
    """A pattern for the word as it is, as a whole word."""
    return F.concat(F.lit(r"(?i)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)"))


def has_word(text: Column, *words: str) -> Column:
    return any_of([text.rlike(r"(?i)(?<!\w)\Q" + w + r"\E(?!\w)") for w in words])


def resolve_metrics(questions: DataFrame, aliases: DataFrame, disambiguation: DataFrame | None = None) -> DataFrame:
    """qid, metric_id, score and rank of the metrics whose aliases a question has; aliases are the catalogue's, a small table that is
    checked before it is broadcast."""
    q = questions.select("qid", F.lower("text").alias("text"), plain_tokens(F.col("text")).alias("qt"))
    named = dictionary.scanned(q, "qid", dictionary.phrases_of(aliases, "alias")).select("qid", F.col("label").alias("alias")).distinct()
    hit = q.join(named, "qid").join(bounded(aliases, 20_000, "aliases"), "alias")
    terms = plain_tokens(F.col("alias"))
    score = F.col("priority") + F.least(F.lit(1.0), 0.2 * F.size(F.array_intersect(terms, "qt"))) + F.when(F.size(terms) >= 2, 0.25).otherwise(0.0)
    score = score - F.when((F.size(terms) == 1) & terms[0].isin(GENERIC) & (F.size("qt") >= 3), 0.35).otherwise(0.0)
    if disambiguation is not None:
        hit = hit.join(bounded(disambiguation, 20_000, "metrics"), "metric_id", "left")
        some = F.size(F.coalesce("disambiguation", F.array().cast("array<string>"))) > 0
        score = score + F.when(some & F.exists("disambiguation", lambda w: F.contains(F.col("text"), w)), 0.6).when(some, -0.4).otherwise(0.0)
    best = hit.withColumn("score", F.round(score, 6)).groupBy("qid", "metric_id").agg(F.max("score").alias("score"))
    from pyspark.sql import Window as W

    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "metric_id")))


def resolve_client(questions: DataFrame, clients: DataFrame) -> DataFrame:
    """qid, client, confidence: the longest client named; 0.3 and none if two are equally long, 0 if there is none."""
    hit = dictionary.scanned(questions, "qid", dictionary.phrases_of(clients, "client")).select("qid", F.col("label").alias("client"))
    most = hit.groupBy("qid").agg(F.max(F.length("client")).alias("n"))
    best = hit.join(most, "qid").filter(F.length("client") == F.col("n")).groupBy("qid").agg(F.count_distinct("client").alias("k"), F.min("client").alias("client"))
    out = questions.join(best, "qid", "left")
    return out.select("qid", F.when(F.col("k") == 1, F.col("client")).alias("client"), F.when(F.col("k") == 1, 0.8).when(F.col("k") > 1, 0.3).otherwise(0.0).alias("confidence"))


def resolve_region(text: Column) -> tuple[Column, Column]:
    """Region and confidence: 0.9 for one, 0.3 and none for several, 0 without any."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(has_word(text, a), r) for a, r in REGION_ALIASES.items()])))
    return F.when(F.size(found) == 1, found[0]), F.when(F.size(found) == 1, 0.9).when(F.size(found) > 1, 0.3).otherwise(0.0)


def resolve_period(text: Column, anchor: Column) -> Column:
    """struct(kind, start, end): a quarter, a half, a fiscal year, or relative to the anchor date (30 days a month)."""
    year = lambda y: F.when(F.length(y) == 2, 2000 + y.try_cast("int")).otherwise(y.try_cast("int"))
    out = []
    for kind, pattern, bounds in (("quarter", r"(?i)\bQ([1-4])\s*(?:FY\s*)?'?(\d{4}|\d{2})\b", quarter_bounds), ("half", r"(?i)\bH([12])\s*(?:FY\s*)?'?(\d{4}|\d{2})\b", half_bounds)):
        a, b = bounds(year(F.regexp_extract(text, pattern, 2)), F.regexp_extract(text, pattern, 1).try_cast("int"))
        out.append(F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))))
    fy = r"(?i)\bFY\s*'?(\d{4}|\d{2})\b"
    a, b = year_bounds(year(F.regexp_extract(text, fy, 1)))
    out.append(F.when(text.rlike(fy), F.struct(F.lit("year").alias("kind"), a.alias("start"), b.alias("end"))))
    months = F.regexp_extract(text, r"(?i)\b(?:last|past)\s+(\d+)\s+months?\b", 1).try_cast("int")
    span = F.when(text.rlike(r"(?i)\blast quarter\b"), 3).when(text.rlike(r"(?i)\blast half\b"), 6).when(text.rlike(r"(?i)\blast year\b"), 12).otherwise(months)
    out.append(F.when(span.isNotNull(), F.struct(F.lit("relative").alias("kind"), F.date_sub(anchor, span * 30).alias("start"), anchor.alias("end"))))
    return F.coalesce(*out)


def aggregation(text: Column) -> Column:
    return F.coalesce(*[F.when(has_word(text, *words), name) for name, words in AGGREGATIONS])


def grouping(text: Column) -> Column:
    return F.coalesce(*[F.when(has_word(text, *words), name) for name, words in GROUPINGS])


def top_n(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"\btop\s+(\d+)\b", 1).try_cast("int")


def intent_type(text: Column, has_metric: Column, has_period: Column) -> Column:
    asks = text.rlike(r"(?i)\bwhat\s+is\b|\bdefine\b|\bdefinition\b|\bhow\s+is\b|\bformula\b|\bcalculated\b")
    return F.when(has_metric & ~has_period & aggregation(text).isNull() & asks, "DEFINITION").otherwise("ANALYTICS")


def periods(text: Column) -> Column:
    """All periods that a text names, as labels without spaces, each once, in order."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"\b((?:[QH][1-4]\s*(?:FY\s*)?'?(?:20)?\d{2})|FY\s*'?(?:20)?\d{2})\b"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s']", ""), "20(?=[0-9]{2}$)", "")))


def comparison(text: Column) -> Column:
    """Why a question compares, or null."""
    t = F.lower(text)
    cue = F.coalesce(*[F.when(t.contains(w), f"keyword:{w.strip()}") for w in COMPARISON_CUES])
    decks = sum((F.when(t.contains(w), 1).otherwise(0) for w in DECK_CUES), F.lit(0))
    return F.when((decks >= 1) & (t.contains("compare") | t.contains("versus") | t.contains("vs")), "deck reference with comparison cue").when(cue.isNotNull(), cue).when(decks >= 2, "mentions multiple deck indicators")


def is_metric_query(text: Column, words: list[str]) -> Column:
    return has_word(text, *words)


def document_tokens(text: Column) -> Column:
    """Tokens of a text by which documents are matched: words, and periods in their compact form."""
    return F.array_sort(F.array_union(plain_tokens(text), F.transform(periods(text), lambda x: F.lower(x))))


def canonical_query(text: Column) -> Column:
    """The question within a JSON wrapper, the outermost first; a text that is no JSON is the question."""
    levels = ["$.query", "$.question", "$.input.query", "$.input.question", "$.data.query", "$.data.question", "$.args.query", "$.args.question", "$.data.input.query", "$.data.input.question"]
    return F.coalesce(*[F.get_json_object(text, p) for p in levels], text)


def follow_up(text: Column) -> Column:
    """Short questions, and those that lean on what came before."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return F.when((text.isNull()) | (F.trim(text) == ""), False).otherwise((words <= 4) | has_word(text, *FOLLOW_UPS))


def greeting(text: Column) -> Column:
    said = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), "[!.? ]+$", "")
    return F.coalesce(F.regexp_replace(said, " there$", "").isin(GREETINGS), F.lit(False))


def attack(text: Column) -> Column:
    """Whether a text has a word of both lists of a pair of ATTACKS."""
    words = plain_tokens(text)
    has = lambda x: F.arrays_overlap(words, F.array(*[F.lit(w) for w in x]))
    return any_of([has(a) & has(b) for a, b in ATTACKS])


def guard(text: Column, scope_score: Column, words: list[str], limit: float = 0.5) -> Column:
    """What stops a question: an attack, too little to do with the data; or allowed."""
    return F.when(attack(text), "jailbreak").when(greeting(text), "greeting").when(is_metric_query(text, words), "allowed").when(scope_score < limit, "out_of_scope").otherwise("allowed")


def region_verdict(text: Column) -> Column:
    w = lambda *x: has_word(text, *x)
    return F.when(w("us", "usa", "united states", "domestic"), "us").when(w("emea", "europe", "eu", "uk"), "emea").when(w("global", "world", "worldwide"), "global").when(w("mixed", "both", "multiple"), "mixed")


@F.pandas_udf(T.StructType([T.StructField("choice", T.StringType()), T.StructField("score", T.DoubleType())]))
def fuzzy_best(texts: pd.Series, choices: pd.Series) -> pd.DataFrame:
    """The choice most like any run of one to four words of the text, if it is like enough and leads the next by enough."""
    out = []
    for text, options in zip(texts, choices):
        words = (text or "").lower().split()
        grams = {" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1)}
        ranked = sorted(((max((difflib.SequenceMatcher(None, g, c.lower()).ratio() for g in grams), default=0.0), c) for c in options), key=lambda x: (-x[0], x[1]))
        sure = ranked and ranked[0][0] >= 0.8 and (len(ranked) < 2 or ranked[0][0] - ranked[1][0] >= 0.04)
        out.append((ranked[0][1], round(ranked[0][0], 6)) if sure else (None, None))
    return pd.DataFrame(out, columns=["choice", "score"])


FOUND = ("metric_ids", "client", "region", "period")


def resolved(questions: DataFrame, aliases: DataFrame, clients: DataFrame, anchor: Column, disambiguation: DataFrame | None = None) -> DataFrame:
    """qid, metric_ids (best first), client, region, period, aggregation, grouping and top of each question (qid, unique, and text):
    what the resolvers find by themselves. Null questions have none of these."""
    ranked = resolve_metrics(questions, aliases, disambiguation).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "metric_id"))).alias("r"))
    t = F.col("text")
    own = questions.select("qid", resolve_region(t)[0].alias("region"), resolve_period(t, anchor).alias("period"), aggregation(t).alias("aggregation"), grouping(t).alias("grouping"), top_n(t).alias("top"))
    out = own.join(ranked, "qid", "left").join(resolve_client(questions, clients).select("qid", "client"), "qid", "left")
    return out.select("qid", F.coalesce("r.metric_id", F.array().cast("array<string>")).alias("metric_ids"), "client", "region", "period", "aggregation", "grouping", "top")


def overridden(proposed: DataFrame, found: DataFrame) -> DataFrame:
    """A model's intents (the columns of resolved; one row a qid at most) with what resolvers found in their place. What the question
    itself names counts, and an assumption names each field that the model had otherwise. A question without a proposal keeps its own."""
    named = {f: F.size(f) > 0 if f == "metric_ids" else F.col(f).isNotNull() for f in FOUND}
    had = {f: F.coalesce(F.size(f"own_{f}") > 0, F.lit(False)) if f == "metric_ids" else F.col(f"own_{f}").isNotNull() for f in FOUND}
    differ = {f: F.array_sort(f) != F.array_sort(f"own_{f}") if f == "metric_ids" else F.col(f) != F.col(f"own_{f}") for f in FOUND}
    rows = found.join(proposed.select("qid", *[F.col(c).alias(f"own_{c}") for c in found.columns if c != "qid"]), "qid", "left")
    values = [F.when(named[f], F.col(f)).otherwise(F.coalesce(f"own_{f}", f)).alias(f) for f in FOUND]
    rest = [F.coalesce(f"own_{c}", c).alias(c) for c in ("aggregation", "grouping", "top")]
    said = F.array_compact(F.array(*[F.when(named[f] & had[f] & differ[f], f"{f} taken from the question, not from the proposal") for f in FOUND]))
    return rows.select("qid", *values, *rest, said.alias("assumptions"))


def candidates(proposed: DataFrame, column: str) -> DataFrame:
    """asked, place, qid and text of each word that was proposed in an array column; qid tells the words of all questions apart."""
    words = proposed.select(F.col("qid").alias("asked"), F.posexplode(column).alias("place", "text"))
    return words.select("asked", "place", F.concat_ws(":", F.col("asked").cast("string"), F.col("place").cast("string")).alias("qid"), "text")


def completed(found: DataFrame, questions: DataFrame, proposed: DataFrame, aliases: DataFrame, clients: DataFrame, anchor: Column, disambiguation: DataFrame | None = None) -> DataFrame:
    """qid, metric_ids, clients, region, periods, assumptions, unresolved: what was found, and where that is nothing, what the proposed
    words (qid, metrics, clients, regions, periods: arrays) stand for by the same resolvers. A metric counts if the words name no other
    one, a region if the question has the word too and no other is named; clients and periods may be several, in the words' order.
    assumptions names what was completed, unresolved what is still open."""
    metric, client, region, period = (candidates(proposed, c) for c in ("metrics", "clients", "regions", "periods"))
    best = resolve_metrics(metric.select("qid", "text"), aliases, disambiguation).filter("rank = 1")
    metric = metric.join(best, "qid").groupBy("asked").agg(F.collect_set("metric_id").alias("words_metric"))
    client = in_order(client.join(resolve_client(client.select("qid", "text"), clients).filter("client is not null").select("qid", "client"), "qid"), F.col("client"), "words_client")
    said = region.join(questions.select(F.col("qid").alias("asked"), F.col("text").alias("question")), "asked").filter(F.rlike("question", quoted(F.col("text"))))
    region = said.groupBy("asked").agg(F.collect_set(resolve_region(F.col("text"))[0]).alias("words_region"))
    period = in_order(period, resolve_period(F.col("text"), anchor), "words_period")
    rows = found
    for words in (metric, client, region, period):
        rows = rows.join(words.withColumnRenamed("asked", "qid"), "qid", "left")
    have = {"metric": F.size("metric_ids") > 0, "client": F.col("client").isNotNull(), "region": F.col("region").isNotNull(), "period": F.col("period").isNotNull()}
    words = {f: F.coalesce(F.size(f"words_{f}") == 1 if f in ("metric", "region") else F.size(f"words_{f}") > 0, F.lit(False)) for f in have}
    return rows.select(
        "qid",
        F.when(have["metric"] | ~words["metric"], F.col("metric_ids")).otherwise(F.col("words_metric")).alias("metric_ids"),
        F.when(have["client"], F.array("client")).when(words["client"], F.col("words_client")).alias("clients"),
        F.when(have["region"], F.col("region")).when(words["region"], F.element_at("words_region", 1)).alias("region"),
        F.when(have["period"], F.array("period")).when(words["period"], F.col("words_period")).alias("periods"),
        F.array_compact(F.array(*[F.when(~have[f] & words[f], f) for f in have])).alias("assumptions"),
        F.array_compact(F.array(*[F.when(~have[f] & ~words[f], f) for f in have])).alias("unresolved"),
    )


def in_order(words: DataFrame, value: Column, name: str) -> DataFrame:
    """asked and the distinct values of its words, by place, nulls left out."""
    rows = words.select("asked", "place", value.alias("v")).filter("v is not null").groupBy("asked", "v").agg(F.min("place").alias("place"))
    return rows.groupBy("asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias(name))


class Cache:
    """The last `most` answers by the hash of their request."""

    def __init__(self, most: int = 256):
        self.most, self.items = most, OrderedDict()

    @staticmethod
    def key(payload) -> str:
        return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, payload):
        k = self.key(payload)
        if k in self.items:
            self.items.move_to_end(k)
        return self.items.get(k)

    def put(self, payload, value) -> None:
        self.items[self.key(payload)] = value
        self.items.move_to_end(self.key(payload))
        while len(self.items) > self.most:
            self.items.popitem(last=False)
