"""Labels found around values in running texts (E12): runs of words before values, counted as n-grams.

Every text is read whole, in the JVM; a value gives at most five n-grams, so rows grow with the values. Counts are reduced by label and
text before they are shuffled by label, so a label that is everywhere is no hot key, and samples are three values, never a list of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import metric_like
from .trees import stored

#: What a value is, and words that may stand in a label.
VALUE_WORD = r"^[$]?[+-]?[0-9][0-9,.]*[%xKMB]?[.,;:)]*$"
LABEL_WORDS = r"^[A-Za-z][A-Za-z0-9/&+%-]*(?: [A-Za-z][A-Za-z0-9/&+%-]*)*[:=]*$"
NO_LABEL = r"^(?:fy ?[0-9]{2,4}|q[1-4]|h[12]|source|slide|notes?|page)$"
LONGEST, CHARS = 5, (4, 80)


def before_values(texts: DataFrame) -> DataFrame:
    """id, value and the words before it (five at most) of each value in texts (id, text). Line breaks, bars and semicolons end a run;
    colons and dashes that stand alone are left out. Null and empty texts have none."""
    parts = texts.select("id", F.explode(F.split("text", r"[\n|;]+")).alias("part")).filter(F.col("part").rlike("[0-9]"))
    words = F.filter(F.split("part", r"[ \t]+"), lambda x: (x != "") & ~x.rlike(r"^[:=-]+$"))
    rows = parts.select("id", words.alias("w")).filter(F.size("w") > 1)
    places = F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.get("w", i).rlike(VALUE_WORD))
    cut = F.transform(places, lambda i: F.struct(F.get("w", i).alias("value"), F.slice("w", F.greatest(i - LONGEST, F.lit(0)) + 1, F.least(i, F.lit(LONGEST))).alias("left")))
    return rows.select("id", F.inline(cut))


def grams(texts: DataFrame) -> DataFrame:
    """id, value, key and shorter (the key without its first word, null if it has one) of each n-gram of label words before a value."""
    ends = F.transform(F.sequence(F.lit(1), F.size("left")), lambda k: F.array_join(F.slice("left", -k, k), " "))
    rows = before_values(texts).select("id", "value", F.explode(F.filter(ends, lambda g: g.rlike(LABEL_WORDS))).alias("g"))
    rows = rows.select("id", "value", F.lower(F.regexp_replace("g", r"[:=]+$", "")).alias("key"))
    return rows.withColumn("shorter", F.when(F.col("key").contains(" "), F.regexp_replace("key", r"^[^ ]+ ", "")))


def is_noise(key: Column) -> Column:
    return ~F.length(key).between(*CHARS) | (F.length(F.regexp_replace(key, "[^a-z]", "")) < 3) | key.rlike(NO_LABEL)


def discovered(texts: DataFrame, known: DataFrame, least: int = 2, hint: bool = False) -> DataFrame:
    """Labels that stand before values at least so often and that no catalogue (known: name) has: key, n, texts, and a value of the first
    and of the last text. A label is left out if a longer one by a word before it stands wherever it stands. hint: only labels with a
    word of metrics. Repeated rows count each time; ids that are equal are one text."""
    by_text = grams(texts).groupBy("key", "shorter", "id").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    c = by_text.groupBy("key", "shorter").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min(F.struct("id", "low")).alias("first"), F.max(F.struct("id", "high")).alias("last"))
    c = stored(c.filter(F.col("n") >= least), "labels")
    longer = c.filter("shorter IS NOT NULL").groupBy(F.col("shorter").alias("key")).agg(F.max("n").alias("most"))
    out = c.join(longer, "key", "left").filter(F.col("most").isNull() | (F.col("most") < F.col("n"))).filter(~is_noise(F.col("key")))
    out = out.filter(metric_like(F.col("key"))) if hint else out
    out = out.join(known.select(F.lower(F.trim("name")).alias("key")).distinct(), "key", "left_anti")
    return out.select("key", "n", "texts", F.col("first.low").alias("first_value"), F.col("last.high").alias("last_value"))
