"""Text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def plain(text: Column) -> Column:
    """ASCII letters and digits in lower case, anything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def plain_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain(text), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def window_around(text: Column, start: Column, end: Column, width: int) -> Column:
    """The text from width characters before start (from 0) to width after end, trimmed."""
    low = F.greatest(start - width, F.lit(0))
    return F.trim(F.substring(text, low + 1, end + width - low))


def chunked(df, size: int = 1500, step: int = 1300, text: str = "text"):
    """A row for each piece of at most size characters, a step apart; none begins where the one before has reached the end."""
    n = F.length(text)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + (size - step) < n)))
    out = df.select("*", F.posexplode(starts).alias("chunk_index", "start"))
    return out.select("*", F.least(F.col("start") + size, n).alias("end"), F.expr(f"substring({text}, start + 1, {size})").alias("chunk"))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def without_note(name: Column, opening: str, closing: str) -> Column:
    """A name without the bracketed number at its end, if there is one."""

    def cut(x: Column) -> Column:
        last = F.substring_index(x, opening, -1)
        note = F.endswith(x, F.lit(closing)) & F.contains(x, F.lit(opening)) & F.rtrim(last, F.lit(closing)).rlike("^[0-9]+$")
        return F.when(note, F.rtrim(F.substring(x, F.lit(1), F.length(x) - F.length(last) - 1))).otherwise(x)

    return let(name, cut)


def without_marks(name: Column) -> Column:
    """A name with white space collapsed, without stars, daggers, or a bracketed number after it, and without punctuation at its end."""
    out = F.rtrim(squeezed(F.coalesce(name, F.lit(""))), F.lit("*†‡ "))
    return F.rtrim(without_note(without_note(out, "[", "]"), "(", ")"), F.lit(" :;,.|/-"))


def label_before_value(text: Column, least: int = 2, most: int = 120) -> Column:
    """What stands before the first colon or equals sign of a text, if a number (or an amount) stands after it; else null."""


    def label(parts: Column) -> Column:
        value = F.ltrim(F.get(parts, F.lit(1)), F.lit(" \t$+-"))
        return let(F.trim(parts[0]), lambda x: F.when(value.rlike("^[0-9]") & F.length(x).between(least, most), x))

    return let(F.split(text, "[:=]", 2), label)
