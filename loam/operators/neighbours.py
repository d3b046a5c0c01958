"""Pairs that take their name from another box: lone values and countries get the title that describes them.

A title is looked for within six boxes of the page before and after, by score, and then on the whole page. One window over the boxes of
each page finds both, so boxes are never joined with boxes; a row of it sees 13 boxes at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, plain, plain_tokens
from .boxes import BOX, PAGE, blended, boxes, candidate, category, clean_name, in_lines, is_country, is_descriptor, is_label, is_metric_like, is_sentence, is_table, is_value, ladder, line_candidates, line_rows, lines_of, name_score, name_support, pair_score, table_cells
from .extract import NUMBER, parsed_number, unit_of
from .facts import first_by
from .trees import stored

#: Fixed: what speaks for a title and against it, how near it must be, and what it must reach.
WITHIN, LEAST, NEAR, A_BOX = 6, 0.15, 0.24, 0.03
METRIC_LIKE, NOT_METRIC_LIKE, LEADS, FEW_WORDS, ONE_SHORT_WORD, SENTENCE, DIMENSION, COLON = 0.38, -0.04, 0.16, 0.12, -0.35, -0.30, -0.22, -0.08
LEADING = ["avg", "average", "total", "cost", "cpa", "cpe", "ctr", "vtr", "reach", "impression", "impressions", "duration", "frequency", "install", "installs", "launch", "launches", "growth", "lift"]
DIMENSIONS = ["audience", "exposed", "market", "markets", "country", "countries", "segment", "group"]


def is_source(text: Column) -> Column:
    return F.lower(F.trim(text)).startswith("source:")


def title_of(text: Column) -> Column:
    """The first line up to "by", without dashes around it."""
    return F.btrim(F.get(F.split(F.substring_index(F.trim(text), "\n", 1), r"(?i)\s+by\s+(?=\S)", 2), F.lit(0)), F.lit(" -"))


def title_weight(title: Column) -> Column:
    """What a title is worth before its distance."""
    like, words, n = is_metric_like(title), F.size(plain_tokens(title)), F.length(title)
    size = F.when(words > 8, -ladder(words, [(12, 0.22), (8, 0.08)])).when(words.between(2, 6), FEW_WORDS).when((words == 1) & (n <= 6), ONE_SHORT_WORD).otherwise(0.0)
    out = F.when(like, METRIC_LIKE).otherwise(NOT_METRIC_LIKE) + F.when(F.lower(F.regexp_extract(title, r"^\w+", 0)).isin(LEADING), LEADS).otherwise(0.0) + size
    out = out - ladder(n, [(85, 0.32), (65, 0.22), (45, 0.08)]) + F.when(is_sentence(title), SENTENCE).otherwise(0.0)
    dimension = F.arrays_overlap(plain_tokens(title), F.array(*map(F.lit, DIMENSIONS)))
    return out + F.when(~like & dimension, DIMENSION).otherwise(0.0) + F.when(~like & title.contains(":"), COLON).otherwise(0.0)


def described(bx: DataFrame) -> DataFrame:
    """Boxes with described_by: the best title near by (ties: the nearer, then the earlier), else the best of the page (ties: the
    earlier), else null. Tables and sources are no titles; a box doesn't describe itself, unless as the best of its page."""
    t = F.col("text")
    rows = bx.withColumn("__title", F.when(~is_table(t) & ~is_source(t) & is_descriptor(t), title_of(t)))
    rows = rows.withColumn("__t", F.when(F.col("__title") != "", F.struct("idx", F.col("__title").alias("title"), title_weight(F.col("__title")).alias("weight")))).drop("__title")
    w = W.partitionBy(*PAGE)
    rows = rows.withColumn("__near", F.collect_list("__t").over(w.orderBy("idx").rangeBetween(-WITHIN, WITHIN)))
    rows = rows.withColumn("__page", F.max(F.struct(F.round(F.col("__t.weight") + NEAR, 6).alias("score"), (-F.col("__t.idx")).alias("early"), F.col("__t.title").alias("title"))).over(w))
    apart = lambda x: F.abs(x["idx"] - F.col("idx"))
    scored = F.transform(F.filter("__near", lambda x: x["idx"] != F.col("idx")), lambda x: F.struct(F.round(x["weight"] + F.greatest(F.lit(0.0), NEAR - A_BOX * apart(x)), 6).alias("score"), (-apart(x)).alias("near"), (-x["idx"]).alias("early"), x["title"].alias("title")))
    rows = rows.withColumn("__best", F.array_max(scored))
    chosen = F.when(F.col("__best.score") >= LEAST, F.col("__best.title")).when(F.col("__page.score") >= LEAST, F.col("__page.title"))
    return rows.withColumn("described_by", chosen).drop("__t", "__near", "__page", "__best")


def partial_candidate() -> Column:
    """`name: words value words`: the first value in what follows, where that is not a value as a whole."""
    line = F.col("line")

    def pair(side: Column) -> Column:
        name, rest = F.trim(F.get(side, F.lit(0))), F.trim(F.get(side, F.lit(1)))
        raw = let(F.regexp_extract(rest, rf"(?<![A-Za-z\d.,]){NUMBER}\+?", 0), lambda x: candidate((x != "") & ~is_value(rest), name, x, "inline_partial"))
        return F.when((F.size(side) == 2) & F.length(name).between(2, 120), raw)

    # most lines have no separator
    return F.when(F.contains(line, F.lit(":")) | F.contains(line, F.lit("-")), let(F.split(line, r"\s*:\s*|\s+-\s+", 2), pair))


def narrow_table(text: Column) -> Column:
    """The pairs (struct(n, pair)) of a table of two columns: a value beside a name (table_pipe), and a row that is one value above a
    row that is one name (table_stacked). Other tables give none."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c))), lambda r: F.size(r) > 1)
    one = lambda r: let(F.filter(r, lambda c: c != ""), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
    found = lambda when, name, raw, pattern: candidate(when & ~is_value(name) & is_label(name), name, raw, pattern)

    def of_row(t: Column, r: Column, i: Column) -> Column:
        a, b, alone, below = F.get(r, F.lit(0)), F.get(r, F.lit(1)), one(r), one(F.get(t, i + 1))
        every = F.array(found(is_value(a), b, a, "table_pipe"), found(is_value(b), a, b, "table_pipe"), found(is_value(alone), below, alone, "table_stacked"))
        return F.transform(F.array_compact(every), lambda p: F.struct(i.alias("n"), p.alias("pair")))

    return let(rows, lambda t: F.when(~F.exists(t, lambda r: F.size(r) > 2), F.flatten(F.transform(t, lambda r, i: of_row(t, r, i)))))


def is_lone(text: Column) -> Column:
    return is_value(F.trim(text)) & ~F.contains(F.trim(text), F.lit("\n"))


def with_pairs(bx: DataFrame, cells: bool = False) -> DataFrame:
    """Boxes' pairs in one pass over the described boxes of each page, which stay where one shuffle has put them: those of lines, of
    tables of two columns and of lone values (boxes that are one value and nothing else, under the title that describes them:
    cross_box), none twice in a box. With cells those of all tables' cells as well, each with its series and its place, cell (else
    null). Boxes of sources give no pairs, nor do null texts."""
    d = described(bx)
    d = d.filter(~is_source(F.col("text"))).withColumn("kind", F.when(is_table(F.col("text")), "table").when(is_lone(F.col("text")), "lone").otherwise("lines"))
    d = d.withColumn("units", F.when(F.col("kind") == "lines", lines_of(F.col("text"))).otherwise(F.array("text")))
    rows = in_lines(line_rows(d, "kind", "described_by"))
    of = lambda n, pair, cell, series: F.struct(n.alias("n"), pair.alias("pair"), cell.cast("int").alias("cell"), series.cast("string").alias("series"))
    none = F.lit(None)
    in_line = F.transform(F.array_compact(F.array(*line_candidates(), partial_candidate())), lambda p: of(F.col("n"), p, none, none))
    lone = F.array(of(F.lit(0), F.struct(clean_name(F.col("described_by")).alias("name"), F.trim("line").alias("raw"), F.lit("cross_box").alias("pattern")), none, none))
    table = F.transform(F.coalesce(narrow_table(F.col("line")), F.array()), lambda x: of(x["n"], x["pair"], none, none))
    if cells:
        own = F.transform(table_cells(F.col("line")), lambda c, i: of(F.lit(0), F.struct(c["name"].alias("name"), c["raw"].alias("raw"), c["pattern"].alias("pattern")), i, c["series"]))
        table = F.concat(table, own)
    every = F.when(F.col("kind") == "lines", in_line).when(F.col("kind") == "table", table).when(F.col("described_by").isNotNull(), lone)
    found = rows.select(*BOX, "kind", "described_by", F.explode(every).alias("x")).select(*BOX, "kind", "described_by", "x.n", "x.pair.*", "x.cell", "x.series")
    found = found.filter((F.col("kind") != "lines") | is_label(F.col("name"))).withColumn("__k", F.lower("name"))
    first = first_by(found, [*BOX, "__k", "raw", "cell"], ["n", "pattern", "name"])
    swap = F.col("cell").isNull() & is_country(F.col("name")) & F.col("described_by").isNotNull()
    rows = first.withColumn("swap", swap)
    return rows.select(*BOX, "n", F.when(F.col("swap"), clean_name(F.col("described_by"))).otherwise(F.col("name")).alias("name"), "raw", "pattern", F.when(F.col("swap"), F.col("name")).otherwise(F.col("series")).alias("country"), "cell")


def all_pairs(bx: DataFrame) -> DataFrame:
    """Pairs of lines, of tables of two columns and of lone values, none twice in a box; where a name is a country, the title that
    describes its box takes its place and the country stands in `country`. Boxes of sources give none."""
    return with_pairs(bx).drop("cell")


#: Kinds of pairs (a name with its pattern and unit) that are broadcast at most; more are joined by a shuffle.
FEW = 100_000


def extracted(decks: DataFrame) -> DataFrame:
    """Metric records of box texts and tables: names, values, units, categories, contexts and confidences; below 0.65 they are for
    review. What follows from name, pattern, unit and country alone is computed once for all pairs that share them, and a name that
    most pairs have is joined by broadcast, so no task gets all its rows."""
    every = with_pairs(boxes(decks), cells=True).withColumnRenamed("country", "series")
    abroad = F.when(F.col("series").isNotNull(), is_country(F.col("series"))).otherwise(False)
    every = stored(every.select("deck_id", "page", "name", "raw", parsed_number(F.col("raw")).alias("value"), F.coalesce(unit_of(F.col("raw")), F.lit("")).alias("unit"), "series", "pattern", abroad.alias("abroad")), "pairs")
    kind = ["name", "pattern", "unit", "abroad"]
    kinds = stored(every.groupBy(*kind).agg(F.count("*").alias("n")), "kinds")
    support = name_support(kinds.select("name", "n")).withColumnRenamed("name", "__name")
    rows = kinds.drop("n").join(support.withColumnRenamed("n", "occurrences"), plain(F.col("name")) == F.col("__name"), "left")
    p, s = pair_score(F.col("pattern"), F.col("name"), F.col("unit"), F.col("abroad")), name_score(F.col("name"), F.col("occurrences"), F.col("support"))
    scored = stored(rows.select(*kind, category(F.col("name")).alias("category"), F.round(blended(p, s, F.col("name")), 6).alias("confidence")), "scored")
    if scored.limit(FEW + 1).count() <= FEW:
        scored = F.broadcast(scored)
    return every.join(scored, kind).select("deck_id", "page", "name", "raw", "value", F.when(F.col("unit") != "", F.col("unit")).alias("unit"), "category", "series", "pattern", "confidence", (F.col("confidence") < 0.65).alias("review"))
