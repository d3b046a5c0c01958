"""What data there is: schema, row counts, listings, coverage (families F01 to F08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_snapshot(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """object, position, column and type of each table or view."""
    rows = [(n, i, c, t) for n, df in tables.items() for i, (c, t) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "object string, position int, column string, type string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("object"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def counts_by(df: DataFrame, column: Column, default: str = "Unknown") -> DataFrame:
    """name and n, most first; null and blank names are one, called the default."""
    name = F.when(F.trim(column) != "", F.trim(column)).otherwise(default)
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def coverage(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count("*").alias("facts"), F.count_distinct("document_id").alias("documents"), F.count_distinct("slide_id").alias("slides"))


#: Fixed: the words that lead to each section.
TOPICS = {
    "access": ["access", "scope", "what data", "what can you access", "available data"],
    "schema": ["schema", "table", "tables", "view", "column", "database structure"],
    "documents": ["document", "documents", "deck", "decks", "ppt", "presentation", "file"],
    "clients": ["client", "clients", "advertiser", "advertisers"],
    "regions": ["region", "regions", "market", "markets", "country", "countries"],
    "periods": ["period", "quarter", "quarters", "fiscal", "fy", "h1", "h2"],
    "metrics": ["metric", "metrics", "kpi", "catalog", "aliases", "definition", "formula", "unit"],
    "coverage": ["coverage", "count", "how many", "inventory", "distribution"],
}


def topics(text: Column) -> Column:
    """The sections that a question is about; overview if there are none."""
    t = F.lower(text)
    hit = F.array_compact(F.array(*[F.when(F.greatest(*[t.contains(w) for w in words], F.lit(False)), name) for name, words in TOPICS.items()]))
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("overview")))
