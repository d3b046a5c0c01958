"""Operator 2, line dedup, in DataFrame functions only: overlapping windows of three lines, hashed, counted over all documents, and
later occurrences removed by merging the positions they cover.

Lines are what line feeds separate. A window is three consecutive lines of one row; of the places where a window occurs, the first by
(doc_id, line) stays and every line of each later place is removed. Windows are judged on the input.

Every row is a document of its own: rows that share a doc_id but not a text are told apart by a hash of the text, which also decides
which of their places at one line comes first.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; a text of fewer than three lines has no
window; a very long text is an array of hashes in one row, 16 bytes for each of its lines; rows equal in doc_id and text count as one
place and are treated alike; a null doc_id sorts before all others; an empty table gives no rows; extra columns, whatever their names,
are ignored by `marked` and kept by `deduplicated`.

Windows travel as two 64-bit hashes and a place; they are reduced per window before the shuffle, and only windows that repeat go into
the joins, the hot ones by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, join_hot, table, written

SIZE = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and row, a hash of the text."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("row"))


def windows(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, row, line (from 0) and two independent hashes of each window."""
    lines = rows.select("doc_id", "row", F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(x)).alias("a"), F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(F.lit("b"), x)).alias("b"))
    n = F.size("a")
    at = F.when(n >= size, F.sequence(F.lit(0), n - size))
    out = lines.select("doc_id", "row", "a", "b", F.explode(at).alias("line"))
    return out.select("doc_id", "row", "line", F.xxhash64(*[F.col("a")[F.col("line") + i] for i in range(size)]).alias("h1"), F.xxhash64(F.lit("b"), *[F.col("b")[F.col("line") + i] for i in range(size)]).alias("h2"))


def later(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, row and at: the ascending places at which windows occur that have occurred before."""
    w = windows(rows, size)
    place = F.struct("doc_id", "line", "row")
    first = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first", "n")
    out = join_hot(w, written(first, "repeated-lines"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return out.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("at"))


def kept(lines: Column, at: Column, size: int = SIZE) -> Column:
    """The lines outside [p, p + size) for all p of at (ascending): slices between the merged stretches."""
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + size))
    ends = F.concat(at, F.array(F.size(lines)))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["b"] > g["a"])
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def placed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (doc_id, row and more) with at."""
    places = later(rows, size)
    return rows.alias("d").join(places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.row") == F.col("p.row")), "left").select("d.*", "p.at")


def marked(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text, n_lines, kept (lines that stay) of each row."""
    lines = lines_of(F.col("text"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    stay = F.when(F.col("text").isNull(), F.expr("cast(array() as array<string>)")).when(F.col("at").isNull(), lines).otherwise(kept(lines, F.col("at"), size))
    return placed(keyed(documents), size).select("doc_id", "text", n.alias("n_lines"), stay.alias("kept"))


def deduplicated(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """documents, same columns, without the lines of later occurrences; n_chars, where there is one, follows a changed text."""
    own, names = apart(documents)
    rows = own.withColumnsRenamed({names["doc_id"]: "doc_id", names["text"]: "text"}).withColumn("row", F.xxhash64("text"))
    out = placed(rows, size)
    out = out.withColumn("text", F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(kept(lines_of(F.col("text")), F.col("at"), size), "\n")))
    if n := names.get("n_chars"):
        out = out.withColumn(n, F.when(F.col("at").isNull(), F.col(n)).otherwise(F.length("text").cast(dict(own.dtypes)[n])))
    return out.select(*[F.col({names["doc_id"]: "doc_id", names["text"]: "text"}.get(c, c)) for c in own.columns]).toDF(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marked(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (SELECT doc_id, i AS line, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS w
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY w ORDER BY doc_id, line) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM f WHERE k > 1),
e AS (SELECT doc_id, unnest(lines) AS x, unnest(range(1, len(lines) + 1)) AS line FROM l),
k AS (SELECT e.doc_id, string_agg(e.x, chr(10) ORDER BY e.line) FILTER (WHERE c.line IS NULL) AS kept,
             count(*) FILTER (WHERE c.line IS NOT NULL) AS n_removed
      FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.line = c.line GROUP BY e.doc_id)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
