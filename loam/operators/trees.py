"""Trees: JSON documents walked as VARIANT values, and rows that name their parents (D50, section trees).

A level of a tree is a table in the shared folder, so lineage stays short and the loop ends with the deepest level: no limit on depth
or rows, and no document is handled outside the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def containers(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, path, depth and value (VARIANT) of every object and array of a JSON text, the outermost first. A text that is no JSON, a
    null, and a plain value have none. Keys of objects stand in path as they are, places of arrays in brackets."""
    spark = df.sparkSession
    inner = lambda c: F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)")
    rows = df.select(*keep, F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(F.col(column)).alias("value"))
    level = stored(rows.filter(inner(F.col("value"))), "tree")
    out = level
    while level.limit(1).count():
        child = level.select(*keep, "path", "depth", F.col("value").alias("__v")).lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = stored(child.filter(inner(F.col("value"))).select(*keep, F.concat("path", step).alias("path"), (F.col("depth") + 1).alias("depth"), "value"), "tree")
        out = out.unionByName(level)
    return out


def column_letters(index: Column) -> Column:
    """A, B ... Z, AA ... of a column's number from 0, of any size (a 32-bit number has seven letters at most)."""
    out, first = F.lit(None).cast("string"), 0
    for n in range(1, 8):
        own = F.concat(*[F.chr(F.floor((index - first) / 26**k) % 26 + 65) for k in range(n - 1, -1, -1)])
        out = F.coalesce(out, F.when(index < first + 26**n, own))
        first += 26**n
    return F.when(index >= 0, out)


def a1(sheet: Column, start_row: Column, end_row: Column, start_column: Column, end_column: Column) -> Column:
    """A range of cells (from 0, ends excluded) in A1 notation; it holds one cell at least."""
    first = F.concat(column_letters(start_column), (start_row + 1).cast("string"))
    last = F.concat(column_letters(F.greatest(end_column - 1, start_column)), F.greatest(end_row, start_row + 1).cast("string"))
    return F.concat(F.lit("'"), F.replace(sheet, F.lit("'"), F.lit("''")), F.lit("'!"), first, F.lit(":"), last)


BOUNDS = ["startRowIndex", "endRowIndex", "startColumnIndex", "endColumnIndex"]


def grid_ranges(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, path, sheet_id, start_row, end_row, start_column and end_column of every grid range in a chart's JSON, at any depth: an
    object with a sheetId and one of the four bounds. An absent start is 0, an absent end is one after the start."""
    found = containers(df, column, *keep)
    number = lambda name: F.try_variant_get("value", f"$.{name}", "long")
    has = lambda name: F.variant_get("value", f"$.{name}", "variant").isNotNull()
    some = has(BOUNDS[0])
    for name in BOUNDS[1:]:
        some = some | has(name)
    ranges = found.filter(F.schema_of_variant("value").startswith("OBJECT") & has("sheetId") & some)
    start_row, start_column = F.coalesce(number(BOUNDS[0]), F.lit(0)), F.coalesce(number(BOUNDS[2]), F.lit(0))
    return ranges.select(*keep, "path", number("sheetId").alias("sheet_id"), start_row.alias("start_row"), F.coalesce(number(BOUNDS[1]), start_row + 1).alias("end_row"), start_column.alias("start_column"), F.coalesce(number(BOUNDS[3]), start_column + 1).alias("end_column"))


def ancestry(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root, depth (0 for a root) of rows that name their parents; a null parent, or one that isn't there, makes a root.

    Each round a node skips to the ancestor of its ancestor, so rounds grow with the logarithm of the depth. Nodes on or under a
    cycle have a null root and depth."""
    rows = nodes.select(F.col(node).alias("n"), F.col(parent).alias("p")).filter("n is not null").dropDuplicates(["n"])
    ids = rows.select(F.col("n").alias("known"))
    start = rows.join(ids, F.col("p") == F.col("known"), "left")
    now = stored(start.select("n", F.coalesce("known", "n").alias("up"), F.col("known").isNotNull().cast("long").alias("steps"), F.col("known").isNull().alias("done")), "ancestry")
    open_ = now.filter("not done").count()
    while open_:
        far = now.select(F.col("n").alias("a"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("done").alias("ends"))
        moved = now.filter("not done").join(far, F.col("up") == F.col("a")).select("n", F.col("far").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done"))
        now = stored(now.filter("done").unionByName(moved), "ancestry")
        left = now.filter("not done").count()
        if left == open_ and not now.filter("not done").join(now.filter("done").select(F.col("n").alias("a")), F.col("up") == F.col("a"), "left_semi").limit(1).count():
            break  # what is left meets no node that has ended: cycles
        open_ = left
    root = F.when(F.col("done"), F.col("up"))
    return now.select(F.col("n").alias(node), root.alias("root"), F.when(F.col("done"), F.col("steps")).alias("depth"))
