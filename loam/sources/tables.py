"""Readers and writers, and tables that tolerate absent columns."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loam-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def col_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a typed null where the table has no such column."""
    return F.col(f"`{name}`").cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def conformed(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of schema (name -> type), in its order; those that df lacks are null."""
    return df.select(*[col_or_null(df, n, t) for n, t in schema.items()])


def empty_to_null(df: DataFrame, *names: str) -> DataFrame:
    """Blank strings become null, once, when a table is loaded."""
    return df.withColumns({n: F.when(F.trim(n) != "", F.col(n)) for n in names})


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON files of a tree, each of a record over many lines; a malformed one is a row of nulls with its text in _corrupt_record."""
    reader = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "PERMISSIVE")
    rows = (reader.schema(f"{schema}, _corrupt_record string") if schema else reader).json(path)
    return rows.select(*[c for c in rows.columns if c != "_corrupt_record"], col_or_null(rows, "_corrupt_record", "string"), F.input_file_name().alias("source_path"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each text file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row for each file with its SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("sha256", F.sha2("content", 256))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def export(datasets: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON files for each data set."""
    for name, df in datasets.items():
        write_json(df, f"{path}/{name}")


def copy_tables(tables: dict[str, DataFrame], parents: dict[str, list[tuple[str, str, str]]], path: str) -> None:
    """Writes every table; rows whose (column, parent table, parent column) has no parent stay behind. A null key is no orphan."""
    for name, df in tables.items():
        for column, parent, key in parents.get(name, []):
            ids = tables[parent].select(F.col(key).alias("__parent")).distinct()
            df = df.filter(F.col(column).isNull()).unionByName(df.join(ids, F.col(column) == F.col("__parent"), "left_semi"))
        df.write.mode("overwrite").parquet(f"{path}/{name}")
