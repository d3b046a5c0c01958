"""From raw documents to token ids: quality classifier, line dedup, near duplicates, benchmark decontamination, BPE.

Every stage takes documents with any further columns, whatever their names, and all but the last give the same columns. An empty table
gives an empty table. Very long texts are read whole, rows with one doc_id are documents of their own, and a null doc_id stays null;
what becomes of null and blank texts, ties and repeated rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from loam.llm.common import table, written

#: Near duplicates: shingles of five words, a Jaccard similarity of 80 % or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps.

    A null or blank text scores quality 0 and goes. Equal rows have equal scores, so they go or stay together. Where a class has too few
    labels its target is not learnt, and no document with words goes for it."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three consecutive lines.

    The first occurrence is that in the smallest doc_id (null first), then the smallest place. Null texts stay null; rows equal in
    doc_id and text are treated alike."""
    return line_dedup.deduplicated(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Texts that are null or without words are no duplicates of anything and stay, as do rows without a doc_id. Rows that share a doc_id,
    repeated rows too, stay or go together."""
    return jaccard_join.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of the benchmark's items.

    Null and wordless texts stay as they are, as do all texts where the benchmark is empty."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of what they decode to.

    A null text has no ids and decodes to the empty string."""
    return bpe.encoded_digests(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and a trained vocabulary are not SQL.
ORACLE_SQL = None
