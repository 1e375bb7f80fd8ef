"""The corpus pipeline: quality, exact and near deduplication, mixing, tokens.

Each stage takes what its predecessor kept, written as Parquet and read again, and all
but the last return the columns of documents.  Mixing returns a document once a draw, and
the order that it puts the draws in is a column of the result.  Nulls, empty texts, ties and empty tables
have the results that the operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks, exact_dedup, mixing, near_dedup, pieces, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it is fitted on a bounded sample of the labels."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts, the lowest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the lowest doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, each once at least, shard by shard in their shuffled order."""
    return mixing.shuffled(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, exact, place): SentencePiece ids, whether decoding them gives the text back, and a
    number that rises in the order of the mix: the file that mixing wrote, which are numbered in the order of
    the shards, and the row in it.  Spark reads files in the order of their sizes, so the rows' own order is lost."""
    file, row = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), F.col("_metadata.row_index")
    return pieces.encoded(docs.withColumn("place", F.shiftleft(file, 40) + row), pieces.load(), "place")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: The classifier, the sketches and the mixing tree have no SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        docs = blocks.cut(made)
        if before is not None:
            blocks.drop(before)
        before = docs
    return docs
