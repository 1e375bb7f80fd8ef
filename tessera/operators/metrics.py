"""Extension: retrieval metrics over ranked hits and relevant documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, reciprocal_rank, ndcg) at k of hits (query_id, doc, rank) against relevant (query_id, doc)."""
    truth = relevant.select("query_id", "doc").distinct()
    found = hits.filter(F.col("rank") <= k).join(truth, ["query_id", "doc"], "left_semi")
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("doc"))
    ideal = truth.withColumn("r", place).groupBy("query_id").agg(F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("r") <= k, 1 / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("best"))
    both = ideal.join(got, "query_id", "left")
    zero = F.lit(0.0)
    return both.select("query_id", F.coalesce(F.col("n") / F.col("all"), zero).alias("recall"), F.coalesce(1 / F.col("first"), zero).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / F.col("best"), zero).alias("ndcg"))
