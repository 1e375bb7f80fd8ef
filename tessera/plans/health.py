"""States of corpora, derived from pointers, revisions and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.snapshot import latest_runs


def corpus_health(corpora: DataFrame, runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """(corpus_id, health): building, ready, failed or empty, in that order of precedence."""
    last = latest_runs(runs).select("corpus_id", "status")
    active = pointers.select("corpus_id", F.lit(True).alias("active")).distinct()
    rows = corpora.select("corpus_id").join(last, "corpus_id", "left").join(active, "corpus_id", "left")
    health = F.when(F.col("status") == "running", "building").when(F.col("active"), "ready").when(F.col("status") == "failed", "failed").otherwise("empty")
    return rows.select("corpus_id", health.alias("health"))


def collection_state(collections: DataFrame, jobs: DataFrame, revisions: DataFrame) -> DataFrame:
    """(collection_name, state): a running job, else a live revision, else how the last completed job ended."""
    job = jobs.groupBy("collection_name").agg(
        F.max(F.when(F.col("state") == "running", 1).otherwise(0)).alias("running"),
        F.max_by(F.when(F.col("finished_at").isNotNull(), F.col("state")), F.struct("finished_at", "job_id")).alias("last"),
    )
    live = revisions.filter("status = 'live'").select("collection_name", F.lit(1).alias("live")).distinct()
    rows = collections.join(job, "collection_name", "left").join(live, "collection_name", "left")
    state = F.when(F.col("running") == 1, "building").when(F.col("live") == 1, "ready").when(F.col("last") == "failed", "failed").otherwise("empty")
    return rows.select("collection_name", state.alias("state"))
