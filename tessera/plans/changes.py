"""Change planning: a snapshot diff between what is scanned and what is active."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNCHANGED, NEW, CHANGED, DELETED, INCOMPATIBLE = "unchanged", "new", "changed", "deleted", "incompatible"
WORK = (NEW, CHANGED, DELETED, INCOMPATIBLE)


def plan_changes(scanned: DataFrame, pointers: DataFrame, revisions: DataFrame, fingerprint: str, failed: DataFrame | None = None) -> DataFrame:
    """(canonical_uri, change, content_hash, pipeline_fingerprint, active_revision_id), one row a source.

    ``scanned`` has canonical_uri and content_hash, ``pointers`` canonical_uri and
    revision_id, ``revisions`` revision_id, content_hash and pipeline_fingerprint.  A
    pointer without its revision counts as none; another fingerprint outweighs another
    content.  Sources in ``failed`` (canonical_uri) could not be fetched: they are neither
    classified nor deleted.
    """
    known = revisions.select("revision_id", F.col("content_hash").alias("old_hash"), F.col("pipeline_fingerprint").alias("old_fp"))
    active = pointers.select("canonical_uri", "revision_id").join(known, "revision_id", "left")
    now = scanned.select("canonical_uri", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.lit(True).alias("listed"))
    both = now.join(active, "canonical_uri", "full_outer")
    if failed is not None:
        both = both.join(failed.select("canonical_uri"), "canonical_uri", "left_anti")
    change = (
        F.when(F.col("listed").isNull(), DELETED).when(F.col("old_fp").isNull(), NEW).when(F.col("old_fp") != fingerprint, INCOMPATIBLE)
        .when(F.col("old_hash") != F.col("content_hash"), CHANGED).otherwise(UNCHANGED)
    )
    return both.select("canonical_uri", change.alias("change"), F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.lit(fingerprint).alias("pipeline_fingerprint"), F.coalesce("revision_id", F.lit("")).alias("active_revision_id"))


def change_counts(plan: DataFrame) -> DataFrame:
    """One row: a count per kind, total_scanned with deletions, total_changed, needs_work."""
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(c) for c in (UNCHANGED, NEW, CHANGED, DELETED, INCOMPATIBLE)]
    row = plan.agg(*counts, F.count(F.lit(1)).alias("total_scanned"))
    changed = sum((F.col(c) for c in WORK[1:]), F.col(NEW))
    return row.withColumn("total_changed", changed).withColumn("needs_work", changed > 0)


def corpus_fingerprint(pointers: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row (fingerprint) over the active revisions in the order of their ids; '' without any."""
    rows = pointers.select("revision_id").join(revisions, "revision_id").select("revision_id", F.concat_ws(":", "revision_id", "content_hash", "pipeline_fingerprint").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = hashlib.sha256(), False
        for batch in batches:
            for line in batch.column("line").to_pylist():
                state.update((f"|{line}" if some else line).encode())
                some = True
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()[:32] if some else ""])], names=["fingerprint"])

    # one digest of all lines in order: a single task sorts, which spills, and streams narrow rows
    return rows.repartition(1).sortWithinPartitions("revision_id").select("line").mapInArrow(run, "fingerprint string")


def active_uris(pointers: DataFrame) -> DataFrame:
    return pointers.select("canonical_uri").orderBy("canonical_uri")


def validate_revisions(chunks: DataFrame, embeddings: DataFrame | None, expected: DataFrame, fingerprint: str, dimension: int | None = None) -> DataFrame:
    """(revision_id, chunk_count, errors, warnings) of staged revisions.

    ``expected`` has revision_id, expected_chunks and pipeline_fingerprint.  Errors: fewer
    chunks than expected, ids that repeat, links that leave the revision, another
    fingerprint, and with ``embeddings`` a chunk without one or one of another dimension.
    """
    per = chunks.groupBy("revision_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("chunk_id").alias("distinct_ids"))
    links = chunks.select("revision_id", F.explode(F.array("prev_chunk_id", "next_chunk_id")).alias("chunk_id")).filter("chunk_id IS NOT NULL")
    loose = links.join(chunks.select("revision_id", "chunk_id"), ["revision_id", "chunk_id"], "left_anti").groupBy("revision_id").agg(F.count(F.lit(1)).alias("loose"))
    rows = expected.join(per, "revision_id", "left").join(loose, "revision_id", "left").fillna(0, ["chunk_count", "distinct_ids", "loose"])
    checks = [
        (F.col("chunk_count") < F.col("expected_chunks"), "fewer chunks than expected"),
        (F.col("distinct_ids") < F.col("chunk_count"), "chunk ids repeat"),
        (F.col("loose") > 0, "a link leaves the revision"),
        (F.col("pipeline_fingerprint") != fingerprint, "another fingerprint"),
    ]
    if embeddings is not None:
        right = F.count(F.when(F.size("vector") == F.coalesce(F.lit(dimension), F.col("dimension")), 1))
        have = embeddings.groupBy("revision_id").agg(F.countDistinct("chunk_id").alias("embedded"), right.alias("right_size"), F.count(F.lit(1)).alias("vectors"))
        rows = rows.join(have, "revision_id", "left").fillna(0, ["embedded", "right_size", "vectors"])
        checks += [(F.col("embedded") != F.col("distinct_ids"), "chunks and embeddings differ"), (F.col("right_size") != F.col("vectors"), "a vector of another dimension")]
    errors = F.filter(F.array(*[F.when(test, F.lit(said)) for test, said in checks]), lambda x: x.isNotNull())
    warnings = F.when(F.col("chunk_count") == 0, F.array(F.lit("no chunks"))).otherwise(F.array().cast("array<string>"))
    return rows.select("revision_id", "chunk_count", errors.alias("errors"), warnings.alias("warnings"))
