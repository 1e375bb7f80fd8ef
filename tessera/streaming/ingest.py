"""Extension: continuous ingestion, a sync for each micro-batch of new files.

The reference behaviour is batch sync; here a stream of documents is turned into such
syncs, each over its batch's documents alone.  The change plan does work for new and
changed ones only, so replaying a batch after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.snapshot import SnapshotStore
from tessera.plans.sync import SyncEngine
from tessera.sources.connectors import TableConnector


def stream_sync(documents: DataFrame, store: SnapshotStore, corpus: str, checkpoint: str, parser: str = "markdown", embedder: object | None = None, once: bool = True, order: str | None = None) -> StreamingQuery:
    """Syncs a stream (uri, content) into a corpus; with ``once`` what is there now, then stops.

    Of a batch's rows of one uri that with the greatest ``order`` counts, without it the
    greatest content, so that a replay decides alike.
    """

    def batch(rows: DataFrame, number: int) -> None:
        newest = rows.groupBy("uri").agg(F.max_by("content", F.struct(*([order] if order else []), "content")).alias("content"))
        report = SyncEngine(store, corpus, TableConnector(newest, "uri", "content"), parser, embedder=embedder, whole=False).sync()
        if report.status == "failed":
            raise RuntimeError("; ".join(report.errors))

    writer = documents.select("uri", "content", *([order] if order else [])).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
