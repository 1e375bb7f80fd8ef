"""Versioned storage: immutable Parquet snapshots and one manifest that names the live one.

A sync writes a new snapshot beside the old ones and then replaces the manifest, which
is the promotion; readers keep the snapshot that they opened.  A crash before that
leaves an orphan folder and the old snapshot live.  One writer at a time is assumed.
Chunks, embeddings and postings lie in segments, one a sync, which snapshots share: a
snapshot lists its segments and the revisions in them that are dead, so that a sync
writes what changed and nothing else.  ``compact`` merges segments without the dead.
The manifest is read and replaced through Hadoop's file system, so that the store can
lie wherever the cluster's tables do.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import StoreError
from tessera.operators.shared import shared_folder, written
from tessera.operators.sparse import POSTINGS

SCHEMA_VERSION = 2
TABLES = {
    "sources": "source_id string, corpus_id string, canonical_uri string, media_type string, title string",
    "revisions": "revision_id string, source_id string, corpus_id string, canonical_uri string, content_hash string, pipeline_fingerprint string, byte_size bigint, fetched_at_iso string",
    "pointers": "corpus_id string, canonical_uri string, revision_id string, promoted_at string",
    "chunks": "chunk_id string, corpus_id string, source_id string, canonical_uri string, revision_id string, section_id string, text string, ordinal int, parent_locator string, heading string, kind string, token_count int, prev_chunk_id string, next_chunk_id string",
    "embeddings": "chunk_id string, corpus_id string, revision_id string, model_name string, dimension int, similarity string, vector array<float>",
    "postings": POSTINGS,
    "stats": "n_docs bigint, total bigint",
    "dead": "segment string, revision_id string",
}
SEGMENTED = ("chunks", "embeddings", "postings")
RUNS = "build_run_id string, corpus_id string, pipeline_fingerprint string, status string, started_at string, finished_at string, seq bigint, errors array<string>"


def now_iso() -> str:
    return datetime.now(UTC).isoformat()


class Files:
    """Small files through Hadoop's file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Writes beside the file and renames over it."""
        p, fs = self._at(path)
        side = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(side, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(fs.makeQualified(side), fs.makeQualified(p), options)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def list(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class SnapshotStore:
    """The tables of all corpora under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    @property
    def _manifest(self) -> str:
        return f"{self.root}/MANIFEST.json"

    def current(self) -> str | None:
        """Name of the live snapshot."""
        return json.loads(self.files.read(self._manifest))["live"] if self.files.exists(self._manifest) else None

    def schema_version(self) -> int:
        return json.loads(self.files.read(self._manifest))["schema"] if self.files.exists(self._manifest) else SCHEMA_VERSION

    def segments(self, snapshot: str | None = None) -> list[str]:
        """The segments of a snapshot, the live one by default."""
        at = snapshot or self.current()
        path = f"{self.root}/{at}/SEGMENTS.json"
        return json.loads(self.files.read(path)) if at and self.files.exists(path) else []

    def segment(self, name: str, segment: str) -> DataFrame:
        """A segment's rows of a table, dead ones too."""
        return self._read(name, [segment]).drop("segment")

    def _read(self, name: str, segments: list[str]) -> DataFrame:
        paths = [p for s in segments if self.files.exists(p := f"{self.root}/segments/{s}/{name}")]
        schema = f"{TABLES[name]}, segment string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table of a snapshot, the live one by default; empty before the first promotion."""
        if name not in TABLES:
            raise StoreError(f"no table {name!r}")
        at = snapshot or self.current()
        if name in SEGMENTED:
            return self._alive(name, at).drop("segment")
        if at is None or not self.files.exists(f"{self.root}/{at}/{name}"):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{at}/{name}")

    def _alive(self, name: str, snapshot: str | None) -> DataFrame:
        rows = self._read(name, self.segments(snapshot) if snapshot else [])
        if snapshot and self.files.exists(f"{self.root}/{snapshot}/dead"):
            # a join by names puts these first, and only snapshots with dead rows have it
            rows = rows.join(self.table("dead", snapshot), ["segment", "revision_id"], "left_anti").select(*rows.columns)
        return rows

    def begin(self) -> str:
        """Name for a new snapshot, which nobody reads yet."""
        return f"snap-{uuid.uuid4().hex[:12]}"

    def stage(self, snapshot: str, name: str, rows: DataFrame) -> DataFrame:
        """Writes a table of a snapshot that isn't live, for segmented tables its own segment, and reads it back."""
        if snapshot == self.current():
            raise StoreError("a live snapshot can't be written")
        return self._write(snapshot, name, rows)

    def _write(self, snapshot: str, name: str, rows: DataFrame) -> DataFrame:
        columns = [F.col(c.split()[0]).cast(c.split(None, 1)[1]) for c in TABLES[name].split(", ")]
        if name in SEGMENTED:
            rows.select(*columns, F.lit(snapshot).alias("segment")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/segments/{snapshot}/{name}")
            return self.segment(name, snapshot)
        rows.select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{snapshot}/{name}")
        return self.table(name, snapshot)

    def inherit(self, snapshot: str, gone: DataFrame) -> None:
        """Gives a staged snapshot the live one's segments and its own; revisions of ``gone`` are dead in the old ones."""
        live = self.current()
        old = self.segments(live) if live else []
        dead = self.table("dead", live) if live else self.table("dead", snapshot)
        more = self._alive("chunks", live).select("segment", "revision_id").join(gone.select("revision_id"), "revision_id", "left_semi").distinct().select("segment", "revision_id")
        self.stage(snapshot, "dead", dead.unionByName(more))
        self.files.replace(f"{self.root}/{snapshot}/SEGMENTS.json", json.dumps([*old, snapshot]))

    def compact(self) -> str | None:
        """Promotes a snapshot equal to the live one with a single segment; readers of old ones keep theirs."""
        live = self.current()
        if live is None or len(self.segments()) < 2:
            return live
        snapshot = self.begin()
        for name in TABLES:
            if name in SEGMENTED:
                self._write(snapshot, name, self.table(name))
            elif name != "dead":
                self._write(snapshot, name, self.table(name))
        self.files.replace(f"{self.root}/{snapshot}/SEGMENTS.json", json.dumps([snapshot]))
        self.promote(snapshot)
        return snapshot

    def promote(self, snapshot: str) -> str | None:
        """Makes a staged snapshot the live one; returns the one before."""
        missing = [t for t in ("sources", "revisions", "pointers", "SEGMENTS.json") if not self.files.exists(f"{self.root}/{snapshot}/{t}")]
        if missing:
            raise StoreError(f"{snapshot} lacks {', '.join(missing)}")
        before = self.current()
        self.files.replace(self._manifest, json.dumps({"live": snapshot, "schema": SCHEMA_VERSION, "promoted_at": now_iso(), "previous": before}))
        return before

    def rollback(self, snapshot: str) -> None:
        """Deletes a staged snapshot; the live one can't be deleted."""
        if snapshot == self.current():
            raise StoreError("the live snapshot can't be rolled back")
        self.files.delete(f"{self.root}/{snapshot}")
        self.files.delete(f"{self.root}/segments/{snapshot}")

    def expire(self, keep: int = 1) -> list[str]:
        """Extension: deletes all but the live snapshot and the ``keep`` - 1 before it, and segments that none lists."""
        live = self.current()
        chain, at = [], live
        while at and len(chain) < keep:
            chain.append(at)
            at = json.loads(self.files.read(self._manifest)).get("previous") if at == live else None
        gone = [n for n in self.files.list(self.root) if n.startswith("snap-") and n not in chain]
        used = {s for c in chain for s in self.segments(c)}
        for n in gone:
            self.files.delete(f"{self.root}/{n}")
        for n in self.files.list(f"{self.root}/segments"):
            if n not in used:
                self.files.delete(f"{self.root}/segments/{n}")
        return gone

    # point reads, each one filter over the live snapshot

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return self.table("chunks").filter(F.col("chunk_id") == chunk_id)

    def get_embedding(self, chunk_id: str) -> DataFrame:
        return self.table("embeddings").filter(F.col("chunk_id") == chunk_id)

    def active_revision(self, corpus: str, uri: str) -> str | None:
        row = self.table("pointers").filter((F.col("corpus_id") == corpus) & (F.col("canonical_uri") == uri)).select("revision_id").first()
        return row[0] if row else None

    def source_info(self, source_ids: DataFrame) -> DataFrame:
        """(source_id, canonical_uri, title), empty strings where a source isn't known."""
        found = source_ids.select("source_id").distinct().join(self.table("sources"), "source_id", "left")
        return found.select("source_id", F.coalesce("canonical_uri", F.lit("")).alias("canonical_uri"), F.coalesce("title", F.lit("")).alias("title"))

    def revision_hashes(self, corpus: str) -> DataFrame:
        """(canonical_uri, revision_id, content_hash, pipeline_fingerprint) of a corpus's active revisions."""
        mine = self.table("pointers").filter(F.col("corpus_id") == corpus).select("canonical_uri", "revision_id")
        return mine.join(self.table("revisions").select("revision_id", "content_hash", "pipeline_fingerprint"), "revision_id").select("canonical_uri", "revision_id", "content_hash", "pipeline_fingerprint")

    def staged(self, snapshot: str, name: str, revision_id: str) -> DataFrame:
        """Chunks or embeddings of a revision in a snapshot that isn't live yet."""
        return self.segment(name, snapshot).filter(F.col("revision_id") == revision_id)

    def count_active_chunks(self, corpus: str) -> int:
        return self.table("chunks").filter(F.col("corpus_id") == corpus).count()

    # build runs are an append-only log beside the snapshots

    def log_run(self, run: dict) -> None:
        self.spark.createDataFrame([tuple(run[c.split()[0]] for c in RUNS.split(", "))], RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/build_runs")

    def runs(self) -> DataFrame:
        if not self.files.exists(f"{self.root}/build_runs"):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/build_runs")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest state of the latest run of each corpus, by started_at, then sequence."""
    from pyspark.sql import Window

    order = Window.partitionBy("corpus_id").orderBy(F.col("started_at").desc(), F.col("seq").desc())
    return runs.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def upsert(rows: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``rows`` with those of ``new`` in place of rows of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``rows`` without the keys; keys that aren't there do nothing."""
    return rows.join(keys.select(key), key, "left_anti")


__all__ = ["SCHEMA_VERSION", "TABLES", "Files", "SnapshotStore", "delete", "latest_runs", "now_iso", "shared_folder", "upsert", "written"]
