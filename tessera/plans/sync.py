"""Incremental sync: scan, plan, parse, chunk, embed, validate, promote.

Everything up to the promotion is DataFrames over the changed documents only; unchanged
documents are fetched, hashed and listed, and nothing else is done for them: chunks,
embeddings and postings of the changed ones are a segment of their own, and statistics
change by what came and went.  Documents that can't be fetched or parsed keep their old
rows, and the others go live together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as T
from tessera.operators import chunk, dense, enrich, parse, sparse
from tessera.plans import changes
from tessera.plans.progress import Stages
from tessera.plans.snapshot import SCHEMA_VERSION, SnapshotStore, now_iso
from tessera.sources.connectors import Connector

SUCCESS, PARTIAL, FAILED = "success", "partial", "failed"
SHOWN_ERRORS = 100


@dataclass(frozen=True)
class SyncReport:
    corpus_id: str
    build_run_id: str
    status: str
    sources_unchanged: int = 0
    sources_new: int = 0
    sources_changed: int = 0
    sources_deleted: int = 0
    chunks_added: int = 0
    chunks_deleted: int = 0
    errors: tuple[str, ...] = ()
    timings: tuple[tuple[str, float], ...] = ()


def status_of(needs_work: bool, changed: int, errors: int) -> str:
    if not errors:
        return SUCCESS
    if not needs_work:
        return PARTIAL
    return PARTIAL if changed > 0 else FAILED


@dataclass
class SyncEngine:
    store: SnapshotStore
    corpus: str
    connector: Connector
    parser: str | Callable = "markdown"
    chunker: dict = field(default_factory=lambda: {"max_tokens": chunk.MAX_TOKENS, "overlap": chunk.OVERLAP})
    embedder: object | None = None
    enricher: enrich.Enricher | None = None
    stemmed: bool = True
    #: whether sources that the connector doesn't list are deleted
    whole: bool = True
    compact_at: int = 64
    clock: Callable[[], str] = now_iso
    observer: Callable[[str, str, dict], None] | None = None

    @property
    def fingerprint(self) -> str:
        e = self.embedder
        return ids.pipeline_fingerprint(f"{self.parser if isinstance(self.parser, str) else getattr(self.parser, '__name__', 'custom')}-1", self.chunker, self.enricher.name if self.enricher else "", e.name if e else "", e.dimension if e else 0, SCHEMA_VERSION)

    def sync(self) -> SyncReport:
        spark, fp, stages = self.store.spark, self.fingerprint, Stages(self.observer)
        started = self.clock()
        run = {"build_run_id": ids.digest_text("build_run", self.corpus, fp, started), "corpus_id": self.corpus, "pipeline_fingerprint": fp, "status": "running", "started_at": started, "finished_at": None, "seq": 0, "errors": []}
        self.store.log_run(run)
        snapshot = self.store.begin()
        report: dict = {"corpus_id": self.corpus, "build_run_id": run["build_run_id"]}
        promoted = False
        try:
            with stages("scan"):
                raw = self._stage_raw(spark, snapshot)
            with stages("plan"):
                plan, counts = self._plan(raw, fp)
            errors = self._log_errors(run["build_run_id"], raw.filter("error IS NOT NULL").select("uri", "error"))
            if counts["needs_work"]:
                made = self._build(stages, snapshot, raw, plan, fp, run["build_run_id"])
                errors += made.pop("errors")
                promoted = made.pop("promoted")
                report |= made
            report |= {"sources_unchanged": counts["unchanged"], "sources_new": counts["new"], "sources_deleted": counts["deleted"]}
            report["status"] = status_of(counts["needs_work"], report.get("sources_changed", 0), len(errors))
        except Exception as e:  # noqa: BLE001  a sync reports its failure; the live snapshot stays
            errors = [f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"]
            report["status"] = FAILED
        finally:
            if promoted:
                self.store.files.delete(f"{self.store.root}/{snapshot}/_raw")
            else:
                self.store.rollback(snapshot)
        self.store.log_run(run | {"status": report["status"], "finished_at": self.clock(), "seq": 1, "errors": errors})
        return SyncReport(**report, errors=tuple(errors), timings=tuple(stages.timings))

    def _log_errors(self, build_run: str, rows: DataFrame) -> list[str]:
        """All (uri, error) go to the store's table of errors; the first of them are returned, with a count of the others."""
        path = f"{self.store.root}/errors/{build_run}"
        n = rows.count()
        if not n:
            return []
        rows.toDF("uri", "error").write.mode("append").parquet(path)
        some = [f"{r[0]}: {r[1]}" for r in rows.toDF("uri", "error").orderBy("uri").limit(SHOWN_ERRORS).collect()]
        return some + [f"and {n - SHOWN_ERRORS} more in {path}"] * (n > SHOWN_ERRORS)

    def _stage_raw(self, spark: SparkSession, snapshot: str) -> DataFrame:
        """Fetched once: later stages read this table, not the source."""
        path = f"{self.store.root}/{snapshot}/_raw"
        self.connector.read(spark).withColumn("content_hash", ids.content_hash(F.col("content"))).write.parquet(path)
        return spark.read.parquet(path)

    def _mine(self, name: str) -> DataFrame:
        return self.store.table(name).filter(F.col("corpus_id") == self.corpus)

    def _plan(self, raw: DataFrame, fp: str) -> tuple[DataFrame, dict]:
        good = raw.filter("error IS NULL").select(F.col("uri").alias("canonical_uri"), "content_hash")
        failed = raw.filter("error IS NOT NULL").select(F.col("uri").alias("canonical_uri"))
        plan = changes.plan_changes(good, self._mine("pointers"), self._mine("revisions"), fp, failed)
        plan = plan if self.whole else plan.filter(F.col("change") != changes.DELETED)
        return plan, changes.change_counts(plan).first().asDict()

    def _build(self, stages: Stages, snapshot: str, raw: DataFrame, plan: DataFrame, fp: str, build_run: str) -> dict:
        store, corpus = self.store, self.corpus
        work = plan.filter(F.col("change").isin("new", "changed", "incompatible"))
        todo = raw.join(work.select(F.col("canonical_uri").alias("uri")), "uri")
        source = ids.source_id(corpus, F.col("uri"))
        todo = todo.withColumn("revision_id", ids.revision_id(source, F.col("content_hash"), fp))
        with stages("parse"):
            made = parse.sections(todo.select("uri", "revision_id", "content"), self.parser)
            made.write.parquet(f"{store.root}/{snapshot}/_sections")
            found = store.spark.read.schema(made.schema).parquet(f"{store.root}/{snapshot}/_sections")
            bad = found.filter(F.col("locator") == parse.ERROR).select(F.col("source_id").alias("canonical_uri"), "text")
            errors = self._log_errors(build_run, bad)
        with stages("chunk"):
            pieces = chunk.chunks(found.filter(F.col("locator") != parse.ERROR), corpus, fp, self.chunker["max_tokens"], self.chunker["overlap"])
            if self.enricher is not None:
                pieces = enrich.enrich(pieces, self.enricher)
            done = todo.join(bad, todo["uri"] == bad["canonical_uri"], "left_anti")
            gone = done.select(F.col("uri").alias("canonical_uri")).unionByName(plan.filter("change = 'deleted'").select("canonical_uri")).withColumn("corpus_id", F.lit(corpus))
            dead = store.table("pointers").join(gone, ["corpus_id", "canonical_uri"], "left_semi").select("revision_id")

            def keep(name: str) -> DataFrame:
                return store.table(name).join(gone, ["corpus_id", "canonical_uri"], "left_anti")

            made_here = Observation()
            chunk_rows = store.stage(snapshot, "chunks", pieces.observe(made_here, F.count(F.lit(1)).alias("n")))
            old = store.table("chunks").join(dead, "revision_id", "left_semi")
            superseded = old.count()
        with stages("embed"):
            if self.embedder is not None:
                cache = store.table("embeddings").filter(F.col("model_name") == self.embedder.name).join(chunk_rows.select("chunk_id"), "chunk_id", "left_semi")
                vectors = dense.embed(chunk_rows, self.embedder, cache.select("chunk_id", "vector"))
                vectors = store.stage(snapshot, "embeddings", dense.checked(vectors, self.embedder.dimension, self.embedder.similarity))
        with stages("validate"):
            if (stored := chunk_rows.count()) != made_here.get["n"]:
                raise ValueError(f"{made_here.get['n']} chunks were made and {stored} stored")
            expected = found.filter(F.col("locator") != parse.ERROR).select("revision_id").distinct().join(chunk_rows.groupBy("revision_id").agg(F.count(F.lit(1)).alias("n")), "revision_id", "left")
            expected = expected.select("revision_id", F.coalesce("n", F.lit(0)).alias("expected_chunks"), F.lit(fp).alias("pipeline_fingerprint"))
            wrong = changes.validate_revisions(chunk_rows, vectors if self.embedder is not None else None, expected, fp, self.embedder.dimension if self.embedder else None).filter(F.size("errors") > 0)
            if problems := wrong.limit(5).collect():
                raise ValueError("; ".join(f"{r['revision_id']}: {', '.join(r['errors'])}" for r in problems))
        with stages("index"):
            ensure_index(store, self.stemmed)
            store.stage(snapshot, "postings", sparse.postings(index_fields(chunk_rows), self.stemmed))
            before, came, went = store.table("stats"), sparse.statistics(index_fields(chunk_rows)), sparse.statistics(index_fields(old))
            store.stage(snapshot, "stats", before.unionByName(came).unionByName(went.select(-F.col("n_docs"), -F.col("total")).toDF("n_docs", "total")).agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total")))
            store.inherit(snapshot, dead)
        with stages("promote"):
            at = self.clock()
            info = done.select(source.alias("source_id"), F.lit(corpus).alias("corpus_id"), F.col("uri").alias("canonical_uri"), "media_type", F.lit("").alias("title"))
            store.stage(snapshot, "sources", store.table("sources").join(info.select("source_id"), "source_id", "left_anti").unionByName(info))
            revs = done.select("revision_id", source.alias("source_id"), F.lit(corpus).alias("corpus_id"), F.col("uri").alias("canonical_uri"), "content_hash", F.lit(fp).alias("pipeline_fingerprint"), F.octet_length("content").cast("bigint").alias("byte_size"), F.lit(at).alias("fetched_at_iso"))
            store.stage(snapshot, "revisions", store.table("revisions").join(revs.select("revision_id"), "revision_id", "left_anti").unionByName(revs))
            point = done.select(F.lit(corpus).alias("corpus_id"), F.col("uri").alias("canonical_uri"), "revision_id", F.lit(at).alias("promoted_at"))
            store.stage(snapshot, "pointers", keep("pointers").unionByName(point))
            changed = gone.count()
            store.promote(snapshot)
            store.files.delete(f"{store.root}/{snapshot}/_sections")
        if len(store.segments()) > self.compact_at:
            store.compact()
        return {"promoted": True, "errors": errors, "sources_changed": changed, "chunks_added": stored, "chunks_deleted": superseded}


def index_fields(chunks: DataFrame) -> DataFrame:
    """The indexed fields of chunks: text, heading path and code."""
    return chunks.select("corpus_id", "chunk_id", "revision_id", "text", F.col("parent_locator").alias("heading"), T.code_content(F.col("text")).alias("code"))


def ensure_index(store: SnapshotStore, stemmed: bool = True) -> list[str]:
    """Makes postings anew for the live segments that lack them, and lost statistics; returns what was made."""
    made = []
    for name in store.segments():
        there = {t for t in ("chunks", "postings") if store.files.exists(f"{store.root}/segments/{name}/{t}")}
        if "chunks" in there and "postings" not in there:
            store._write(name, "postings", sparse.postings(index_fields(store.segment("chunks", name)), stemmed))
            made.append(name)
    live = store.current()
    if live and not store.files.exists(f"{store.root}/{live}/stats"):
        store._write(live, "stats", sparse.statistics(index_fields(store.table("chunks"))))
        made.append("stats")
    return made
