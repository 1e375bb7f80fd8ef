"""Collections with aliases, revisions and sync jobs: the state of a multi-tenant service."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import StoreError
from tessera.plans.health import collection_state
from tessera.plans.snapshot import Files, now_iso

NAME = r"^[a-z0-9][a-z0-9_-]{0,63}$"
MARK = "__rev_"
SCHEMAS = {
    "collections": "name string, created_at string, settings_json string",
    "sources": "collection_name string, canonical_uri string, connector_kind string, content_hash string, status string",
    "revisions": "revision_id string, collection_name string, fingerprint string, status string, chunk_count bigint, source_count bigint, seq bigint",
    "jobs": "job_id string, collection_name string, state string, sources_added bigint, sources_removed bigint, sources_unchanged bigint, error_detail string, started_at string, finished_at string, created_at string, seq bigint",
}
KEYS = {"collections": ["name"], "sources": ["collection_name", "canonical_uri"], "revisions": ["revision_id"], "jobs": ["job_id"]}


def valid_name(name: Column) -> Column:
    """Lower-case names of up to 64 characters without a double underscore."""
    return F.coalesce(name.rlike(NAME) & ~name.contains("__"), F.lit(False))


def check_name(name: str) -> str:
    if not re.match(NAME, name) or "__" in name:
        raise StoreError(f"not a collection name: {name!r}")
    return name


class Catalog:
    """State tables, each a small Parquet file that is replaced as a whole, and aliases to index folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # tables

    def _pointer(self) -> dict:
        path = f"{self.root}/STATE.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {"tables": {}, "aliases": {}}

    def _save(self, state: dict) -> None:
        self.files.replace(f"{self.root}/STATE.json", json.dumps(state))

    def table(self, name: str) -> DataFrame:
        at = self._pointer()["tables"].get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(at) if at else self.spark.createDataFrame([], SCHEMAS[name])

    def _put(self, name: str, rows: DataFrame) -> None:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        rows.coalesce(1).write.parquet(path)
        state = self._pointer()
        before = state["tables"].get(name)
        state["tables"][name] = path
        self._save(state)
        if before:
            self.files.delete(before)

    def upsert(self, name: str, rows: DataFrame) -> None:
        old = self.table(name)
        self._put(name, old.join(rows.select(*KEYS[name]), KEYS[name], "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))

    def _row(self, table: str, **values: object) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.get(c.split()[0]) for c in SCHEMAS[table].split(", "))], SCHEMAS[table])

    # collections and sources

    def create_collection(self, name: str, settings: dict | None = None) -> None:
        """Creates a collection, or does nothing where it exists."""
        check_name(name)
        if self.table("collections").filter(F.col("name") == name).isEmpty():
            self.upsert("collections", self._row("collections", name=name, created_at=now_iso(), settings_json=json.dumps(settings or {}, sort_keys=True)))

    def list_collections(self) -> DataFrame:
        return self.table("collections").orderBy("name")

    def delete_collection(self, name: str) -> None:
        self._put("collections", self.table("collections").filter(F.col("name") != name))

    def put_source(self, collection: str, uri: str, kind: str, content_hash: str) -> None:
        """Adds or replaces a source, which is active again."""
        self.upsert("sources", self._row("sources", collection_name=collection, canonical_uri=uri, connector_kind=kind, content_hash=content_hash, status="active"))

    def retire_source(self, collection: str, uri: str) -> None:
        mine = (F.col("collection_name") == collection) & (F.col("canonical_uri") == uri)
        self._put("sources", self.table("sources").withColumn("status", F.when(mine, "retired").otherwise(F.col("status"))))

    # revisions

    def stage_revision(self, collection: str, fingerprint: str, chunks: int = 0, sources: int = 0) -> str:
        rid = uuid.uuid4().hex
        seq = self.table("revisions").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.upsert("revisions", self._row("revisions", revision_id=rid, collection_name=collection, fingerprint=fingerprint, status="staged", chunk_count=chunks, source_count=sources, seq=seq))
        return rid

    def set_live(self, revision_id: str) -> None:
        """Makes a staged revision live and retires the one before: one live revision a collection."""
        rows = self.table("revisions")
        row = rows.filter(F.col("revision_id") == revision_id).first()
        if row is None or row["status"] != "staged":
            raise StoreError("only a staged revision can go live")
        same = F.col("collection_name") == row["collection_name"]
        status = F.when(F.col("revision_id") == revision_id, "live").when(same & (F.col("status") == "live"), "retired").otherwise(F.col("status"))
        self._put("revisions", rows.withColumn("status", status))

    # jobs

    def start_job(self, collection: str) -> str:
        job, at = uuid.uuid4().hex, now_iso()
        seq = self.table("jobs").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        self.upsert("jobs", self._row("jobs", job_id=job, collection_name=collection, state="running", sources_added=0, sources_removed=0, sources_unchanged=0, started_at=at, created_at=at, seq=seq))
        return job

    def finish_job(self, job: str, state: str, added: int = 0, removed: int = 0, unchanged: int = 0, error: str | None = None) -> None:
        row = self.table("jobs").filter(F.col("job_id") == job).first()
        if row is None:
            raise StoreError(f"no job {job}")
        self.upsert("jobs", self._row("jobs", **row.asDict() | {"state": state, "sources_added": added, "sources_removed": removed, "sources_unchanged": unchanged, "error_detail": error, "finished_at": now_iso()}))

    def fail_stale_jobs(self) -> int:
        """Ends jobs that a crash left running; returns how many."""
        rows = self.table("jobs")
        stale = F.col("state") == "running"
        n = rows.filter(stale).count()
        if n:
            at = now_iso()
            self._put("jobs", rows.withColumn("finished_at", F.when(stale, F.lit(at)).otherwise(F.col("finished_at"))).withColumn("error_detail", F.when(stale, F.lit("interrupted")).otherwise(F.col("error_detail"))).withColumn("state", F.when(stale, F.lit("failed")).otherwise(F.col("state"))))
        return n

    def status(self) -> DataFrame:
        """(collection_name, state) of all collections."""
        return collection_state(self.table("collections").select(F.col("name").alias("collection_name")), self.table("jobs"), self.table("revisions"))

    # index folders behind aliases

    def begin_index(self, alias: str) -> str:
        """A shadow folder for an alias's next index."""
        return f"{self.root}/{check_name(alias)}{MARK}{uuid.uuid4().hex[:12]}"

    def write_index(self, path: str, points: DataFrame) -> None:
        """Adds points to an index; a point of an id that is there replaces it, and of points written together any counts."""
        n = len([f for f in self.files.list(path) if f.startswith("part=")])
        points.dropDuplicates(["chunk_id"]).write.parquet(f"{path}/part={n}")

    def read_index(self, path: str) -> DataFrame:
        """The points of an index, of each id the last written."""
        rows = self.spark.read.option("basePath", path).parquet(path)
        parts = len(self.files.list(path))
        if parts > 1:
            newer = rows.select("chunk_id", "part").groupBy("chunk_id").agg(F.max("part").alias("part"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
            old = rows.select("chunk_id", "part").join(newer.withColumnRenamed("part", "last"), "chunk_id").filter("part < last").select("chunk_id", "part")
            rows = rows.join(old, ["chunk_id", "part"], "left_anti")
        return rows.drop("part")

    def index_info(self, alias: str) -> dict:
        """Folder, points and dimension of an alias's index; no folder where it points nowhere."""
        at = self.resolve(alias)
        if at is None:
            return {"alias": alias, "path": None, "points": 0, "dimension": None}
        n, size = self.read_index(at).agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        return {"alias": alias, "path": at, "points": n, "dimension": size}

    def resolve(self, alias: str) -> str | None:
        return self._pointer()["aliases"].get(alias)

    def aliases(self) -> dict[str, str]:
        return self._pointer()["aliases"]

    def promote_index(self, alias: str, path: str) -> None:
        """Points the alias to a new folder at once; the old folder is deleted after, as well as can be."""
        if not self.files.exists(path):
            raise StoreError(f"nothing was written to {path}")
        state = self._pointer()
        before = state["aliases"].get(alias)
        state["aliases"][alias] = path
        self._save(state)
        if before and before != path:
            self.files.delete(before)

    def abort_index(self, path: str) -> None:
        if path in self.aliases().values():
            raise StoreError("a live index can't be aborted")
        self.files.delete(path)

    def delete_alias(self, alias: str) -> None:
        state = self._pointer()
        state["aliases"].pop(alias, None)
        self._save(state)

    def query_index(self, alias: str, queries: DataFrame, k: int = 10, predicate: Column | None = None, threshold: float | None = None, digits: int | None = None) -> DataFrame:
        """Top-k of an alias's points (chunk_id, corpus_id, vector, ...); no hits where it points nowhere.

        The predicate applies before ranking, the threshold to scores.
        """
        from tessera.operators.dense import top_k

        at = self.resolve(alias)
        points = self.read_index(at) if at else self.spark.createDataFrame([], "chunk_id string, corpus_id string, vector array<float>")
        hits = top_k(queries, points.filter(predicate) if predicate is not None and at else points, k=k, digits=digits)
        return hits.filter(F.col("dense_score") >= threshold) if threshold is not None else hits
