"""The facade: sync, search, answer, inspect and health of one corpus."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import registry
from tessera.config import Config
from tessera.errors import ConfigError, ConflictError, ProtocolError, RegistryError
from tessera.operators import answer as answers
from tessera.operators.enrich import Enricher
from tessera.plans import health as healths
from tessera.plans.search import SearchPipeline, SearchResult, SearchSettings
from tessera.plans.snapshot import SnapshotStore, latest_runs
from tessera.plans.sync import SyncEngine, SyncReport
from tessera.sources.connectors import Connector

MODES = ("hybrid", "sparse", "dense")


@dataclass
class KnowledgeBase:
    """A corpus in a store.  ``mode`` 'sparse' searches without the embedder; 'dense' keeps both legs."""

    store: SnapshotStore
    corpus: str
    connector: Connector | None = None
    parser: str | Callable = "markdown"
    embedder: object | None = None
    reranker: Callable | None = None
    generator: Callable[[str], str] | None = None
    settings: SearchSettings = field(default_factory=SearchSettings)
    chunk_size: int = 512
    chunk_overlap: int = 64
    mode: str = "hybrid"
    abstain_threshold: float = 0.0
    enricher: Enricher | None = None
    observer: Callable | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ConfigError(f"mode must be one of {', '.join(MODES)}")

    @classmethod
    def configured(cls, spark: SparkSession, config: Config, points: Mapping[str, Mapping] | None = None, **given: object) -> KnowledgeBase:
        """A knowledge base of a configuration.

        Components are found by role: one given here as ``connector=...``, else the
        installed one named by ``connector_name=...``, else the sole one installed, else
        the built-in.  Roles that nothing fills are left out, but those that were named.
        ``points`` replaces what is installed, by role.
        """
        r, found = config.retrieval, {}
        for role in ("connector", "parser", "embedder", "reranker", "generator", "observer"):
            name = given.pop(f"{role}_name", None)
            try:
                found[role] = registry.resolve(role, given.pop(role, None), name, points=None if points is None else points.get(role, {}))
            except (ConflictError, ProtocolError):
                raise
            except RegistryError:
                if name is not None:
                    raise
        settings = SearchSettings(top_k=r.top_k, similarity=r.similarity, duplicate_threshold=r.duplicate_threshold, trade_off=r.trade_off, rerank_window=r.rerank_window, token_budget=config.answer.token_budget)
        store = SnapshotStore(spark, config.store.root)
        return cls(store, config.store.corpus, settings=settings, chunk_size=r.chunk_size, chunk_overlap=r.chunk_overlap, mode=r.mode, abstain_threshold=config.answer.abstain_threshold, **found, **given)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def sync(self) -> SyncReport:
        if self.connector is None:
            raise ConfigError("sync needs a connector")
        chunker = {"max_tokens": self.chunk_size, "overlap": self.chunk_overlap}
        return SyncEngine(self.store, self.corpus, self.connector, self.parser, chunker, self.embedder, self.enricher, observer=self.observer).sync()

    def queries(self, *texts: str, top_k: int | None = None, corpus: str | None = None) -> DataFrame:
        """A batch of queries from texts; without a corpus they search all corpora."""
        return self.spark.createDataFrame([(f"q{i}", t, corpus, top_k) for i, t in enumerate(texts)], "query_id string, text string, corpus_id string, top_k int")

    def search(self, queries: DataFrame | str) -> SearchResult:
        rows = self.queries(queries) if isinstance(queries, str) else queries
        return SearchPipeline(self.store, self.settings, None if self.mode == "sparse" else self.embedder, self.reranker).search(rows)

    def answer(self, queries: DataFrame | str, threshold: float | None = None) -> DataFrame:
        if self.generator is None:
            raise ConfigError("answer needs a generator")
        rows = self.queries(queries) if isinstance(queries, str) else queries
        found = self.search(rows)
        return answers.answer(rows, found.evidence, found.hits, self.generator, self.abstain_threshold if threshold is None else threshold)

    def investigate(self, query: str) -> None:
        """The investigation loop is planned behaviour, which isn't there."""
        raise ConfigError("there is no investigation loop")

    def health(self) -> str:
        one = self.spark.createDataFrame([(self.corpus,)], "corpus_id string")
        return healths.corpus_health(one, self.store.runs(), self.store.table("pointers")).first()["health"]

    def inspect(self) -> dict:
        last = latest_runs(self.store.runs().filter(F.col("corpus_id") == self.corpus)).first()
        pointers = self.store.table("pointers").filter(F.col("corpus_id") == self.corpus)
        return {"corpus_id": self.corpus, "health": self.health(), "snapshot": self.store.current(), "active_sources": pointers.count(), "active_chunks": self.store.count_active_chunks(self.corpus), "last_run": last.asDict() if last else None, "schema_version": self.store.schema_version()}
