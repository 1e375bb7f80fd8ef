"""Batch search: sparse and dense retrieval to packed evidence, as one plan keyed by query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import context, dense, ranking, sparse
from tessera.plans.snapshot import SnapshotStore, written
from tessera.plans.sync import ensure_index

#: Rows of hits and of evidence that travel to the chunks; of more, both are shuffled.
FEW = 50_000


@dataclass(frozen=True)
class SearchSettings:
    top_k: int = 10
    similarity: str = "cosine"
    duplicate_threshold: float = 0.85
    trade_off: float = 1.0
    rerank_window: int = 50
    hops: int = 1
    context_per_hit: int = 2
    token_budget: int = 4096
    overhead: int = 0
    snippet_chars: int = 400
    overfetch: int = 3
    stemmed: bool = True
    #: where exact names end in a query's text, see ``boost_words``
    ascii_borders: bool = False


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    evidence: DataFrame
    summary: DataFrame


def prepare(queries: DataFrame, rewrite_sparse: Callable | None = None, rewrite_dense: Callable | None = None) -> DataFrame:
    """Queries with the variants sparse_text and dense_text; an empty query fails the plan."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    checked = F.when(clean == "", F.raise_error(F.lit("a query is empty"))).otherwise(F.col("text"))
    rows = queries.withColumn("text", checked)
    return rows.withColumn("sparse_text", rewrite_sparse(F.col("text")) if rewrite_sparse else F.col("text")).withColumn("dense_text", rewrite_dense(F.col("text")) if rewrite_dense else F.col("text"))


def _once(rows: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``rows`` made once, and how they meet the chunks."""
    rows = written(rows)
    return rows, F.broadcast if rows.count() <= FEW else (lambda r: r)


class SearchPipeline:
    """Search over the snapshot that is live when the pipeline is made."""

    def __init__(self, store: SnapshotStore, settings: SearchSettings = SearchSettings(), embedder: object | None = None, reranker: Callable[[list[str], list[str]], list[float]] | None = None):
        self.store, self.settings, self.embedder, self.reranker = store, settings, embedder, reranker
        ensure_index(store, settings.stemmed)
        self.snapshot = store.current()

    def _table(self, name: str) -> DataFrame:
        return self.store.table(name, self.snapshot)

    def search(self, queries: DataFrame, filters: ranking.FilterSpec | None = None, **changes: object) -> SearchResult:
        """Hits, evidence with snippets and a budget summary of queries (query_id, text, corpus_id, top_k)."""
        s = replace(self.settings, **changes)
        asked = prepare(queries)
        wanted = F.coalesce("top_k", F.lit(s.top_k)).cast("int")
        more = s.overfetch if filters is not None and filters.active else 1
        wide = asked.withColumn("top_k", wanted * more)
        chunks = self._table("chunks")
        legs = self._legs(wide, chunks, s, filters)
        hits, near = _once(ranking.rrf(*legs))
        facts = chunks.select("chunk_id", "source_id", "text", "token_count")
        hits = near(hits).join(facts, "chunk_id").join(asked.select("query_id", F.col("text").alias("query_text"), wanted.alias("top_k")), "query_id")
        if self.reranker is not None:
            hits = ranking.rerank(hits, self.reranker, s.rerank_window)
        else:
            hits = hits.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("rerank_failed", F.lit(False))
        hits, near = _once(ranking.trim(ranking.mmr(ranking.collapse_duplicates(hits, s.duplicate_threshold), s.trade_off), s.top_k))
        around = near(context.neighbors(hits, chunks, s.hops, near)).join(chunks.select(F.col("chunk_id").alias("neighbor_id"), "token_count"), "neighbor_id")
        packed, near = _once(context.pack(hits, around, s.token_budget, s.overhead, s.context_per_hit))
        evidence = context.with_snippets(near(packed), chunks, asked, self._table("sources"), s.snippet_chars)
        return SearchResult(hits, evidence, context.budget_summary(hits, packed, s.token_budget, s.overhead))

    def _legs(self, asked: DataFrame, chunks: DataFrame, s: SearchSettings, filters: ranking.FilterSpec | None) -> tuple[DataFrame, DataFrame]:
        found = sparse.retrieve(asked.select("query_id", F.col("sparse_text").alias("text"), "corpus_id", "top_k"), self._table("postings"), self._table("stats"), stemmed=s.stemmed, ascii_borders=s.ascii_borders)
        if self.embedder is None:
            near = found.select("query_id", "chunk_id", "rank", F.col("sparse_score").alias("dense_score")).limit(0)
        else:
            near = dense.top_k(self._vectors(asked), self._table("embeddings"), s.similarity)
            near = dense.active_only(near, chunks)
        if filters is not None:
            keys = chunks.select("chunk_id", "source_id")
            found, near = (ranking.apply_filters(leg.join(keys, "chunk_id"), filters).drop("source_id") for leg in (found, near))
        return found, near

    def _vectors(self, asked: DataFrame) -> DataFrame:
        """The query vectors, made by the executors in batches of the embedder's size."""
        embedder = self.embedder

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["query_vector"] = [[float(x) for x in v] for v in dense.embed_with_retries(embedder, batch.pop("dense_text").tolist())]
                yield batch

        rows = asked.select(F.col("query_id").cast("string").alias("query_id"), "corpus_id", F.col("top_k").cast("int").alias("top_k"), "dense_text")
        # written once: an embedder must not be asked twice for a query
        return written(rows.mapInPandas(run, "query_id string, corpus_id string, top_k int, query_vector array<double>"))
