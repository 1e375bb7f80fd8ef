"""Operators on ranked lists: fusion, filters, reranking, duplicate collapse, diversity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(sparse: DataFrame, dense: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (query_id, chunk_id, rank, score).

    Returns (query_id, chunk_id, sparse_score, dense_score, fusion_score, rank).  A chunk
    that a list repeats counts at its best rank; a score that is missing stays null.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def leg(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("query_id", "chunk_id").agg(F.min("rank").alias(f"{name}_rank"), F.min_by(f"{name}_score", "rank").alias(f"{name}_score"))

    both = leg(sparse, "sparse").join(leg(dense, "dense"), ["query_id", "chunk_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.lit(k) + F.col(r)), F.lit(0.0))
    fused = both.withColumn("fusion_score", part("sparse_rank") + part("dense_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), F.col("chunk_id").asc())
    return fused.select("query_id", "chunk_id", "sparse_score", "dense_score", "fusion_score", F.row_number().over(order).alias("rank"))


@dataclass(frozen=True)
class FilterSpec:
    """Restrictions on hits.  Chunks have no tags, media types or dates, so asking for one excludes all."""

    source_ids: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    require_after: str | None = None
    namespace: str | None = None
    acl_ids: tuple[str, ...] = ()

    @property
    def active(self) -> bool:
        """Whether any axis is set, even those that aren't enforced."""
        return bool(self.source_ids or self.tags or self.media_types or self.require_after or self.namespace or self.acl_ids)

    def predicate(self, source: Column) -> Column:
        if self.tags or self.media_types or self.require_after:
            return F.lit(False)
        return source.isin(*self.source_ids) if self.source_ids else F.lit(True)


def apply_filters(hits: DataFrame, spec: FilterSpec) -> DataFrame:
    """Hits (with source_id) that pass; order and scores stay."""
    return hits.filter(spec.predicate(F.col("source_id")))


def rerank(hits: DataFrame, score: Callable[[list[str], list[str]], list[float]], window: int = 50) -> DataFrame:
    """Orders the first ``window`` hits of each query by a scorer (queries, texts) -> scores.

    ``hits`` has query_id, query_text, chunk_id, text and rank.  The tail follows in its
    order.  Where the scorer fails or gives another number of scores, the query's hits
    keep their order and say so in rerank_failed.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        head = rows.iloc[:window]
        rows["rerank_score"], rows["rerank_failed"] = None, False
        try:
            got = [float(x) for x in score(head["query_text"].tolist(), head["text"].tolist())]
            if len(got) != len(head):
                raise ValueError("the scorer gave another number of scores")
        except Exception:  # noqa: BLE001  any failure of a plug-in falls back to the order there is
            rows["rerank_failed"] = True
            return rows
        rows.loc[: len(head) - 1, "rerank_score"] = got
        order = sorted(range(len(head)), key=lambda i: -got[i]) + list(range(len(head), len(rows)))
        rows = rows.iloc[order].reset_index(drop=True)
        rows["rank"] = range(1, len(rows) + 1)
        return rows

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields)
    return hits.groupBy("query_id").applyInPandas(run, f"{out}, rerank_score double, rerank_failed boolean")


def word_set(text: str | None) -> frozenset[str]:
    return frozenset((text or "").lower().split())


def jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


def _per_query(hits: DataFrame, pick: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """Hits of each query as ``pick`` chooses and orders them; ranks are made anew."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        rows = rows.iloc[pick(rows)].reset_index(drop=True)
        rows["rank"] = range(1, len(rows) + 1)
        return rows

    return hits.groupBy("query_id").applyInPandas(run, hits.schema)


def collapse_duplicates(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Drops a hit that is at least ``threshold`` similar to a kept, better hit of its source."""

    def pick(rows: pd.DataFrame) -> list[int]:
        kept: dict[str, list[frozenset[str]]] = {}
        out = []
        for i, (source, text) in enumerate(zip(rows["source_id"], rows["text"])):
            words = word_set(text)
            if all(jaccard(words, other) < threshold for other in kept.get(source, [])):
                kept.setdefault(source, []).append(words)
                out.append(i)
        return out

    return _per_query(hits, pick)


def mmr(hits: DataFrame, trade_off: float = 1.0) -> DataFrame:
    """Orders hits by maximal marginal relevance; 1.0 leaves them as they are.

    Relevance is the rerank score, else the fusion score, else 1 / rank.
    """
    if trade_off == 1.0:
        return hits

    def pick(rows: pd.DataFrame) -> list[int]:
        sets = [word_set(t) for t in rows["text"]]
        relevance = []
        for i in range(len(rows)):
            named = [rows[c].iloc[i] for c in ("rerank_score", "fusion_score") if c in rows and pd.notna(rows[c].iloc[i])]
            relevance.append(float(named[0]) if named else 1.0 / (1 + i))
        left, order, nearest = list(range(len(rows))), [], [0.0] * len(rows)
        while left:
            best = max(left, key=lambda i: (trade_off * relevance[i] - (1 - trade_off) * nearest[i], -i))
            left.remove(best)
            order.append(best)
            for i in left:
                nearest[i] = max(nearest[i], jaccard(sets[i], sets[best]))
        return order

    return _per_query(hits, pick)


def trim(hits: DataFrame, default_k: int = 10) -> DataFrame:
    """The first top_k hits of each query, or the default where that is null."""
    return hits.filter(F.col("rank") <= F.coalesce("top_k", F.lit(default_k)))
