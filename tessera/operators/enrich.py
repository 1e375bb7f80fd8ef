"""Enrichment: a text generated for each chunk goes in front of it, before it is embedded and indexed.

Texts are cached by chunk id and the enricher's name, so that a chunk is asked for once.
A failure leaves a chunk as it was, or with ``required`` fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import IngestionError
from tessera.functions.text import token_count
from tessera.operators.shared import lean


@dataclass(frozen=True)
class Enricher:
    """``describe`` gives texts for a batch of chunk texts; the name is part of the pipeline's fingerprint."""

    name: str
    describe: Callable[[list[str]], list[str]]
    batch_size: int = 16
    required: bool = False


def described(chunks: DataFrame, enricher: Enricher) -> DataFrame:
    """(chunk_id, enrichment) of chunks; null where the enricher failed or said nothing."""

    def ask(texts: list[str]) -> list[str | None]:
        try:
            got = list(enricher.describe(texts))
            if len(got) != len(texts):
                raise IngestionError(f"{len(texts)} texts gave {len(got)} enrichments")
        except Exception as e:  # noqa: BLE001  a plug-in's failure is only passed on where it must not be missed
            if enricher.required:
                raise IngestionError(f"{enricher.name}: {e}") from e
            return [None] * len(texts)
        return [(g or "").strip() or None for g in got]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), enricher.batch_size):
                part = batch.iloc[i : i + enricher.batch_size]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "enrichment": ask(part["text"].fillna("").tolist())})

    return chunks.select("chunk_id", "text").mapInPandas(lean(chunks, run), "chunk_id string, enrichment string")


def enrich(chunks: DataFrame, enricher: Enricher, cache: DataFrame | None = None) -> DataFrame:
    """Chunks whose text begins with their enrichment; ``cache`` has (chunk_id, enrichment) made before."""
    new = chunks if cache is None else chunks.join(cache.select("chunk_id"), "chunk_id", "left_anti")
    made = described(new, enricher)
    made = made if cache is None else made.unionByName(cache.select("chunk_id", "enrichment"))
    both = chunks.join(made, "chunk_id", "left")
    text = F.when(F.col("enrichment").isNull(), F.col("text")).otherwise(F.concat("enrichment", F.lit("\n\n"), "text"))
    both = both.withColumn("text", text)
    return both.withColumn("token_count", token_count(F.col("text"))).select(*chunks.columns)
