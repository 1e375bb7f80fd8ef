"""Content-addressed identifiers as column expressions."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVISIONAL = "unpinned"


def _col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def digest(*parts: Column | str) -> Column:
    """First 32 hexadecimal digits of SHA-256 over the parts joined by ':'.

    A ':' inside a part becomes '_', and a null part counts as empty, so that parts
    never shift.
    """
    clean = [F.replace(F.coalesce(_col(p).cast("string"), F.lit("")), F.lit(":"), F.lit("_")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(":", *clean), 256), 1, 32)


def digest_text(*parts: str) -> str:
    """``digest`` for values at hand on the driver."""
    return hashlib.sha256(":".join(p.replace(":", "_") for p in parts).encode()).hexdigest()[:32]


def source_id(corpus: Column | str, uri: Column | str) -> Column:
    return digest("source", corpus, uri)


def revision_id(source: Column | str, content_hash: Column | str, fingerprint: Column | str) -> Column:
    return digest("revision", source, content_hash, fingerprint)


def section_id(source: Column | str, revision: Column | str, locator: Column | str) -> Column:
    return digest("section", source, revision, locator)


def chunk_id(corpus: Column | str, uri: Column | str, revision: Column | str, fingerprint: Column | str, locator: Column | str, ordinal: Column | str) -> Column:
    return digest("chunk", corpus, uri, revision, fingerprint, locator, ordinal)


def build_run_id(corpus: Column | str, fingerprint: Column | str, started_at: Column | str) -> Column:
    return digest("build_run", corpus, fingerprint, started_at)


def evidence_id(query: Column | str, chunk: Column | str) -> Column:
    return digest("evidence", query, chunk)


def content_hash(text: Column) -> Column:
    """SHA-256 of the decoded text as UTF-8."""
    return F.sha2(text.cast("string"), 256)


def pipeline_fingerprint(parser: str = "", chunker: dict[str, Any] | None = None, enrichment: str = "", embedder: str = "", dimension: int = 0, schema: int = 0) -> str:
    """Digest of all settings that decide what a document's chunks are."""
    settings = "|".join(f"{k}={v}" for k, v in sorted((chunker or {}).items()))
    fields = {"parser": parser, "chunker": settings, "enrichment": enrichment, "embedder": embedder, "dim": dimension, "schema": schema}
    return hashlib.sha256("|".join(f"{k}={v}" for k, v in fields.items()).encode()).hexdigest()[:32]
