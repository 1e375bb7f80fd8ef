"""Dense retrieval: vector checks, similarities and top-k by full scan of blocks against blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EmbeddingError, RetrievalError
from tessera.operators.shared import lean
from tessera.operators.sparse import DEFAULT_K, top

SIMILARITIES = ("cosine", "dot", "euclidean")
NORM_TOLERANCE = 1e-4
BLOCK = 4096
QUERIES = 512
#: Queries that travel with the tasks, and rows of a group where there are more.
SMALL = 1024
GROUP = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def negative_distance(a: Column, b: Column) -> Column:
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def similarity(kind: str, a: Column, b: Column) -> Column:
    """Score of two vectors, greater is nearer.  Cosine is the dot product, as vectors have norm 1."""
    check_similarity(kind)
    return negative_distance(a, b) if kind == "euclidean" else dot(a, b)


def check_similarity(kind: str) -> None:
    if kind not in SIMILARITIES:
        raise RetrievalError(f"unknown similarity {kind!r}; known: {', '.join(SIMILARITIES)}")


def problem(vector: Column, dimension: int, kind: str = "cosine") -> Column:
    """What is wrong with a vector, or null."""
    check_similarity(kind)
    unit = F.abs(norm(vector) - 1) > NORM_TOLERANCE if kind == "cosine" else F.lit(False)
    return F.when(vector.isNull(), "missing").when(F.size(vector) != dimension, "dimension").when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "not a number").when(unit, "norm")


def _best(asked: pd.DataFrame, points: pd.DataFrame, kind: str, digits: int | None) -> Iterator[pd.DataFrame]:
    """The best of ``points`` for each row of ``asked``, a block of both at a time; pairs of unequal dimension are left out."""
    size = lambda vs: np.array([-1 if v is None else len(v) for v in vs], np.int64)
    points = points.sort_values("chunk_id", kind="stable")
    asked_size, point_size = size(asked["query_vector"]), size(points["vector"])
    for d in np.intersect1d(asked_size, point_size):
        if d < 0:
            continue
        these, those = asked[asked_size == d], points[point_size == d]
        for i in range(0, len(those), BLOCK):
            part = those.iloc[i : i + BLOCK]
            x = np.array(part["vector"].tolist(), np.float64).reshape(len(part), d)
            names, corpus = part["chunk_id"].to_numpy(), part["corpus_id"].to_numpy()
            for j in range(0, len(these), QUERIES):
                q = these.iloc[j : j + QUERIES]
                m = np.array(q["query_vector"].tolist(), np.float64).reshape(len(q), d)
                if kind == "euclidean":
                    s = -np.sqrt(np.maximum((m**2).sum(1)[:, None] + (x**2).sum(1) - 2 * m @ x.T, 0))
                else:
                    s = m @ x.T
                s = np.round(s, digits) if digits is not None else s
                s[~np.isfinite(s)] = -np.inf
                for r, c in enumerate(q["corpus_id"]):
                    if not pd.isna(c):
                        s[r, corpus != c] = -np.inf
                ks = q["top_k"].to_numpy()
                most = min(max(int(ks.max()), 1), len(part))
                # all that tie with the last of the best stay until the names decide
                rows, cols = np.nonzero((s >= np.partition(s, -most, axis=1)[:, [-most]]) & (s > -np.inf))
                order = np.lexsort((cols, -s[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, cols = rows[place < ks[rows]], cols[place < ks[rows]]
                if len(rows):
                    yield pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "chunk_id": names[cols], "top_k": ks[rows], "score": s[rows, cols]})


def top_k(queries: DataFrame, embeddings: DataFrame, kind: str = "cosine", k: int = DEFAULT_K, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, dense_score) for queries (query_id, query_vector, corpus_id, top_k).

    Vectors are scored a block at a time by a matrix product, which keeps each block's best
    per query.  Up to SMALL queries travel with the tasks; of more, groups of queries meet
    groups of vectors, each pair of groups in a task, and nothing is collected.
    """
    check_similarity(kind)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query_vector", "corpus_id", F.coalesce("top_k", F.lit(k)).cast("int").alias("top_k"))
    points = embeddings.select(F.col("chunk_id").cast("string").alias("chunk_id"), "corpus_id", "vector")
    out = "query_id string, chunk_id string, top_k int, score double"
    few = asked.limit(SMALL + 1).toPandas()
    if len(few) <= SMALL:

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _best(few, batch, kind, digits)

        found = points.mapInPandas(lean(points, score), out)
    else:
        across, down = (max(1, -(-t.count() // GROUP)) for t in (asked, points))
        left = asked.withColumn("across", F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int")).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        right = points.withColumn("down", F.pmod(F.xxhash64("chunk_id"), F.lit(down)).cast("int")).withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

        def meet(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            best = [*_best(q, p, kind, digits)]
            if not best:
                return pd.DataFrame({"query_id": [], "chunk_id": [], "top_k": [], "score": []})
            # of a group's blocks only the best go on
            rows = pd.concat(best).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
            return rows[rows.groupby("query_id").cumcount() < rows["top_k"]]

        found = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInPandas(meet, out)
    return top(found, "score").select("query_id", "chunk_id", "rank", F.col("score").alias("dense_score"))


def active_only(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk is still active; a query may so end with fewer than k."""
    return hits.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def checked(vectors: DataFrame, dimension: int, kind: str = "cosine") -> DataFrame:
    """``vectors``; one of another dimension, with a component that isn't a number, or for cosines not of norm 1 fails the job."""
    wrong = problem(F.col("vector"), dimension, kind)
    said = F.concat(F.lit("vector of "), F.col("chunk_id"), F.lit(": "), wrong)
    return vectors.withColumn("vector", F.when(wrong.isNotNull(), F.raise_error(said)).otherwise(F.col("vector")))


def encode_vector(vector: Column) -> Column:
    """Little-endian float32 bytes of a vector."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def decode_vector(blob: Column, dimension: int) -> Column:
    """The vector in such bytes; null where their length isn't the dimension's."""

    @F.pandas_udf("array<float>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None or len(x) != 4 * dimension else np.frombuffer(x, "<f4"))

    return run(blob)


class HashEmbedder:
    """Deterministic unit vectors seeded by a digest of the text, for tests and examples."""

    name, dimension, similarity, batch_size = "hash-embedder", 16, "cosine", 8

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") ^ 42
            v = np.random.Generator(np.random.PCG64(seed)).normal(size=self.dimension)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


def embed_with_retries(embedder: object, texts: list[str], attempts: int = 3) -> list[list[float]]:
    """Vectors of texts in batches of the embedder's size, each tried up to ``attempts`` times."""
    out: list[list[float]] = []
    size = max(1, int(getattr(embedder, "batch_size", 32)))
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        for attempt in range(attempts):
            try:
                got = embedder.embed(part)
                break
            except EmbeddingError:
                if attempt == attempts - 1:
                    raise
        if len(got) != len(part):
            raise EmbeddingError(f"{len(part)} texts gave {len(got)} vectors")
        if any(len(v) != embedder.dimension for v in got):
            raise EmbeddingError(f"a vector hasn't {embedder.dimension} components")
        out += got
    return out


def embed(chunks: DataFrame, embedder: object, cache: DataFrame | None = None, on_batch: Callable[[int], None] | None = None) -> DataFrame:
    """(chunk_id, corpus_id, revision_id, model_name, dimension, similarity, vector) of chunks.

    Chunks in ``cache`` (chunk_id, vector) keep their vector, so the embedder sees new ones only.
    """
    # whole batches of the embedder, and few: vectors may be longer than texts
    size = max(1, int(getattr(embedder, "batch_size", 32)))
    step = size * max(1, 1024 // size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), step):
                part = batch.iloc[i : i + step]
                vectors = embed_with_retries(embedder, part["text"].fillna("").tolist())
                if on_batch is not None:
                    on_batch(len(part))
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "vector": [np.asarray(v, np.float32) for v in vectors]})

    new = chunks if cache is None else chunks.join(cache.select("chunk_id"), "chunk_id", "left_anti")
    made = new.select("chunk_id", "text").mapInPandas(lean(new, run), "chunk_id string, vector array<float>")
    if cache is not None:
        made = made.unionByName(cache.select("chunk_id", "vector").join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
    keys = chunks.select("chunk_id", "corpus_id", "revision_id")
    return keys.join(made, "chunk_id").select("chunk_id", "corpus_id", "revision_id", F.lit(embedder.name).alias("model_name"), F.lit(embedder.dimension).alias("dimension"), F.lit(embedder.similarity).alias("similarity"), "vector")
