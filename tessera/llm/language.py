"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams, taken inside lower
case words with their borders.  A linear layer and a softmax over the languages follow;
embeddings and layer are trained together by stochastic gradient descent in numpy.  The
logits' temperature is fitted on held-out rows, and the rejection threshold is the
confidence that all but ``REJECT_SHARE`` of the held-out rows reach.

Defined results: null and empty texts, texts without letters and those whose calibrated
confidence is under the threshold are "und" with their confidence (0 where there is
nothing to go by).  Every row gives one row.  The sample for fitting is bounded by
``max_docs``, chosen by a hash of the doc_id; null languages aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk

BUCKETS = 1 << 15
DIM = 16
NGRAMS = (2, 3, 4)
MAX_DOCS = 3000
REJECT_SHARE = 0.002
UNKNOWN = "und"
_STEP = np.uint64(0x100000001B3)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): the embeddings times the layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row) of all n-grams of a slice whose bytes are letters, or a letter and the border before it.

    ASCII letters are lowered; letters of other scripts count as the bytes they are.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _LETTER[data]
    code = np.where(letter, _LOWER[data], 32).astype(np.uint64)
    first = np.zeros(n, bool)
    inner = offsets[:-1]
    first[inner[inner < n]] = True
    code[first & ~letter] = 32
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    out, rows = [], []
    h = code.copy()
    ok = np.ones(n, bool)
    for size in range(2, max(NGRAMS) + 1):
        m = n - size + 1
        if m <= 0:
            break
        h = h[:m] * _STEP + code[size - 1 :]
        ok = ok[:m] & letter[size - 1 :] & ~first[size - 1 :]
        if size in NGRAMS:
            at = np.flatnonzero(ok)
            x = (h[at] + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((x >> np.uint64(64 - 15)).astype(np.int64))
            rows.append(row_of[at])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(rows)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    out = []
    for i, j, data, offsets in tk.slices(texts):
        bucket, row = ngrams(data, offsets)
        key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(j - i + 1) * BUCKETS)
        out += [(key[a:b] % BUCKETS, count[a:b].astype(np.float32)) for a, b in zip(cut[:-1], cut[1:])]
    return out


def fit(texts: pa.Array, langs: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 9) -> LanguageModel:
    """Trains on four fifths of the rows; calibrates temperature and threshold on the rest.

    Besides the whole text, a random stretch of its n-grams is shown, so that short texts
    are no surprise to the model.
    """
    names = sorted(set(langs))
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), b)
    y = np.array([names.index(x) for x in langs])
    docs = bags(texts)
    held = np.arange(len(docs)) % 5 == 4
    train = np.flatnonzero(~held)
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            bucket, count = docs[i]
            if not len(bucket):
                continue
            if rng.random() < 0.5 and len(bucket) > 8:
                some = rng.choice(len(bucket), size=int(rng.integers(4, min(len(bucket), 64))), replace=False)
                bucket, count = bucket[some], np.minimum(count[some], 2)
            share = count / count.sum()
            x = share @ emb[bucket]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = rate * (1 - done / steps)
            done += 1
            back = w @ p
            w -= lr * np.outer(x, p)
            b -= lr * p
            emb[bucket] -= (lr * 4) * share[:, None] * back
    model = LanguageModel(names, emb @ w, b)
    if held.any() and len(names) > 1:
        z = np.stack([logits(model, *docs[i]) for i in np.flatnonzero(held)])
        model.temperature = _temperature(z, y[held])
        right = z.argmax(axis=1) == y[held]
        top = _softmax(z / model.temperature).max(axis=1)[right]
        model.threshold = float(min(np.quantile(top, REJECT_SHARE), 0.6)) if len(top) else 0.0
    return model


def logits(model: LanguageModel, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (count @ model.table[bucket]) / max(count.sum(), 1) + model.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    grid = np.geomspace(0.2, 5, 60)
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def predict(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, calibrated confidence) of each text."""
    lang, sure = np.full(len(texts), -1, np.int64), np.zeros(len(texts))
    if not model.languages:
        return lang, sure
    for i, j, data, offsets in tk.slices(texts, 1 << 18):
        bucket, row = ngrams(data, offsets)
        n = np.bincount(row, minlength=j - i)
        z = np.stack([np.bincount(row, weights=model.table[:, k][bucket], minlength=j - i) for k in range(len(model.languages))], axis=1)
        z = z / np.maximum(n, 1)[:, None] + model.bias
        p = _softmax(z / model.temperature)
        best = p.argmax(axis=1)
        top = p[np.arange(j - i), best]
        lang[i:j] = np.where((n > 0) & (top >= model.threshold), best, -1)
        sure[i:j] = np.where(n > 0, top, 0.0)
    return lang, sure


def sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[pa.Array, list[str]]:
    """Texts and languages of a bounded sample of documents, chosen by a hash of the doc_id.

    The ids are chosen first, so that no text is sorted.
    """
    ids = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    rows = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table = rows.toPandas().sort_values(["doc_id", "lang", "text"])
    return pa.array(table["text"].tolist(), pa.large_string()), table["lang"].tolist()


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> LanguageModel:
    return fit(*sample(docs, max_docs))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, language, confidence) of every row."""
    names = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, sure = predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.take(pa.array(names), pa.array(np.where(lang < 0, len(names) - 1, lang))), pa.array(sure.round(6))], names=["doc_id", "language", "confidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, language string, confidence double")
