"""Near duplicates: MinHash samples, banded candidates, verification by odd sketches.

Each document's word shingles give ``PERMUTATIONS`` MinHash samples.  Groups of ROWS
samples form the bands that bring candidates together.  All samples are folded into an
odd sketch, a bitmap in which each sample flips one bit.  Samples that two documents
share cancel in the exclusive or of their sketches, so with k samples and n bits the
Jaccard similarity is about 1 + n/(4k) ln(1 - 2x/n) for x bits set in it.  At high
similarities few bits differ, and the estimate is at its most precise.

Documents with equal samples are tied to the lowest id first, so copies enter the bands
once.  Inside a band's bucket a search compares a node with those not reached yet only:
it yields a spanning forest of all pairs clearly above the threshold, however large the
bucket, and no partner is dropped.  A bucket of more than TILE documents is cut into
tiles of which every two are searched together, in tasks of their own, so that no task
grows with it.  Pairs about the threshold, where estimates err most, are settled by the
shingles of their texts, in lower case without punctuation; those whose documents clear
pairs have joined already need no settling.  Groups are the connected components over
all bands.

Defined results: null texts and texts without words are near no other; texts with fewer
words than a shingle have one shingle of all their words; the lowest id of a group stays
(a row without an id is never grouped); rows that repeat an id are one document.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.blocks import Scatter, cut, gather, lean, partitions, runs
from tessera.llm.components import components

SHINGLE = 3
PERMUTATIONS = 256
BITS = 512
BANDS = 40
ROWS = 3
THRESHOLD = 0.45
#: Estimates from this much below the threshold to SURE above it are settled by the texts.
MARGIN = 0.1
SURE = 0.15
TILE = 2048
#: Bits of the map of hashed ids, a document asked for and at most.
MAP_BITS = 16
MOST_BITS = 1 << 28
_PART = 1 << 19

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_WORDS = BITS // 64
_SKETCH = f"V{BITS // 8}"
_ROWS_OUT = {"key": "u8", "node": "i8", "sketch": _SKETCH}


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles of each row) of a slice; rows with 1 to width-1 words have one shingle."""
    starts, ends, count = tk.word_spans(data, offsets)
    words = tk.span_hashes(data, starts, ends)
    n = np.diff(count)
    full = np.maximum(n - width + 1, 0)
    per = np.where((n > 0) & (n < width), 1, full)
    out = np.empty(int(per.sum()), np.uint64)
    begin = np.cumsum(per) - per
    at = np.repeat(count[:-1], full) + tk.ranges(full)
    out[np.repeat(begin, full) + tk.ranges(full)] = tk.window_hashes(words, at, width)
    for size in range(1, width):
        rows = np.flatnonzero(n == size)
        if len(rows):
            out[begin[rows]] = tk.window_hashes(words, count[rows], size)
    return out, per


def minhashes(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Samples of each row with shingles, (rows, PERMUTATIONS)."""
    begin = (np.cumsum(per) - per)[per > 0]
    out = np.empty((len(begin), PERMUTATIONS), np.uint64)
    if len(begin):
        buffer = np.empty_like(hashes)
        for k in range(PERMUTATIONS):
            np.multiply(hashes, _A[k], out=buffer)
            np.add(buffer, _B[k], out=buffer)
            out[:, k] = np.minimum.reduceat(buffer, begin)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, (rows, BITS / 64) words."""
    bit = tk.mix(samples ^ (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    out = np.zeros((len(samples), _WORDS), np.uint64)
    rows = np.arange(len(samples))
    for k in range(PERMUTATIONS):
        out[rows, (bit[:, k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit[:, k] & np.uint64(63))
    return out


def similarity(differing: np.ndarray) -> np.ndarray:
    """Jaccard similarity that so many differing bits stand for."""
    return 1 + BITS / (4 * PERMUTATIONS) * np.log(np.maximum(1 - 2 * np.asarray(differing) / BITS, 1e-9))


def most_bits(threshold: float) -> int:
    """The most differing bits at which the estimate is at least ``threshold``."""
    return int(np.flatnonzero(similarity(np.arange(BITS + 1)) >= threshold)[-1])


def _signatures(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    out = Scatter({"sign": "V16", "node": "i8", "sketch": _SKETCH, "bands": f"V{8 * BANDS}"})
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("doc_id")), pc.is_valid(batch.column("text"))))
        ids = batch.column("doc_id").to_numpy()
        for i, j, data, offsets in tk.slices(batch.column("text")):
            hashes, per = shingle_hashes(data, offsets)
            samples = minhashes(hashes, per)
            if not len(samples):
                continue
            sketch = odd_sketches(samples)
            used = np.ascontiguousarray(samples[:, : BANDS * ROWS]).reshape(-1, BANDS, ROWS)
            weights = tk.powers(ROWS + 1)[1:]
            bands = tk.mix((tk.mix(used) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            whole = tk.powers(PERMUTATIONS + 1)[1:]
            sign = np.stack([tk.mix((samples * whole).sum(axis=1, dtype=np.uint64)), tk.mix((tk.mix(samples) * whole).sum(axis=1, dtype=np.uint64))], axis=1)
            yield from out.add((sign[:, 0] % np.uint64(buckets)).astype(np.int32), sign=sign.view("V16").ravel(), node=ids[i:j][per > 0], sketch=sketch.view(_SKETCH).ravel(), bands=np.ascontiguousarray(bands).view(f"V{8 * BANDS}").ravel())
    yield from out.flush()


def _edge_rows(a: list[np.ndarray], b: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(np.concatenate(a) if a else np.zeros(0, np.int64)), pa.array(np.concatenate(b) if b else np.zeros(0, np.int64))]


def _equal_samples(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Edges to the lowest id of equal samples (negative buckets), and the bands of those lowest ids."""
    out = Scatter(_ROWS_OUT)
    names = ["bucket", "key", "node", "sketch"]
    for at, rows in gather(batches, {"sign": "V16", "node": "i8", "sketch": _SKETCH, "bands": f"V{8 * BANDS}"}):
        node = rows["node"]
        sign = rows["sign"].view(np.uint64).reshape(-1, 2)
        order = np.lexsort((node, sign[:, 1], sign[:, 0]))
        s = sign[order]
        start = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]).any(axis=1)])
        size = np.diff(np.r_[start, len(order)])
        root = np.repeat(node[order[start]], size)
        more = node[order] != root
        if more.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1 - at], pa.int32()), pa.array([root[more].tobytes()], pa.binary()), pa.array([node[order][more].tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=names)
        first = order[start]
        bands = rows["bands"][first].view(np.uint64).reshape(-1, BANDS)
        for k in range(BANDS):
            key = bands[:, k]
            yield from out.add((key % np.uint64(buckets)).astype(np.int32), key=key, node=node[first], sketch=rows["sketch"][first])
    yield from out.flush()


def forest(node: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs with at most ``most`` differing bits."""
    return bucket_pairs(node, sketch, most, most)[:2]


def bucket_pairs(node: np.ndarray, sketch: np.ndarray, most: int, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest of the pairs with at most ``sure`` differing bits, and the pairs with at
    most ``most``: each node that is reached is compared once with all that aren't yet."""
    left = np.arange(len(node))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            bits = np.bitwise_count(sketch[left] ^ sketch[at]).sum(axis=1, dtype=np.int64)
            near, good = bits <= most, bits <= sure
            if near.any():
                found.append((np.full(int(near.sum()), node[at]), node[left[near]], good[near]))
                queue.extend(left[good].tolist())
                left = left[~good]
    return tuple(np.concatenate(z) for z in zip(*found))


def _band_edges(batches: Iterator[pa.RecordBatch], most: int, sure: int, tile: int) -> Iterator[pa.RecordBatch]:
    def split() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("bucket").to_numpy()
            edges = batch.filter(pa.array(key < 0))
            for i in range(edges.num_rows):
                ready.append((np.frombuffer(edges.column("key")[i].as_py(), np.int64), np.frombuffer(edges.column("node")[i].as_py(), np.int64)))
            yield batch.filter(pa.array(key >= 0))

    ready: list[tuple[np.ndarray, np.ndarray]] = []
    for _, rows in gather(split(), _ROWS_OUT):
        order = np.lexsort((rows["node"], rows["key"]))
        key, node = rows["key"][order], rows["node"][order]
        start, size = runs(key)
        sketch = rows["sketch"][order].view(np.uint64).reshape(-1, _WORDS)
        two = size == 2
        x, y = start[two], start[two] + 1
        bits = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        near = bits <= most
        found = [(node[x[near]], node[y[near]], bits[near] <= sure)]
        found += [bucket_pairs(node[s : s + c], sketch[s : s + c], most, sure) for s, c in zip(start[(size > 2) & (size <= tile)], size[(size > 2) & (size <= tile)])]
        a, b, good = (np.concatenate(z) for z in zip(*found))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), good], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] == 1)], names=["a", "b", "sure"])
    if ready:
        a, b = _edge_rows([x for x, _ in ready], [y for _, y in ready])
        yield pa.RecordBatch.from_arrays([a, b, pa.array(np.ones(len(a), bool))], names=["a", "b", "sure"])


def _tiles(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Every two tiles of each large bucket of a band."""
    for _, rows in gather((b.filter(pc.greater_equal(b.column("bucket"), 0)) for b in batches), _ROWS_OUT):
        order = np.lexsort((rows["node"], rows["key"]))
        key = rows["key"][order]
        for s, c in zip(*runs(key)):
            if c <= tile:
                continue
            parts = np.array_split(order[s : s + c], -(-c // tile))
            for i in range(len(parts)):
                for j in range(i + 1, len(parts)):
                    both = np.concatenate([parts[i], parts[j]])
                    name = int(tk.mix(key[s : s + 1] + np.uint64(i * len(parts) + j))[0]) >> 1
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([rows["node"][both].tobytes()], pa.binary()), pa.array([rows["sketch"][both].tobytes()], pa.binary())], names=["tile", "node", "sketch"])


def _tile_edges(batches: Iterator[pa.RecordBatch], most: int, sure: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, sketch in zip(batch.column("node").to_pylist(), batch.column("sketch").to_pylist()):
            a, b, good = bucket_pairs(np.frombuffer(node, np.int64), np.frombuffer(sketch, np.uint64).reshape(-1, _WORDS), most, sure)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(good)], names=["a", "b", "sure"])


def normalised(text: Column) -> Column:
    """Lower case without ASCII punctuation, which parts no copies."""
    return F.translate(F.lower(text), string.punctuation, "")


def shingle_sets(texts: pd.Series) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in tk.slices(pa.array(texts, pa.string())):
        found, per = shingle_hashes(data, offsets)
        out += [np.unique(x) for x in np.split(found, np.cumsum(per)[:-1])]
    return out


def exact_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two normalised texts' shingles."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        shared = ((len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in zip(shingle_sets(a), shingle_sets(b)))
        return pd.Series([s / (n - s) if n > s else 0.0 for s, n in shared], dtype=float)

    return run(a, b)


def _id_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, bits) of the parts of the map that lie in a partition."""
    bit = np.unique(np.concatenate([np.zeros(0, np.int64)] + [b.column("bit").to_numpy() for b in batches]))
    for s, c in zip(*runs(bit // _PART)):
        flags = np.zeros(_PART, bool)
        flags[bit[s : s + c] % _PART] = True
        yield pa.RecordBatch.from_arrays([pa.array([bit[s] // _PART], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])


def perhaps_among(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` is among those of ``ids``, and a few others: a map of hashed ids goes to all
    tasks, so that a join that decides moves no rows that have no partner."""
    size = min(MOST_BITS, max(_PART, 1 << (MAP_BITS * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(name), F.lit(size))
    parts = ids.select(place.alias("bit")).repartition(partitions(ids.sparkSession), F.floor(F.col("bit") / _PART)).mapInArrow(_id_bits, "part long, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for part, found in parts.toLocalIterator():
        bits[part * _PART // 8 : (part + 1) * _PART // 8] = np.frombuffer(found, np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def there(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(there(place))


def near_duplicate_edges(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b) of doc_ids: pairs of each band bucket that join its copies.

    The sketches settle clear pairs; the texts of the others are compared themselves.
    """
    spark = docs.sparkSession
    lean(spark)
    n, most, sure = partitions(spark), most_bits(threshold - MARGIN), most_bits(min(threshold + SURE, 1.0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("text"))
    signs = rows.mapInArrow(tk.trimmed(_signatures, n), "bucket int, sign binary, node binary, sketch binary, bands binary")
    bands = signs.repartition(n, "bucket").mapInArrow(tk.trimmed(_equal_samples, n), "bucket int, key binary, node binary, sketch binary")
    tile = TILE
    met, edge = bands.repartition(n, "bucket"), "a long, b long, sure boolean"
    small = met.mapInArrow(tk.trimmed(_band_edges, most, sure, tile), edge)
    large = met.mapInArrow(tk.trimmed(_tiles, tile), "tile long, node binary, sketch binary").repartition(n, "tile").mapInArrow(tk.trimmed(_tile_edges, most, sure), edge)
    found = cut(small.unionByName(large))
    joined = cut(components(found.filter("sure").select("a", "b")))
    pairs = found.filter("NOT sure").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(joined.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    doubtful = cut(pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"))
    asked = doubtful.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = cut(perhaps_among(rows, asked, "doc_id").join(asked, "doc_id", "left_semi"))
    both = doubtful.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    near = both.filter("x IS NOT NULL AND y IS NOT NULL").filter(exact_similarity(F.col("x"), F.col("y")) >= threshold).select("a", "b")
    return found.filter("sure").select("a", "b").unionByName(near)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_doc_id) for every document that goes, with the one that stays of its group."""
    found = components(near_duplicate_edges(docs, threshold))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_doc_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group, the lowest id; all columns stay."""
    gone = cut(near_duplicates(docs, threshold).select(F.col("doc_id").alias("__gone")))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
