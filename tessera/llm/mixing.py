"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Documents of a source are laid out in the order of their ids and cut into blocks.  The
target weights give exact block quotas per source.  A binary tree over the output
shards splits the quotas: at each node the left half draws its blocks from the node's
blocks without replacement, by a multivariate hypergeometric law seeded by the node, and
the right half gets the rest.  Any task can walk the tree, so that a block's shard
follows from its number alone: nothing is joined, and the tree is never materialised.
Blocks are dealt by a keyed permutation of each source's block numbers, so the shards'
draws are disjoint; inside a shard documents are shuffled by a keyed hash.

Ranks within a source are exact without one task a source: ids are cut into ranges whose
counts are summed first.

Defined results: with a total, quotas follow the weights up to one block by largest
remainders, a source that has less gives all it has, and the others share the rest by
their weights; without a total, given weights take the largest quotas that keep them
exact, and where no weights are given either, every document is drawn, those without a
source too: once where its source has most for its weight, and more often elsewhere, so
that the draws have the weights' shares up to one document by largest remainders, and the
documents of a source differ by one draw at most.  Every draw of a document is dealt to a
shard by a permutation and a tree of its own.  Sources that given weights leave out or give 0, and documents beyond the
quotas, are not drawn; weights of sources without
documents are left out and the others scaled up; a last block may be short, and is
drawn like any other; rows with a null doc_id come first in their source; rows that
repeat an id are drawn as rows.  An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import named, partitions, plain

BLOCK = 8
SEED = 2
DOCS_PER_SHARD = 4096
NULL_SOURCE = "\x00null"


def block_quotas(counts: Mapping[str, int], weights: Mapping[str, float], block: int = BLOCK, total: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sources, blocks there are, blocks to draw), sources in order of their names; ``total`` counts documents."""
    names = sorted(s for s, w in weights.items() if w > 0 and counts.get(s, 0) > 0)
    have = np.array([-(-counts[s] // block) for s in names], dtype=np.int64)
    if not names:
        return names, have, have
    w = np.array([weights[s] for s in names], dtype=np.float64)
    w = w / w.sum()
    if total is not None:
        return names, have, _capped(have, w, min(-(-total // block), int(have.sum())))
    total = int(math.floor(min(h / x for h, x in zip(have, w)) + 1e-9))
    return names, have, np.minimum(_apportioned(w, total), have)


def _apportioned(w: np.ndarray, total: int) -> np.ndarray:
    """``total`` blocks by shares ``w``, up to one block by largest remainders."""
    want = np.floor(w * total + 1e-9).astype(np.int64)
    rest = w * total - want
    want[np.argsort(-rest, kind="stable")[: total - int(want.sum())]] += 1
    return want


def _capped(have: np.ndarray, w: np.ndarray, total: int) -> np.ndarray:
    """``total`` blocks by shares ``w``; sources with less give all, and the others share what is left."""
    out, left = np.zeros_like(have), np.arange(len(have))
    while len(left):
        room = total - int(out.sum())
        short = have[left] <= w[left] / w[left].sum() * room
        if not short.any():
            out[left] = np.minimum(_apportioned(w[left] / w[left].sum(), room), have[left])
            break
        out[left[short]] = have[left[short]]
        left = left[~short]
    return out


def draw_quotas(counts: Mapping[str, int], weights: Mapping[str, float]) -> tuple[list[str], np.ndarray]:
    """(sources, documents to draw), the fewest that have the weights' shares and draw every document of the sources."""
    names = sorted(s for s, w in weights.items() if w > 0 and counts.get(s, 0) > 0)
    n = np.array([counts[s] for s in names], dtype=np.int64)
    if not names:
        return names, n
    w = np.array([weights[s] for s in names], dtype=np.float64)
    w = w / w.sum()
    return names, np.maximum(_apportioned(w, math.floor((n / w).max() + 1e-6)), n)


def keyed_place(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at ``i``: a Feistel network over the next even power of 2, walked until it is inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        left, right = y >> np.uint64(half), y & mask
        for r in range(4):
            f = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f * np.uint64(0x94D049BB133111EB) >> np.uint64(32) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo & (x >= np.uint64(n))
    return x.astype(np.int64)


class SplittingTree:
    """Block quotas of the nodes over ``shards`` leaves; nodes are made when walked."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int = SEED):
        self.quotas, self.shards, self.seed = quotas, shards, seed
        self.nodes: dict[tuple[int, int], np.ndarray] = {}

    def left(self, lo: int, hi: int, quotas: np.ndarray) -> np.ndarray:
        """What the left half of the shards lo..hi-1 draws of the node's quotas."""
        if (lo, hi) not in self.nodes:
            mid, total = (lo + hi) // 2, int(quotas.sum())
            # shard sizes in blocks are even: shard k ends at block floor((k + 1) * all / shards)
            whole = int(self.quotas.sum())
            share = mid * whole // self.shards - lo * whole // self.shards
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            self.nodes[lo, hi] = rng.multivariate_hypergeometric(quotas, min(share, total), method="marginals")
        return self.nodes[lo, hi]

    def shard_of(self, source: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Shard of each block, given as (source number, place among the source's drawn blocks)."""
        out = np.zeros(len(source), np.int64)

        def walk(lo: int, hi: int, quotas: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
            if not len(rows):
                return
            if hi - lo == 1:
                out[rows] = lo
                return
            left, mid = self.left(lo, hi, quotas), (lo + hi) // 2
            cut = left[source[rows]]
            goes = at < cut
            walk(lo, mid, left, rows[goes], at[goes])
            walk(mid, hi, quotas - left, rows[~goes], at[~goes] - cut[~goes])

        walk(0, self.shards, self.quotas, np.arange(len(source)), place)
        return out

    def shard_quotas(self) -> np.ndarray:
        """Quotas of all shards, (shards, sources)."""
        out = np.zeros((self.shards, len(self.quotas)), np.int64)

        def walk(lo: int, hi: int, quotas: np.ndarray) -> None:
            if hi - lo == 1:
                out[lo] = quotas
                return
            left, mid = self.left(lo, hi, quotas), (lo + hi) // 2
            walk(lo, mid, left)
            walk(mid, hi, quotas - left)

        walk(0, self.shards, self.quotas)
        return out


@lru_cache(maxsize=64)
def _tree(quotas: tuple[int, ...], shards: int, seed: int) -> SplittingTree:
    """A worker keeps the nodes that it has walked from one batch to the next."""
    return SplittingTree(np.array(quotas, np.int64), shards, seed)


def tempered(counts: Mapping[str, int], power: float = 0.7) -> dict[str, float]:
    """Target weights proportional to a power of the counts, which lifts small sources."""
    return {s: float(n) ** power for s, n in counts.items()}


def source_counts(docs: DataFrame) -> dict[str, int]:
    """Documents per source; the number of sources is small by nature, as weights are listed by source."""
    return {r[0]: r[1] for r in docs.groupBy(F.coalesce(docs["source"].cast("string"), F.lit(NULL_SOURCE)).alias("s")).agg(F.count(F.lit(1))).collect()}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, docs_per_shard: int = DOCS_PER_SHARD, seed: int = SEED, total: int | None = None, spread: bool = False) -> DataFrame:
    """The drawn rows with __shard, __position, the place within the shard, and __shards, the shards of
    all draws of the row; these get underscores where ``docs`` has columns of these names.

    A row is here once, in the shard of its first draw.  With ``spread`` it is here once a draw.

    ``weights`` are target shares by source; without any, the counts to the power 0.7.
    With ``spread`` ranges of shards of about equal size lie in a partition each.
    ``total`` is the number of documents to draw, up to a block a source; without it and weights, all are
    drawn, those of sources that have less than their share more often.
    """
    counts = source_counts(docs)
    again = weights is None and total is None
    if weights is None:
        weights, total = tempered(counts), block * sum(-(-n // block) for n in counts.values()) if total is None else total
    names, have, quotas = block_quotas(counts, weights, block, total)
    drawn = int(quotas.sum()) if len(quotas) else 0
    shards = max(1, -(-drawn * block // docs_per_shard))
    number = {s: i for i, s in enumerate(names)}
    flat, at = plain(docs)
    source = F.coalesce(F.col(at["source"]).cast("string"), F.lit(NULL_SOURCE))
    lookup = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(number[s]))]) if names else F.lit(None).cast("map<string, int>")
    rows = flat.withColumn("source", F.element_at(lookup, source)).filter(F.col("source").isNotNull())
    rows = rows.withColumn("id", F.col(at["doc_id"]).cast("long")).withColumn("tie", F.xxhash64(at["text"]))
    rows = _ranked(rows, int(sum(counts[s] for s in names)))

    sizes, n_blocks, keys, n_shards = quotas.tolist(), have.tolist(), [seed * 1_000_003 + i for i in range(len(names))], shards
    n_docs = [counts[s] for s in names]
    n_draws = draw_quotas(counts, weights)[1].tolist() if again else n_docs

    @F.pandas_udf("array<long>")
    def shards_of(source: pd.Series, rank: pd.Series) -> pd.Series:
        s, at = source.to_numpy(np.int64), rank.to_numpy(np.int64)
        times = np.empty(len(s), np.int64)
        for k in np.unique(s):
            whole, rest = divmod(n_draws[k], n_docs[k])
            times[s == k] = whole + (keyed_place(at[s == k], n_docs[k], -1 - keys[k]) < rest) if rest else whole
        row, out = [], []
        for draw in range(int(times.max(initial=0))):
            todo = np.flatnonzero(times > draw)
            place = np.empty(len(todo), np.int64)
            for k in np.unique(s[todo]):
                mine = s[todo] == k
                place[mine] = keyed_place(at[todo[mine]] // block, n_blocks[k], keys[k] + draw * len(n_docs))
            inside = place < np.array(sizes)[s[todo]]
            row.append(todo[inside])
            out.append(_tree(tuple(sizes), n_shards, seed + draw * 1_000_003).shard_of(s[row[-1]], place[inside]))
        row, out = np.concatenate(row or [s[:0]]), np.concatenate(out or [s[:0]])
        bounds = np.r_[0, np.cumsum(np.bincount(row, minlength=len(s)))]
        out = out[np.argsort(row, kind="stable")]
        return pd.Series([out[a:b] for a, b in zip(bounds[:-1], bounds[1:])], dtype=object)

    # the optimizer would evaluate a deterministic function both for the filter and for the column
    dealt = rows.withColumn("shards", shards_of.asNondeterministic()("source", "rank")).filter(F.size("shards") > 0)
    if spread:
        dealt = dealt.select("*", F.posexplode("shards").alias("draw", "shard"))
    else:
        dealt = dealt.select("*", F.lit(0).alias("draw"), F.col("shards")[0].alias("shard"))
    dealt, by = dealt.withColumn("key", F.xxhash64(F.lit(seed), "source", "rank", "draw")), ["key", "source", "rank", "draw"]
    if spread:  # sorted here, as the optimizer leaves out a window whose position nobody reads
        dealt = dealt.repartitionByRange(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard", *by)
    order = Window.partitionBy("shard").orderBy(*by)
    return named(dealt.withColumn("position", F.row_number().over(order).cast("long") - 1), docs, __shard="shard", __position="position", __shards="shards")


def shuffled(docs: DataFrame, **how: object) -> DataFrame:
    """The drawn rows, once a draw, in the order of their shards and positions, with the columns of ``docs``."""
    mixed = mix(docs, spread=True, **how)
    return mixed.drop(*mixed.columns[len(docs.columns) :])


def _ranked(rows: DataFrame, total: int, per_range: int = 50_000) -> DataFrame:
    """``rows`` with their rank, the place among their source's in the order of id and tie.

    Ranges of ids of about equal counts keep each window small: the count of a source's
    earlier ranges is added to the place within the range.
    """
    parts = max(1, -(-total // per_range))
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        found = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0]
        bounds = np.unique(np.array(found or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="left").astype(np.int32))

    # not deterministic, so that it is evaluated once and not again for a filter on it
    cut = rows.withColumn("range", range_of.asNondeterministic()(F.coalesce("id", F.lit(0))))
    cut = cut.withColumn("range", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.col("range")))
    sums = cut.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # equal ids are told apart by their texts' hash, so that narrow queries move no texts
    within = Window.partitionBy("source", "range").orderBy("id", "tie")
    placed = cut.withColumn("r", F.row_number().over(within) - 1)
    joined = placed.join(sums, (placed["source"] == sums["s"]) & (placed["range"] == sums["g"]))
    return joined.withColumn("rank", F.col("before") + F.col("r"))
