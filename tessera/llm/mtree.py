"""Exact k nearest neighbours by an M-tree over all rows, searched best first.

The tree has three levels of routing objects.  The root's entries are at most FANOUT
pivots; under each hang the cells of its own pivots, PIVOTS at most in all, with their
distances to the parent.  A cell's vectors are cut by their distance to its pivot into
rings, and rings into nodes of about NODE vectors, so that no node grows with the table;
a ring that many equal distances fill is parted by id.  In a node's task the last level
is built: pages of at most PAGE vectors under pivots with covering radii and distances
to their parent.

Queries are the rows that ``asked`` holds for, every row by default.  A query is first
answered in its own node, which bounds its k-th distance.  Then it visits the nodes that
may hold a vector within the bound: an entry of the root is left out by its covering
radius, a cell before its distance is computed by the stored distance to its parent, a
ring by its two radii.  Inside a node pages are visited best first: the queries of a task
advance together, each to its next nearest page, until that page's bound exceeds the k-th
distance.  A node's vectors are sent to its task once for every QUERIES queries that
visit it, and not at all if none does.

Distances are Euclidean, which orders unit vectors as their cosine does.  They are
compared rounded to 6 digits, ties go to the lower id, and bounds leave room for that.

Defined results: rows with a null id or vector, a null or non-finite component, or
another dimension than most vectors, take no part; a row is no neighbour of rows with
its own id; rows that repeat id and vector are one; a query id with several vectors has
the nearest of all of them; with fewer than k others a query has as many neighbours as
there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.llm import textkit as tk
from tessera.llm.blocks import cut

PAGE = 64
CELL = 2048  # vectors a cell has on average, up to PIVOTS cells
FANOUT = 256
PIVOTS = FANOUT * FANOUT
NODE = 8192
RINGS = 64
QUERIES = 65_536
DIGITS = 6
_SLACK = 2e-6
_STEP = 1024  # queries that a search advances together


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b`` in double precision."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


class Cell:
    """The pages under one entry of the root."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, to_parent: np.ndarray):
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        ids, vectors, to_parent = ids[order], vectors[order], to_parent[order]
        routes = max(1, -(-n // (PAGE // 2)))
        at = np.unique(np.linspace(0, n - 1, routes).astype(int))
        near = np.concatenate([distances(vectors[i : i + 8192], vectors[at]).argmin(axis=1) for i in range(0, n, 8192)])
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pivots, parents, radii = [], [], []
        for k, p in enumerate(at):
            rows = np.flatnonzero(near == k)
            d = distances(vectors[rows], vectors[p : p + 1])[:, 0]
            rows, d = rows[np.argsort(d, kind="stable")], np.sort(d, kind="stable")
            for i in range(0, len(rows), PAGE):  # a full node splits by distance
                part = rows[i : i + PAGE]
                self.pages.append((ids[part], vectors[part], d[i : i + PAGE]))
                pivots.append(vectors[p])
                parents.append(to_parent[p])
                radii.append(d[i : i + PAGE].max())
        self.pivots, self.parents, self.radii = np.array(pivots), np.array(parents), np.array(radii)

    def search(self, ids: np.ndarray, queries: np.ndarray, to_parent: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, rounded distances) of each query's k best within its bound; -1 and infinity fill up."""
        m = len(ids)
        best_d, best_i = np.full((m, k), np.inf), np.full((m, k), -1, np.int64)
        # the parent's distances rule pages out before their pivots are looked at
        gap = np.abs(to_parent[:, None] - self.parents) - self.radii
        open_ = gap <= bound[:, None] + _SLACK
        to_pivot = np.full((m, len(self.pages)), np.inf)
        for p in np.flatnonzero(open_.any(axis=0)):
            rows = np.flatnonzero(open_[:, p])
            to_pivot[rows, p] = distances(queries[rows], self.pivots[p : p + 1])[:, 0]
        low = np.where(open_, np.maximum(to_pivot - self.radii, 0), np.inf)
        turn = np.argsort(low, axis=1, kind="stable")
        live = np.arange(m)
        for step in range(len(self.pages)):
            page = turn[live, step]
            go = low[live, page] <= np.minimum(bound[live], best_d[live, -1]) + _SLACK
            live, page = live[go], page[go]  # pages come in the order of their bounds, so these queries are done
            if not len(live):
                break
            for p in np.unique(page):
                rows = live[page == p]
                p_ids, p_vectors, p_dist = self.pages[p]
                limit = np.minimum(bound[rows], best_d[rows, -1]) + _SLACK
                near = np.abs(to_pivot[rows, p][:, None] - p_dist) <= limit[:, None]
                use = np.flatnonzero(near.any(axis=0))
                if not len(use):
                    continue
                d = np.round(distances(queries[rows], p_vectors[use]), DIGITS)
                d[~near[:, use] | (p_ids[use] == ids[rows][:, None]) | (d > bound[rows][:, None] + _SLACK)] = np.inf
                some = d.min(axis=1) <= best_d[rows, -1]
                rows, d = rows[some], d[some]
                all_d = np.concatenate([best_d[rows], d], axis=1)
                all_i = np.concatenate([best_i[rows], np.where(np.isfinite(d), p_ids[use], -1)], axis=1)
                top = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d[rows], best_i[rows] = np.take_along_axis(all_d, top, 1), np.take_along_axis(all_i, top, 1)
        return best_i, best_d


@dataclass
class Root:
    """The upper levels: pivots of the root's entries and of the cells under them."""

    tops: np.ndarray
    pivots: np.ndarray  # by entry of the root
    top_of: np.ndarray
    to_top: np.ndarray  # distance of each cell's pivot to its parent
    first: np.ndarray  # the first cell of each entry

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, distance to its parent's pivot) of each vector."""
        d = distances(x, self.tops)
        top = d.argmin(axis=1)
        cell, near = np.empty(len(x), np.int64), np.empty(len(x))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            own = distances(x[rows], self.pivots[self.first[t] : self.first[t + 1]])
            at = own.argmin(axis=1)
            cell[rows], near[rows] = self.first[t] + at, own[np.arange(len(rows)), at]
        return cell, near, d[np.arange(len(x)), top]


def root(picked: np.ndarray) -> Root:
    """Every picked vector is the pivot of a cell; the first of them are the root's entries."""
    tops = picked[: len(picked) if len(picked) <= FANOUT // 4 else min(FANOUT, int(np.ceil(np.sqrt(len(picked)))))]
    near = np.concatenate([distances(picked[i : i + 4096], tops).argmin(axis=1) for i in range(0, len(picked), 4096)])
    near[: len(tops)] = np.arange(len(tops))  # equal pivots keep an entry each
    order = np.argsort(near, kind="stable")
    pivots, top_of = picked[order], near[order]
    to_top = np.sqrt(((pivots - tops[top_of]) ** 2).sum(axis=1))
    return Root(tops, pivots, top_of, to_top, np.searchsorted(top_of, np.arange(len(tops) + 1)))


@dataclass
class Directory:
    """The nodes under the cells: rings [low, high] of distances to the pivot, each parted by id."""

    radius: np.ndarray  # covering radius of each entry of the root
    bounds: dict[int, np.ndarray]  # where the rings of a large cell part
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    first: np.ndarray  # the first node of each ring
    start: np.ndarray  # the first ring of each cell

    def node_of(self, cell: np.ndarray, d: np.ndarray, ids: np.ndarray) -> np.ndarray:
        ring = np.zeros(len(cell), np.int64)
        for c in np.unique(cell):
            if int(c) in self.bounds:
                rows = np.flatnonzero(cell == c)
                ring[rows] = np.searchsorted(self.bounds[int(c)], d[rows], side="left")
        at = self.start[cell] + ring
        return self.first[at] + (tk.mix(ids.astype(np.int64).view(np.uint64)) % self.parts[at].astype(np.uint64)).astype(np.int64)


def _rings(bounds: dict[int, np.ndarray], cells: int, found: list[tuple], radius: np.ndarray) -> Directory:
    """A directory of the rings (cell, ring, rows, low, high); a ring without rows stays empty."""
    per = np.array([len(bounds.get(c, ())) + 1 for c in range(cells)])
    start = np.r_[0, np.cumsum(per)]
    n = int(start[-1])
    low, high, parts = np.full(n, np.inf), np.full(n, -np.inf), np.ones(n, np.int64)
    for c, r, rows, a, b in found:
        low[start[c] + r], high[start[c] + r], parts[start[c] + r] = a, b, -(-rows // NODE)
    return Directory(radius, bounds, np.repeat(np.arange(cells), per), low, high, parts, np.r_[0, np.cumsum(parts)][:-1], start)


def visits(tree: Root, nodes: Directory, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, distance to its cell's pivot) of all nodes that may hold a vector within a query's bound."""
    limit = bound + _SLACK
    to_tops = distances(x, tree.tops)
    out = []
    for t in range(len(tree.tops)):
        rows = np.flatnonzero(to_tops[:, t] - nodes.radius[t] <= limit)
        a, b = tree.first[t], tree.first[t + 1]
        if not len(rows) or a == b:
            continue
        r0, r1 = nodes.start[a], nodes.start[b]
        ring_cell = nodes.cell[r0:r1] - a
        reach = np.full(b - a, -np.inf)
        np.maximum.at(reach, ring_cell, nodes.high[r0:r1])
        maybe = (np.abs(to_tops[rows, t][:, None] - tree.to_top[a:b]) - reach <= limit[rows][:, None]).any(axis=0)
        some = np.flatnonzero(maybe)
        if not len(some):
            continue
        d = np.full((len(rows), b - a), np.inf)
        d[:, some] = distances(x[rows], tree.pivots[a:b][some])
        of_ring = d[:, ring_cell]
        with np.errstate(invalid="ignore"):
            go = np.maximum(of_ring - nodes.high[r0:r1], nodes.low[r0:r1] - of_ring) <= limit[rows][:, None]
        q, ring = np.nonzero(go & np.isfinite(nodes.low[r0:r1]))
        many = nodes.parts[r0 + ring]
        out.append((np.repeat(rows[q], many), np.repeat(nodes.first[r0 + ring], many) + tk.ranges(many), np.repeat(of_ring[q, ring], many)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype: str) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_matrix(c, dim, dtype) for c in column.chunks] or [np.zeros((0, dim))])
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim).astype(np.float64)


def _binary(x: np.ndarray, dtype: str) -> pa.Array:
    x = np.ascontiguousarray(x, dtype)
    offsets = (np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def nearest(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", asked: Column | None = None) -> DataFrame:
    """(vec_id, neighbor_id, rank, distance) of the k nearest other rows of every row that is asked for."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    dtype = "f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "f8"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), F.coalesce(asked if asked is not None else F.lit(True), F.lit(False)).alias("q"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.size("v") > 0)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "vec_id long, neighbor_id long, rank int, distance double")
    dim, n = sizes[0]
    rows = rows.filter(F.size("v") == dim)
    picked = rows.orderBy(F.xxhash64("id"), "id", "v").limit(min(PIVOTS, max(1, -(-n // CELL)))).select("v").collect()
    tree = root(np.array([r[0] for r in picked], np.float64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.parts(batches, 4096):
            x = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            cell, d, far = tree.place(x)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), _binary(x, dtype), pa.array(d), pa.array(far), batch.column("q")], names=["cell", "id", "vec", "d", "far", "q"])

    placed = cut(rows.mapInArrow(place, "cell int, id long, vec binary, d double, far double, q boolean"))
    nodes = _directory(placed, tree)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = nodes.node_of(batch.column("cell").to_numpy(), batch.column("d").to_numpy(), batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), *(batch.column(c) for c in ("id", "vec", "d"))], names=["node", "id", "vec", "d"])

    numbered = "node int, id long, vec binary, d double"
    data = placed.select("cell", "id", "vec", "d").mapInArrow(number, numbered)
    own = placed.filter("q").select("cell", "id", "vec", "d").mapInArrow(number, numbered).withColumn("bound", F.lit(float("inf")))
    first = cut(_visited(data, own, k, dim, dtype))
    reach = first.groupBy("id", "vec").agg(F.max("last").alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.parts(batches, _STEP):
            x, bound, home = _matrix(batch.column("vec"), dim, dtype), batch.column("bound").to_numpy(), batch.column("node").to_numpy()
            q, node, d = visits(tree, nodes, x, bound)
            other = node != home[q]
            q, node, d = q[other], node[other], d[other]
            for j in range(0, len(q), 8192):
                s = slice(j, j + 8192)
                at = pa.array(q[s])
                yield pa.RecordBatch.from_arrays([pa.array(node[s], pa.int32()), batch.column("id").take(at), batch.column("vec").take(at), pa.array(d[s]), pa.array(bound[q[s]])], names=["node", "id", "vec", "d", "bound"])

    homes = own.select("id", "vec", "node").distinct()
    more = cut(homes.join(reach, ["id", "vec"]).mapInArrow(route, f"{numbered}, bound double"))
    every = first.select("id", "hits").unionByName(_visited(data, more, k, dim, dtype).select("id", "hits"))
    flat = every.select("id", F.inline("hits"))
    best = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    top = flat.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k).distinct()
    return top.select(F.col("id").alias("vec_id"), "neighbor_id", F.col("rank").cast("int").alias("rank"), "distance")


def _directory(placed: DataFrame, tree: Root) -> Directory:
    cells = len(tree.pivots)
    radius = np.full(len(tree.tops), -np.inf)
    found, large = [], []
    for c, rows, low, high, far in placed.groupBy("cell").agg(F.count(F.lit(1)), F.min("d"), F.max("d"), F.max("far")).collect():
        radius[tree.top_of[c]] = max(radius[tree.top_of[c]], far)
        if rows > NODE:
            large.append(c)
        else:
            found.append((c, 0, rows, low, high))
    bounds: dict[int, np.ndarray] = {}
    if large:
        some = placed.filter(F.col("cell").isin(large)) if len(large) < cells else placed
        at = [i / RINGS for i in range(1, RINGS)]
        bounds = {c: np.unique(q) for c, q in some.groupBy("cell").agg(F.percentile_approx("d", at, 1000)).collect()}
        lookup = placed.sparkSession.createDataFrame([(c, q.tolist()) for c, q in bounds.items()], "cell int, q array<double>")
        ring = F.size(F.filter("q", lambda b: b < F.col("d")))
        counts = some.select("cell", "d").join(F.broadcast(lookup), "cell").groupBy("cell", ring.alias("ring")).agg(F.count(F.lit(1)), F.min("d"), F.max("d"))
        found += [tuple(r) for r in counts.collect()]
    return _rings(bounds, cells, found, radius)


def _visited(data: DataFrame, asked: DataFrame, k: int, dim: int, dtype: str) -> DataFrame:
    """(id, vec, last, hits) of each visit: the query's k best of a node within its bound, and the k-th distance."""
    count = {r[0]: -(-r[1] // QUERIES) for r in asked.groupBy("node").agg(F.count(F.lit(1))).collect()}
    size = max(count, default=-1) + 1
    chunks = np.zeros(size + 1, np.int32)  # the last place stands for nodes that no query visits
    for node, c in count.items():
        chunks[node] = c

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = chunks[np.minimum(batch.column("node").to_numpy(), size)].astype(np.int64)
            part = batch.take(pa.array(np.repeat(np.arange(len(many)), many)))
            yield part.append_column("chunk", pa.array(tk.ranges(many), pa.int32()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = chunks[batch.column("node").to_numpy()].astype(np.uint64)
            key = tk.mix(batch.column("id").to_numpy().view(np.uint64)) >> np.uint64(20)
            yield batch.append_column("chunk", pa.array((key % c).astype(np.int32)))

    hit = pa.list_(pa.struct([("neighbor_id", pa.int64()), ("distance", pa.float64())]))
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary()), ("last", pa.float64()), ("hits", hit)])

    def visit(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, x, d = rows.column("id").to_numpy(), _matrix(rows.column("vec"), dim, dtype), rows.column("d").to_numpy()
        order = np.lexsort((*x.T, ids))
        new = np.r_[True, (ids[order][1:] != ids[order][:-1]) | (x[order][1:] != x[order][:-1]).any(axis=1)]
        keep = order[new]
        cell, out = Cell(ids[keep], x[keep], d[keep]), []
        for i in range(0, queries.num_rows, _STEP):
            q = queries.slice(i, _STEP)
            who = q.column("id").to_numpy()
            best_i, best_d = cell.search(who, _matrix(q.column("vec"), dim, dtype), q.column("d").to_numpy(), q.column("bound").to_numpy(), k)
            there = best_i >= 0
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(axis=1))], pa.int32()), pa.StructArray.from_arrays([pa.array(best_i[there]), pa.array(best_d[there])], names=["neighbor_id", "distance"]))
            out.append(pa.table([q.column("id"), q.column("vec"), pa.array(best_d[:, -1]), lists], schema=schema))
        return pa.concat_tables(out)

    copies = data.mapInArrow(spread, "node int, id long, vec binary, d double, chunk int")
    dealt = asked.mapInArrow(deal, "node int, id long, vec binary, d double, bound double, chunk int")
    return copies.groupBy("node", "chunk").cogroup(dealt.groupBy("node", "chunk")).applyInArrow(visit, "id long, vec binary, last double, hits array<struct<neighbor_id: long, distance: double>>")
