"""Exact duplicates by distributed MSD radix partitioning; no digest takes part.

The digits of a document are its length in bytes, then its bytes from the first on.
Map tasks split their own rows by all digits and pass each distinct text on once, with
the ids of its copies, so that a text with any number of copies is moved at most once
per task.  The distinct texts then meet in buckets of their leading digits (length and
first bytes), where the recursion goes on until every group is a single text or its
documents have ended.  Two documents are equal only where all their bytes were compared.

Defined results: a null text equals no other; empty texts equal each other; the copy
with the lowest doc_id stays (null ids come last); rows that repeat a doc_id count as
copies of each other where their texts are equal.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.blocks import lean, named, partitions, plain

LEAD = 24
NO_ID = np.iinfo(np.int64).max


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _digits(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from ``begin`` on as fixed-width byte strings; zeros after the end."""
    at = begin[:, None] + np.arange(width)
    inside = at < end[:, None]
    out = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return np.ascontiguousarray(out).view(">u8")


def equal_groups(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Group number of each text: MSD radix recursion over all texts level by level.

    Level 0 splits by length, level 1 on by 8, 16, ... up to 4,096 successive bytes.
    Groups of one text, and groups whose documents have ended, leave the recursion.
    """
    n = len(offsets) - 1
    begin, end = offsets[:-1].copy(), offsets[1:]
    result = np.arange(n)
    if n < 2:
        return result
    group = np.unique(end - begin, return_inverse=True)[1]
    alive = np.arange(n)
    width = 8
    while len(alive):
        size = np.bincount(group)
        alive, group = alive[size[group] > 1], group[size[group] > 1]
        if not len(alive):
            break
        ended = begin[alive] >= end[alive]
        if ended.any():
            # all of a group end together, for they have one length
            order = np.argsort(group[ended], kind="stable")
            rows, g = alive[ended][order], group[ended][order]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            result[rows] = np.repeat(rows[first], np.diff(np.r_[first, len(g)]))
            alive, group = alive[~ended], group[~ended]
            if not len(alive):
                break
        step = max(8, min(width, (1 << 22) // len(alive) // 8 * 8))
        words = _digits(data, begin[alive], end[alive], step)
        order = np.lexsort((*words.T[::-1], group))
        s, g = words[order], group[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]).any(axis=1)]
        group = np.empty(len(alive), np.int64)
        group[order] = np.cumsum(new) - 1
        begin[alive] += step
        width = min(width * 2, 4096)
    return result


def _collapse(ids: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(a row of the group, the sorted ids of all its rows) of each group of equal texts."""
    group = equal_groups(data, offsets)
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, int)
    for a, b in zip(start, np.r_[start[1:], len(order)].astype(int)):
        rows = order[a:b]
        yield int(rows[0]), np.sort(np.concatenate([ids[r] for r in rows])) if b - a > 1 else ids[rows[0]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.compute.is_valid(batch.column("text")))
        if not batch.num_rows:
            continue
        ids = pa.compute.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
        texts = batch.column("text")
        data, offsets = _buffers(texts)
        take, lists = zip(*_collapse([ids[i : i + 1] for i in range(len(ids))], data, offsets), strict=True)
        take = np.array(take)
        lead = _digits(data, offsets[take], offsets[take + 1], LEAD)
        out = [pa.array((offsets[take + 1] - offsets[take]).astype(np.int64)), pa.array([x.tobytes() for x in lead], pa.binary()), texts.take(pa.array(take)).cast(pa.string()), pa.array(lists, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, names=["digit_len", "digit_lead", "text", "ids"])


def _wide(batches: list[pa.RecordBatch]) -> pa.Table:
    """One table whose texts have wide offsets, as a partition's may be over 2 GB together."""
    table = pa.Table.from_batches(batches)
    at = table.schema.get_field_index("text")
    return table.set_column(at, "text", table.column("text").cast(pa.large_string())).combine_chunks()


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    if not rows:
        return
    table = _wide(rows)
    values = table.column("ids").combine_chunks() if table.num_rows else None
    if values is None:
        return
    flat, off = values.values.to_numpy(), values.offsets.to_numpy()
    ids = [flat[off[i] : off[i + 1]] for i in range(table.num_rows)]
    data, offsets = _buffers(table.column("text"))
    gone, kept = [], []
    for _, members in _collapse(ids, data, offsets):
        if len(members) > 1:
            gone.append(members[1:])
            kept.append(np.full(len(members) - 1, members[0]))
    if gone:
        a, b = np.concatenate(gone), np.concatenate(kept)
        yield pa.RecordBatch.from_arrays([pa.array(a, mask=a == NO_ID), pa.array(b, mask=b == NO_ID)], names=["doc_id", "kept_doc_id"])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) for every row whose text another row with a lower id has too."""
    lean(docs.sparkSession)
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    split = rows.mapInArrow(tk.trimmed(_local), "digit_len long, digit_lead binary, text string, ids array<long>")
    return split.repartition(n, "digit_len", "digit_lead").mapInArrow(tk.trimmed(_final), "doc_id long, kept_doc_id long")


def _first_rows(batches: Iterator[pa.RecordBatch], lead: bool) -> Iterator[pa.RecordBatch]:
    """The row with the lowest id of each group of equal texts; rows without a text all stay."""
    for batch in batches:
        valid = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
        ids = pa.compute.fill_null(batch.column("id"), NO_ID).to_numpy()
        data, offsets = _buffers(batch.column("text").fill_null(""))
        group = equal_groups(data, offsets)
        group = np.where(valid, group, len(group) + np.arange(len(group)))
        order = np.lexsort((ids, group))
        first = np.sort(order[np.r_[True, np.diff(group[order]) != 0]]) if len(order) else order
        out = batch.take(pa.array(first))
        if lead:
            out = out.append_column("digit_len", pa.array(np.where(valid, np.diff(offsets), -1 - np.abs(ids % 997))[first]))
            out = out.append_column("digit_lead", pa.array([x.tobytes() for x in _digits(data, offsets[first], offsets[first + 1], LEAD)], pa.binary()))
        yield out


def _first_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    if rows:
        table = _wide(rows)
        for batch in _first_rows(iter(table.to_batches()), False):
            yield batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").cast(pa.string()))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a row with a lower doc_id has; all columns stay.

    The rows travel with their other columns, so nothing is joined back, and of rows that
    repeat doc_id and text exactly one stays.  Rows with a null text all stay.
    """
    lean(docs.sparkSession)
    n = partitions(docs.sparkSession)
    flat, at = plain(docs)
    rows = flat.select(F.col(at["doc_id"]).cast("long").alias("id"), F.col(at["text"]).cast("string").alias("text"), F.struct(*[c for c in flat.columns if c != at["text"]]).alias("rest"))
    schema = f"id long, text string, rest {_ddl(rows)}"
    split = rows.mapInArrow(tk.trimmed(_first_rows, True), schema + ", digit_len long, digit_lead binary")
    first = split.repartition(n, "digit_len", "digit_lead").select("id", "text", "rest").mapInArrow(tk.trimmed(_first_of_all), schema)
    return named(first.select(*[F.col("text").cast(flat.schema[c].dataType).alias(c) if c == at["text"] else F.col("rest").getField(c).alias(c) for c in flat.columns]), docs)


def _ddl(rows: DataFrame) -> str:
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["rest"].dataType.fields)
    return f"struct<{inner}>"
