"""Repeated passages by a blockwise suffix array over words with a difference cover.

Suffixes start at words (maximal runs of bytes that aren't ASCII white space) and end
with their document.  What a dedup needs of the suffix array is which suffixes tie with
a neighbour on at least ``MIN_WORDS`` words.  Two such suffixes p and q have, by the
cover property of COVER modulo PERIOD, a shift d < PERIOD at which both p+d and q+d are
cover samples, and the samples still share MIN_WORDS - PERIOD + 1 words.  So

1. only the cover samples (6 of 31 positions) of all documents are ranked, by the name
   of their prefix, one bucket of names at a time;
2. a suffix can be in a long tie only if a sample within its next PERIOD words has a
   rank that it shares: the sample ranks settle every other suffix without moving it;
3. the suffixes left are spread over buckets and sorted one bucket at a time by their
   MIN_WORDS-word prefix; neighbours that tie are repeated.

Where this bends the method: suffixes and samples are ordered by names, hashes of the
words of a prefix, and not letter by letter, and only to the depth of the threshold.
Ties are what a dedup needs, and names tell them at any offset; ranks of samples to full
depth would take a round of prefix doubling for each doubling of the longest repeat, each
a shuffle of all tied samples.

A task holds a partition of samples, or a home bucket's texts with its tied samples;
both follow the session's shuffle partitions.  Sample names may be short, since a false
tie among them only adds candidates; the names that decide have 96 bits, of two hashes.

Defined results: a passage counts where another document, that is another doc_id, has it
too; what only one document repeats, such as a line that it has again and again, isn't
a repeat across documents.  Null and empty texts, and texts under MIN_WORDS words, have no
repeated passage; exact and near copies of a document repeat each other's passages; rows
that repeat a doc_id are one document, rows without one are each their own; spans of a
row that touch or overlap are one.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit as tk
from tessera.llm.blocks import Scatter, blob, gather, named, partitions, plain, runs

MIN_WORDS = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
BLOCKS_PER_PARTITION = 4

_SAMPLE = {"name": "u4", "low": "u4", "high": "u2", "at": "u4"}
_TIED = {"low": "u4", "high": "u2", "at": "u4"}
_SUFFIX = {"name": "u8", "more": "u8", "place": "u4"}
_NO = np.iinfo(np.int64).min
_SECOND = np.uint64(0xA0761D6478BD642F)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Whether the differences of ``cover`` reach every residue of ``period``."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _uids(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    return tk.mix(np.where(valid, ids, _NO).astype(np.int64).view(np.uint64)) & np.uint64(2**48 - 1)


def _home(uid: np.ndarray, n: int) -> np.ndarray:
    return (uid % np.uint64(n)).astype(np.int32)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("doc_id")
    return pc.fill_null(column, _NO).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _samples(batches: Iterator[pa.RecordBatch], blocks: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """The names of the cover samples' prefixes, by block of names."""
    width = min_words - PERIOD + 1
    out = Scatter(_SAMPLE)
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    for batch in batches:
        uid = _uids(*_ids(batch))
        for i, j, data, offsets in tk.slices(batch.column("text")):
            starts, ends, count = tk.word_spans(data, offsets)
            n = np.diff(count)
            n = np.where(n >= min_words, n - width + 1, 0)
            if not n.any():
                continue
            words = tk.span_hashes(data, starts, ends)
            at = tk.ranges(n)
            keep = inside[at % PERIOD]
            row = np.repeat(np.arange(j - i), n)[keep]
            at = at[keep]
            name = tk.window_hashes(words, count[row] + at, width)
            owner = uid[i:j][row]
            yield from out.add(((name >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32), name=name.astype(np.uint32), low=owner.astype(np.uint32), high=(owner >> np.uint64(32)).astype(np.uint16), at=at.astype(np.uint32))
    yield from out.flush()


def _tied_samples(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """Samples that share their rank, by the home bucket of their document."""
    out = Scatter(_TIED)
    for _, rows in gather(batches, _SAMPLE):
        order = np.argsort(rows["name"])
        start, size = runs(rows["name"][order])
        tied = order[np.repeat(size > 1, size)]
        uid = rows["high"][tied].astype(np.uint64) << np.uint64(32) | rows["low"][tied]
        yield from out.add(_home(uid, homes), low=rows["low"][tied], high=rows["high"][tied], at=rows["at"][tied])
    yield from out.flush()


def _candidates(docs: pa.Table, tied: pa.Table, blocks: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """Suffixes that a shared rank leaves open, and the bucket's directory of documents."""
    uid_t = blob(tied.column("high"), "u2").astype(np.uint64) << np.uint64(32) | blob(tied.column("low"), "u4")
    at_t = blob(tied.column("at"), "u4").astype(np.int64)
    order = np.argsort(uid_t, kind="stable")
    uid_t, at_t = uid_t[order], at_t[order]
    out = Scatter(_SUFFIX)
    home = docs.column("home")[0].as_py()
    base = 0
    directory: list[tuple[np.ndarray, ...]] = []
    for batch in docs.to_batches():
        ids, valid = _ids(batch)
        uid = _uids(ids, valid)
        lo, hi = np.searchsorted(uid_t, uid, side="left"), np.searchsorted(uid_t, uid, side="right")
        rows = np.flatnonzero(hi > lo)
        if not len(rows):
            continue
        ids, valid, lo, hi = ids[rows], valid[rows], lo[rows], hi[rows]
        for i, j, data, offsets in tk.slices(batch.column("text").take(pa.array(rows))):
            starts, ends, count = tk.word_spans(data, offsets)
            n = np.diff(count)
            words = tk.span_hashes(data, starts, ends)
            per = hi[i:j] - lo[i:j]
            row = np.repeat(np.arange(j - i), per)
            at = at_t[np.repeat(lo[i:j], per) + tk.ranges(per)]
            real = at < n[row]  # another document of the same short owner name may be longer
            row, at = row[real], at[real]
            # a tied sample at s opens the suffixes s-PERIOD+1 .. s
            begin = count[row] + np.maximum(at - PERIOD + 1, 0)
            open_ = np.zeros(len(words) + 1, np.int64)
            np.add.at(open_, begin, 1)
            np.add.at(open_, count[row] + at + 1, -1)
            place = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
            owner = np.searchsorted(count, place, side="right") - 1
            place = place[place - count[owner] + min_words <= n[owner]]
            name = tk.window_hashes(words, place, min_words)
            second = tk.window_hashes(tk.mix(words ^ _SECOND), place, min_words) >> np.uint64(32) << np.uint64(32)
            who = np.where(valid[i:j], tk.mix(ids[i:j].astype(np.int64).view(np.uint64)), tk.mix((base + count[:-1]).astype(np.uint64) ^ np.uint64(home << 40 | 1 << 39)))
            if base + len(words) >= 1 << 32:
                raise OverflowError("a home bucket of over 2**32 words: raise spark.sql.shuffle.partitions")
            yield from _marked(out.add((name % np.uint64(blocks)).astype(np.int32), name=name, more=second | who[owner_of(place, count)] >> np.uint64(32), place=(base + place).astype(np.uint32)), home)
            directory.append((np.where(valid[i:j], ids[i:j], _NO), base + count[:-1]))
            base += len(words)
    yield from _marked(out.flush(), home)
    if directory:
        ids, first = (np.concatenate(x) for x in zip(*directory))
        order = np.argsort(first, kind="stable")
        yield pa.RecordBatch.from_arrays([pa.array([-1 - home], pa.int32()), pa.array([first[order].astype(np.int64).tobytes()], pa.binary()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([home], pa.int32())], names=["bucket", "name", "place", "home"]).add_column(2, "more", pa.array([b""], pa.binary()))


def owner_of(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The row of each word of a slice."""
    return np.searchsorted(count, place, side="right") - 1


def _marked(batches: Iterator[pa.RecordBatch], home: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("home", pa.array(np.full(batch.num_rows, home, np.int32)))


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket of suffixes at a time; what ties with a neighbour goes home."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        for b in np.unique(bucket):
            rows = batch.filter(pa.array(bucket == b))
            if b < 0:  # a directory passes through
                yield rows.select(["home", "name", "place"])
            else:
                held.setdefault(int(b), []).append(rows)
    for b in sorted(held):
        rows = held.pop(b)
        name = np.concatenate([blob(r.column("name"), "u8") for r in rows])
        more = np.concatenate([blob(r.column("more"), "u8") for r in rows])
        place = np.concatenate([blob(r.column("place"), "u4") for r in rows])
        home = np.concatenate([np.repeat(r.column("home").to_numpy(), pc.divide(pc.binary_length(r.column("place")), 4).to_numpy()) for r in rows])
        order = np.lexsort((more, name))
        n, m = name[order], more[order]
        if not len(n):
            continue
        start = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (m[1:] >> np.uint64(32) != m[:-1] >> np.uint64(32))])
        size = np.diff(np.r_[start, len(n)])
        # within a tie owners are in order: the first and last differ where several documents have it
        hit = order[np.repeat(m[start] != m[start + size - 1], size)]
        hit = hit[np.lexsort((place[hit], home[hit]))]
        s, c = runs(home[hit])
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(home[hit][s], pa.int32()), pa.array([b""] * len(s), pa.binary()), pa.array([place[hit][i : i + k].tobytes() for i, k in zip(s, c)], pa.binary())], names=["home", "name", "place"])


def _spans(rows: pa.Table, min_words: int) -> pa.Table:
    """Merges a home bucket's repeated suffixes into spans of words of its documents."""
    first = ids = None
    hits = []
    for batch in rows.to_batches():
        for name, place in zip(batch.column("name").to_pylist(), batch.column("place").to_pylist()):
            if name:
                first, ids = np.frombuffer(name, np.int64), np.frombuffer(place, np.int64)
            else:
                hits.append(np.frombuffer(place, np.uint32))
    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    if first is None or not hits:
        return schema.empty_table()
    place = np.sort(np.concatenate(hits).astype(np.int64))
    owner = np.searchsorted(first, place, side="right") - 1
    new = np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + min_words)]
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:] - 1, len(place) - 1]
    own = owner[begin]
    doc = ids[own]
    return pa.table([pa.array(doc, mask=doc == _NO), pa.array(place[begin] - first[own]), pa.array(place[last] + min_words - first[own])], schema=schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word): the maximal spans of words, end exclusive, covered by
    ``min_words``-word passages that several documents have."""
    if min_words < PERIOD:
        raise ValueError(f"min_words must be at least {PERIOD}")
    n = partitions(docs.sparkSession)
    blocks = n * BLOCKS_PER_PARTITION
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.mapInArrow(lambda it: _samples(it, blocks, min_words), "bucket int, name binary, low binary, high binary, at binary")
    tied = sample.repartition(n, "bucket").mapInArrow(lambda it: _tied_samples(it, n), "bucket int, low binary, high binary, at binary")
    homes = rows.mapInArrow(lambda it: _homes(it, n), "home int, doc_id long, text string")
    open_ = homes.groupBy("home").cogroup(tied.groupBy("bucket")).applyInArrow(lambda a, b: _cogroup(a, b, blocks, min_words), "bucket int, name binary, more binary, place binary, home int")
    ties = open_.repartition(n, "bucket").mapInArrow(_ties, "home int, name binary, place binary")
    return ties.groupBy("home").applyInArrow(lambda t: _spans(t, min_words), "doc_id long, start_word long, end_word long")


def _homes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("text")))
        home = _home(_uids(*_ids(batch)), n)
        yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), batch.column("doc_id"), batch.column("text")], names=["home", "doc_id", "text"])


def _cogroup(docs: pa.Table, tied: pa.Table, blocks: int, min_words: int) -> pa.Table:
    schema = pa.schema([("bucket", pa.int32()), ("name", pa.binary()), ("more", pa.binary()), ("place", pa.binary()), ("home", pa.int32())])
    if not docs.num_rows or not tied.num_rows:
        return schema.empty_table()
    return pa.Table.from_batches(list(_candidates(docs, tied, blocks, min_words)), schema=schema)


def remove_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans``; what stays is joined with the white space before it.

    Texts without a span stay as they are.
    """
    cuts = spans.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("__cuts"))

    @F.pandas_udf("string")
    def without(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, s in zip(text, spans):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            raw = t.encode()
            data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
            starts, ends, _ = tk.word_spans(data, offsets)
            parts, at = [], 0
            for x in s:
                a, b = x["start_word"], x["end_word"]
                parts.append(raw[at : starts[a]])
                at = int(ends[b - 1])
            parts.append(raw[at:])
            out.append(b"".join(parts).decode())
        return pd.Series(out, dtype=object)

    rows, at = plain(docs)
    joined = rows.join(cuts, F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("__id")), "left")
    return named(joined.withColumn(at["text"], without(at["text"], "__cuts")), docs)
