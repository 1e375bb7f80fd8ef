"""Sparse retrieval: BM25 with phrases and branches over a postings table.

``postings`` is made once per snapshot, row by row: a chunk's task has all its tokens, so
nothing is shuffled, and each distinct term of a batch is stemmed once.  A query becomes
branches of phrases: one branch holds all content words and only counts where each of its
phrases occurs; every exact technical name is a branch of its own.  Queries without a hit
are answered with every word as a branch.  Both come from one pass over the postings of
the batch's terms: a query's words are the same phrases either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.porter import stem
from tessera.operators.shared import lean, written

K1, B = 1.2, 0.75
FIELDS = ("text", "heading", "code")
WEIGHTS = (1.0, 10.0, 5.0)
EVEN = (1.0, 1.0, 1.0)
DEFAULT_K = 10
#: Phrases of a batch that travel to all tasks.
SMALL = 500_000
#: Pairs of a query and a chunk that a task scores at once.
PAIRS = 1 << 18
#: How far apart scores may be that are equal to the digits that they are compared to, and more.
ROUNDING = 4e-9
POSTINGS = "corpus_id string, chunk_id string, revision_id string, field tinyint, term string, positions array<int>, length bigint"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column, stemmed: bool = True) -> Column:
    """Index tokens: ASCII letters lowered, split at ASCII characters that are neither letters
    nor digits; all other characters belong to tokens."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAK)
    parts = F.filter(parts, lambda w: w != "")
    if not stemmed:
        return parts

    @F.pandas_udf("array<string>")
    def stems(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: [stem(w) for w in ws])

    return stems(parts)


def _posted(batches: Iterator[pa.RecordBatch], stemmed: bool) -> Iterator[pa.RecordBatch]:
    """The postings of chunks whose fields are lists of tokens."""
    for batch in batches:
        for field in range(len(FIELDS)):
            lists = batch.column(FIELDS[field])
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), count)
            if not len(row):
                continue
            place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            coded = pc.dictionary_encode(pc.list_flatten(lists))
            code, words = coded.indices.to_numpy(), coded.dictionary
            if stemmed:
                merged = pc.dictionary_encode(pa.array([stem(w) for w in words.to_pylist()], pa.string()))
                code, words = merged.indices.to_numpy()[code], merged.dictionary
            order = np.lexsort((place, code, row))
            r, c = row[order], code[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
            at = pa.array(r[first])
            positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)], pa.int32()), pa.array(place[order]))
            columns = [batch.column("corpus_id").take(at), batch.column("chunk_id").take(at), batch.column("revision_id").take(at), pa.array(np.full(len(first), field, np.int8)), words.take(pa.array(c[first])), positions, batch.column("length").take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in POSTINGS.split(", ")])


def postings(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """(corpus_id, chunk_id, revision_id, field, term, positions, length) of chunks (corpus_id, chunk_id,
    text, heading, code and perhaps revision_id); length counts the chunk's tokens over all fields."""
    revision = F.col("revision_id") if "revision_id" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.select("corpus_id", "chunk_id", revision.alias("revision_id"), *[tokens(F.col(name), False).alias(name) for name in FIELDS])
    rows = rows.withColumn("length", sum((F.size(name) for name in FIELDS[1:]), F.size(FIELDS[0])).cast("bigint"))
    return rows.mapInArrow(lean(rows, lambda it: _posted(it, stemmed)), POSTINGS)


def statistics(chunks: DataFrame) -> DataFrame:
    """One row (n_docs, total) over all corpora: chunks, those without a token too, and their tokens."""
    size = sum((F.size(tokens(F.col(name), False)) for name in FIELDS[1:]), F.size(tokens(F.col(FIELDS[0]), False)))
    return chunks.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total"))


def phrases(queries: DataFrame, stemmed: bool = True, ascii_borders: bool = False) -> DataFrame:
    """(query_id, corpus_id, top_k, branch, phrase, terms): the phrases of each query's branches.

    Branch 0 holds the content words; each boosted name is a branch.  Words without an
    index token are dropped.
    """
    base = F.transform(T.content_words(F.col("text")), lambda w, i: F.struct(F.lit(0).alias("branch"), i.alias("phrase"), w.alias("word")))
    boost = F.transform(T.boost_words(F.col("text"), ascii_borders), lambda w, i: F.struct((i + 1).alias("branch"), F.lit(0).alias("phrase"), w.alias("word")))
    flat = queries.select("query_id", "corpus_id", "top_k", F.explode(F.concat(base, boost)).alias("p"))
    flat = flat.select("query_id", "corpus_id", "top_k", "p.branch", "p.phrase", tokens(F.col("p.word"), stemmed).alias("terms"))
    return flat.filter(F.size("terms") > 0)


def scores(asked: DataFrame, posts: DataFrame, stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, default_k: int = DEFAULT_K) -> DataFrame:
    """(query_id, chunk_id, strict, score, top_k) of chunks with a phrase of a query (``phrases``), the best at least.

    ``strict`` says whether a branch holds: then the score sums the branches that do, else
    all content words.  The postings of the batch's terms move once, to their chunk; there a
    task scores blocks of chunks and lets through what can be among the best of a query, so
    that pairs of query and chunk are never a table.  A batch of more than SMALL phrases is
    joined by shuffles instead, and all pairs are returned.
    """
    asked = written(asked)
    small = asked.count() <= SMALL
    near = F.broadcast if small else (lambda rows: rows)
    # phrases are looked up once, however many queries have them
    wanted = written(asked.select("terms").distinct().withColumn("phrase", F.row_number().over(Window.orderBy("terms"))))
    base = F.col("branch") == 0
    need = asked.groupBy("query_id").agg(F.count(F.when(base, 1)).alias("need"))
    lines = asked.groupBy("query_id", "corpus_id", "top_k", base.alias("base"), "terms").agg(F.count(F.lit(1)).alias("times"))
    lines = lines.join(wanted, "terms").join(need, "query_id").select("query_id", "corpus_id", "top_k", "base", "phrase", "times", "need")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("field").cast("int") + 1)
    one = wanted.filter(F.size("terms") == 1).select("phrase", F.col("terms")[0].alias("term"))
    single = posts.join(near(one), "term").select("phrase", "chunk_id", "corpus_id", "length", (weight * F.size("positions")).alias("w"))
    steps = wanted.filter(F.size("terms") > 1).select("phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("step", "term"))
    hits = posts.join(near(steps), "term").select("phrase", "chunk_id", "corpus_id", "length", "field", "size", F.explode(F.transform("positions", lambda p: p - F.col("step"))).alias("anchor"))
    whole = hits.groupBy("phrase", "chunk_id", "corpus_id", "length", "field", "anchor", "size").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == F.col("size"))
    both = single.unionByName(whole.select("phrase", "chunk_id", "corpus_id", "length", weight.alias("w")))
    return _of_blocks(both, lines, stats, default_k) if small else _of_pairs(both, lines, stats)


def _of_pairs(both: DataFrame, lines: DataFrame, stats: DataFrame) -> DataFrame:
    """``scores`` by joins, of all pairs."""
    tf = both.repartition("chunk_id").groupBy("phrase", "chunk_id", "corpus_id", "length").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # the table of statistics has one row
    idf = df.crossJoin(F.broadcast(stats)).select("phrase", (F.col("total") / F.greatest("n_docs", F.lit(1))).alias("avg_len"), F.when(raw <= 0, F.lit(1e-6)).otherwise(raw).alias("idf"))
    norm = F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("avg_len"))
    worth = tf.join(idf, "phrase").select("phrase", "chunk_id", F.col("corpus_id").alias("chunk_corpus"), (F.col("idf") * F.col("tf") * F.lit(K1 + 1) / norm).alias("part"))
    inside = F.col("corpus_id").isNull() | (F.col("corpus_id") == F.col("chunk_corpus"))
    of_words = F.when(F.col("base"), F.col("part") * F.col("times"))
    found = worth.join(lines, "phrase").filter(inside).groupBy("query_id", "chunk_id", "top_k", "need").agg(
        F.sum(F.when(F.col("base"), F.col("times"))).alias("have"), F.coalesce(F.sum(of_words), F.lit(0.0)).alias("words"), F.sum(F.when(~F.col("base"), F.col("part"))).alias("names")
    )
    every = F.coalesce((F.col("have") == F.col("need")) & (F.col("need") > 0), F.lit(False))
    score = F.when(every, F.col("words")).otherwise(F.lit(0.0)) + F.coalesce("names", F.lit(0.0))
    strict = every | F.col("names").isNotNull()
    return found.select("query_id", "chunk_id", "top_k", strict.alias("strict"), F.when(strict, score).otherwise(F.col("words")).alias("score"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk, with its phrases and their weights summed up, of rows in the order of chunks and phrases."""
    held: pa.RecordBatch | None = None

    def made(rows: pa.RecordBatch) -> pa.RecordBatch:
        phrase, w = rows.column("phrase").to_numpy(), rows.column("w").to_numpy()
        key = pc.run_end_encode(rows.column("chunk_id")).run_ends.to_numpy()
        start = np.r_[0, key[:-1]]
        mark = np.zeros(len(phrase), bool)
        mark[start] = True
        first = np.flatnonzero(mark | np.r_[True, phrase[1:] != phrase[:-1]])
        offsets = pa.array(np.r_[np.searchsorted(first, start), len(first)], pa.int32())
        at = pa.array(start)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (phrase[first], np.add.reduceat(w, first))]
        return pa.RecordBatch.from_arrays([*[rows.column(n).take(at) for n in ("chunk_id", "corpus_id", "length")], *lists], names=["chunk_id", "corpus_id", "length", "phrases", "tfs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        # the last chunk may go on in the next batch
        last = int(pc.run_end_encode(rows.column("chunk_id")).run_ends.to_numpy()[-2:][0]) if rows.column("chunk_id")[0] != rows.column("chunk_id")[-1] else 0
        held = rows.slice(last)
        if last:
            yield made(rows.slice(0, last))
    if held is not None:
        yield made(held)


class _Lines:
    """The lines of a batch's queries by phrase, of content words or of names."""

    def __init__(self, rows: pd.DataFrame, phrases: int):
        rows = rows.sort_values("phrase", kind="stable")
        self.query, self.times = rows["query"].to_numpy(np.int64), rows["times"].to_numpy(np.float64)
        count = np.bincount(rows["phrase"].to_numpy(np.int64), minlength=phrases + 1)
        self.start, self.count = np.cumsum(count) - count, count

    def add(self, row: np.ndarray, phrase: np.ndarray, part: np.ndarray, queries: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(times, sums of parts) of each pair of a block's row and a query."""
        n = self.count[phrase]
        entry = np.repeat(np.arange(len(phrase)), n)
        line = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n - self.start[phrase], n)
        at, times = row[entry] * queries + self.query[line], self.times[line]
        have = np.bincount(at, times, queries * rows).reshape(rows, queries)
        return have, np.bincount(at, times * part[entry], queries * rows).reshape(rows, queries)


def _best(batches: Iterator[pa.RecordBatch], words: _Lines, names: _Lines, asked: pd.DataFrame, idf: np.ndarray, average: float) -> Iterator[pa.RecordBatch]:
    """Of the chunks of a task those that can be among the best of a query, with the query's number.

    A chunk stays where fewer than k of its block, and of an earlier one, are better by more
    than rounding; of equal scores the k lowest ids stay, and where a chunk holds strictly, only such.
    """
    queries = len(asked)
    k, need = asked["k"].to_numpy(np.int64), asked["need"].to_numpy(np.float64)
    floor, held = np.full(queries, -np.inf), np.zeros(queries, bool)
    corpora = [(c, np.flatnonzero((asked["corpus_id"] == c).to_numpy())) for c in asked["corpus_id"].dropna().unique()]
    for batch in batches:
        off, at = batch.column("phrases").offsets.to_numpy(), batch.column("phrases").values.to_numpy()
        tfs, length = batch.column("tfs").values.to_numpy(), batch.column("length").to_numpy().astype(np.float64)
        i = 0
        while i < batch.num_rows:
            # a block's pairs and lines are bounded, whatever the number of queries
            lines = np.cumsum((words.count + names.count)[at[off[i] : off[min(i + max(1, PAIRS // queries), batch.num_rows)]]])
            j = i + max(1, int(np.searchsorted(off[i + 1 : min(i + max(1, PAIRS // queries), batch.num_rows) + 1] - off[i], np.searchsorted(lines, 2 * PAIRS, "right"), "right")))
            rows, phrase, tf = j - i, at[off[i] : off[j]].astype(np.int64), tfs[off[i] : off[j]]
            row = np.repeat(np.arange(rows), np.diff(off[i : j + 1]))
            part = idf[phrase] * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length[i:j][row] / average))
            have, s = words.add(row, phrase, part, queries, rows)
            named, more = names.add(row, phrase, part, queries, rows)
            every = (have == need) & (need > 0)
            strict = every | (named > 0)
            s = np.where(strict, np.where(every, s, 0.0) + more, s)
            s[(have == 0) & (named == 0)] = -np.inf
            if corpora:
                mine = np.array(batch.column("corpus_id").slice(i, rows).to_pylist(), object)
                for c, of in corpora:
                    s[np.ix_(mine != c, of)] = -np.inf
            strict &= s > -np.inf
            new = strict.any(axis=0) & ~held
            floor[new], held[new] = -np.inf, True
            s[:, held] = np.where(strict[:, held], s[:, held], -np.inf)
            most = min(max(int(k.max()), 1), rows)
            best = -np.sort(-np.partition(s, rows - most, axis=0)[rows - most :], axis=0)
            full = (k <= rows) & (k > 0)
            floor[full] = np.maximum(floor[full], best[k[full] - 1, np.flatnonzero(full)])
            r, q = np.nonzero((s > -np.inf) & (s >= floor - ROUNDING))
            order = np.lexsort((r, -s[r, q], q))
            r, q = r[order], q[order]
            v = s[r, q]
            first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]) if len(r) else np.zeros(0, np.int64)
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            r, q, v = (x[place < k[q]] for x in (r, q, v))
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column("chunk_id").take(pa.array(r + i)), pa.array(strict[r, q]), pa.array(v)], names=["query", "chunk_id", "strict", "score"])
            i = j


def _of_blocks(both: DataFrame, lines: DataFrame, stats: DataFrame, default_k: int) -> DataFrame:
    """``scores`` by blocks of chunks; the lines of the batch, SMALL at most, travel with the tasks as numbers."""
    spark = both.sparkSession
    known = lines.withColumn("k", F.coalesce("top_k", F.lit(default_k)).cast("long")).toPandas()
    asked = known[["query_id", "corpus_id", "top_k", "k", "need"]].drop_duplicates().reset_index(drop=True)
    known = known.merge(asked.assign(query=asked.index), on=["query_id", "corpus_id", "top_k", "k", "need"])
    count = int(known["phrase"].max()) if len(known) else 0
    rows = both.repartition("chunk_id").select("chunk_id", "corpus_id", "length", F.col("phrase").cast("int").alias("phrase"), F.col("w").cast("double").alias("w"))
    packed = "chunk_id string, corpus_id string, length bigint, phrases array<int>, tfs array<double>"
    rows = written(rows.sortWithinPartitions("chunk_id", "phrase").mapInArrow(lean(rows, _packed), packed))
    out = "query long, chunk_id string, strict boolean, score double"
    if not len(known):
        found = spark.createDataFrame([], out)
    else:
        total = stats.first()
        df = np.zeros(count + 1)
        for r in rows.select(F.explode("phrases").alias("phrase")).groupBy("phrase").count().collect():
            df[r["phrase"]] = r["count"]
        raw = np.log((total["n_docs"] - df + 0.5) / (df + 0.5))
        idf, average = np.where(raw <= 0, 1e-6, raw), total["total"] / max(total["n_docs"], 1)
        of = [_Lines(known[known["base"] == b], count) for b in (True, False)]
        found = rows.mapInArrow(lean(rows, lambda it: _best(it, *of, asked, idf, average)), out)
    names = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(asked["query_id"].tolist(), [None if pd.isna(t) else int(t) for t in asked["top_k"]]))], "query long, query_id string, top_k int")
    names = names.withColumn("query_id", F.col("query_id").cast(lines.schema["query_id"].dataType))
    return found.join(F.broadcast(names), "query").select("query_id", "chunk_id", "top_k", "strict", "score")


def top(rows: DataFrame, score: str, default_k: int = DEFAULT_K, key: str = "chunk_id", digits: int | None = None, first: str | None = None) -> DataFrame:
    """The best rows of each query with their 1-based rank; ties go to the lower key, rows that ``first`` holds for lead."""
    by = F.round(score, digits) if digits is not None else F.col(score)
    lead = [F.col(first).desc()] if first is not None else []
    order = Window.partitionBy("query_id").orderBy(*lead, by.desc(), F.col(key).asc())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.coalesce("top_k", F.lit(default_k)))


def retrieve(queries: DataFrame, posts: DataFrame, stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, stemmed: bool = True, sources: list[str] | None = None, chunk_sources: DataFrame | None = None, ascii_borders: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank, sparse_score) for queries (query_id, text, corpus_id, top_k).

    A query's corpus restricts its hits, not the statistics.  ``sources`` filters the top
    hits after ranking, by ``chunk_sources`` (chunk_id, source_id).
    """
    # sums differ in their last digits by the order of their terms, which must not break ties
    best = top(scores(phrases(queries, stemmed, ascii_borders), posts, stats, weights), "score", digits=9, first="strict")
    # a query with a strict hit has no others
    any_strict = F.max("strict").over(Window.partitionBy("query_id"))
    hits = best.withColumn("any", any_strict).filter("strict OR NOT any").select("query_id", "chunk_id", "rank", F.col("score").alias("sparse_score"))
    if sources is not None:
        hits = hits.join(chunk_sources.filter(F.col("source_id").isin(*sources)).select("chunk_id"), "chunk_id", "left_semi")
    return hits
