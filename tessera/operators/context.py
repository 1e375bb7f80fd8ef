"""Context: neighbours, token budgets, evidence and its summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.functions import text as T
from tessera.operators.shared import lean

EVIDENCE = (
    "evidence_id string, query_id string, chunk_id string, citation_label string, role string, context_of string, position int, token_count int, "
    "sparse_score double, dense_score double, fusion_score double, rerank_score double"
)


def link_neighbors(chunks: DataFrame) -> DataFrame:
    """Chunks with prev_chunk_id and next_chunk_id within their section, in the order of ordinal."""
    order = Window.partitionBy("section_id").orderBy("ordinal")
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def neighbors(hits: DataFrame, chunks: DataFrame, hops: int = 1, near: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(query_id, chunk_id, neighbor_id, distance) up to ``hops`` links away; a missing chunk ends a walk.

    Distances are negative for predecessors.  Each hop is one equi-join on chunk_id.
    ``near`` is broadcast where hits are few.
    """
    links = chunks.select("chunk_id", "prev_chunk_id", "next_chunk_id")
    out = None
    for column, sign in (("prev_chunk_id", -1), ("next_chunk_id", 1)):
        at = hits.select("query_id", "chunk_id", F.col("chunk_id").alias("here"))
        for hop in range(1, hops + 1):
            step = near(at).join(links.select(F.col("chunk_id").alias("here"), F.col(column).alias("there")), "here").filter("there IS NOT NULL")
            step = step.join(links.select(F.col("chunk_id").alias("there")), "there", "left_semi")
            at = step.select("query_id", "chunk_id", F.col("there").alias("here"))
            found = at.select("query_id", "chunk_id", F.col("here").alias("neighbor_id"), F.lit(sign * hop).alias("distance"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        return hits.select("query_id", "chunk_id", F.col("chunk_id").alias("neighbor_id"), F.lit(0).alias("distance")).limit(0)
    return out


def prefix_budget(rows: DataFrame, budget: Column | int, group: str = "query_id", order: str = "position", tokens: str = "token_count") -> DataFrame:
    """Rows with used_tokens and fits: packing in order that stops at the first row over the budget."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    if not isinstance(budget, Column) and budget < 0:
        raise ValueError("the budget must not be negative")
    so_far = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = rows.withColumn("used_tokens", F.sum(tokens).over(so_far))
    return used.withColumn("fits", F.max(F.when(F.col("used_tokens") > limit, 1).otherwise(0)).over(so_far) == 0)


def skip_budget(rows: DataFrame, budget: int, group: str = "query_id", order: str = "position", tokens: str = "token_count", key: str = "chunk_id") -> DataFrame:
    """(group, key, order, fits): packing that skips a row over what is left and goes on.

    A task goes through its groups row by row, sorted, and holds no more than a batch.
    """
    keys = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(order).alias("o"), F.col(tokens).cast("long").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, last, begun = 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            # nulls are a group, and so are values that aren't numbers
            coded = pc.dictionary_encode(batch.column("g"), null_encoding="encode")
            code, values, fits = coded.indices.to_pylist(), coded.dictionary.to_pylist(), []
            first = values[code[0]]
            before = code[0] if begun and (first == last or (first != first and last != last)) else -1
            for g, t in zip(code, batch.column("t").to_pylist()):
                if g != before:
                    used, before = 0, g
                ok = None if t is None else used + t <= budget
                used += t if ok else 0
                fits.append(ok)
            last, begun = values[before], True
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in "gko"], pa.array(fits, pa.bool_())], names=[*"gko", "fits"])

    kinds = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in "gko")
    flat = keys.repartition("g").sortWithinPartitions("g", "o", "k", "t").mapInArrow(lean(keys, run), f"{kinds}, fits boolean")
    return flat.select(F.col("g").alias(group), F.col("k").alias(key), F.col("o").alias(order), "fits")


def pack(hits: DataFrame, around: DataFrame, budget: int = 4096, overhead: int = 0, per_hit: int = 2) -> DataFrame:
    """Evidence of each query within a token budget.

    ``hits`` has query_id, chunk_id, rank, token_count and scores; ``around`` is what
    ``neighbors`` gives, with the neighbour's token_count.  Hits come first, in order; one
    over the budget is skipped.  Then each packed hit brings up to ``per_hit`` neighbours
    not yet included, predecessors from the farthest on, then successors.  Labels have no gaps.
    """
    room = max(0, budget - overhead)
    scores = ["sparse_score", "dense_score", "fusion_score", "rerank_score"]
    base = hits.select("query_id", "chunk_id", "rank", "token_count", *[F.col(c).cast("double").alias(c) if c in hits.columns else F.lit(None).cast("double").alias(c) for c in scores])
    lists = around.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id", "token_count"))).alias("around"))
    rows = base.join(lists, ["query_id", "chunk_id"], "left")

    def one(query: str, listed: list[dict]) -> list[tuple]:
        used, out, seen = 0, [], set()

        def add(chunk: str, role: str, of: str | None, tokens: int, row: dict) -> None:
            nonlocal used
            used += tokens
            seen.add(chunk)
            n = len(out) + 1
            mine = ids.digest_text("evidence", query, chunk)
            marks = [row[c] if of is None else None for c in scores]
            out.append((mine, query, chunk, f"S{n}", role, of, n, tokens, *marks))

        packed = []
        for row in listed:
            if row["token_count"] is not None and used + row["token_count"] <= room and row["chunk_id"] not in seen:
                add(row["chunk_id"], "hit", None, int(row["token_count"]), row)
                packed.append((row, out[-1][0]))
        for row, evidence in packed:
            taken = 0
            for x in row["around"] or []:
                if taken >= per_hit:
                    break
                if x["neighbor_id"] in seen or used + x["token_count"] > room:
                    continue
                add(x["neighbor_id"], "context", evidence, int(x["token_count"]), row)
                taken += 1
        return out

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    columns = [c.split() for c in EVIDENCE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            out = [x for query, own in groupby(rows, lambda r: r["query_id"]) for x in one(query, list(own))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*out), columns)], names=[n for n, _ in columns])

        for batch in batches:
            held += batch.to_pylist()
            # the last query may go on in the next batch
            at = next((i for i in range(len(held) - 1, 0, -1) if held[i - 1]["query_id"] != held[-1]["query_id"]), 0)
            yield from made(held[:at])
            held = held[at:]
        yield from made(held)

    # queries are many and small: a task goes through its own, a call for each would cost more than the packing
    return rows.repartition("query_id").sortWithinPartitions("query_id", "rank", "chunk_id").mapInArrow(lean(rows, run), EVIDENCE)


def budget_summary(hits: DataFrame, evidence: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """(query_id, result_count, total_tokens, remaining_tokens, budget, overflow_count, recap)."""
    room = max(0, budget - overhead)
    packed = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"), F.sum("token_count").alias("total_tokens"), F.sum(F.when(F.col("role") == "hit", 1).otherwise(0)).alias("hits"))
    asked = hits.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("asked"))
    both = asked.join(packed, "query_id", "left").fillna(0, ["result_count", "total_tokens", "hits"])
    out = both.select("query_id", "result_count", "total_tokens", (F.lit(room) - F.col("total_tokens")).alias("remaining_tokens"), F.lit(room).alias("budget"), (F.col("asked") - F.col("hits")).alias("overflow_count"))
    return out.withColumn("recap", F.format_string("Budget: %d/%d tokens used (%d results fit, %d excluded, %d tokens remaining)", "total_tokens", "budget", "result_count", "overflow_count", "remaining_tokens"))


def with_snippets(evidence: DataFrame, chunks: DataFrame, queries: DataFrame, sources: DataFrame, max_chars: int = 400) -> DataFrame:
    """Evidence with a struct ``snippet``; a source that isn't known has an empty uri and title."""
    rows = evidence.join(chunks.select("chunk_id", "source_id", "parent_locator", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    rows = rows.join(sources.select("source_id", "canonical_uri", "title"), "source_id", "left")
    cut = T.snippet(F.col("text"), F.col("query_text"), max_chars)
    rows = rows.withColumn("cut", cut)
    made = F.struct(
        F.col("cut.text").alias("text"), "source_id", F.coalesce("canonical_uri", F.lit("")).alias("source_uri"), F.coalesce("title", F.lit("")).alias("title"),
        F.col("parent_locator").alias("locator"), F.col("cut.char_start").alias("char_start"), F.col("cut.char_end").alias("char_end"), "chunk_id",
    )
    return rows.select(*evidence.columns, made.alias("snippet"), F.col("text").alias("chunk_text"))
