"""Answers: abstention, prompts, citations, and the one call of a generator per query."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import CitationError
from tessera.functions import text as T
from tessera.operators.shared import written

ABSTAIN = "ABSTAIN"
EXCERPT = 200


def best_score(rerank: Column, fusion: Column, dense: Column, sparse: Column) -> Column:
    """The first score that there is, in order of precedence; 0 without any."""
    return F.coalesce(rerank, fusion, dense, sparse, F.lit(0.0))


def pre_abstain(queries: DataFrame, hits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(query_id, abstain): no hits, or with a positive threshold none that reaches it."""
    best = hits.groupBy("query_id").agg(F.max(best_score(*[F.col(c) for c in ("rerank_score", "fusion_score", "dense_score", "sparse_score")])).alias("best"))
    low = F.col("best") < threshold if threshold > 0 else F.lit(False)
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", (F.col("best").isNull() | F.coalesce(low, F.lit(True))).alias("abstain"))


def post_abstain(answer: Column) -> Column:
    """Whether a generator's text is empty or the word for abstaining."""
    clean = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)^\s+|\s+$", "")
    return clean.isin("", ABSTAIN)


def context_block(evidence: DataFrame) -> DataFrame:
    """(query_id, context): a line with label and text for each piece of evidence, in order."""
    line = F.concat(F.lit("["), T.neutralize(F.col("citation_label")), F.lit("] "), T.neutralize(F.col("snippet.text")))
    lines = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return lines.select("query_id", F.array_join("lines.line", "\n").alias("context"))


def user_message(question: Column, context: Column) -> Column:
    body = F.when(F.coalesce(context, F.lit("")) == "", F.lit("(no evidence)")).otherwise(context)
    return F.concat(F.lit(T.OPEN + "\n"), body, F.lit("\n" + T.CLOSE + "\n\nQuestion: "), T.neutralize(question))


def citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, label, position, evidence_id, chunk_id, canonical_uri, excerpt) of each cited label.

    A label that an answer's evidence lacks has a null evidence_id; of evidence that
    repeats a label the last counts.
    """
    cited = answers.select("query_id", F.posexplode(T.cited_labels(F.col("answer_text"))).alias("position", "label"))
    last = evidence.groupBy("query_id", F.col("citation_label").alias("label")).agg(F.max_by(F.struct("evidence_id", "chunk_id", "snippet", "chunk_text"), "position").alias("e"))
    both = cited.join(last, ["query_id", "label"], "left")
    text = F.when(F.coalesce(F.col("e.snippet.text"), F.lit("")) != "", F.col("e.snippet.text")).otherwise(F.col("e.chunk_text"))
    uri = F.when(F.coalesce(F.col("e.snippet.source_uri"), F.lit("")) != "", F.col("e.snippet.source_uri")).otherwise(F.col("e.snippet.source_id"))
    return both.select("query_id", "label", "position", F.col("e.evidence_id").alias("evidence_id"), F.col("e.chunk_id").alias("chunk_id"), uri.alias("canonical_uri"), F.trim(F.substring(text, 1, EXCERPT)).alias("excerpt"))


def unknown_labels(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, label) of citations without evidence."""
    cited = answers.select("query_id", F.explode(T.cited_labels(F.col("answer_text"))).alias("label"))
    return cited.join(evidence.select("query_id", F.col("citation_label").alias("label")), ["query_id", "label"], "left_anti")


def foreign_evidence(claimed: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows (query_id, evidence_id) that a generator returned but wasn't given."""
    return claimed.join(evidence.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_anti")


def answer(queries: DataFrame, evidence: DataFrame, hits: DataFrame, generate: Callable[[str], str], threshold: float = 0.0, strict: bool = True) -> DataFrame:
    """(query_id, answer_text, abstained, reason, citations) with at most one generator call a query.

    Only hits are shown to the generator.  A query that abstains beforehand makes no call.
    With ``strict`` a citation of unknown evidence raises; else it is left out.
    """
    # written once, as it is read for the prompts, the labels and the citations
    shown = written(evidence.filter("role = 'hit'"))
    early = pre_abstain(queries, hits, threshold)
    asked = queries.join(early, "query_id").join(context_block(shown), "query_id", "left")
    message = asked.select("query_id", "abstain", user_message(F.col("text"), F.col("context")).alias("message"))

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            text = [None if a else generate(m) for a, m in zip(batch["abstain"], batch["message"])]
            yield pd.DataFrame({"query_id": batch["query_id"], "early": batch["abstain"], "raw": text})

    # written once: a generator must not be asked twice for a query, even if an executor is lost
    raw = written(message.mapInPandas(run, "query_id string, early boolean, raw string"))
    late = post_abstain(F.col("raw"))
    texts = raw.select("query_id", F.when(F.col("early") | late, F.lit(None)).otherwise(F.col("raw")).alias("answer_text"), "early", late.alias("late"))
    if strict and (bad := unknown_labels(texts, shown).limit(5).collect()):
        raise CitationError("unknown evidence cited: " + ", ".join(f"{r[0]}: {r[1]}" for r in bad))
    found = citations(texts, shown).filter("evidence_id IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "label", "evidence_id", "chunk_id", "canonical_uri", "excerpt"))).alias("citations"))
    reason = F.when(F.col("early"), "no_evidence").when(F.col("late"), "generator").otherwise(F.lit(None).cast("string"))
    return texts.join(found, "query_id", "left").select("query_id", F.coalesce("answer_text", F.lit("")).alias("answer_text"), (F.col("early") | F.col("late")).alias("abstained"), reason.alias("reason"), F.coalesce("citations", F.array().cast(found.schema["citations"].dataType)).alias("citations"))
