"""Queries over the driver's tables, one for each operator of the subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, html_extract, language, mixing, mtree, near_dedup, pieces, quality, secrets, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "source", "__shard AS shard", "__position AS position", "__shards AS shards")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"), pieces.load())


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest(_table(spark, sf_dir, "embeddings"), k=10, asked=F.col("vec_id") % 50 == 0)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    kept = quality.scored(docs.select("doc_id", "text"), model).filter(F.col("__score") >= quality.THRESHOLD)
    return kept.select("doc_id", F.round("__score", 6).alias("score"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extracted(pages, html_extract.train(pages))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_exact_topk": op4_exact_topk,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_html_extraction": op7_html_extraction,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
        WITH words AS (
            SELECT row_number() OVER () AS doc, doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS w
            FROM documents WHERE text IS NOT NULL),
        suffixes AS (
            SELECT doc, doc_id, w, unnest(range(len(w) - 49)) AS p FROM words WHERE len(w) >= 50),
        prefixes AS (
            SELECT doc, doc_id, p, array_to_string(w[p + 1 : p + 50], ' ') AS s FROM suffixes),
        ties AS (
            SELECT doc, doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS a, max(doc_id) OVER (PARTITION BY s) AS z FROM prefixes) AS c WHERE a <> z),
        steps AS (
            SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM ties),
        groups AS (
            SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM steps)
        SELECT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) + 50 AS BIGINT) AS end_word
        FROM groups GROUP BY doc, doc_id, g""",
    "op4_exact_topk": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
        pairs AS (
            SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_distance(a.e, b.e), 6) AS distance
            FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs)
        SELECT vec_id, neighbor_id, rank, distance FROM ranked WHERE rank <= 10""",
    "op5_exact_dedup": """
        SELECT doc_id, kept_doc_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_doc_id,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy
            FROM documents WHERE text IS NOT NULL) AS copies
        WHERE copy > 1""",
}
