"""Queries over the driver's tables for the engine's own operators, with their SQL.

``documents`` stands for sources or chunks, ``benchmark`` for queries, ``embeddings``
for chunk vectors and ``conversations`` for sections of ordered chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import ids, media
from tessera.functions import text as T
from tessera.operators import answer, chunk, context, dense, metrics, parse, ranking, sparse
from tessera.plans import changes, health, snapshot
from tessera.plans.collections import valid_name
from tessera.plans.search import SearchPipeline
from tessera.plans.sync import SyncEngine
from tessera.sources.connectors import TableConnector, canonical_url

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


FP = "pipe-1"
_SRC = "replace('memory://doc-' || doc_id, ':', '_')"
_ID = "substr(sha256({}), 1, 32)"
_SRC_ID = _ID.format(f"'source:corpus:' || {_SRC}")
_REV_ID = _ID.format(f"'revision:' || {_SRC_ID} || ':' || sha256(text) || ':{FP}'")


def _uri(c: str = "doc_id") -> F.Column:
    return F.concat(F.lit("memory://doc-"), F.col(c).cast("string"))


# identity


@query(f"""
    SELECT doc_id, {_SRC_ID} AS source_id, sha256(text) AS content_hash, {_REV_ID} AS revision_id,
        {_ID.format("'section:' || " + _SRC + " || ':' || " + _REV_ID + " || ':__root__'")} AS section_id,
        {_ID.format("'chunk:corpus:' || " + _SRC + " || ':' || " + _REV_ID + " || ':" + FP + ":__root__:0'")} AS chunk_id,
        {_ID.format("'evidence:q-1:' || doc_id")} AS evidence_id, {_ID.format("'build_run:corpus:" + FP + ":' || doc_id")} AS build_run_id
    FROM documents""")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").withColumn("source_id", ids.source_id("corpus", _uri())).withColumn("content_hash", ids.content_hash(F.col("text")))
    rows = rows.withColumn("revision_id", ids.revision_id(F.col("source_id"), F.col("content_hash"), FP))
    return rows.select(
        "doc_id", "source_id", "content_hash", "revision_id", ids.section_id(_uri(), F.col("revision_id"), "__root__").alias("section_id"), ids.chunk_id("corpus", _uri(), F.col("revision_id"), FP, "__root__", "0").alias("chunk_id"),
        ids.evidence_id("q-1", F.col("doc_id")).alias("evidence_id"), ids.build_run_id("corpus", FP, F.col("doc_id")).alias("build_run_id"),
    )


# sources


@query("""
    WITH e AS (SELECT *, lower(regexp_extract(url, '[^/]*//[^/]*/.*[^/.][^/]*\\.([^./?#]*)$', 1)) AS ext FROM (
        SELECT page_id, 'https://site/' || page_id || ['.md', '.html', '.pdf', '.yml', '.bin', '.rst', '', '.JSONL'][CAST(page_id % 8 AS INT) + 1] AS url FROM pages) AS u),
    m AS (SELECT page_id, url, CASE ext WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html' WHEN 'pdf' THEN 'application/pdf' WHEN 'yml' THEN 'text/yaml'
        WHEN 'rst' THEN 'text/x-rst' WHEN 'jsonl' THEN 'application/jsonlines' ELSE 'application/octet-stream' END AS media_type FROM e)
    SELECT page_id, media_type, media_type LIKE 'text/%' OR media_type = 'application/jsonlines' AS is_text,
        CASE media_type WHEN 'text/markdown' THEN 'markdown' WHEN 'text/html' THEN 'html' WHEN 'application/pdf' THEN 'pdf' WHEN 'text/yaml' THEN 'yaml'
        WHEN 'text/x-rst' THEN 'rst' WHEN 'application/jsonlines' THEN 'jsonlines' ELSE 'binary' END AS parser_hint
    FROM m""")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in (".md", ".html", ".pdf", ".yml", ".bin", ".rst", "", ".JSONL")])
    rows = _t(spark, d, "pages").select("page_id", F.concat(F.lit("https://site/"), "page_id", F.element_at(kinds, (F.col("page_id") % 8 + 1).cast("int"))).alias("url"))
    rows = rows.withColumn("media_type", media.media_type(F.col("url")))
    return rows.select("page_id", "media_type", media.is_text(F.col("media_type")).alias("is_text"), media.parser_hint(F.col("media_type")).alias("parser_hint"))


@query("SELECT 'memory://doc-' || doc_id AS uri, text AS content, 'text/plain' AS media_type, text IS NULL AS failed FROM documents")
def table_connector(spark: SparkSession, d: str) -> DataFrame:
    rows = TableConnector(_t(spark, d, "documents"), "concat('memory://doc-', doc_id)", "text", "text/plain").read(spark)
    return rows.select("uri", "content", "media_type", F.col("error").isNotNull().alias("failed"))


@query("""
    WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) AS q FROM pages),
    k AS (SELECT page_id, regexp_extract(base, '^[^/]*//[^/]*') AS site, base, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid=|gclid=)')), '&') AS q FROM u)
    SELECT page_id, lower(site) || CASE WHEN substr(base, length(site) + 1) = '' THEN '/' ELSE substr(base, length(site) + 1) END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url FROM k""")
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.pandas_udf(canonical_url, "string")("url").alias("url"))


# parsing and chunking


def _page_docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select(F.col("url").alias("uri"), F.col("page_id").cast("string").alias("revision_id"), F.col("html").alias("content"))


def _text_docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(_uri().alias("uri"), F.col("doc_id").cast("string").alias("revision_id"), F.col("text").alias("content"))


@query()
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    return parse.sections(_page_docs(spark, d), "html")


@query("""
    SELECT 'memory://doc-' || doc_id AS source_id, CAST(doc_id AS VARCHAR) AS revision_id, '__root__' AS locator, rtrim(text, chr(10)) AS text, 0 AS ordinal, 0 AS depth
    FROM documents WHERE trim(text) <> ''""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return parse.sections(_text_docs(spark, d), "markdown").select("source_id", "revision_id", "locator", "text", "ordinal", "depth")


def _talks(spark: SparkSession, d: str, part: F.Column, between: str = "") -> DataFrame:
    """Conversations as documents: what ``part`` makes of their turns, one after another."""
    turns = _t(spark, d, "conversations").select("conv_id", F.struct("turn", part.alias("part")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return lists.select(F.concat(F.lit("memory://talk-"), "conv_id").alias("uri"), F.col("conv_id").cast("string").alias("revision_id"), F.array_join("t.part", between).alias("content"))


_TALK = "'memory://talk-' || conv_id AS source_id, CAST(conv_id AS VARCHAR) AS revision_id"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""
    WITH p AS (SELECT {_TALK}, 2 * turn + 1 AS page, turn, {_STRIP.format("text")} AS text FROM conversations),
    f AS (SELECT *, {_STRIP.format("string_split(text, chr(10))[1]")} AS first, contains(text, chr(10)) AS many FROM p)
    SELECT source_id, revision_id, 'page:' || page AS locator, CASE WHEN many AND length(first) BETWEEN 1 AND 119 AND NOT contains('.,;:?!', right(first, 1)) THEN first ELSE '' END AS heading,
        text, CAST(turn AS INTEGER) AS ordinal, '' AS parent_locator, 0 AS depth FROM f""")
def pdf_page_sections(spark: SparkSession, d: str) -> DataFrame:
    """The turns of a conversation are its pages, with an empty page after each."""
    return parse.sections(_talks(spark, d, F.col("text"), "\f\f"), "pdf_pages").drop("section_id", "warnings")


@query(f"""
    WITH one AS (SELECT conv_id, turn AS base, role || CASE WHEN n > 1 THEN '[' || n || ']' ELSE '' END AS a FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn % 3 = 0) AS x),
    s AS (SELECT c.*, one.a, two.role AS b FROM conversations AS c JOIN one ON one.conv_id = c.conv_id AND one.base = c.turn - c.turn % 3 LEFT JOIN conversations AS two ON two.conv_id = c.conv_id AND two.turn = c.turn - c.turn % 3 + 1)
    SELECT {_TALK}, CASE turn % 3 WHEN 0 THEN a WHEN 1 THEN a || '/' || b ELSE a || '/' || b || '/' || role END AS locator, role AS heading,
        chr(10) || text || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' AS text, CAST(turn AS INTEGER) AS ordinal,
        CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN a ELSE a || '/' || b END AS parent_locator, CAST(turn % 3 + 1 AS INTEGER) AS depth FROM s""")
def markdown_outline(spark: SparkSession, d: str) -> DataFrame:
    """Headings of three levels that repeat, with a fence that holds what looks like one."""
    part = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), "role", F.lit(" ##\n\n"), "text", F.lit("\n```\n# not a heading\n```\n"))
    return parse.sections(_talks(spark, d, part), "markdown").drop("section_id", "warnings")


@query(f"""
    WITH one AS (SELECT conv_id, turn AS base, role || CASE WHEN n > 1 THEN '[' || n || ']' ELSE '' END AS a FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 0) AS x)
    SELECT 'memory://talk-' || c.conv_id AS source_id, CAST(c.conv_id AS VARCHAR) AS revision_id, CASE turn % 2 WHEN 0 THEN a ELSE a || '/' || role END AS locator, role AS heading,
        'See ' || {_STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')")} || ' [/t/' || turn || '] now' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'a' || chr(10) || ' b' AS text,
        CAST(turn AS INTEGER) AS ordinal, CASE turn % 2 WHEN 0 THEN '' ELSE a END AS parent_locator, CAST(turn % 2 + 1 AS INTEGER) AS depth
    FROM conversations AS c JOIN one ON one.conv_id = c.conv_id AND one.base = c.turn - c.turn % 2""")
def html_outline(spark: SparkSession, d: str) -> DataFrame:
    """Headings, links in paragraphs, lists without end tags and verbatim code."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    level = (F.col("turn") % 2 + 1).cast("string")
    part = F.concat(F.lit("<h"), level, F.lit(">"), "role", F.lit("</h"), level, F.lit('><p>See <a href="/t/'), "turn", F.lit('">'), safe, F.lit("</a> now</p><script>x</script><ul><li>one<li>two</ul><pre>a\n b</pre>"))
    return parse.sections(_talks(spark, d, part), "html").drop("section_id", "warnings")


@query("""
    SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) || chr(10) || 'end' AS code FROM conversations""")
def code_fields(spark: SparkSession, d: str) -> DataFrame:
    """What is in fences: a turn's text, and a last fence that stays open."""
    text = F.concat(F.lit("before\n```py\n  "), "text", F.lit("\n\n```\nbetween\n~~~\nend"))
    return _t(spark, d, "conversations").select("conv_id", "turn", T.code_content(text).alias("code"))


@query("""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
    t AS (SELECT doc_id, w, sum(CAST(ceil(length(u) / 4.0) AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY i) AS s, i FROM (SELECT doc_id, w, unnest(w) AS u, generate_subscripts(w, 1) AS i FROM d) AS x),
    p AS (SELECT doc_id, any_value(w) AS w, list_prepend(0, list(CAST(s AS BIGINT) ORDER BY i)) AS s FROM t GROUP BY doc_id),
    r AS (SELECT doc_id, 0 AS ordinal, 0 AS a, greatest(1, len(list_filter(s, lambda x: x - s[1] <= 512)) - 1) AS b FROM p
        UNION ALL SELECT doc_id, ordinal + 1, a, greatest(a + 1, len(list_filter(s, lambda x: x - s[a + 1] <= 512)) - 1) FROM (
            SELECT r.doc_id, ordinal, s, greatest(r.a + 1, len(list_filter(s[1 : b + 1], lambda x: s[b + 1] - x >= 64)) - 1) AS a FROM r JOIN p ON p.doc_id = r.doc_id WHERE b < len(w)) AS n)
    SELECT r.doc_id, ordinal, array_to_string(w[a + 1 : b], ' ') AS text FROM r JOIN p ON p.doc_id = r.doc_id""")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 512 tokens with an overlap of 64, of each document's words on one line."""
    return chunk.pieces(_t(spark, d, "documents").select("doc_id", "text"), "text", lambda t: chunk.split_words(t, chunk.MAX_TOKENS, chunk.OVERLAP))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk.chunks(parse.sections(_text_docs(spark, d)), "corpus", FP)


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INTEGER) AS token_count FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("token_count"))


@query("""
    SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbor_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").alias("section_id"), F.col("turn").alias("ordinal"), F.col("turn").alias("chunk_id"))
    return context.link_neighbors(rows).select("conv_id", "turn", F.col("prev_chunk_id").alias("prev_turn"), F.col("next_chunk_id").alias("next_turn"))


# change planning and versions: documents by residue of their id stand for scans and states


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = _t(spark, d, "documents").withColumn("canonical_uri", _uri())
    scanned = docs.filter("doc_id % 10 <> 0").select("canonical_uri", F.sha2("text", 256).alias("content_hash"))
    pointers = docs.filter("doc_id % 10 <> 1").select("canonical_uri", F.col("doc_id").cast("string").alias("revision_id"))
    old = F.when(F.col("doc_id") % 10 == 2, F.lit("old")).otherwise(F.sha2("text", 256))
    revisions = docs.filter("doc_id % 10 <> 4").select(F.col("doc_id").cast("string").alias("revision_id"), old.alias("content_hash"), F.when(F.col("doc_id") % 10 == 3, "pipe-0").otherwise(FP).alias("pipeline_fingerprint"))
    failed = docs.filter("doc_id % 20 = 0").select("canonical_uri")
    return scanned, pointers, revisions, failed


_PLAN = f"""
    WITH d AS (SELECT doc_id, 'memory://doc-' || doc_id AS canonical_uri, sha256(text) AS h, doc_id % 10 AS r FROM documents),
    s AS (SELECT canonical_uri, h FROM d WHERE r <> 0), p AS (SELECT canonical_uri, CAST(doc_id AS VARCHAR) AS rev FROM d WHERE r <> 1),
    v AS (SELECT CAST(doc_id AS VARCHAR) AS rev, CASE WHEN r = 2 THEN 'old' ELSE h END AS oh, CASE WHEN r = 3 THEN 'pipe-0' ELSE '{FP}' END AS fp FROM d WHERE r <> 4),
    j AS (SELECT coalesce(s.canonical_uri, p.canonical_uri) AS canonical_uri, s.h, p.rev, v.oh, v.fp, s.canonical_uri IS NOT NULL AS listed
        FROM s FULL JOIN p ON s.canonical_uri = p.canonical_uri LEFT JOIN v ON p.rev = v.rev),
    plan AS (SELECT canonical_uri, CASE WHEN NOT listed THEN 'deleted' WHEN fp IS NULL THEN 'new' WHEN fp <> '{FP}' THEN 'incompatible'
        WHEN oh <> h THEN 'changed' ELSE 'unchanged' END AS change, coalesce(h, '') AS content_hash, coalesce(rev, '') AS active_revision_id
        FROM j WHERE canonical_uri NOT IN (SELECT canonical_uri FROM d WHERE doc_id % 20 = 0))"""


@query(_PLAN + " SELECT * FROM plan")
def change_plan(spark: SparkSession, d: str) -> DataFrame:
    scanned, pointers, revisions, failed = _state(spark, d)
    return changes.plan_changes(scanned, pointers, revisions, FP, failed).drop("pipeline_fingerprint")


@query(_PLAN + """
    SELECT count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed,
        count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'incompatible') AS incompatible, count(*) AS total_scanned,
        count(*) FILTER (change <> 'unchanged') AS total_changed, count(*) FILTER (change <> 'unchanged') > 0 AS needs_work FROM plan""")
def change_counts(spark: SparkSession, d: str) -> DataFrame:
    scanned, pointers, revisions, failed = _state(spark, d)
    return changes.change_counts(changes.plan_changes(scanned, pointers, revisions, FP, failed))


@query(f"""
    SELECT substr(sha256(string_agg(rev || ':' || h || ':' || fp, '|' ORDER BY rev)), 1, 32) AS fingerprint FROM (
        SELECT CAST(doc_id AS VARCHAR) AS rev, CASE WHEN doc_id % 10 = 2 THEN 'old' ELSE sha256(text) END AS h, CASE WHEN doc_id % 10 = 3 THEN 'pipe-0' ELSE '{FP}' END AS fp
        FROM documents WHERE doc_id % 10 NOT IN (1, 4)) AS a""")
def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    _, pointers, revisions, _ = _state(spark, d)
    return changes.corpus_fingerprint(pointers, revisions)


@query("SELECT 'memory://doc-' || doc_id AS canonical_uri FROM documents WHERE doc_id % 10 <> 1")
def active_uris(spark: SparkSession, d: str) -> DataFrame:
    return changes.active_uris(_state(spark, d)[1])


@query("""
    WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS revision_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id)
    SELECT revision_id, n AS chunk_count, len(e) AS error_count, CASE WHEN len(e) > 0 THEN e[1] END AS first_error FROM (
        SELECT revision_id, n, list_filter([CASE WHEN CAST(revision_id AS BIGINT) % 3 = 0 THEN 'fewer chunks than expected' END,
            CASE WHEN CAST(revision_id AS BIGINT) % 5 = 0 THEN 'a link leaves the revision' END,
            CASE WHEN CAST(revision_id AS BIGINT) % 7 = 0 THEN 'another fingerprint' END], lambda x: x IS NOT NULL) AS e FROM c) AS x""")
def validate_revision(spark: SparkSession, d: str) -> DataFrame:
    name = lambda turn: F.concat_ws("/", "conv_id", turn)
    rows = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("revision_id"), "conv_id", F.col("conv_id").alias("section_id"), F.col("turn").alias("ordinal"), name("turn").alias("chunk_id"))
    rows = context.link_neighbors(rows)
    broken = (F.col("conv_id") % 5 == 0) & F.col("next_chunk_id").isNull()
    rows = rows.withColumn("next_chunk_id", F.when(broken, F.lit("elsewhere")).otherwise(F.col("next_chunk_id")))
    want = rows.groupBy("revision_id", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    want = want.select("revision_id", (F.col("n") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("expected_chunks"), F.when(F.col("conv_id") % 7 == 0, "pipe-0").otherwise(FP).alias("pipeline_fingerprint"))
    out = changes.validate_revisions(rows, None, want, FP)
    return out.select("revision_id", "chunk_count", F.size("errors").cast("bigint").alias("error_count"), F.try_element_at("errors", F.lit(1)).alias("first_error"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("build_run_id"), F.col("user_id").cast("string").alias("corpus_id"), F.element_at(F.array(F.lit("running"), F.lit("success"), F.lit("failed")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.col("event_id").alias("seq"))


_LAST = """
    WITH r AS (SELECT CAST(user_id AS VARCHAR) AS corpus_id, event_id, ['running', 'success', 'failed'][CAST(event_id % 3 AS INT) + 1] AS status,
        row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, event_id DESC) AS n FROM events)"""


@query(_LAST + " SELECT corpus_id, CAST(event_id AS VARCHAR) AS build_run_id, status FROM r WHERE n = 1")
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.latest_runs(_runs(spark, d)).select("corpus_id", "build_run_id", "status")


@query(_LAST + """
    , u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS corpus_id, user_id FROM events)
    SELECT u.corpus_id, CASE WHEN status = 'running' THEN 'building' WHEN user_id % 2 = 0 THEN 'ready' WHEN status = 'failed' THEN 'failed' ELSE 'empty' END AS health
    FROM u JOIN r ON u.corpus_id = r.corpus_id AND n = 1""")
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    runs = _runs(spark, d)
    corpora = runs.select("corpus_id").distinct()
    return health.corpus_health(corpora, runs, corpora.filter(F.col("corpus_id").cast("bigint") % 2 == 0))


@query("""
    WITH j AS (SELECT CAST(user_id AS VARCHAR) AS c, user_id, event_id, event_id % 50 = 0 AS running, event_id % 50 = 0 OR event_id % 7 = 0 AS unfinished,
        CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS s, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events),
    l AS (SELECT c, max(running) AS running, arg_max(s, (t, CAST(event_id AS VARCHAR))) FILTER (NOT unfinished) AS last FROM j GROUP BY c)
    SELECT c AS collection_name, CASE WHEN running THEN 'building' WHEN CAST(c AS BIGINT) % 4 = 0 THEN 'ready' WHEN last = 'failed' THEN 'failed' ELSE 'empty' END AS state FROM l""")
def collections_status(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("collection_name", F.col("user_id").cast("string"))
    state = F.when(F.col("event_id") % 50 == 0, "running").when(F.col("event_id") % 3 == 0, "failed").otherwise("success")
    ended = F.when((F.col("event_id") % 50 == 0) | (F.col("event_id") % 7 == 0), F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    jobs = e.select(F.col("event_id").cast("string").alias("job_id"), "collection_name", state.alias("state"), ended.alias("finished_at"))
    live = e.filter("user_id % 4 = 0").select("collection_name", F.lit("live").alias("status"))
    return health.collection_state(e.select("collection_name").distinct(), jobs, live)


@query("""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 5 <> 0
    UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 20 = 0""")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows upserted where ids divide by 4, over a table from which ids that divide by 5 were deleted."""
    ids_ = _t(spark, d, "documents").select("doc_id")
    old = snapshot.delete(ids_.withColumn("version", F.lit("old")), ids_.filter("doc_id % 5 = 0"), "doc_id")
    return snapshot.upsert(old, ids_.filter("doc_id % 4 = 0").withColumn("version", F.lit("new")), "doc_id")


@query("SELECT user_id, regexp_matches(n, '^[a-z0-9][a-z0-9_-]{0,63}$') AND NOT contains(n, '__') AS valid FROM (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN 'kb-' || user_id WHEN 1 THEN 'KB' || user_id WHEN 2 THEN 'a__' || user_id ELSE '_x' || user_id END AS n FROM events) AS t")
def collection_names(spark: SparkSession, d: str) -> DataFrame:
    made = F.expr("CASE user_id % 4 WHEN 0 THEN concat('kb-', user_id) WHEN 1 THEN concat('KB', user_id) WHEN 2 THEN concat('a__', user_id) ELSE concat('_x', user_id) END")
    return _t(spark, d, "events").select("user_id").distinct().select("user_id", valid_name(made).alias("valid"))


# vectors


@query("""
    SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'dimension' WHEN abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * (CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END) - 1) > 0.0001 THEN 'norm' END AS problem
    FROM embeddings""")
def vector_validation(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))
    return _t(spark, d, "embeddings").select("vec_id", dense.problem(v, 64).alias("problem"))


def _dense(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = _t(spark, d, "embeddings")
        asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector"), F.lit(None).cast("string").alias("corpus_id"), F.lit(None).cast("int").alias("top_k"))
        points = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("c").alias("corpus_id"), F.col("embedding").alias("vector"))
        return dense.top_k(asked, points, kind, digits=6).select("query_id", "chunk_id", "rank", F.round("dense_score", 6).alias("score"))

    return run


_DENSE = """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    s AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, round({}, 6) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, chunk_id, rank, score FROM r WHERE rank <= 10"""
for _kind, _sql in (("cosine", "list_dot_product(q.e, v.e)"), ("dot", "list_dot_product(q.e, v.e)"), ("euclidean", "-list_distance(q.e, v.e)")):
    QUERIES[f"dense_topk_{_kind}"], ORACLES[f"dense_topk_{_kind}"] = _dense(_kind), _DENSE.format(_sql)


# sparse retrieval


def _bm25(spark: SparkSession, d: str, stemmed: bool) -> DataFrame:
    rows = _t(spark, d, "documents").filter("text IS NOT NULL").select(F.lit("c").alias("corpus_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.concat_ws(" ", "source", "lang").alias("heading"), F.lit("").alias("code"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", F.lit(None).cast("string").alias("corpus_id"), F.lit(None).cast("int").alias("top_k"))
    posts = snapshot.written(sparse.postings(rows, stemmed))
    # the SQL of the query without stems has borders of ASCII
    return sparse.retrieve(asked, posts, sparse.statistics(rows), stemmed=stemmed, ascii_borders=not stemmed)


_CODE, _COMMAND, _CAMEL = (p.replace("'", "''") for p in (T.CODE, T.COMMAND, T.CAMEL))
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"


def bm25_sql(chunks: str, queries: str, k: int = 10) -> str:
    """CTEs up to bm (query_id, chunk_id, rank, score): BM25 with phrases and branches over
    ``chunks`` (chunk_id, text, heading, code) for ``queries`` (query_id, text)."""
    fields = " UNION ALL ".join(f"SELECT chunk_id, {i} AS f, {_TOKENS.format(name)} AS w FROM ch" for i, name in enumerate(sparse.FIELDS))
    return f"""
    WITH ch AS ({chunks}), qs AS ({queries}),
    tok AS (SELECT chunk_id, f, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM ({fields}) AS x),
    len AS (SELECT chunk_id, count(*) AS l FROM tok GROUP BY ALL),
    n AS (SELECT count(*) AS n, (SELECT sum(l) FROM len) / count(*) AS a FROM ch),
    w AS (SELECT query_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM qs),
    c AS (SELECT query_id, CASE WHEN len(list_filter(w, lambda x: lower(x) NOT IN ({_STOP}))) > 0 THEN list_filter(w, lambda x: lower(x) NOT IN ({_STOP})) ELSE w END AS w,
        list_distinct(regexp_extract_all(text, '{_CODE}') || regexp_extract_all(text, '{_COMMAND}') || regexp_extract_all(text, '{_CAMEL}')) AS b FROM w),
    ph AS (SELECT * FROM (SELECT query_id, 0 AS branch, {_TOKENS.format("u")} AS terms FROM (SELECT query_id, unnest(w) AS u FROM c) AS x
        UNION ALL SELECT query_id, i AS branch, {_TOKENS.format("u")} FROM (SELECT query_id, unnest(b) AS u, generate_subscripts(b, 1) AS i FROM c) AS y) AS z WHERE len(terms) > 0),
    st AS (SELECT terms, generate_subscripts(terms, 1) - 1 AS step, unnest(terms) AS term FROM (SELECT DISTINCT terms FROM ph) AS x),
    an AS (SELECT terms, chunk_id, f, pos - step AS anchor FROM st JOIN tok USING (term) GROUP BY ALL HAVING count(*) = len(terms)),
    tf AS (SELECT terms, chunk_id, sum(CASE f WHEN 0 THEN 1.0 WHEN 1 THEN 10.0 ELSE 5.0 END)::DOUBLE AS tf FROM an GROUP BY ALL),
    idf AS (SELECT terms, CASE WHEN (n - count(*) + 0.5) / (count(*) + 0.5) <= 1 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, n GROUP BY terms, n),
    worth AS (SELECT terms, chunk_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a)) AS part FROM tf JOIN idf USING (terms) JOIN len USING (chunk_id), n),
    found AS (SELECT query_id, chunk_id, count(*) FILTER (branch = 0) AS have, coalesce(sum(part) FILTER (branch = 0), 0) AS words, sum(part) FILTER (branch > 0) AS names FROM ph JOIN worth USING (terms) GROUP BY ALL),
    need AS (SELECT query_id, count(*) FILTER (branch = 0) AS need FROM ph GROUP BY ALL),
    marked AS (SELECT query_id, chunk_id, have = need AND need > 0 OR names IS NOT NULL AS strict, words, CASE WHEN have = need AND need > 0 THEN words ELSE 0 END + coalesce(names, 0) AS exact FROM found JOIN need USING (query_id)),
    every AS (SELECT query_id, chunk_id, CASE WHEN strict THEN exact ELSE words END AS score FROM (SELECT *, max(strict) OVER (PARTITION BY query_id) AS has_strict FROM marked) AS m WHERE strict OR NOT has_strict),
    ranked AS (SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM every),
    bm AS (SELECT * FROM ranked WHERE rank <= {k})"""


_SCORES = bm25_sql("SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, source || ' ' || lang AS heading, '' AS code FROM documents WHERE text IS NOT NULL", "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark")


@query(_SCORES + " SELECT query_id, chunk_id, rank, score FROM bm")
def bm25_topk_ascii(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, False).select("query_id", "chunk_id", "rank", F.round("sparse_score", 6).alias("score"))


@query()
def bm25_topk_porter(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, True)


@query(f"SELECT doc_id, CASE WHEN len(k) > 0 THEN len(k) ELSE len(w) END AS content_words, len(w) AS words FROM (SELECT doc_id, w, list_filter(w, lambda x: lower(x) NOT IN ({_STOP})) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents) AS a) AS b")
def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", F.size(T.content_words(t)).cast("bigint").alias("content_words"), F.size(T.words(t)).cast("bigint").alias("words"))


@query(f"""
    WITH t AS (SELECT conv_id, turn, 'why does ERR_' || upper(role) || ' follow run-' || role || ' for UserId in /usr/' || role || ' or ERR_' || upper(role) || ' as in ' || regexp_replace(text, '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{24F}}]', '_', 'g') AS text FROM conversations),
    f AS (SELECT conv_id, turn, regexp_extract_all(text, '{_CODE}') || regexp_extract_all(text, '{_COMMAND}') || regexp_extract_all(text, '{_CAMEL}') AS b FROM t)
    SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_distinct(list_transform(b, lambda x: lpad(CAST(list_position(b, x) AS VARCHAR), 6, '0') || x))), lambda x: substr(x, 7)), ',') AS boosts FROM f""")
def boost_tokens(spark: SparkSession, d: str) -> DataFrame:
    up = F.upper("role")
    text = F.concat(F.lit("why does ERR_"), up, F.lit(" follow run-"), "role", F.lit(" for UserId in /usr/"), "role", F.lit(" or ERR_"), up, F.lit(" as in "), "text")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.boost_words(text), ",").alias("boosts"))


# fusion, filters and ranking


def _legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the documents of each source: by length and by id."""
    docs = _t(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "n_chars")
    order = lambda *c: F.row_number().over(Window.partitionBy("query_id").orderBy(*c))
    a = docs.select("query_id", "chunk_id", order(F.desc("n_chars"), "doc_id").alias("rank"), F.col("n_chars").cast("double").alias("sparse_score"))
    b = docs.select("query_id", "chunk_id", order(F.desc("doc_id")).alias("rank"), F.col("doc_id").cast("double").alias("dense_score"))
    return a, b


_RRF = """
    WITH d AS (SELECT source AS query_id, doc_id, CAST(doc_id AS VARCHAR) AS chunk_id, n_chars FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS b FROM d),
    f AS (SELECT query_id, chunk_id, CAST(n_chars AS DOUBLE) AS sparse_score, CAST(doc_id AS DOUBLE) AS dense_score, 1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b) AS s FROM r),
    rrf AS (SELECT query_id, chunk_id, sparse_score, dense_score, round(s, 9) AS fusion_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS INTEGER) AS rank FROM f)"""


@query(_RRF + " SELECT * FROM rrf")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rrf(*_legs(spark, d)).withColumn("fusion_score", F.round("fusion_score", 9))


@query(_RRF + " SELECT query_id, chunk_id, rank FROM rrf WHERE rank <= CASE WHEN query_id = 'src1' THEN 3 ELSE 10 END")
def top_k_trim(spark: SparkSession, d: str) -> DataFrame:
    hits = ranking.rrf(*_legs(spark, d)).withColumn("top_k", F.when(F.col("query_id") == "src1", 3))
    return ranking.trim(hits).select("query_id", "chunk_id", "rank")


@query("SELECT doc_id, source AS source_id FROM documents WHERE source IN ('src1', 'src2')")
def filter_spec(spark: SparkSession, d: str) -> DataFrame:
    hits = _t(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"))
    none = ranking.apply_filters(hits, ranking.FilterSpec(tags=("x",)))
    return ranking.apply_filters(hits, ranking.FilterSpec(source_ids=("src1", "src2"))).unionByName(none)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each conversation as the hits of a query, their roles as sources."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.lit("what").alias("query_text"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("rank"), T.token_count(F.col("text")).alias("token_count"))


@query("""
    WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, conv_id || '/' || turn AS chunk_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
    SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN r <= 3 THEN 0 ELSE 1 END, CASE WHEN r <= 3 THEN -n ELSE 0 END, r) AS INTEGER) AS rank,
        CASE WHEN r <= 3 THEN CAST(n AS DOUBLE) END AS rerank_score FROM h""")
def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rerank(_hits(spark, d), lambda _, texts: [float(len(t)) for t in texts], 3).select("query_id", "chunk_id", "rank", "rerank_score")


_SETS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''))"
_ALIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) * 1.0::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"


@query(f"""
    WITH s AS (SELECT doc_id, source, {_SETS} AS w FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id AS a, w, lead(doc_id) OVER o AS b, lead(w) OVER o AS x FROM s WINDOW o AS (PARTITION BY source ORDER BY doc_id))
    SELECT a, b, round({_ALIKE.format("w", "x")}, 6)::DOUBLE AS jaccard FROM p WHERE b IS NOT NULL""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each document to the next of its source; null texts have none."""
    s = _t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", T.word_set(F.col("text")).alias("words"))
    order = Window.partitionBy("source").orderBy("doc_id")
    pairs = s.select(F.col("doc_id").alias("a"), "words", F.lead("doc_id").over(order).alias("b"), F.lead("words").over(order).alias("other")).filter("b IS NOT NULL")
    return pairs.select("a", "b", F.round(T.jaccard_of_sets(F.col("words"), F.col("other")), 6).alias("jaccard"))


_TURNS = f"SELECT CAST(conv_id AS VARCHAR) AS query_id, role, conv_id || '/' || turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g, {_SETS} AS w FROM conversations"


@query(f"""
    WITH RECURSIVE c AS (SELECT conv_id, role, turn, 0 AS copy, text FROM conversations UNION ALL SELECT conv_id, role, turn, 1, text || ' again' FROM conversations),
    h AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, role, conv_id || '/' || turn || '/' || copy AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, copy) AS r, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, copy) AS g, {_SETS} AS w FROM c),
    f AS (SELECT query_id, role, chunk_id, r, g, true AS kept, [w] AS ws FROM h WHERE g = 1
        UNION ALL SELECT query_id, role, chunk_id, r, g, fresh, CASE WHEN fresh THEN list_append(ws, w) ELSE ws END FROM (
            SELECT h.query_id, h.role, h.chunk_id, h.r, h.g, h.w, f.ws, len(list_filter(f.ws, lambda o: {_ALIKE.format("o", "h.w")} >= 0.85)) = 0 AS fresh
            FROM f JOIN h ON h.query_id = f.query_id AND h.role = f.role AND h.g = f.g + 1) AS x)
    SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS rank FROM f WHERE kept""")
def collapse_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Each turn is followed by a copy of itself with one word more, which goes where the turn is long enough."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lit(0).alias("copy"))
    rows = turns.unionByName(turns.select("conv_id", "turn", "role", F.concat("text", F.lit(" again")).alias("text"), F.lit(1).alias("copy")))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "copy"))
    hits = rows.select(F.col("conv_id").cast("string").alias("query_id"), F.concat_ws("/", "conv_id", "turn", "copy").alias("chunk_id"), F.col("role").alias("source_id"), "text", rank.alias("rank"))
    return ranking.collapse_duplicates(hits).select("query_id", "chunk_id", "rank")


@query(f"""
    WITH RECURSIVE h AS ({_TURNS}),
    m AS (SELECT query_id, list(chunk_id ORDER BY r) AS ids, list(w ORDER BY r) AS ws, count(*) AS n FROM h GROUP BY query_id),
    f AS (SELECT query_id, 0 AS step, 0 AS best, ids, ws, n, list_transform(ids, lambda x: false) AS used, list_transform(ids, lambda x: 0.0::DOUBLE) AS near FROM m
        UNION ALL SELECT query_id, step, best, ids, ws, n, list_transform(used, lambda u, i: u OR i = best), list_transform(near, lambda v, i: greatest(v, {_ALIKE.format("ws[i]", "ws[best]")})) FROM (
            SELECT query_id, step + 1 AS step, ids, ws, n, used, near, list_position(s, list_max(s)) AS best FROM (
                SELECT *, list_transform(near, lambda v, i: CASE WHEN used[i] THEN -9.0 ELSE 0.5::DOUBLE * (1.0::DOUBLE / i) - 0.5::DOUBLE * v END) AS s FROM f WHERE step < n) AS y) AS x)
    SELECT query_id, ids[best] AS chunk_id, CAST(step AS INTEGER) AS rank FROM f WHERE step > 0""")
def mmr_order(spark: SparkSession, d: str) -> DataFrame:
    return ranking.mmr(_hits(spark, d), 0.5).select("query_id", "chunk_id", "rank")


# context, budgets and evidence


@query("""
    SELECT source, doc_id, CAST(used AS BIGINT) AS used_tokens, used <= 4096 AS fits FROM (
        SELECT source, doc_id, sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) AS x""")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("source", "doc_id", T.token_count(F.col("text")).alias("token_count"))
    return context.prefix_budget(rows, 4096, "source", "doc_id").select("source", "doc_id", "used_tokens", "fits")


@query("""
    WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
    f AS (SELECT source, doc_id, r, t <= 4096 AS fits, CASE WHEN t <= 4096 THEN t ELSE 0 END AS used FROM d WHERE r = 1
        UNION ALL SELECT d.source, d.doc_id, d.r, f.used + d.t <= 4096, CASE WHEN f.used + d.t <= 4096 THEN f.used + d.t ELSE f.used END FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1)
    SELECT source, doc_id, fits FROM f""")
def skip_budget_pack(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("position"), T.token_count(F.col("text")).alias("token_count"))
    return context.skip_budget(rows, 4096, "source", "position", key="doc_id").select("source", "doc_id", "fits")


@query("""
    SELECT CAST(a.conv_id AS VARCHAR) AS query_id, a.conv_id || '/' || a.turn AS chunk_id, b.conv_id || '/' || b.turn AS neighbor_id, CAST(b.turn - a.turn AS INTEGER) AS distance
    FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) AS a
    JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) AS b
    ON a.conv_id = b.conv_id AND abs(a.r - b.r) BETWEEN 1 AND 2""")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.col("conv_id").alias("section_id"), F.col("turn").alias("ordinal"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), "turn")
    linked = context.link_neighbors(rows)
    return context.neighbors(rows, linked, 2)


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("query_id"), F.col("conv_id").alias("section_id"), F.col("turn").alias("ordinal"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), "turn", T.token_count(F.col("text")).alias("token_count"), F.col("text"), F.col("role").alias("parent_locator"), F.col("role").alias("source_id"))
    linked = context.link_neighbors(rows)
    hits = linked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn")))
    around = context.neighbors(hits, linked, 1).join(linked.select(F.col("chunk_id").alias("neighbor_id"), "token_count"), "neighbor_id")
    return linked, context.pack(hits, around, 400)


_PACK = f"""
    WITH RECURSIVE h AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, conv_id || '/' || turn AS chunk_id, role, text, CAST(ceil(length(text) / 4.0) AS INTEGER) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f AS (SELECT query_id, r, t <= 400 AS fits, CASE WHEN t <= 400 THEN t ELSE 0 END AS used FROM h WHERE r = 1
        UNION ALL SELECT h.query_id, h.r, f.used + h.t <= 400, CASE WHEN f.used + h.t <= 400 THEN f.used + h.t ELSE f.used END FROM f JOIN h ON h.query_id = f.query_id AND h.r = f.r + 1),
    e AS (SELECT {_ID.format("'evidence:' || query_id || ':' || chunk_id")} AS evidence_id, query_id, chunk_id, 'S' || n AS citation_label, 'hit' AS role, n AS position, t AS token_count, text, source_id
        FROM (SELECT h.query_id, chunk_id, t, text, role AS source_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.r) AS n FROM h JOIN f ON f.query_id = h.query_id AND f.r = h.r WHERE fits) AS x)"""


@query(_PACK + " SELECT evidence_id, query_id, chunk_id, citation_label, role, CAST(position AS INTEGER) AS position, token_count FROM e")
def expand_and_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[1].drop("context_of", "sparse_score", "dense_score", "fusion_score", "rerank_score")


_SPACE = "[ \\t\\n\\r\\f]"


@query(_PACK + f"""
    , q AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: length(w) > 2) AS ws FROM conversations WHERE turn = 0),
    m AS (SELECT e.*, length(text) AS n, coalesce(list_min(list_filter(list_transform(ws, lambda w: instr(lower(text), w)), lambda p: p > 0)) - 1, length(text) // 2) AS mid FROM e JOIN q USING (query_id)),
    c AS (SELECT *, greatest(0, mid - 200) AS lo0, least(n, mid + 200) AS hi0 FROM m),
    d AS (SELECT *, CASE WHEN lo0 > 0 THEN lo0 + length(regexp_extract(substr(text, lo0 + 1), '^[^ \\t\\n\\r\\f]*{_SPACE}*')) ELSE 0 END AS lo1,
        CASE WHEN hi0 < n THEN length(regexp_replace(regexp_replace(substr(text, 1, hi0), '[^ \\t\\n\\r\\f]*$', ''), '{_SPACE}+$', '')) ELSE n END AS hi1 FROM c),
    g AS (SELECT *, CASE WHEN lo1 >= hi1 THEN greatest(0, n // 2 - 200) ELSE lo1 END AS lo2, CASE WHEN lo1 >= hi1 THEN least(n, greatest(0, n // 2 - 200) + 400) ELSE hi1 END AS hi2 FROM d),
    k AS (SELECT *, regexp_replace(substr(text, lo2 + 1, hi2 - lo2), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS cut FROM g)
    SELECT evidence_id, query_id, chunk_id, citation_label, cut AS snippet, CAST(lo2 + instr(substr(text, lo2 + 1), cut) - 1 AS INTEGER) AS char_start,
        CAST(lo2 + instr(substr(text, lo2 + 1), cut) - 1 + length(cut) AS INTEGER) AS char_end, CASE WHEN source_id = 'user' THEN 'memory://user' ELSE '' END AS source_uri, CASE WHEN source_id = 'user' THEN 'Users' ELSE '' END AS title, source_id AS locator FROM k""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Cut around what a conversation's first turn asks."""
    rows, evidence = _packed(spark, d)
    asked = rows.filter("turn = 0").select("query_id", "text")
    sources = spark.createDataFrame([("user", "memory://user", "Users")], "source_id string, canonical_uri string, title string")
    made = context.with_snippets(evidence, rows, asked, sources)
    return made.select("evidence_id", "query_id", "chunk_id", "citation_label", F.col("snippet.text").alias("snippet"), "snippet.char_start", "snippet.char_end", "snippet.source_uri", "snippet.title", "snippet.locator")


@query("""
    SELECT conv_id, CAST(count(*) AS BIGINT) AS result_count, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS total_tokens,
        CAST(1000000 - sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS remaining_tokens, CAST(0 AS BIGINT) AS overflow_count,
        'Budget: ' || sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) || '/1000000 tokens used (' || count(*) || ' results fit, 0 excluded, ' || (1000000 - sum(CAST(ceil(length(text) / 4.0) AS BIGINT))) || ' tokens remaining)' AS recap
    FROM conversations GROUP BY conv_id""")
def budget_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), T.token_count(F.col("text")).alias("token_count"), F.lit("hit").alias("role"))
    return context.budget_summary(rows, rows, 1_000_000).select(F.col("query_id").alias("conv_id"), "result_count", "total_tokens", "remaining_tokens", "overflow_count", "recap")


# answers: a turn's text with labels stands for what a generator wrote


@query("""
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'S1,S2' WHEN 1 THEN 'S' || turn ELSE '' END AS labels FROM conversations""")
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a [S1] b [S2][S1] [X3] "), "role")).when(F.col("turn") % 3 == 1, F.concat(F.lit("see ["), F.concat(F.lit("S"), "turn"), F.lit("]"))).otherwise(F.lit("none S4"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.cited_labels(text), ",").alias("labels"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, d, "conversations").withColumn("query_id", F.col("conv_id").cast("string"))
    texts = rows.filter("turn = 0").select("query_id", F.concat(F.lit("so [S1] and [S2] and [S99] of "), "role").alias("answer_text"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))
    evidence = rows.select("query_id", position.alias("position"), F.concat(F.lit("S"), position).alias("citation_label"), F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), F.concat(F.lit("e"), "conv_id", F.lit("/"), "turn").alias("evidence_id"), F.struct(F.lit("").alias("text"), F.col("role").alias("source_id"), F.lit("").alias("source_uri")).alias("snippet"), F.col("text").alias("chunk_text"), F.lit("hit").alias("role"))
    return texts, evidence


_EVIDENCE = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), a AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0)"


@query(_EVIDENCE + """
    SELECT CAST(a.conv_id AS VARCHAR) AS query_id, l.label, CAST(l.position AS INTEGER) AS position, CASE WHEN e.n IS NOT NULL THEN e.conv_id || '/' || e.turn END AS chunk_id, e.role AS canonical_uri, trim(substr(e.text, 1, 200), ' ') AS excerpt
    FROM a CROSS JOIN (VALUES ('S1', 0, 1), ('S2', 1, 2), ('S99', 2, 99)) AS l(label, position, n) LEFT JOIN e ON e.conv_id = a.conv_id AND e.n = l.n""")
def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    return answer.citations(*_answers(spark, d)).drop("evidence_id")


@query(_EVIDENCE + """
    SELECT CAST(a.conv_id AS VARCHAR) AS query_id, l.label FROM a CROSS JOIN (VALUES ('S1', 1), ('S2', 2), ('S99', 99)) AS l(label, n)
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = a.conv_id AND e.n = l.n)""")
def unknown_citations(spark: SparkSession, d: str) -> DataFrame:
    return answer.unknown_labels(*_answers(spark, d))


@query("SELECT CAST(conv_id AS VARCHAR) AS query_id, string_agg('[S' || n || '] ' || text, chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) AS e GROUP BY conv_id")
def context_block(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)[1].withColumn("snippet", F.struct(F.col("chunk_text").alias("text")))
    return answer.context_block(rows)


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS query_id, doc_id % 4 = 0 OR CASE WHEN doc_id % 3 = 0 THEN n_chars / 1000.0 ELSE n_chars / 2000.0 END < 0.5 AS abstain FROM documents""")
def pre_abstain(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").withColumn("query_id", F.col("doc_id").cast("string"))
    none = F.lit(None).cast("double")
    hits = docs.filter("doc_id % 4 <> 0").select("query_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") / 1000).alias("rerank_score"), (F.col("n_chars") / 2000).alias("fusion_score"), none.alias("dense_score"), F.lit(9.0).alias("sparse_score"))
    return answer.pre_abstain(docs, hits, 0.5)


@query("SELECT doc_id, doc_id % 3 <> 2 AS abstain FROM documents")
def post_abstain(spark: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("  ABSTAIN\n"), F.lit(" \t"), F.lit("abstain")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", answer.post_abstain(said).alias("abstain"))


# whole runs


def _store(spark: SparkSession) -> snapshot.SnapshotStore:
    """A fresh store in the shared folder."""
    return snapshot.SnapshotStore(spark, f"{snapshot.shared_folder(spark)}/store-{snapshot.uuid.uuid4().hex}")


def _synced(spark: SparkSession, d: str) -> tuple[snapshot.SnapshotStore, list]:
    store = _store(spark)
    docs = _t(spark, d, "documents")
    engine = SyncEngine(store, "corpus", TableConnector(docs, "concat('memory://doc-', doc_id)", "text"), embedder=dense.HashEmbedder())
    return store, [engine.sync()]


@query()
def sync_and_search(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for every benchmark item over the synced documents."""
    store, _ = _synced(spark, d)
    asked = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", F.lit(None).cast("string").alias("corpus_id"), F.lit(None).cast("int").alias("top_k"))
    return SearchPipeline(store, embedder=dense.HashEmbedder()).search(asked).evidence.select("query_id", "citation_label", "role", "chunk_id", "token_count", "snippet")


@query("""
    SELECT CAST(count(*) AS BIGINT) AS sources, 'success' AS first_status, 'success' AS second_status, CAST(0 AS BIGINT) AS second_chunks_added, CAST(count(*) AS BIGINT) AS second_unchanged
    FROM documents WHERE text IS NOT NULL""")
def sync_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A first sync of all documents, and a second that has nothing to do."""
    store = _store(spark)
    connector = TableConnector(_t(spark, d, "documents"), "concat('memory://doc-', doc_id)", "text")
    one, two = (SyncEngine(store, "corpus", connector).sync() for _ in range(2))
    return spark.createDataFrame([(store.table("pointers").count(), one.status, two.status, two.chunks_added, two.sources_unchanged)], "sources long, first_status string, second_status string, second_chunks_added long, second_unchanged long")


@query("""
    WITH h AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    t AS (SELECT d.source AS query_id, d.doc_id FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id WHERE quality = 1 GROUP BY ALL),
    a AS (SELECT query_id, count(*) AS n FROM t GROUP BY ALL),
    f AS (SELECT h.query_id, count(*) AS n, min(r) AS first, sum(1 / log2(r + 1)) AS dcg FROM h JOIN t ON h.query_id = t.query_id AND h.doc_id = t.doc_id WHERE r <= 10 GROUP BY ALL)
    SELECT a.query_id, round(coalesce(f.n * 1.0::DOUBLE / a.n, 0), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank,
        round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) AS g(i) WHERE i <= a.n), 0), 6) AS ndcg FROM a LEFT JOIN f USING (query_id)""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    hits = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("doc"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    good = docs.join(labels.filter("quality = 1").select("doc_id"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("doc"))
    return metrics.ranking_metrics(hits, good).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


__all__ = ["ORACLES", "QUERIES"]
