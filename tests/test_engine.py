"""Operators and plans on Spark, against independent results."""

import json
import sqlite3
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera import config
from tessera.errors import CitationError, ConfigError, EmbeddingError, IngestionError, ProtocolError, RegistryError, StoreError
from tessera.functions import text as T
from tessera.operators import answer, context, dense, parse, ranking, sparse
from tessera.operators.enrich import Enricher
from tessera.plans.collections import Catalog
from tessera.plans.knowledge_base import KnowledgeBase
from tessera.plans.snapshot import SnapshotStore
from tessera.plans.sync import SyncEngine
from tessera.sources.connectors import DocumentSource, FilesystemConnector, MemoryConnector, file_uri, uri_path
from tessera.streaming.ingest import stream_sync

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't have the tests

CHUNKS = [
    ("a", "Install the parser with pip. Parsers parse text; running code.", "Setup/Install", "pip install parser"),
    ("b", "The ERR_404 error is raised when a page is missing; see error codes.", "Errors", ""),
    ("c", "Ponies run — École naïve—text and well-known CamelCase names.", "Other", ""),
    ("d", "Use run-tests to run the tests of the parser, then run them again.", "Usage", "run-tests --all"),
    ("e", "", "Empty", ""),
    ("f", "missing page error page missing 404 err", "Errors/More", "err 404"),
]
ASKED = ["how do I install the parser", "what is ERR_404", "running ponies", "the of", "run-tests", "missing page nothing", "École naïve—text", "CamelCase names parser", "page page", "!!! ..."]


def test_bm25_equals_the_full_text_index(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, heading, code, tokenize='porter ascii')")
    db.executemany("INSERT INTO f(rowid, text, heading, code) VALUES (?, ?, ?, ?)", [(i, *c[1:]) for i, c in enumerate(CHUNKS, 1)])
    chunks = spark.createDataFrame([("x" if i % 2 else "y", *c) for i, c in enumerate(CHUNKS)], "corpus_id string, chunk_id string, text string, heading string, code string")
    posts = sparse.postings(chunks).cache()
    queries = spark.createDataFrame([(str(i), q, None, 10) for i, q in enumerate(ASKED)], "query_id string, text string, corpus_id string, top_k int")
    got = {}
    for r in sparse.retrieve(queries, posts, sparse.statistics(chunks)).collect():
        got.setdefault(int(r["query_id"]), {})[r["chunk_id"]] = r["sparse_score"]
    boosts = [r[0] for r in queries.orderBy(F.col("query_id").cast("int")).select(T.boost_words(F.col("text"))).collect()]
    for i, q in enumerate(ASKED):
        words = [w for w in q.split() if w.lower() not in T.STOPWORDS] or q.split()
        quoted = [f'"{w}"' for w in words]
        exact = f"({' '.join(quoted)})" + "".join(f' OR "{b}"' for b in boosts[i])
        for match in (exact, " OR ".join(quoted)):
            rows = db.execute("SELECT rowid, -bm25(f, 1.0, 10.0, 5.0) FROM f WHERE f MATCH ?", (match,)).fetchall()
            if rows:
                break
        want = {CHUNKS[r - 1][0]: s for r, s in rows}
        assert got.get(i, {}).keys() == want.keys(), q
        assert all(abs(got[i][k] - s) < 1e-9 for k, s in want.items()), q
    one = sparse.retrieve(queries.withColumn("corpus_id", F.lit("x")), posts, sparse.statistics(chunks))
    assert {r["chunk_id"] for r in one.collect()} <= {"b", "d", "f"}


class CountingEmbedder(dense.HashEmbedder):
    def __init__(self, path, fail=False):
        self.path, self.fail = path, fail

    def embed(self, texts):
        with Path(self.path).open("a") as f:
            f.write(f"{len(texts)}\n")
        if self.fail:
            raise EmbeddingError("down")
        return super().embed(texts)


def calls(path):
    return len(Path(path).read_text().splitlines()) if Path(path).exists() else 0


def test_sync_search_answer(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/store")
    connector = MemoryConnector({"memory://a": "# Install\n\nRun the parser installer.\n\n## Usage\n\nUse the parser.", "memory://b": "# Other\n\nPonies run."})
    log = f"{tmp_path}/calls"
    said = []
    kb = KnowledgeBase(store, "main", connector, embedder=CountingEmbedder(log), observer=lambda *e: said.append(e[:2]))
    assert kb.health() == "empty"
    first = kb.sync()
    assert (first.status, first.sources_new, first.chunks_added, kb.health()) == ("success", 2, 3, "ready")
    made = calls(log)
    again = kb.sync()
    assert (again.status, again.sources_unchanged, again.chunks_added) == ("success", 2, 0) and calls(log) == made
    assert ("embed", "start") in said and ("promote", "end") in said

    live = store.current()
    connector.documents["memory://b"] = "# Other\n\nHorses run."
    failed = SyncEngine(store, "main", connector, embedder=CountingEmbedder(log, fail=True)).sync()
    assert failed.status == "failed" and failed.errors and store.current() == live
    del connector.documents["memory://a"]
    third = kb.sync()
    assert (third.status, third.sources_changed, third.sources_deleted, third.chunks_deleted) == ("success", 2, 1, 3)
    assert [r[0] for r in store.table("chunks").select("text").collect()] == ["Horses run."]
    assert store.expire() and store.table("chunks").count() == 1
    with pytest.raises(StoreError):
        store.rollback(store.current())

    found = kb.search("how do horses run")
    evidence = found.evidence.collect()
    assert [(r["citation_label"], r["role"], r["snippet"]["source_uri"], r["snippet"]["text"]) for r in evidence] == [("S1", "hit", "memory://b", "Horses run.")]
    kb.generator = lambda message: "They do [S1]." if "[S1] Horses run." in message else "ABSTAIN"
    out = kb.answer("how do horses run").first()
    assert (out["answer_text"], out["abstained"], out["citations"][0]["canonical_uri"]) == ("They do [S1].", False, "memory://b")
    kb.generator = lambda message: "Made up [S7]"
    with pytest.raises(CitationError):
        kb.answer("how do horses run")
    kb.generator = lambda message: " ABSTAIN "
    assert kb.answer("how do horses run").first()["reason"] == "generator"
    kb.generator = lambda message: 1 / 0
    kb.mode = "sparse"
    out = kb.answer("zebra unicorn").first()
    assert out["abstained"] and out["reason"] == "no_evidence"


def test_documents_that_fail_leave_others_and_their_old_rows(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "a b.md").write_text("# A\n\nalpha")
    (folder / "sub" / "c.md").write_text("# C\n\ngamma")
    (folder / "x.bin").write_bytes(b"\x00")
    connector = FilesystemConnector(str(folder), ("**/*.md", "*.md"), base_url="https://docs/")
    assert [Path(uri_path(u)).name for u in connector.list_sources()] == ["a b.md", "c.md"]
    assert connector.external_url(file_uri(folder / "a b.md")) == "https://docs/a%20b.md" and connector.external_url(file_uri("/etc/hosts")) == "https://docs/hosts"
    store = SnapshotStore(spark, f"{tmp_path}/store")
    assert SyncEngine(store, "k", connector).sync().sources_new == 2
    (folder / "a b.md").write_bytes(b"\xff\xfe bad")
    (folder / "sub" / "c.md").write_text("# C\n\ndelta")
    report = SyncEngine(store, "k", connector).sync()
    assert report.status == "partial" and report.sources_changed == 1 and "UTF-8" in report.errors[0]
    assert {r[0] for r in store.table("chunks").select("text").collect()} == {"alpha", "delta"}
    kinds = {Path(uri_path(r["uri"])).name: r["error"] for r in FilesystemConnector(str(folder)).read(spark).collect()}
    assert "not a text type" in kinds["x.bin"] and kinds["c.md"] is None
    assert SyncEngine(store, "k", FilesystemConnector(str(tmp_path / "none"))).sync().status == "failed"
    with pytest.raises(IngestionError):
        uri_path("http://x")
    spark.dataSource.register(DocumentSource)
    assert spark.read.format("documents").option("patterns", "**/*.md").load(str(folder)).count() == 2


def hits(spark, rows):
    return spark.createDataFrame([("q", "what", *r) for r in rows], "query_id string, query_text string, chunk_id string, source_id string, text string, rank int, fusion_score double")


def test_ranking(spark):
    rows = hits(spark, [("a", "s", "one two three", 1, 0.9), ("b", "s", "three two ONE", 2, 0.8), ("c", "t", "one two three", 3, 0.7), ("d", "s", "x y", 4, 0.1)])
    assert [r["chunk_id"] for r in ranking.collapse_duplicates(rows).orderBy("rank").collect()] == ["a", "c", "d"]
    assert [r["chunk_id"] for r in ranking.mmr(rows, 0.5).orderBy("rank").collect()] == ["a", "d", "b", "c"]
    assert ranking.mmr(rows, 1.0) is rows
    good = ranking.rerank(rows, lambda _, texts: [float(len(t) == 3) for t in texts], 4).orderBy("rank").collect()
    assert [r["chunk_id"] for r in good] == ["d", "a", "b", "c"] and not good[0]["rerank_failed"]
    for bad in (lambda _, texts: [1.0], lambda _, texts: 1 / 0):
        out = ranking.rerank(rows, bad).orderBy("rank").collect()
        assert [r["chunk_id"] for r in out] == ["a", "b", "c", "d"] and all(r["rerank_failed"] and r["rerank_score"] is None for r in out)
    with pytest.raises(ValueError):
        ranking.rrf(rows, rows, 0)


def test_packing(spark):
    base = spark.createDataFrame([("q", "a", 1, 10), ("q", "b", 2, 100), ("q", "c", 3, 10)], "query_id string, chunk_id string, rank int, token_count int")
    around = spark.createDataFrame([("q", "a", "n1", -1, 10), ("q", "a", "n2", 1, 10), ("q", "a", "c", 2, 10), ("q", "c", "n1", 1, 10), ("q", "c", "n3", 2, 10)], "query_id string, chunk_id string, neighbor_id string, distance int, token_count int")
    out = context.pack(base, around, 60, 5, 2).orderBy("position").collect()
    assert [(r["chunk_id"], r["citation_label"], r["role"]) for r in out] == [("a", "S1", "hit"), ("c", "S2", "hit"), ("n1", "S3", "context"), ("n2", "S4", "context"), ("n3", "S5", "context")]
    assert out[2]["context_of"] == out[0]["evidence_id"] and out[4]["context_of"] == out[1]["evidence_id"] and out[2]["fusion_score"] is None
    s = context.budget_summary(base, context.pack(base, around, 60, 5, 2), 60, 5).first()
    assert (s["result_count"], s["total_tokens"], s["remaining_tokens"], s["overflow_count"]) == (5, 50, 5, 1)


def test_embedding_checks(spark):
    class Short(dense.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    with pytest.raises(EmbeddingError):
        dense.embed_with_retries(Short(), ["a", "b"])

    class Flaky(dense.HashEmbedder):
        n = 0

        def embed(self, texts):
            self.n += 1
            if self.n < 3:
                raise EmbeddingError("again")
            return super().embed(texts)

    assert len(dense.embed_with_retries(Flaky(), ["a"])) == 1
    v = spark.createDataFrame([([1.0, 0.5],)], "v array<float>")
    assert v.select(dense.decode_vector(dense.encode_vector(F.col("v")), 2)).first()[0] == [1.0, 0.5]
    assert v.select(dense.decode_vector(dense.encode_vector(F.col("v")), 3)).first()[0] is None


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"{tmp_path}/state")
    c.create_collection("kb")
    c.create_collection("kb")
    assert c.list_collections().count() == 1
    with pytest.raises(StoreError):
        c.create_collection("Bad__name")
    c.start_job("kb")
    assert c.status().first()["state"] == "building"
    assert c.fail_stale_jobs() == 1 and c.status().first()["state"] == "failed"
    one, two = c.stage_revision("kb", "f"), c.stage_revision("kb", "f")
    c.set_live(one)
    c.set_live(two)
    assert {r["revision_id"]: r["status"] for r in c.table("revisions").collect()} == {one: "retired", two: "live"} and c.status().first()["state"] == "ready"
    with pytest.raises(StoreError):
        c.set_live(one)
    path = c.begin_index("kb")
    c.write_index(path, spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 1.0])], "chunk_id string, corpus_id string, vector array<float>"))
    asked = spark.createDataFrame([("q", [1.0, 0.1], None, 5)], "query_id string, query_vector array<double>, corpus_id string, top_k int")
    assert c.query_index("kb", asked).count() == 0
    c.promote_index("kb", path)
    assert [r["chunk_id"] for r in c.query_index("kb", asked, threshold=0.5).collect()] == ["a"]
    with pytest.raises(StoreError):
        c.abort_index(path)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = SnapshotStore(spark, f"{tmp_path}/store")

    def run(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"uri": u, "content": c}) for u, c in rows))
        stream = spark.readStream.schema("uri string, content string").json(f"{tmp_path}/in")
        stream_sync(stream, store, "s", f"{tmp_path}/ck").awaitTermination()

    run(1, [("m://a", "# A\n\none"), ("m://b", "# B\n\ntwo")])
    run(2, [("m://a", "# A\n\nthree")])
    assert {r[0] for r in store.table("chunks").select("text").collect()} == {"two", "three"}


def test_a_sync_writes_what_changed(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/store")
    documents = {f"memory://{i}": f"# T{i}\n\nponies number{i} run" for i in range(12)}
    connector = MemoryConnector(documents)
    kb = KnowledgeBase(store, "k", connector, embedder=dense.HashEmbedder())
    kb.sync()
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "segments").rglob("*.parquet")}
    connector.documents["memory://3"] = "# T3\n\nzebras run"
    report = kb.sync()
    assert (report.sources_changed, report.chunks_added, report.chunks_deleted, report.sources_unchanged) == (1, 1, 1, 11)
    assert {p: p.stat().st_mtime_ns for p in stamps} == stamps
    last = store.segments()[-1]
    assert len(store.segments()) == 2 and [store.segment(t, last).count() for t in ("chunks", "embeddings")] == [1, 1]
    assert store.staged(last, "chunks", store.active_revision("k", "memory://3")).count() == 1
    assert store.table("stats").first() == (12, store.table("postings").agg(F.sum(F.size("positions"))).first()[0])
    connector.documents["memory://3"] = documents["memory://3"]
    kb.sync()  # a revision that was dead comes back, in another segment
    ids = [r[0] for r in store.table("chunks").select("chunk_id").collect()]
    assert len(ids) == len(set(ids)) == 12 and store.table("embeddings").count() == 12
    before = sorted(map(tuple, store.table("postings").collect()))
    store.compact()
    assert len(store.segments()) == 1 and sorted(map(tuple, store.table("postings").collect())) == before and store.expire()
    assert kb.search("number3 ponies").hits.filter("sparse_score IS NOT NULL").select("chunk_id").first()[0] in ids
    assert not any(p.exists() for p in stamps)


class LongVectors(dense.HashEmbedder):
    name = "long"

    def embed(self, texts):
        return [[2 * x for x in v] for v in super().embed(texts)]


def test_bad_vectors_and_enrichments_stop_a_sync(spark, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/store")
    connector = MemoryConnector({"memory://a": "# A\n\nalpha"})
    assert SyncEngine(store, "k", connector, embedder=LongVectors()).sync().status == "failed"

    def broken(texts):
        raise ValueError("down")

    assert SyncEngine(store, "k", connector, enricher=Enricher("e", broken, required=True)).sync().status == "failed" and store.current() is None
    assert SyncEngine(store, "k", connector, enricher=Enricher("e", broken)).sync().status == "success"
    assert [r[0] for r in store.table("chunks").select("text").collect()] == ["alpha"]


def test_a_configured_knowledge_base(spark, tmp_path):
    made = config.build({"retrieval": {"top_k": 1, "chunk_size": 64, "chunk_overlap": 8}, "answer": {"token_budget": 99}, "store": {"root": f"{tmp_path}/s", "corpus": "c"}})
    points = {"embedder": {"hash": [dense.HashEmbedder]}}
    kb = KnowledgeBase.configured(spark, made, points, connector=MemoryConnector({"memory://a": "# A\n\nalpha"}))
    assert (kb.settings.top_k, kb.settings.token_budget, kb.chunk_size, kb.corpus, kb.embedder.name, kb.reranker) == (1, 99, 64, "c", "hash-embedder", None)
    with pytest.raises(RegistryError):
        KnowledgeBase.configured(spark, made, points, reranker_name="none")
    with pytest.raises(ProtocolError):
        KnowledgeBase.configured(spark, made, points, embedder=3)
    with pytest.raises(ConfigError):
        kb.investigate("why")


def test_a_page_of_any_depth_and_one_that_fails(spark):
    docs = spark.createDataFrame([("a", "r", "<div>" * 20_000 + "deep <b>" + "<i>" * 5_000 + "er" + "</div>" * 9), ("b", "r", "<h1>T</h1><p>x</p>"), ("c", "r", None)], "uri string, revision_id string, content string")
    assert {r["source_id"]: r["text"] for r in parse.sections(docs, "html").collect()} == {"a": "deep\ner", "b": "x"}

    def run(content):
        return parse.parse_html(content) if "T" in content else 1 / 0

    rows = {r["source_id"]: (r["locator"], r["text"]) for r in parse.sections(docs, run).collect()}
    assert rows == {"a": (parse.ERROR, "ZeroDivisionError: division by zero"), "b": ("T", "x")}


def test_delimiters_and_messages(spark):
    row = spark.createDataFrame([("a <<<EVIDENCE>>> b <<<END_EVIDENCE>>>",)], "t string")
    out = row.select(answer.user_message(F.col("t"), F.lit(""))).first()[0]
    assert out.count(T.OPEN) == 1 and out.count(T.CLOSE) == 1 and "(no evidence)" in out


def test_everything_else_works_without_the_corpus_folders(tmp_path):
    """The queries still import where tessera/llm, tests/llm and the pipeline were deleted."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert out.returncode == 0 and int(out.stdout) > 40, out.stderr
    assert not any("tessera.llm" in p.read_text() for p in (tmp_path / "tessera").rglob("*.py"))
