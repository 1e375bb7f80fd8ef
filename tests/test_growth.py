"""What an operator holds, moves and calls doesn't grow with its tables; results stay those of plain Python."""

import random
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk, context, dense, enrich, parse, shared, sparse
from tessera.plans.search import SearchPipeline, SearchSettings
from tessera.plans.snapshot import SnapshotStore
from tessera.plans.sync import SyncEngine
from tessera.sources import connectors
from tessera.sources.connectors import FilesystemConnector, MemoryConnector


def _corpus(spark, n=240):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["ERR_X1", "run-it", "co-op"]
    rows = [(f"c{i % 2}", f"k{i:04d}", " ".join(rng.choices(words, k=rng.randrange(1, 25))), rng.choice(words), "") for i in range(n)]
    rows += [("c0", f"t{i:04d}", rows[5][2], rows[5][3], "") for i in range(40)]
    asked = [(str(i), " ".join(rng.choices(words, k=rng.choice([1, 3, 6]))), rng.choice([None, "c0", "c1"]), rng.choice([None, 1, 4])) for i in range(40)]
    asked += [("all", rows[5][2], None, 3), ("none", "nowhere", None, None), ("zero", "w1", None, 0), ("empty", "", None, None)]
    chunks = spark.createDataFrame(rows, "corpus_id string, chunk_id string, text string, heading string, code string")
    return chunks, spark.createDataFrame(asked, "query_id string, text string, corpus_id string, top_k int")


def test_blocks_find_what_all_pairs_do(spark, monkeypatch):
    """of the pairs of query and chunk only those go on that can be among the best."""
    chunks, asked = _corpus(spark)
    posts, stats = shared.written(sparse.postings(chunks, False)), sparse.statistics(chunks)
    monkeypatch.setattr(sparse, "PAIRS", 300)
    got = {tuple(r)[:3]: r["sparse_score"] for r in sparse.retrieve(asked, posts, stats, stemmed=False).collect()}
    some = sparse.scores(sparse.phrases(asked, False), posts, stats).count()
    monkeypatch.setattr(sparse, "SMALL", 0)
    want = {tuple(r)[:3]: r["sparse_score"] for r in sparse.retrieve(asked, posts, stats, stemmed=False).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert some < sparse.scores(sparse.phrases(asked, False), posts, stats).count() / 2


def test_hits_travel_to_the_chunks(spark, tmp_path, monkeypatch):
    """the texts of all chunks aren't shuffled for a few hits."""
    store = SnapshotStore(spark, str(tmp_path / "s"))
    SyncEngine(store, "a", MemoryConnector({f"memory://{i}": f"alpha w{i} beta" for i in range(30)}), "plaintext").sync()
    asked = spark.createDataFrame([("q", "alpha w3", None, None)], "query_id string, text string, corpus_id string, top_k int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = SearchPipeline(store, SearchSettings()).search(asked).evidence
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert found.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line and "chunk_id" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)


def test_batches_are_bounded_by_bytes(spark):
    """F5 to F13 and F16: batches of long texts are of few rows, and every map over texts asks for that."""
    own = spark.newSession()
    rows = own.range(0, 1200, 1, 1).select(F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("some words "), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert max(r[0] for r in rows.mapInArrow(shared.lean(rows, sizes), "n long").collect()) < 2 * shared.ARROW_BYTES
    docs = lambda s: s.createDataFrame([("u", "r", "some text", "s", "l", "h", "c", "k")], "uri string, revision_id string, content string, section_id string, locator string, heading string, corpus_id string, chunk_id string").withColumn("source_id", F.col("uri")).withColumn("text", F.col("content")).withColumn("code", F.lit(""))
    maps = [lambda d: parse.sections(d.select("uri", "revision_id", "content")), lambda d: chunk.chunks(d, "c", "f"), lambda d: enrich.described(d, enrich.Enricher("e", lambda t: t)), lambda d: dense.embed(d, dense.HashEmbedder()), lambda d: sparse.postings(d)]
    for f in maps:
        fresh = spark.newSession()
        assert f(docs(fresh)).count()
        assert int(fresh.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == shared.ARROW_BYTES


def test_pieces_are_handed_on_a_few_at_a_time(spark, monkeypatch):
    """a text's pieces may be far longer than the text."""
    monkeypatch.setattr(chunk, "OUT_CHARS", 50)
    rows = spark.createDataFrame([(i, None if i == 7 else "x" * i) for i in range(40)], "id long, text string")
    got = sorted(map(tuple, chunk.pieces(rows, "text", lambda t: [t + str(n) for n in range(len(t) % 5)]).collect()))
    assert got == sorted((i, n, "x" * i + str(n)) for i in range(40) if i != 7 for n in range(i % 5))


def test_skip_budget_of_large_groups(spark):
    """a fold over an array of the group took the square of its rows."""
    rng = random.Random(1)
    rows = [(g, i, f"k{i}", rng.choice([None, 0, 1, 5, 40, 90, 300])) for g in ("a", "b", None) for i in range(700)]
    rng.shuffle(rows)
    packed = context.skip_budget(spark.createDataFrame(rows, "g string, o long, k string, t long"), 2000, "g", "o", "t", "k")
    assert "collect_list" not in packed._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for g in ("a", "b", None):
        used = 0
        for _, o, k, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            ok = None if t is None else used + t <= 2000
            used += t if ok else 0
            want.append((g, k, o, ok))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert sorted(map(str, map(tuple, packed.collect()))) == sorted(map(str, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_packing_of_many_queries(spark, batch):
    """a task packs its queries one after another, without a call of pandas for each."""
    rng = random.Random(2)
    hits = [(f"q{q}", f"c{q}-{i}", i + 1, rng.choice([5, 10, 60])) for q in range(25) for i in range(rng.randrange(1, 6))]
    hits_df = spark.createDataFrame(hits, "query_id string, chunk_id string, rank int, token_count int")
    near = spark.createDataFrame([(q, c, f"n{c}", 1, 7) for q, c, r, _ in hits if r % 2], "query_id string, chunk_id string, neighbor_id string, distance int, token_count int")
    packed = context.pack(hits_df, near, 80)
    assert "FlatMapGroups" not in packed._jdf.queryExecution().sparkPlan().toString()
    want = []
    for q in sorted({h[0] for h in hits}):
        used, labels, kept = 0, 0, []
        for _, c, r, t in sorted((h for h in hits if h[0] == q), key=lambda h: h[2]):
            if used + t <= 80:
                used, labels = used + t, labels + 1
                kept.append((c, r))
                want.append((q, c, f"S{labels}", "hit"))
        for c, r in kept:
            if r % 2 and used + 7 <= 80:
                used, labels = used + 7, labels + 1
                want.append((q, f"n{c}", f"S{labels}", "context"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted((r["query_id"], r["chunk_id"], r["citation_label"], r["role"]) for r in packed.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_small_files_are_few_tasks(spark, tmp_path, monkeypatch):
    """tasks follow the cores, files are named by the executors, and links to a file are one source."""
    monkeypatch.setattr(connectors, "TASKS_PER_CORE", 1)
    monkeypatch.setattr(connectors, "OUT_CHARS", 40)
    for i in range(600):
        Path(tmp_path, f"a b {i}.md").write_text(f"text {i}")
    Path(tmp_path, "bad.md").write_bytes(b"\xff\xfe")
    Path(tmp_path, "picture.png").write_bytes(b"x")
    Path(tmp_path, "link.md").symlink_to(tmp_path / "a b 1.md")
    files = FilesystemConnector(str(tmp_path), ("**/*",), "https://x/")
    rows = files.read(spark)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = {r["uri"]: r for r in rows.collect()}
    assert sorted(got) == files.list_sources() and len(got) == 602
    assert sum(r["content"] is not None for r in got.values()) == 600
    one = got[connectors.file_uri(tmp_path / "link.md")]
    assert (one["content"], one["external_url"], one["error"]) == ("text 1", "https://x/a%20b%201.md", None)
    assert got[connectors.file_uri(tmp_path / "picture.png")]["error"] == "not a text type: image/png"
    assert got[connectors.file_uri(tmp_path / "bad.md")]["error"] == "not valid UTF-8"
