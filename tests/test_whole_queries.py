"""Queries over small tables against brute force on every row."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import dense
from tessera.queries import ORACLES, QUERIES


@pytest.mark.parametrize("kind", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("groups", [False, True])
def test_dense_queries_search_every_vector(spark, tmp_path, monkeypatch, kind, groups):
    """Queries are the rows whose id is divisible by 50."""
    if groups:
        monkeypatch.setattr(dense, "SMALL", 1)
        monkeypatch.setattr(dense, "GROUP", 30)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    x[7:12] = x[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i * 10, [float(v) for v in x[i]]) for i in range(90)] + [(9050, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES[f"dense_topk_{kind}"](spark, str(tmp_path)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["score"])
    assert set(got) == {str(i * 10) for i in range(0, 90, 5)}
    for q in range(0, 90, 5):
        s = -np.linalg.norm(x - x[q], axis=1) if kind == "euclidean" else x @ x[q]
        best = sorted(((-round(float(v), 6), str(i * 10)) for i, v in enumerate(s)))[:10]
        mine = [got[str(q * 10)][k] for k in range(1, 11)]
        assert [c for c, _ in mine] == [c for _, c in best] and np.allclose([v for _, v in mine], [-v for v, _ in best])


def test_bm25_asks_with_the_whole_item(spark, tmp_path):
    """Words from the ninth on count: they decide the strict match, the scores and the order."""
    names = "alpha bravo carbon delta ember falcon garnet harbor".split()
    rows = [(1, " ".join(names)), (2, " ".join([*names, "indigo", "jasper"])), (3, " ".join([*names, "indigo"])), (4, "zebra"), (5, "indigo jasper jasper"), (6, None), *[(i, f"other{i} text") for i in range(10, 40)]]
    spark.createDataFrame([(i, t, None, None) for i, t in rows], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join([*names, "indigo", "jasper"])), (2, " ".join([*names, "jasper", "nowhere"]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {str(i): t.split() for i, t in rows if t is not None}
    average = sum(map(len, texts.values())) / len(texts)

    def idf(word):
        df = sum(word in t for t in texts.values())
        return max(np.log((len(texts) - df + 0.5) / (df + 0.5)), 1e-6)

    def part(word, t):
        tf = t.count(word)
        return idf(word) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / average))

    for stemmed in ("porter", "ascii"):
        got = {}
        for r in QUERIES[f"bm25_topk_{stemmed}"](spark, str(tmp_path)).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], float(r[3])))
        for item, asked in items:
            words = asked.split()
            strict = [c for c, t in texts.items() if all(w in t for w in words)]
            scored = {c: sum(part(w, t) for w in words if w in t) for c, t in texts.items() if (c in strict if strict else any(w in t for w in words))}
            best = sorted(scored, key=lambda c: (-round(scored[c], 9), c))[:10]
            mine = sorted(got[str(item)])
            assert [c for _, c, _ in mine] == best and np.allclose([s for *_, s in mine], [scored[c] for c in best], atol=1e-6)


@pytest.fixture(scope="module")
def long_lists(spark, tmp_path_factory):
    """Sources with more documents than any cap had, most of them long."""
    rng = random.Random(6)
    rows = []
    for i in range(130):
        text = " ".join(f"w{rng.randrange(80)}" for _ in range(rng.choice([20, 150])))
        rows.append((i, text, "en", f"src{i % 2}", len(text)))
    rows.append((500, None, "en", "src0", None))
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_jaccard_of_all_documents(spark, long_lists):
    d, rows = long_lists
    sets = [(i, s, set(t.split())) for i, t, _, s, _ in rows if t is not None]
    per = {s: sorted((i, x) for i, t, x in sets if t == s) for s in ("src0", "src1")}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for rows in per.values() for (a, x), (b, y) in zip(rows, rows[1:])}
    got = {(r["a"], r["b"]): r["jaccard"] for r in QUERIES["jaccard_pairs"](spark, d).collect()}
    assert got == want


def test_lists_have_all_hits(spark, long_lists):
    d, rows = long_lists
    every = {(s, str(i)) for i, _, _, s, _ in rows}
    fused = {(r["query_id"], r["chunk_id"]): (r["fusion_score"], r["rank"]) for r in QUERIES["rrf_hybrid"](spark, d).collect()}
    assert set(fused) == every
    first = {"src0": [], "src1": []}
    for source, hits in first.items():
        ids = [(i, -1 if n is None else n) for i, _, _, s, n in rows if s == source]
        a = {i: k for k, (i, _) in enumerate(sorted(ids, key=lambda x: (-x[1], x[0])), 1)}
        b = {i: k for k, (i, _) in enumerate(sorted(ids, reverse=True), 1)}
        score = {i: 1 / (60 + a[i]) + 1 / (60 + b[i]) for i, _ in ids}
        hits += sorted(score, key=lambda i: (-score[i], str(i)))
        for k, i in enumerate(hits, 1):
            assert fused[source, str(i)] == (pytest.approx(score[i], abs=1e-9), k)
    trimmed = {(r["query_id"], r["chunk_id"], r["rank"]) for r in QUERIES["top_k_trim"](spark, d).collect()}
    assert trimmed == {(s, str(i), k) for s, n in (("src0", 10), ("src1", 3)) for k, i in enumerate(first[s][:n], 1)}


def test_every_turn_is_a_hit(spark, tmp_path):
    turns = {1: range(7), 2: [0], 3: [0, 1, 2]}
    rows = [(c, t, "user", f"what about the other {t}") for c, ts in turns.items() for t in ts]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {(str(c), f"{c}/{a}", f"{c}/{b}", b - a) for c, ts in turns.items() for a in ts for b in ts if 1 <= abs(a - b) <= 2}
    assert {tuple(r) for r in QUERIES["neighbor_expand"](spark, str(tmp_path)).collect()} == want
    for name in ("mmr_order", "rerank_window"):
        hits = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r["query_id"], r["chunk_id"]) for r in hits) == sorted((str(c), f"{c}/{t}") for c, t, *_ in rows)
    packed = QUERIES["expand_and_pack"](spark, str(tmp_path)).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["role"]) for r in packed) == sorted((str(c), f"{c}/{t}", "hit") for c, t, *_ in rows)
    cited = QUERIES["snippets"](spark, str(tmp_path)).collect()
    assert sorted(r["chunk_id"] for r in cited) == sorted(f"{c}/{t}" for c, t, *_ in rows)


def test_names_end_where_their_sql_says(spark, tmp_path):
    """A name before a letter of another script: none by Unicode's borders, one by ASCII's, which the SQL has."""
    asked = spark.createDataFrame([("SS\u00f6 t", ["SS"]), ("x ERR_A\u00e9 \u00e9RunIt RunIt_ run-it\u00df /us/r", ["ERR_A", "run-it", "/us/r", "RunIt"]), (None, [])], "text string, want array<string>")
    assert all(r[0] == r[1] for r in asked.select(T.boost_words(F.col("text"), True), "want").collect())
    assert [r[0] for r in asked.select(T.boost_words(F.col("text"))).collect()] == [[], ["/us/r"], []]
    rows = [(i, t, "a", "en") for i, t in enumerate(["alpha bravo carbon", "ss alpha", "SS bravo", "ss\u00f6 carbon", "delta", "ember", "falcon"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "SS\u00f6 alpha bravo"), (2, "alpha bravo")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(db.execute(ORACLES["bm25_topk_ascii"]).fetchall())
    assert {c for q, c, *_ in want if q == "1"} == {"1", "2"}
    assert sorted(map(tuple, QUERIES["bm25_topk_ascii"](spark, str(tmp_path)).collect())) == want
