"""Operators as DataFrames: brute force on small tables, and the defined results of odd inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import blocks, exact_dedup, html_extract, language, mixing, mtree, near_dedup, pieces, quality, secrets, suffix_dedup
from tessera.llm.components import components
from tessera.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for with was on are as at be by this from it an or have not but they".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "er", "ing"]) + str(rng.randrange(60)) for _ in range(n))


def row(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empties and repeated rows."""
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 200)) for _ in range(120)]
    passage = prose(rng, 60)
    rows = [row(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [row(200 + i, texts[i]) for i in range(10)]
    for i in range(10, 30):
        words = texts[i].split()
        if len(words) > 30:
            words[rng.randrange(len(words))] = "changed"
        rows.append(row(300 + i, " ".join(words)))
    for i in range(5):
        rows.append(row(400 + i, f"{prose(rng, 40)}\n{passage} {prose(rng, 30)}"))
    rows += [row(500, None), row(501, None), row(502, ""), row(503, ""), row(504, "  \n"), row(None, "a text without an id"), row(None, texts[3]), row(505, "x" * 200_000), row(506, "w " * 30_000)]
    rows += [rows[0], rows[7], row(508, "same id, one"), row(508, "same id, two")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


def wide(docs):
    """Extra columns whose names operators might use themselves."""
    names = ["id", "rest", "bucket", "node", "root", "score", "rank", "shard", "home", "w", "n", "ids", "label", "position", "tie", "range", "c0", "c1", "s", "g", "a.b", "__gone", "__id"]
    names += ["__source", "__rank", "__tie", "__range", "__s", "__score", "__stats", "__words", "__counts", "__cuts", "__shard", "__position", "digit_len", "digit_lead"]
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(names)])


def test_exact_duplicates(spark, docs, corpus):
    want, seen = Counter(), defaultdict(list)
    for r in corpus:
        if r[1] is not None:
            seen[r[1]].append(r[0])
    for ids in seen.values():
        ids.sort(key=lambda i: (i is None, i))
        want.update((i, ids[0]) for i in ids[1:])
    assert Counter(map(tuple, exact_dedup.exact_duplicates(docs).collect())) == want
    kept = exact_dedup.drop_exact_duplicates(wide(docs))
    assert kept.columns == wide(docs).columns
    rows = kept.select("doc_id", "text").collect()
    assert Counter(r[1] for r in rows if r[1] is not None) == Counter(dict.fromkeys(seen, 1))
    assert sum(r[1] is None for r in rows) == 2
    assert all(r[0] == seen[r[1]][0] for r in rows if r[1] is not None)


def shingles(text, width=near_dedup.SHINGLE):
    w = text.split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


@pytest.mark.parametrize("tile", [near_dedup.TILE, 4])
def test_near_duplicates(spark, docs, corpus, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    found = {tuple(r) for r in near_dedup.near_duplicates(docs).collect()}
    sets = {}
    for r in corpus:
        if r[0] is not None and r[1] is not None and r[0] != 508 and shingles(r[1]):
            sets[r[0]] = shingles(r[1])
    root = dict(found)
    same = lambda a, b: root.get(a, a) == root.get(b, b)
    close = apart = hit = 0
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.75:
                close += 1
                hit += same(a, b)
            elif j < 0.3:
                apart += same(a, b)
    assert close > 20 and hit / close >= 0.9 and apart == 0
    assert all(a > b for a, b in found) and len(root) == len(found)
    kept = near_dedup.drop_near_duplicates(wide(docs))
    assert kept.columns == wide(docs).columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in corpus} - set(root)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (200, 200)]
    random.Random(0).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_repeated_passages(spark, docs, corpus):
    seen = defaultdict(set)
    texts = [(r[0], r[1].split()) for r in corpus if r[1] is not None]
    n = suffix_dedup.MIN_WORDS
    for k, (i, w) in enumerate(texts):
        for p in range(len(w) - n + 1):
            seen[tuple(w[p : p + n])].add(("row", k) if i is None else i)
    want = Counter()
    for i, w in texts:
        spans = []
        for p in range(len(w) - n + 1):
            if len(seen[tuple(w[p : p + n])]) > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n])
        want.update((i, a, b) for a, b in spans)
    spans = suffix_dedup.repeated_passages(docs)
    assert Counter(map(tuple, spans.collect())) == want
    assert {i for i, *_ in want} >= {400, 401, 402, 403, 404}
    only = docs.filter("doc_id BETWEEN 400 AND 404")
    left = suffix_dedup.remove_repeats(wide(only), suffix_dedup.repeated_passages(only))
    assert left.columns == wide(only).columns
    assert all(len(r[0].split()) == 70 for r in left.select("text").collect())


def test_short_minimum_is_refused(docs):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(docs, 10)


def test_mixing(spark):
    rows = [row(i, f"t{i}", "big") for i in range(800)] + [row(2000 + i, f"u{i}", "small") for i in range(90)] + [row(3000, None, None), row(None, "x", "small"), row(3001, "", "other"), row(-2**63, "low", "small"), row(2**63 - 1, "high", "small")]
    rows += [rows[0], rows[0]]
    docs = wide(spark.createDataFrame(rows, DOCS))
    got = mixing.mix(docs, {"big": 3.0, "small": 1.0, "absent": 5.0}, docs_per_shard=64).collect()
    counts = Counter(r["source"] for r in got)
    blocks_small = -(-93 // mixing.BLOCK)
    assert set(counts) == {"big", "small"} and abs(counts["small"] - 93) <= mixing.BLOCK
    assert abs(counts["big"] - 3 * blocks_small * mixing.BLOCK) <= 3 * mixing.BLOCK
    assert max(Counter((r["doc_id"], r["text"]) for r in got).values()) <= 3
    per = defaultdict(list)
    for r in got:
        per[r["__shard_"]].append(r["__position_"])
    assert all(sorted(p) == list(range(len(p))) for p in per.values()) and len(per) > 3
    assert sum({r["source"] for r in got if r["__shard_"] == k} == {"big", "small"} for k in per) > 0.7 * len(per)
    again = mixing.mix(docs, {"big": 3.0, "small": 1.0, "absent": 5.0}, docs_per_shard=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mixing.mix(docs, {"big": 3.0, "small": 1.0}, docs_per_shard=64, seed=9).collect()
    assert {r["doc_id"] for r in other if r["source"] == "big"} != {r["doc_id"] for r in got if r["source"] == "big"}


def test_pieces(spark, docs, corpus):
    model = pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = pieces.encoded(wide(docs), model)
    got = Counter((r["doc_id"], None if r["ids"] is None else tuple(r["ids"])) for r in rows.collect())
    assert got == Counter((r[0], None if r[1] is None else tuple(sp.encode(r[1]))) for r in corpus)
    assert all(r["exact"] for r in rows.collect() if r["ids"] is not None)
    back = Counter((r[0], r[1]) for r in pieces.decoded(rows, model).collect())
    assert back == Counter((r[0], r[1]) for r in corpus)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[10:14] = x[0]
    data = [(i, [float(v) for v in x[i]], i % 3) for i in range(300)] + [(900, None, 0), (901, [1.0], 0), (902, [float("nan")] * 6, 0), (903, [None] * 6, 0), (None, [0.0] * 6, 0), (5, [float(v) for v in x[5]], 1)]
    got = mtree.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), k=4).collect()
    ids = np.array([*range(300), 5])
    every = np.concatenate([x, x[5:6]])
    real = np.round(mtree.distances(every, every), 6)
    for q in range(300):
        best = sorted({(real[q, j], int(ids[j])) for j in range(301) if ids[j] != q})[:4]
        mine = [(r["distance"], r["neighbor_id"]) for r in sorted((r for r in got if r["vec_id"] == q), key=lambda r: r["rank"])]
        assert [i for _, i in mine] == [i for _, i in best] and np.allclose([d for d, _ in mine], [d for d, _ in best])


def test_nearest_across_cells(spark, monkeypatch):
    """More levels, rings and chunks than tables of this size need; a third of the rows are one vector."""
    for name, value in {"CELL": 8, "QUERIES": 100, "NODE": 16, "FANOUT": 8, "PIVOTS": 24, "RINGS": 4}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)) + rng.integers(0, 4, size=(400, 1)) * 3
    x[:130] = x[0]
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(400)] + [(7, [float(v) for v in x[7]])], "vec_id long, embedding array<float>")
    real = np.round(mtree.distances(x.astype(np.float64), x.astype(np.float64)), 6)
    np.fill_diagonal(real, np.inf)
    for asked, ids in ((None, range(400)), (F.col("vec_id") % 50 == 0, range(0, 400, 50))):
        got = mtree.nearest(rows, k=3, asked=asked).collect()
        assert Counter(r["vec_id"] for r in got) == Counter({i: 3 for i in ids})
        for r in got:
            order = np.lexsort((np.arange(400), real[r["vec_id"]]))
            assert order[r["rank"] - 1] == r["neighbor_id"]


def test_quality(spark, docs, corpus):
    rng = random.Random(5)
    good = [row(i, prose(rng, 60)) for i in range(150)]
    bad = [row(1000 + i, " ".join(f"{w}$$$ ### %%%" for w in prose(rng, 40).split())) for i in range(150)]
    train = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good + bad if r[0] % 3] + [(None, 1, 0), (7777, None, 0), (4242, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(train, labels)
    kept = {r[0] for r in quality.accepted(train, model).select("doc_id").collect()}
    assert len(kept & {r[0] for r in good}) >= 148 and len(kept - {r[0] for r in good}) <= 2
    odd = quality.accepted(wide(docs), model)
    assert odd.columns == wide(docs).columns and odd.count() <= len(corpus)
    assert quality.scored(docs, model).filter("__score IS NULL OR isnan(__score)").count() == 0
    assert quality.accepted(docs, quality.RuleModel()).count() == len(corpus)


def test_html(spark):
    pages = [(1, "u", "<nav><a href=x>Home</a></nav><article><p>A long sentence with many words that is the text of the page.</p></article>"), (2, "u", None), (3, "u", ""), (3, "u", "<nav><a>x</a></nav>"), (None, "u", "<article><p>Some more text here, which is long enough, I hope.</p></article>"), (5, "u", "<p>" + "word " * 50_000)]
    df = wide(spark.createDataFrame(pages, "page_id long, url string, html string"))
    weights = html_extract.train(df)
    got = Counter(map(tuple, html_extract.extracted(df, weights).collect()))
    assert sum(got.values()) == 6 and got[(2, None)] == 1 and got[(3, "")] >= 1
    assert any(k[0] == 1 and k[1] == "A long sentence with many words that is the text of the page." for k in got)


def test_secrets(spark, docs):
    key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0ffeeddcc"
    rows = [row(1, f"é start {key} and {key}."), row(1, f"é start {key} and {key}."), row(2, "a_long_identifier_name_of_things"), row(3, None), row(4, ""), row(5, "4785380592391139 1234567890123456"), row(None, f"id {key}"), row(6, "x " * 50_000 + key)]
    got = Counter((r["doc_id"], r["start"], r["length"]) for r in secrets.scan(wide(spark.createDataFrame(rows, DOCS)), secrets.train()).collect())
    assert got == Counter({(1, 8, 40): 2, (1, 53, 40): 2, (None, 3, 40): 1, (6, 100_000, 40): 1})
    assert secrets.scan(docs, secrets.train(docs)).count() == 0


def test_language(spark, docs, corpus):
    model = language.train(docs)
    got = Counter((r["doc_id"], r["language"]) for r in language.identify(wide(docs), model).collect())
    assert sum(got.values()) == len(corpus) and got[(500, "und")] == 1 and got[(502, "und")] == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_duplicates(none).count() == exact_dedup.drop_exact_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == near_dedup.drop_near_duplicates(none).count() == 0
    assert suffix_dedup.repeated_passages(none).count() == 0
    assert mixing.mix(none).count() == pieces.encoded(none, pieces.load()).count() == 0
    assert mtree.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quality.accepted(none, quality.train(none, labels)).count() == 0
    assert secrets.scan(none, secrets.train(none)).count() == language.identify(none, language.train(none)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extracted(pages, html_extract.train(pages)).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    """The stages against brute force on the stages' own inputs."""
    rng = random.Random(8)
    bad = [row(700 + i, " ".join(f"{w}$$$ ### %%%" for w in prose(rng, 40).split()), f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(corpus + bad, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in corpus if r[0] is not None and r[0] < 120] + [(r[0], 0, 0) for r in bad[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tables = [now.collect()]
    for _, stage in corpus_pipeline.STAGES:
        now = blocks.cut(stage(spark, now, str(tmp_path)))
        tables.append(now.collect())
    first, rated, exact, near, mixed, last = tables
    assert all(t[0].__fields__ == list(DOCS.replace(" long", "").replace(" string", "").split(", ")) for t in (rated, exact, near, mixed))
    assert not {r.doc_id for r in rated} & {r[0] for r in bad} and len({r.doc_id for r in rated} & set(range(120))) >= 118
    assert Counter(r.text for r in exact if r.text is not None) == Counter(dict.fromkeys({r.text for r in rated if r.text is not None}, 1))
    assert set(near) <= set(exact) and set(mixed) <= set(near)
    ids = {r.doc_id for r in near}
    assert not any(300 + i in ids and i in ids for i in range(10, 30) if (a := next((r for r in exact if r.doc_id == i), None)) and len(a.text.split()) > 60)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter((r.doc_id, None if r.ids is None else tuple(r.ids)) for r in last) == Counter((r.doc_id, None if r.text is None else tuple(sp.encode(r.text))) for r in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_ids) for r in whole) == Counter((r.doc_id, r.n_ids) for r in last)


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
