"""The numpy kernels against plain Python."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exact_dedup, html_extract, language, mixing, mtree, near_dedup, pieces, quality, secrets, suffix_dedup
from tessera.llm import textkit as tk

TEXTS = ["", " ", "a", "a b", "\na\tb  c\n", "éà ü x", "日本 語", "x" * 300, "one two three four five"]


def test_words_of_slices():
    array = pa.array(TEXTS)
    got = []
    for i, j, data, offsets in tk.slices(array, 8):
        starts, ends, count = tk.word_spans(data, offsets)
        for k in range(j - i):
            got.append([data[s:e].tobytes() for s, e in zip(starts[count[k] : count[k + 1]], ends[count[k] : count[k + 1]])])
    assert got == [t.encode().split() for t in TEXTS]


def test_hashes_depend_on_content_only():
    data, offsets = np.frombuffer(b"ab cd ab cd ab", np.uint8), np.array([0, 14])
    starts, ends, _ = tk.word_spans(data, offsets)
    h = tk.span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]
    w = tk.window_hashes(h, np.arange(4), 2)
    assert w[0] == w[2] and w[1] == w[3] and w[0] != w[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\0é", max_size=40), max_size=30))
def test_equal_groups(texts):
    data, offsets = exact_dedup._buffers(pa.array(texts, pa.string()))
    group = exact_dedup.equal_groups(data, offsets)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (group[i] == group[j]) == (texts[i] == texts[j])


def test_equal_groups_of_long_texts():
    base = "x" * 50_000
    texts = [base, base, base[:-1] + "y", base + "z", base[:40_000] + "q" + base[40_001:], ""]
    group = exact_dedup.equal_groups(*exact_dedup._buffers(pa.array(texts)))
    assert len(set(group)) == 5 and group[0] == group[1]


def test_cover():
    assert suffix_dedup.is_cover(suffix_dedup.COVER, suffix_dedup.PERIOD)
    assert not suffix_dedup.is_cover((0, 1), 31)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for target in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(12):
            n = 400
            shared = int(n * 2 * target / (1 + target))
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)])
            real = shared / (2 * n - shared)
            sketch = near_dedup.odd_sketches(near_dedup.minhashes(np.concatenate([a, b]), np.array([n, n])))
            errors.append(near_dedup.similarity(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) - real)
        assert abs(np.mean(errors)) < 0.04 and np.std(errors) < 0.09


def test_forest_spans_all_components():
    rng = random.Random(3)
    base = [rng.getrandbits(512) for _ in range(5)]
    rows, label = [], []
    for k in range(60):
        c = k % 5
        rows.append(base[c] ^ (1 << rng.randrange(512)))
        label.append(c)
    sketch = np.array([[(r >> (64 * w)) & (2**64 - 1) for w in range(8)] for r in rows], np.uint64)
    a, b = near_dedup.forest(np.arange(60), sketch, 4)
    assert len(a) == 55 and all(label[i] == label[j] for i, j in zip(a, b))


def test_keyed_place_is_a_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixing.keyed_place(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.keyed_place(np.arange(1000), 1000, 5).tolist() != mixing.keyed_place(np.arange(1000), 1000, 6).tolist()


def test_block_quotas_are_exact():
    names, have, quotas = mixing.block_quotas({"a": 800, "b": 80, "c": 8}, {"a": 0.5, "b": 0.5, "x": 1.0}, 8)
    assert names == ["a", "b"] and have.tolist() == [100, 10] and quotas.tolist() == [10, 10]
    assert mixing.block_quotas({}, {"a": 1.0})[0] == []


def test_splitting_tree():
    quotas = np.array([40, 7, 0, 13])
    tree = mixing.SplittingTree(quotas, 7)
    per = tree.shard_quotas()
    assert per.sum(axis=0).tolist() == quotas.tolist()
    assert per.sum(axis=1).max() - per.sum(axis=1).min() <= 1
    source = np.repeat(np.arange(4), quotas)
    place = np.concatenate([np.arange(q) for q in quotas])
    shard = mixing.SplittingTree(quotas, 7).shard_of(source, place)
    for k in range(7):
        assert np.bincount(source[shard == k], minlength=4).tolist() == per[k].tolist()


def test_hypergeometric_split_is_fair():
    draws = np.array([mixing.SplittingTree(np.array([30, 10]), 2, seed).left(0, 2, np.array([30, 10])) for seed in range(300)])
    assert (draws.sum(axis=1) == 20).all() and abs(draws[:, 0].mean() - 15) < 0.4 and draws[:, 0].std() > 0.8


MODEL = pieces.load()
SP = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def encode(texts):
    enc, out = pieces.Encoder(MODEL), []
    for _, _, data, offsets in tk.slices(pa.array(texts, pa.string())):
        enc.learn(data, offsets)
    for i, j, data, offsets in tk.slices(pa.array(texts, pa.string())):
        ids, before = enc.encode(data, offsets)
        back, ends = pieces.decode(MODEL, ids, before)
        assert (back == data).all() and (ends == offsets).all()
        out += [ids[before[k] : before[k + 1]].tolist() for k in range(j - i)]
    return out


def test_pieces_equal_the_library():
    texts = [*TEXTS, "unbelievable internationalisation!!!", "    deep  indent", "😀x​", "aaaaaaaaaaaa bbbbb ------", "https://x.y/z?q=1&r=2", "\x00\x01", "a" * 5000]
    assert encode(texts) == SP.encode(texts)


def test_long_words_equal_the_library():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(letters) for _ in range(100_000)), "the" * 2000, "-" * 700, " " * 300 + "x", "日本語" * 500, "=-" * 200 + "x" * 130, "\n" * 400]
    texts += [" " * n + w for n in (2, 14, 15, 16, 17, 31, 33) for w in ("", "word", "x")]
    texts += ["".join(rng.choice(["th", "e", "ing", "an", "q"]) for _ in range(n)) for n in range(60, 130)]
    assert encode(texts) == SP.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",), exclude_characters="▁"), max_size=60))
def test_pieces_round_trip_and_equal_the_library(text):
    assert encode([text]) == [SP.encode(text)]


def test_unigram_viterbi_finds_the_best_path():
    words = ["▁a", "a", "b", "ab", "▁ab", "ba", "▁", "aba"]
    scores = np.array([-2.0, -3.0, -3.5, -4.0, -4.2, -3.9, -1.0, -5.0])
    keys = np.array([pieces._hash(np.array([ord(c) for c in w], np.uint32)) for w in words], np.uint64)
    o = np.argsort(keys)
    model = pieces.PieceModel(keys[o], np.arange(len(words))[o], scores, *[np.zeros(len(words), np.int64)] * 3, np.zeros(0, np.int64), np.zeros(0, np.int64), np.full(256, 0), np.zeros(0, np.uint8), np.zeros(1, np.int64), 3, False, pieces._seen(keys))

    def best(w):
        if not w:
            return 0.0
        return max((scores[words.index(w[:k])] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in words), default=-math.inf)

    for w in ["▁ab", "▁aba", "▁abab", "▁bab"]:
        ids, count = pieces.encode_words(model, np.array([ord(c) for c in w], np.uint32), np.array([len(w)]))
        assert "".join(words[i] for i in ids) == w and count[0] == len(ids)
        assert math.isclose(sum(scores[i] for i in ids), best(w))


def test_cell_search_equals_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8))
    x[50:60] = x[0]
    ids = np.arange(700) * 3
    d = mtree.distances(x, x[:1])[:, 0]
    got_i, got_d = mtree.Cell(ids, x, d).search(ids, x, d, np.full(700, np.inf), 5)
    real = np.round(mtree.distances(x, x), mtree.DIGITS)
    np.fill_diagonal(real, np.inf)
    for q in range(700):
        order = np.lexsort((ids, real[q]))[:5]
        assert got_i[q].tolist() == ids[order].tolist() and np.allclose(got_d[q], real[q][order])


def test_rules_learn_and_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(4)
    n = 3000
    stats = {k: rng.random(n) for k in quality.NAMES}
    good = ((stats["symbols"] < 0.4) & (stats["distinct"] > 0.3)).astype(int)
    train, test = np.arange(n) < 2000, np.arange(n) >= 2000
    model = quality.fit({k: v[train] for k, v in stats.items()}, good[train])
    held = {k: v[test] for k, v in stats.items()}
    score = model.score(held)
    assert ((score >= 0.5) == good[test]).mean() > 0.96
    assert len(model.rules) < 300 and all(w != 0 for w in model.weights)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([[float(held[k][i]) for k in quality.NAMES] for i in range(50)], list(quality.NAMES))
    jvm = [r[0] for r in rows.select(model.column({k: F.col(k) for k in quality.NAMES})).collect()]
    assert np.allclose(jvm, score[:50])


def test_rules_without_two_classes_accept_all():
    model = quality.fit({k: np.zeros(3) for k in quality.NAMES}, np.ones(3))
    assert (model.score({k: np.zeros(2) for k in quality.NAMES}) > 0.99).all()


def brute_cut(source, sink, links):
    n, best, sides = len(source), math.inf, None
    for keep in itertools.product([False, True], repeat=n):
        cost = sum(sink[i] if keep[i] else source[i] for i in range(n)) + sum(c for a, b, c in links if keep[a] != keep[b])
        if cost < best - 1e-9:
            best, sides = cost, keep
    return best, sides


def test_min_cut_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(1, 9)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        links = [(a, b, rng.random() * 2) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        keep = html_extract.min_cut(source, sink, links)
        cost = sum(sink[i] if keep[i] else source[i] for i in range(n)) + sum(c for a, b, c in links if keep[a] != keep[b])
        assert math.isclose(cost, brute_cut(source, sink, links)[0], abs_tol=1e-9)


def test_html_blocks_and_extraction():
    page = (
        "<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
        "<div class='ad'>Buy now</div><article><h1>Title &amp; more</h1><p>First long sentence of the text, with many words in it. And one more.<p>Second <b>bold<br>line"
        "</p><!-- note --></article><footer>&copy; site</footer></body></html>"
    )
    found = html_extract.blocks(page)
    assert [b.text for b in found] == ["Home", "News", "Buy now", "Title & more", "First long sentence of the text, with many words in it. And one more.", "Second bold", "line", "© site"]
    text = html_extract.extract(page, html_extract.fit(np.zeros((0, 9)), np.zeros(0)))
    assert "First long sentence" in text and "Home" not in text and "site" not in text
    for odd in ("", "<", "<p", "plain", "<script>x", "</div></p>", "<!-- open", "<a href='>'>t</a>"):
        html_extract.extract(odd, html_extract.fit(np.zeros((0, 9)), np.zeros(0)))


def test_secrets_told_from_identifiers():
    model = secrets.train()
    rng = np.random.default_rng(99)
    assert np.mean(model.ratio(secrets.random_strings(1000, rng)) >= secrets.THRESHOLD) > 0.98
    assert np.mean(model.ratio(secrets.ordinary_strings(1000, rng)) >= secrets.THRESHOLD) < 0.02
    assert not secrets.plausible("1234567890123456") and not secrets.plausible("abcdefghijklmnopq") and secrets.plausible("abc1efghijklmnopq")


def test_language_model_generalises():
    rng = random.Random(2)
    stems = {"en": "the and of to in that was for with".split(), "de": "der und die nicht mit das ist ein".split(), "fr": "le la les des est que pour dans".split()}
    rows = [(lang, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for lang, words in stems.items() for _ in range(150)]
    rng.shuffle(rows)
    model = language.fit(pa.array([t for _, t in rows[:300]]), [lang for lang, _ in rows[:300]])
    lang, sure = language.predict(model, pa.array([t for _, t in rows[300:]] + ["", "1234 !!", None]))
    names = [*model.languages, "und"]
    right = np.mean([names[i] == rows[300 + k][0] for k, i in enumerate(lang[:-3])])
    assert right > 0.97 and lang[-3:].tolist() == [-1, -1, -1] and sure[-3:].tolist() == [0, 0, 0]


def test_language_without_rows():
    model = language.fit(pa.array([], pa.string()), [])
    assert language.predict(model, pa.array(["x"]))[0].tolist() == [-1]


if __name__ == "__main__":
    pytest.main([__file__])
