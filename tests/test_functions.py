"""Functions that need no cluster, against plain definitions."""

import hashlib
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import config, registry
from tessera.errors import ConfigError, ConflictError, ProtocolError, RegistryError
from tessera.functions import ids
from tessera.functions import text as T
from tessera.functions.porter import stem
from tessera.operators import chunk, parse, ranking
from tessera.plans.sync import status_of


def test_digest_text():
    assert ids.digest_text("source", "a:b", "c") == hashlib.sha256(b"source:a_b:c").hexdigest()[:32]


def test_fingerprint_changes_with_each_setting():
    base = {"parser": "m", "chunker": {"b": 2, "a": 1}, "enrichment": "", "embedder": "e", "dimension": 3, "schema": 1}
    prints = {ids.pipeline_fingerprint(**base)}
    for key, value in (("parser", "x"), ("chunker", {"a": 2}), ("enrichment", "y"), ("embedder", "f"), ("dimension", 4), ("schema", 2)):
        prints.add(ids.pipeline_fingerprint(**base | {key: value}))
    assert len(prints) == 7
    assert ids.pipeline_fingerprint(**base) == ids.pipeline_fingerprint(**base | {"chunker": {"a": 1, "b": 2}})


def test_stemmer_equals_the_full_text_index():
    import pydoc_data.topics

    words = sorted({w for t in list(pydoc_data.topics.topics.values())[:40] for w in re.findall(r"[a-z0-9]+", t.lower())} | set("caresses ponies ties sayyed relational naïves éées yes controll internationalization".split()))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter ascii')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(words, 1)))
    assert [stem(w) for w in words] == [t for t, in db.execute("SELECT term FROM v ORDER BY doc")]


def test_snippets():
    text = "alpha " * 100 + "needle here " + "omega " * 100
    cut, a, b = T.cut_snippet(text, "find the NEEDLE", 60)
    assert "needle" in cut and text[a:b] == cut and len(cut) <= 60
    assert T.cut_snippet("", "x") == ("", 0, 0)
    assert T.cut_snippet("x" * 900, "nothing", 100) == ("x" * 100, 400, 500)
    assert T.match_center("abcdef", "zz") == 3


def test_code_lines():
    assert T.code_lines("a\n```py\n x = 1\n\n~~~\n```\nb\n~~~\ny") == "x = 1\n~~~\ny"


def test_markdown():
    text = "intro\n\n# A\n\ntext\n```\n# not a heading\n```\n## B ##\n### C\n# A\n## B\nend"
    sections, warnings = parse.parse_markdown(text)
    assert [s["locator"] for s in sections] == ["__root__", "A", "A/B", "A/B/C", "A[2]", "A[2]/B"] and not warnings
    assert "# not a heading" in sections[1]["text"] and sections[2]["heading"] == "B" and sections[3]["parent_locator"] == "A/B"
    assert parse.parse_markdown("  \n") == ([], [])
    assert parse.parse_markdown("# a/b\nx")[0][0]["locator"] == "a_b"
    assert [s["ordinal"] for s in parse.parse_markdown("\n# A\nx")[0]] == [1]


def test_html():
    sections, warnings = parse.parse_html("<body>loose<h1>T</h1><p>See <a href='/x'>here</a> now<p>two</p><pre>a\n b</pre><ul><li>one<li>two</ul><h2>E</h2><h1>T</h1><div>in <span>div</span></div><!-- no --><script>x</script></body>")
    assert [(s["locator"], s["text"]) for s in sections] == [("__root__", "loose"), ("T", "See here [/x] now\ntwo\na\n b\none\ntwo"), ("T/E", ""), ("T[2]", "in\ndiv")]
    assert [c for c, _ in warnings] == ["html_empty_section"]
    assert [c for c, _ in parse.parse_html("<p>x</p>")[1]] == ["html_missing_heading"]


def test_pdf_pages():
    long = "Body text that goes on for more than fifty characters in total."
    sections, warnings = parse.parse_pages([f"Title\n{long}", "", "tiny", f"A sentence.\n{long}"])
    assert [(s["locator"], s["heading"]) for s in sections] == [("page:1", "Title"), ("page:3", ""), ("page:4", "")]
    assert [c for c, _ in warnings] == ["pdf_guessed_heading", "pdf_empty_page", "pdf_low_text"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n`~#x", max_size=400), st.integers(1, 20), st.integers(0, 19))
def test_chunking_ends_and_keeps_all_words(text, limit, overlap):
    pieces = chunk.split_text(text, limit, min(overlap, limit - 1))
    left = iter(" ".join(pieces).split())
    assert all(any(w == x for x in left) for w in text.split())
    assert all(p.strip() for p in pieces)


def test_chunking_overlap_and_fences():
    words = [f"word{i:010d}" for i in range(60)]
    pieces = [p.split() for p in chunk.split_text(" ".join(words), 40, 8)]
    assert all(len(p) <= 10 for p in pieces) and all(b[0] in a[-2:] for a, b in zip(pieces, pieces[1:]))
    fence = "```\n" + "code line\n" * 30 + "```\n"
    assert any(p.count("code line") == 30 for p in chunk.split_text("intro text\n" * 5 + fence + "after\n" * 20, 30, 0))
    assert max(map(len, chunk.split_text("short\n" + "long " * 2000 + "\nend", 100, 20))) <= 100 * 8


def test_filters_and_statuses():
    assert not ranking.FilterSpec().active and ranking.FilterSpec(acl_ids=("x",)).active
    assert [status_of(*x) for x in ((False, 0, 0), (False, 0, 1), (True, 1, 1), (True, 0, 1), (True, 3, 0))] == ["success", "partial", "partial", "failed", "success"]


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[retrieval]\ntop_k = 3\nmode = 'sparse'\n")
    made = config.load(str(path), {"TESSERA_RETRIEVAL_TOP_K": "7", "TESSERA_ANSWER_TOKEN_BUDGET": "99"})
    assert (made.retrieval.top_k, made.retrieval.mode, made.answer.token_budget) == (7, "sparse", 99)
    for bad in ({"x": {}}, {"retrieval": {"y": 1}}, {"retrieval": {"top_k": "z"}}, {"retrieval": {"top_k": 0}}):
        with pytest.raises(ConfigError):
            config.build(bad)
    with pytest.raises(ConfigError):
        config.load(str(tmp_path / "missing.toml"), {})


def test_registry():
    one, two = (lambda: (lambda x: x)), (lambda: (lambda x: x))
    assert registry.resolve("fusion", points={}) is ranking.rrf
    assert callable(registry.resolve("reranker", points={"a": [one]})) and callable(registry.resolve("reranker", name="a", points={"a": [one], "b": [two]}))
    for error, args in ((ConflictError, {"points": {"a": [one], "b": [two]}}), (ConflictError, {"name": "a", "points": {"a": [one, two]}}), (RegistryError, {"name": "c", "points": {}}), (RegistryError, {"points": {}}), (ProtocolError, {"explicit": 3})):
        with pytest.raises(error):
            registry.resolve("reranker", **args)
    with pytest.raises(RegistryError):
        registry.resolve("nothing")
