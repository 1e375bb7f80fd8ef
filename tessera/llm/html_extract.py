"""Main text of web pages by minimum-cut labelling.

A page is split into blocks of text.  A logistic classifier over a block's statistics
gives the costs of calling it content or boilerplate; they are the capacities to the two
terminals.  Neighbouring blocks are joined by smoothness edges, stronger where they hang
from the same element of the DOM.  The minimum cut labels all blocks at once: content is
what stays on the source's side.  Blocks whose terminal capacity exceeds all their edges
are labelled at once, which leaves the maximum flow to the doubtful stretches only.

The classifier is trained on a bounded sample of pages, in which the elements that
authors mark as content or boilerplate (article, main; nav, footer, aside, ..., and
elements whose class, id or role names a kind of boilerplate) label their blocks.  None
of these marks is a feature: a block is judged by its text, its links, its own element
and how much text its container has, as on pages without marks.

Defined results: a null page gives a null text, a page without content blocks an empty
one.  Scripts, styles, comments, templates and a head's elements are never content.  Unclosed
elements are closed by the next block element; a head ends at the first element or text
that can't be in it; where the end tag of another dropped element is missing only
its tags are dropped (a script or style goes on to the end of the page).  Unknown entities stay as they are.  Rows
that repeat a page_id give a row each.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 600
SMOOTH = 0.6
SAME_PARENT = 0.9
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>", re.S)
_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "select", "textarea", "title"}
_BLOCK = {
    "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody",
    "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "body", "html", "hr", "br", "center", "caption",
}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_GOOD, _BAD = {"article", "main"}, {"nav", "footer", "aside", "form", "header"}
_SPACE = re.compile(r"\s+")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_AD = re.compile(r"\b(ad|ads|advert|sponsor|promo|banner|menu|nav|footer|sidebar|related|share|social|cookie|comment|breadcrumb)s?\b", re.I)


def skip_ends(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a name that have an end tag end, by where their start tags end."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in _TOKEN.finditer(page):
        if m.group(2) is None or m.group(2).lower() != tag:
            continue
        if not m.group(1):
            if not m.group(3).rstrip().endswith("/"):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


@dataclass
class Block:
    text: str
    tag: str
    linked: int  # characters inside anchors
    parent: int  # number of the container element
    depth: int
    hinted: bool  # class, id or role of an element around it names a kind of boilerplate
    label: int  # 1 in an element marked as content, 0 as boilerplate, -1 neither


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in their order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]  # element, number, hinted, label
    parts: list[str] = []
    linked = anchors = serial = at = 0
    ends: dict[str, dict[int, int]] = {}

    def close() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                tag = next((t for t, *_ in reversed(stack) if t in _BLOCK and t != "br"), "")
                top = stack[-1]
                up = next((n for t, n, *_ in reversed(stack) if t in _BLOCK and t not in {"p", "li", "td", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}), 0)
                out.append(Block(text, tag, min(linked, len(text)), up, len(stack), top[2], 0 if top[2] else top[3]))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, ending = tag.lower(), bool(m.group(1))
        if tag == "head":
            # what a head may hold is dropped or empty; anything else is the body's, with </head> or without
            continue
        if not ending and tag in _SKIP:
            if tag in {"script", "style", "textarea", "title"}:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in {"script", "style"}:
                    at = len(page)
                else:
                    at = after if (after := page.find("<", at)) >= 0 else len(page)
            elif not m.group(3).rstrip().endswith("/"):
                if tag not in ends:
                    ends[tag] = skip_ends(page, tag)
                at = ends[tag].get(at, at)
            continue
        if tag in _BLOCK:
            close()
        if ending:
            if tag == "a":
                anchors = max(0, anchors - 1)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in {"article", "main", "nav", "footer", "aside", "body", "table"} and tag not in {"html", "body", "article", "main", "nav", "footer", "aside", "div", "section", "table"}:
                    break
            continue
        if tag in _VOID:
            continue
        if tag == "a":
            anchors += 1
        if tag in _BLOCK:
            # a block element ends paragraphs and inline elements left open
            while len(stack) > 1 and (stack[-1][0] not in _BLOCK or stack[-1][0] == "p" or (tag == stack[-1][0] and tag in {"li", "tr", "td", "th", "dt", "dd"})):
                stack.pop()
            anchors = 0
        serial += 1
        _, _, hinted, label = stack[-1]
        attrs = m.group(3)
        if attrs and not hinted and tag not in {"html", "body"}:
            hinted = any(_AD.search(v.replace("-", " ").replace("_", " ")) for v in _ATTR.findall(attrs))
        label = 1 if tag in _GOOD else 0 if tag in _BAD else label
        stack.append((tag, serial, hinted, label))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Statistics of each block, (blocks, features)."""
    n = len(found)
    out = np.zeros((n, 9))
    mass: dict[int, int] = {}
    for b in found:
        mass[b.parent] = mass.get(b.parent, 0) + b.text.count(" ") + 1
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        out[i, 0] = 1.0
        out[i, 1] = np.log1p(words) / 5
        out[i, 2] = b.linked / max(len(b.text), 1)
        out[i, 3] = min(b.text.count(".") + b.text.count("!") + b.text.count("?"), 10) / 10
        out[i, 4] = np.log1p(mass[b.parent]) / 7
        out[i, 5] = b.tag in {"p", "pre", "blockquote", "td"}
        out[i, 6] = b.tag in {"h1", "h2", "h3", "h4"}
        out[i, 7] = b.tag in {"li", "dd", "dt"}
        out[i, 8] = b.text[:1] == "©" or "©" in b.text[:40]
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; without both classes a fixed rule by length and links."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-1.5, 6.0, -5.0, 3.0, 0.0, 1.0, 1.5, -1.0, -3.0])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) / len(y) + ridge * w
        h = (x.T * (p * (1 - p))) @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next, and to the next under the same container."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i and found[i - 1].parent != b.parent:
            out.append((i - 1, i, SMOOTH / (1 + abs(found[i - 1].depth - b.depth))))
        if b.parent in last:
            out.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return out


def min_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut, by shortest augmenting paths.

    ``source`` and ``sink`` are the terminal capacities; links hold both ways.  Nodes that
    the cut leaves free are on the sink's side.
    """
    n = len(source)
    excess = [a - b for a, b in zip(source, sink)]
    label: list[bool | None] = [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    # a terminal stronger than all edges settles its node, which then pulls its neighbours
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(excess[i]) > sum(near[i].values()):
            label[i] = excess[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                excess[j] += c if label[i] else -c
                todo.append(j)
            near[i] = {}
    flow = [dict(x) for x in near]
    gain = [max(e, 0.0) for e in excess]
    drain = [max(-e, 0.0) for e in excess]
    free = [i for i in range(n) if label[i] is None]
    while True:
        back = {i: -1 for i in free if gain[i] > 1e-12}
        queue, end = deque(back), -1
        while queue and end < 0:
            i = queue.popleft()
            if drain[i] > 1e-12:
                end = i
                break
            for j, c in flow[i].items():
                if c > 1e-12 and j not in back:
                    back[j] = i
                    queue.append(j)
        if end < 0:
            break
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        push = min([gain[path[0]], drain[end], *(flow[a][b] for a, b in zip(path, path[1:]))])
        gain[path[0]] -= push
        drain[end] -= push
        for a, b in zip(path, path[1:]):
            flow[a][b] -= push
            flow[b][a] += push
    for i in free:
        label[i] = i in back
    return [bool(x) for x in label]


def extract(page: str, weights: np.ndarray) -> str:
    """The content blocks of a page, a line each."""
    found = blocks(page)
    if not found:
        return ""
    z = np.clip(features(found) @ weights, -8, 8)
    # costs are the negative log probabilities of either label
    content, other = np.logaddexp(0, z), np.logaddexp(0, -z)
    keep = min_cut(content.tolist(), other.tolist(), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def labelled(pages: DataFrame, max_pages: int = MAX_PAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, page number) of the marked blocks of at most ``max_pages`` pages, chosen by a hash of their page_id."""
    ids = pages.filter("page_id IS NOT NULL AND html IS NOT NULL").select(F.col("page_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_pages)
    rows = pages.select("page_id", "html").filter("html IS NOT NULL").join(F.broadcast(ids), F.col("page_id") == F.col("__id")).select("page_id", "html").toPandas().sort_values(["page_id", "html"])
    x, y, of = [np.zeros((0, 9))], [], []
    for k, page in enumerate(rows["html"]):
        found = blocks(page)
        marked = [i for i, b in enumerate(found) if b.label >= 0]
        if marked:
            x.append(features(found)[marked])
            y += [found[i].label for i in marked]
            of += [k] * len(marked)
    return np.concatenate(x), np.array(y, np.float64), np.array(of, np.int64)


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> np.ndarray:
    x, y, _ = labelled(pages, max_pages)
    return fit(x, y)


def held_out_accuracy(pages: DataFrame, max_pages: int = MAX_PAGES) -> float:
    """Share of right labels, each class counting half, on every fourth page by a fit on the others."""
    x, y, of = labelled(pages, max_pages)
    held = of % 4 == 3
    right = (x[held] @ fit(x[~held], y[~held]) > 0) == (y[held] > 0.5)
    return float(np.mean([right[y[held] == c].mean() for c in (0, 1)]))


def extracted(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, text) of every page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else extract(p, weights) for p in pages], dtype=object)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), run(pages["html"].cast("string")).alias("text"))
