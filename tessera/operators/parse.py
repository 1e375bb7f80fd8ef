"""Parsers: one document to its sections, as plain functions and as DataFrame operators."""

from __future__ import annotations

import base64
import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators.shared import lean

SECTION = "section_id string, source_id string, revision_id string, locator string, heading string, text string, ordinal int, parent_locator string, depth int"
ROOT = "__root__"
ERROR = "\x00error"
Section = dict[str, object]
Warnings = list[tuple[str, str]]


def locator(path: list[str]) -> str:
    return "/".join(p.replace("/", "_") for p in path) or ROOT


class Outline:
    """The headings around the current place; repeated paths get a number that children inherit."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str]] = []
        self.seen: dict[str, int] = {}

    def enter(self, level: int, title: str) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        path = locator([t for _, t in self.stack] + [title])
        n = self.seen[path] = self.seen.get(path, 0) + 1
        leaf = path.rsplit("/", 1)[-1]
        self.stack.append((level, leaf if n == 1 else f"{leaf}[{n}]"))

    def section(self, heading: str, text: str, ordinal: int, depth: int) -> Section:
        path = [t for _, t in self.stack]
        return {"locator": locator(path), "heading": heading, "text": text, "ordinal": ordinal, "parent_locator": locator(path[:-1]) if path[:-1] else "", "depth": depth}


_HEADING = re.compile(r"^(#{1,6})\s+(.*?)(?:\s+#+)?\s*$")
_FENCE = re.compile(r"^(`{3,}|~{3,})")


def parse_markdown(text: str) -> tuple[list[Section], Warnings]:
    """Sections by ATX headings outside fences; text before the first heading is the root's.

    The heading's line isn't part of the text.  Setext headings are text.
    """
    outline, out = Outline(), []
    lines: list[str] = []
    heading, depth, ordinal, fence = "", 0, 0, ""

    def end() -> None:
        body = "".join(lines).rstrip("\n")
        if heading or body.strip():
            out.append(outline.section(heading, body, ordinal, depth))

    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        mark = _FENCE.match(bare)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
        elif mark:
            fence = mark[1]
        elif title := _HEADING.match(bare):
            end()
            ordinal += bool(lines or heading)
            lines = []
            depth, heading = len(title[1]), title[2]
            outline.enter(depth, heading)
            continue
        lines.append(line)
    end()
    return out, []


_SILENT = {"script", "style", "noscript", "template"}
_WHOLE = {"p", "li", "td", "th", "dd", "dt", "figcaption", "caption"}
_VERBATIM = {"pre", "code"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CONTAINERS = {"div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "dl", "table", "thead", "tbody", "tr", "blockquote", "figure", "form", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "pre"} | _WHOLE


class _Tree(HTMLParser):
    """A small DOM: nested lists [tag, attributes, children].

    Recovery: an end tag closes up to its own element, if that is open; a block element
    closes an open paragraph; list items, cells and rows close their like; void elements
    have no children; comments are dropped.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.paragraph = -1  # where the outermost open paragraph is
        self.count: dict[str, int] = {}  # open elements by tag

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node[0]] -= 1
        del self.open[at:]
        if self.paragraph >= at:
            self.paragraph = -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CONTAINERS:
            if self.paragraph >= 0 and not any(n[0] in {"table", "button"} for n in self.open[self.paragraph :]):
                self._cut(self.paragraph)
            if tag in {"li", "dt", "dd", "td", "th", "tr"} and self.open[-1][0] in ({"dt", "dd"} if tag in {"dt", "dd"} else {"td", "th"} if tag in {"td", "th"} else {tag}):
                self._cut(len(self.open) - 1)
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            if tag == "p" and self.paragraph < 0:
                self.paragraph = len(self.open)
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _plain(node: list) -> str:
    """All text of an element, as it is; elements may be nested to any depth."""
    out, stack = [], [iter(node[2])]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            out.append(c)
        elif c[0] not in _SILENT:
            stack.append(iter(c[2]))
    return "".join(out)


def _inline(node: list) -> str:
    """Text of an element with link targets in brackets; elements may be nested to any depth."""
    stack: list[tuple[list, Iterator, list[str]]] = [(node, iter(node[2]), [])]
    while True:
        of, rest, parts = stack[-1]
        c = next(rest, None)
        if isinstance(c, str):
            parts.append(c.strip())
        elif c is not None:
            if c[0] not in _SILENT:
                stack.append((c, iter(c[2]), []))
        else:
            text = re.sub(r" +", " ", " ".join(p for p in parts if p)).strip()
            stack.pop()
            if not stack:
                return text
            if of[0] == "a":
                anchor, target = " ".join(text.split()), of[1].get("href") or ""
                text = f"{anchor} [{target}]" if anchor and target else anchor
            stack[-1][2].append(text)


def _find(node: list, tag: str) -> list | None:
    """The first element of a tag in document order."""
    stack = [iter(node[2])]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif not isinstance(c, str):
            if c[0] == tag:
                return c
            stack.append(iter(c[2]))
    return None


def parse_html(text: str, cleanup: Callable[[str], str] | None = None) -> tuple[list[Section], Warnings]:
    """Sections by h1 to h6 in document order; code is verbatim, links show their target."""
    tree = _Tree()
    tree.feed(cleanup(text) if cleanup else text)
    tree.close()

    outline, out, warnings = Outline(), [], []
    parts: list[str] = []
    state = {"heading": "", "depth": 0, "ordinal": 0}

    def end() -> None:
        body = "\n".join(p for p in parts if p.strip())
        parts.clear()
        if not body and state["heading"]:
            warnings.append(("html_empty_section", state["heading"]))
        if body or state["heading"]:
            out.append(outline.section(state["heading"], body, state["ordinal"], state["depth"]))
            state["ordinal"] += 1

    stack = [iter((_find(tree.root, "body") or tree.root)[2])]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
        elif isinstance(c, str):
            if c.strip():
                parts.append(" ".join(c.split()))
        elif c[0] in _SILENT:
            continue
        elif re.fullmatch("h[1-6]", c[0]):
            end()
            title = " ".join(_plain(c).split())
            state.update(heading=title, depth=int(c[0][1]))
            outline.enter(state["depth"], title)
        elif c[0] in _VERBATIM:
            parts.append(_plain(c).strip("\n"))
        elif c[0] in _WHOLE or c[0] == "a":
            parts.append(_inline(c if c[0] != "a" else ["", {}, [c]]))
        elif c[0] in _CONTAINERS or any(not isinstance(x, str) and x[0] in _CONTAINERS for x in c[2]):
            stack.append(iter(c[2]))
        else:
            parts.append(_inline(c))
    end()
    if not any(s["heading"] for s in out):
        warnings.append(("html_missing_heading", ""))
    return out, warnings


def pages_of_pdf(content: str) -> list[str]:
    """Texts of a PDF's pages, from base64 or latin-1 text; needs pypdf."""
    raw = content.encode("latin-1") if content.startswith("%PDF") else base64.b64decode(content, validate=True)
    import io

    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages]


def parse_pages(pages: list[str]) -> tuple[list[Section], Warnings]:
    """A section per page that has text; a short first line that ends no sentence is its heading."""
    out, warnings = [], []
    for i, page in enumerate(pages, 1):
        where = f"page:{i}"
        if not page.strip():
            warnings.append(("pdf_empty_page", where))
            continue
        if len(re.sub(r"\s", "", page)) < 50:
            warnings.append(("pdf_low_text", where))
        lines = page.strip().splitlines()
        first = lines[0].strip()
        heading = ""
        if len(lines) > 1 and 0 < len(first) < 120 and first[-1] not in ".,;:?!":
            heading = first
            warnings.append(("pdf_guessed_heading", where))
        out.append({"locator": where, "heading": heading, "text": page.strip(), "ordinal": len(out), "parent_locator": "", "depth": 0})
    return out, warnings


def parse_plain(text: str) -> tuple[list[Section], Warnings]:
    return ([{"locator": ROOT, "heading": "", "text": text, "ordinal": 0, "parent_locator": "", "depth": 0}] if text.strip() else []), []


PARSERS: dict[str, Callable[[str], tuple[list[Section], Warnings]]] = {
    "markdown": parse_markdown,
    "html": parse_html,
    "plaintext": parse_plain,
    "pdf": lambda content: parse_pages(pages_of_pdf(content)),
    "pdf_pages": lambda content: parse_pages(content.split("\f")),
}


def sections(docs: DataFrame, parser: str | Callable[[str], tuple[list[Section], Warnings]] = "markdown") -> DataFrame:
    """Sections of documents (uri, revision_id, content), with the warnings of their document.

    A section's source_id is the document's uri.  Documents with null content have no
    section; one that its parser fails on gives a row with the locator ERROR and the
    reason as text, and the others go on.
    """
    run = PARSERS[parser] if isinstance(parser, str) else parser

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, revision, content in zip(batch["uri"], batch["revision_id"], batch["content"]):
                if content is None:
                    continue
                try:
                    found, warnings = run(content)
                except Exception as e:  # noqa: BLE001  one bad document must not fail the others
                    found, warnings = [{"locator": ERROR, "heading": "", "text": f"{type(e).__name__}: {e}", "ordinal": 0, "parent_locator": "", "depth": 0}], []
                for s in found:
                    rows.append((ids.digest_text("section", uri, revision, s["locator"]), uri, revision, s["locator"], s["heading"], s["text"], s["ordinal"], s["parent_locator"], s["depth"], [f"{c}: {m}" if m else c for c, m in warnings]))
            yield pd.DataFrame(rows, columns=[*[c.split()[0] for c in SECTION.split(", ")], "warnings"])

    return docs.select(F.col("uri").cast("string"), F.col("revision_id").cast("string"), F.col("content").cast("string")).mapInPandas(lean(docs, each), SECTION + ", warnings array<string>")


unescape = html.unescape
