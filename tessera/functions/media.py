"""Media types of URIs, and which parser they go to."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY = "application/octet-stream"
#: Documentation formats that a platform's table may lack.
KNOWN = {
    "md": "text/markdown", "markdown": "text/markdown", "rst": "text/x-rst", "adoc": "text/asciidoc", "asciidoc": "text/asciidoc",
    "ipynb": "application/x-ipynb+json", "jsonl": "application/jsonlines", "yaml": "text/yaml", "yml": "text/yaml", "toml": "application/toml",
}
TEXT_APPLICATIONS = ("application/json", "application/jsonlines", "application/toml", "application/x-ipynb+json", "application/xml")
HINTS = {
    "application/json": "json", "application/jsonlines": "jsonlines", "application/pdf": "pdf", "application/toml": "toml", "application/x-ipynb+json": "jupyter",
    "text/asciidoc": "asciidoc", "text/html": "html", "text/markdown": "markdown", "text/plain": "plaintext", "text/x-rst": "rst", "text/yaml": "yaml",
}


def extension(uri: Column) -> Column:
    """Lower-case extension of the last segment of a URI's path, without the dot; '' if none."""
    path = F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^\.*[^.].*\.([^.]*)$", 1))


def _table() -> dict[str, str]:
    mimetypes.init()
    return {k[1:].lower(): v for k, v in sorted(mimetypes.types_map.items())} | KNOWN


def media_type(uri: Column) -> Column:
    """Media type by extension only; the table is a literal map, so nothing is joined."""
    pairs = [F.lit(x) for kv in sorted(_table().items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(uri)), F.lit(BINARY))


def is_text(media: Column) -> Column:
    return F.coalesce(media.startswith("text/") | media.isin(*TEXT_APPLICATIONS), F.lit(False))


def parser_hint(media: Column) -> Column:
    """Parser family: by the whole type, else plain text for any text, else binary."""
    pairs = [F.lit(x) for kv in sorted(HINTS.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), media), F.when(media.startswith("text/"), F.lit("plaintext")), F.lit("binary"))
