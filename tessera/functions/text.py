"""Expressions over query and chunk texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = tuple("a an and are at be by can do does for from how i in is it me my of on or that the this to was were what with".split())
CODE = r"\b(?:[A-Z][A-Z0-9_]{2,}(?:_[A-Z0-9]+)+|E[A-Z0-9]{2,}|ERR(?:OR)?[_A-Z0-9]*)\b"
COMMAND = r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+)+\b|/[a-z][a-z0-9/_-]+"
CAMEL = r"\b[A-Z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b"


def token_count(text: Column) -> Column:
    """Estimated model tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("int")


def words(text: Column) -> Column:
    """White-space separated words; none for an empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def content_words(text: Column) -> Column:
    """Words that aren't stopwords, or all words where every word is one."""
    every = words(text)
    kept = F.filter(every, lambda w: ~F.lower(w).isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def boost_words(text: Column, ascii_borders: bool = False) -> Column:
    """Error codes, commands and camel-case names, each once, in that order of kinds.

    Word borders count letters of every script; with ``ascii_borders`` those of ASCII only,
    as SQL engines' do, so that a name also ends where another script's letter follows.
    """
    t = F.coalesce(text, F.lit(""))
    # each pattern begins and ends with a word character; Java's own \b isn't of ASCII in all versions
    ascii_only = [re.sub(r"^\\b", "(?<![A-Za-z0-9_])", re.sub(r"\\b(?=$|\|)", "(?![A-Za-z0-9_])", p)) for p in (CODE, COMMAND, CAMEL)]
    found = [F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)) for p in (ascii_only if ascii_borders else [f"(?U){p}" for p in (CODE, COMMAND, CAMEL)])]
    return F.array_distinct(F.concat(*found))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of lower-case words: 1 if both are empty, 0 if one is."""
    return jaccard_of_sets(word_set(a), word_set(b))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard_of_sets(x: Column, y: Column) -> Column:
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / F.greatest(every, F.lit(1)))


def locator(path: Column) -> Column:
    """Heading path as one string; '/' inside a heading becomes '_'."""
    joined = F.array_join(F.transform(path, lambda p: F.replace(p, F.lit("/"), F.lit("_"))), "/")
    return F.when(F.size(path) > 0, joined).otherwise(F.lit("__root__"))


def cited_labels(answer: Column) -> Column:
    """Evidence labels such as S1 that an answer cites in brackets, each once in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(S\d+)\]"), F.lit(1)))


OPEN, CLOSE = "<<<EVIDENCE>>>", "<<<END_EVIDENCE>>>"


def neutralize(text: Column) -> Column:
    """Text in which the evidence delimiters can't be taken for real ones."""
    return F.replace(F.replace(text, F.lit(CLOSE), F.lit("[end-evidence]")), F.lit(OPEN), F.lit("[evidence]"))


def match_center(text: str, query: str) -> int:
    """Earliest place where a query word of 3 or more characters occurs; else the middle."""
    lower = text.lower()
    found = [at for w in re.findall(r"\w+", query.lower()) if len(w) > 2 and (at := lower.find(w)) >= 0]
    return min(found, default=len(text) // 2)


def cut_snippet(text: str, query: str, max_chars: int = 400) -> tuple[str, int, int]:
    """(excerpt, start, end): a window around the match, its ends moved inwards to white space."""
    if not text:
        return "", 0, 0
    n, half = len(text), max_chars // 2
    mid = match_center(text, query)
    lo, hi = max(0, mid - half), min(n, mid + half)
    if lo > 0:
        lo = next((i for i in range(lo, n) if text[i].isspace()), n)
        lo = next((i for i in range(lo, n) if not text[i].isspace()), n)
    if hi < n:
        hi = next((i for i in range(hi, 0, -1) if text[i - 1].isspace()), 0)
        hi = next((i for i in range(hi, 0, -1) if not text[i - 1].isspace()), 0)
    if lo >= hi:
        lo = max(0, n // 2 - half)
        hi = min(n, lo + max_chars)
    excerpt = text[lo:hi].strip()
    if excerpt and (at := text.find(excerpt, lo)) >= 0:
        lo, hi = at, at + len(excerpt)
    return excerpt, lo, hi


def snippet(text: Column, query: Column, max_chars: int = 400) -> Column:
    """Struct (text, char_start, char_end) of the excerpt around the first match."""

    @F.pandas_udf("text string, char_start int, char_end int")
    def run(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_snippet(a or "", b or "", max_chars) for a, b in zip(t, q)], columns=["text", "char_start", "char_end"])

    return run(text, query)


def code_lines(text: str) -> str:
    """Non-empty lines inside fences, stripped."""
    out, fence = [], ""
    for raw in text.splitlines():
        line = raw.strip()
        mark = line[:1] if line.startswith(("```", "~~~")) else ""
        if not fence:
            fence = mark
        elif mark == fence:
            fence = ""
        elif line:
            out.append(line)
    return "\n".join(out)


def code_content(text: Column) -> Column:
    """Code of a chunk for its own index column; texts without a fence reach Python as nulls."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: code_lines(x) if x else "")

    return run(F.when(F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~")), text))
