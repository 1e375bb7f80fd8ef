"""Secret scan: character Markov models of random strings and of ordinary identifiers.

Candidates are the maximal runs of characters that secrets are written in.  Each of two
first-order Markov models, with the smoothed frequencies of labelled samples, gives the
likelihood of a candidate's characters; their log-likelihood ratio per string decides.
A candidate that fails as a whole is searched for stretches: those of the greatest sum of
ratios, widened to the next / _ or -, so that a key in a path or name isn't outvoted.
No table labels secrets, so the labelled samples are made: random strings are drawn in
the usual alphabets (hexadecimal, base 32, 62 and 64, with prefixes); ordinary identifiers
are camel and snake case names, paths, dates and numbers from a list of stems and from
the words of a bounded sample of the documents that are scanned, whatever their language.
The threshold is what all but 1 in 1,000 of further ordinary identifiers stay under, and
THRESHOLD at least, as secrets are rare.

Defined results: null and empty texts have no secrets; each occurrence is a row; a
candidate or stretch must have ``MIN_LENGTH`` characters and a digit or mixed case within; plain
numbers, such as telephone and card numbers, are personal data and not secrets.  Offsets
count characters.  The secret itself is shown by its first 4 characters only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 16
THRESHOLD = 6.0
SAMPLES = 4000
MAX_DOCS = 500
MAX_WORDS = 4000
CANDIDATE = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_CODE = np.full(256, 0, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_N = len(ALPHABET) + 1  # 0 stands for the border

_STEMS = (
    "the and for with get set user name file path data list item index value count total config manager service handler request response "
    "client server session token password secret access public private internal static final abstract default parse format string number "
    "buffer stream reader writer factory builder provider context event listener adapter model view controller test case assert error "
    "exception message queue worker thread process memory cache table column row key map node tree graph vector matrix input output source "
    "target network address protocol version release update create delete insert select filter group order limit offset window function "
    "return import module package library framework application component interface document paragraph section chapter information "
    "international development environment management organization university government communication relationship understanding "
    "verbindung gesellschaft entwicklung wissenschaft informacion desarrollo conocimiento connaissance developpement environnement "
    "thing tion ing er ed re th an on en es at he st nd or nt ti ly ble ou ha in wh sh ea heit keit lich ung schaft cion mente ado ment eaux"
).split()


@dataclass
class MarkovModel:
    """Log probabilities of a character after another; the border begins and ends a string."""

    steps: np.ndarray

    def log_likelihood(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        codes, owner = _pairs(strings)
        return np.bincount(owner, weights=self.steps[codes[:, 0], codes[:, 1]], minlength=len(strings))


def _pairs(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer("\0".join(["", *strings, ""]).encode("latin-1", "replace"), np.uint8)
    code = _CODE[raw]
    border = np.cumsum(raw == 0)[:-1] - 1
    return np.stack([code[:-1], code[1:]], axis=1), np.minimum(border, len(strings) - 1)


def fit(strings: list[str], smoothing: float = 0.5) -> MarkovModel:
    codes, _ = _pairs(strings)
    counts = np.full((_N, _N), smoothing)
    np.add.at(counts, (codes[:, 0], codes[:, 1]), 1.0)
    return MarkovModel(np.log(counts / counts.sum(axis=1, keepdims=True)))


def random_strings(n: int, rng: np.random.Generator) -> list[str]:
    """Labelled samples of random strings."""
    kinds = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "abcdefghijklmnopqrstuvwxyz0123456789"]
    prefixes = ["", "", "", "", "sk_live_", "AKIA", "ghp_", "xoxb-", "key-", "AIza"]
    out = []
    for i in range(n):
        a = kinds[i % len(kinds)]
        s = "".join(a[k] for k in rng.integers(0, len(a), int(rng.integers(16, 65))))
        out.append(prefixes[int(rng.integers(len(prefixes)))] + s)
    return out


def ordinary_strings(n: int, rng: np.random.Generator, stems: list[str] = _STEMS) -> list[str]:
    """Labelled samples of ordinary identifiers."""
    out = []
    for i in range(n):
        words = [stems[k] for k in rng.integers(0, len(stems), int(rng.integers(2, 7)))]
        kind = i % 8
        if kind == 0:
            s = words[0] + "".join(w.capitalize() for w in words[1:])
        elif kind == 1:
            s = "_".join(words)
        elif kind == 2:
            s = "-".join(words)
        elif kind == 3:
            s = "/".join(words)
        elif kind == 4:
            s = "".join(words)
        elif kind == 5:
            s = "_".join(words).upper()
        elif kind == 6:
            s = "".join(words).capitalize() + (str(rng.integers(0, 10000)) if i % 3 else "")
        else:
            s = f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}" + "-" + "-".join(words[:2])
        out.append(s)
    return out


@dataclass
class SecretModel:
    random: MarkovModel
    ordinary: MarkovModel
    threshold: float = THRESHOLD

    def ratio(self, strings: list[str]) -> np.ndarray:
        """Log-likelihood ratio of random to ordinary; above 0 the string looks random."""
        return self.random.log_likelihood(strings) - self.ordinary.log_likelihood(strings)

    def stretches(self, s: str, threshold: float) -> list[tuple[int, int, float]]:
        """(start, end, ratio) of the stretches of a candidate that pass on their own."""
        code = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        gain = (self.random.steps[code[:-1], code[1:]] - self.ordinary.steps[code[:-1], code[1:]]).tolist()
        out, todo = [], [(0, len(s))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < MIN_LENGTH:
                continue
            best, begin, end, total, since = 0.0, lo, lo, 0.0, lo
            for i in range(lo, hi - 1):
                total += gain[i]
                if total <= 0:
                    total, since = 0.0, i + 1
                elif total > best:
                    best, begin, end = total, since, i + 2
            if best < threshold:
                continue
            while begin > lo and s[begin - 1] not in "/_-":
                begin -= 1
            while end < hi and s[end] not in "/_-":
                end += 1
            while begin < end and s[begin] in "/_-":
                begin += 1
            part = s[begin:end]
            if len(part) >= MIN_LENGTH and plausible(part) and (r := float(np.round(self.ratio([part])[0], 6))) >= threshold:
                out.append((begin, end, r))
            todo += [(lo, begin), (max(end, begin + 1), hi)]
        return sorted(out)


def document_words(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> list[str]:
    """Lower-case words of a sample of at most ``max_docs`` documents, chosen by a hash of their ids."""
    ids = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(max_docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    found = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9+/_\-])([a-z]{2,14})(?![a-z0-9+/_\-=])"), F.lit(1)))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r[0] for r in found.filter("n > 1").orderBy(F.xxhash64("w"), "w").limit(max_words).collect())


def train(docs: DataFrame | None = None, samples: int = SAMPLES, seed: int = 8) -> SecretModel:
    """Models from made samples, of ordinary identifiers half from the words of ``docs``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    words = document_words(docs) if docs is not None else []

    def ordinary(n: int) -> list[str]:
        return [*ordinary_strings(n - n // 2 if words else n, rng), *(ordinary_strings(n // 2, rng, words) if words else [])]

    model = SecretModel(fit(random_strings(samples, rng)), fit(ordinary(samples)))
    held = [s for s in ordinary(samples) if plausible(s)]
    model.threshold = float(np.clip(np.quantile(model.ratio(held), 0.999), THRESHOLD, 2 * THRESHOLD)) if held else THRESHOLD
    return model


def plausible(s: str) -> bool:
    """Whether a candidate has a digit or mixed case among letters."""
    digit, letter = any(c.isdigit() for c in s), any(c.isalpha() for c in s)
    return letter and (digit or (any(c.islower() for c in s[1:]) and any(c.isupper() for c in s[1:])))


def scan(docs: DataFrame, model: SecretModel, threshold: float | None = None) -> DataFrame:
    """(doc_id, start, length, preview, score) of each secret; start counts characters from 0.

    The candidates are found and split from their texts in the JVM; only they go through Python.
    """
    threshold = model.threshold if threshold is None else threshold
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("text").rlike(CANDIDATE))
    # splitting at candidates gives what lies before each: the offsets follow by adding lengths
    found = rows.select("doc_id", F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)).alias("c"), F.transform(F.split("text", CANDIDATE, -1), F.length).alias("gaps"))

    @F.pandas_udf("array<struct<i:int,at:int,n:int,score:double>>")
    def score(lists: pd.Series) -> pd.Series:
        flat = [s for x in lists for s in x]
        ratio = np.round(model.ratio(flat), 6)
        out, k = [], 0
        for x in lists:
            hits = []
            for i, s in enumerate(x):
                if plausible(s):
                    whole = float(ratio[k])
                    parts = [(0, len(s), whole)] if whole >= threshold else model.stretches(s, threshold)
                    hits += [{"i": i, "at": a, "n": b - a, "score": r} for a, b, r in parts]
                k += 1
            out.append(hits)
        return pd.Series(out)

    scored = found.withColumn("s", score("c")).filter(F.size("s") > 0)
    wide = scored.select("doc_id", F.explode("s").alias("s"), "c", "gaps").select("doc_id", "s.i", "s.at", "s.n", "s.score", "c", "gaps")
    before = F.aggregate(F.slice("gaps", 1, F.col("i") + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("c", 1, F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    secret = F.element_at("c", F.col("i") + 1)
    return wide.select("doc_id", (before + F.col("at")).cast("long").alias("start"), F.col("n").cast("long").alias("length"), F.concat(F.substring(secret, F.col("at") + 1, F.lit(4)), F.lit("...")).alias("preview"), "score")
