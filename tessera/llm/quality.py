"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics of labelled documents, each on a bootstrap
sample and a random subset of the statistics.  Every path from a root to a node becomes
a rule, a conjunction of threshold conditions.  Lasso logistic regression weighs the
rules and drops most.  The rules left are compiled into one Spark column expression, so
that scoring stays in the JVM.

Defined results: a null text has an empty text's statistics; the statistics of an empty
text are 0.  Both are scored like any other text.  Labels with a null doc_id or quality
aren't used; the sample for fitting is bounded by ``max_labels``, chosen by a hash of
the doc_id.  Without labels of both classes every document gets the score 1 and stays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import named, plain

MAX_LABELS = 8000
THRESHOLD = 0.5


_CLASSES = {"upper": r"\p{Lu}", "symbols": r"%&$*#@^~|<>{}\[\]=+_\\", "marks": "!?;:", "stops": ".", "digits": "0-9", "lines": r"\n"}
_PER_CHARACTER = ("upper", "symbols", "marks", "digits")


def with_statistics(docs: DataFrame, used: set[str], text: str = "text") -> DataFrame:
    """``docs`` with a struct __stats of the ``used`` statistics over whole texts.

    Words and counts pass through one-element generators, which the optimizer does not
    merge with what reads them, so that each is computed once a row.
    """
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "") if used - set(_PER_CHARACTER) else F.array().cast("array<string>")
    wide = docs.select("*", F.explode(F.array(words)).alias("__words"))

    def count(chars: str) -> Column:
        # cutting runs out copies what lies between them, which is most of a text, in long pieces
        return (F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]+", ""))).cast("double")

    parts = [F.length(t).cast("double").alias("n"), F.size("__words").cast("double").alias("w")]
    parts += [count(chars).alias(k) for k, chars in _CLASSES.items() if k in used]
    parts += [F.size(F.array_distinct("__words")).cast("double").alias("distinct")] if "distinct" in used else []
    wide = wide.select(*docs.columns, F.explode(F.array(F.struct(*parts))).alias("__counts"))
    n, w = F.col("__counts.n"), F.col("__counts.w")

    def share(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(F.lit(0.0))

    made = {"words": w, "word_length": share(n, w)}
    made |= {k: share(F.col(f"__counts.{k}"), n if k in _PER_CHARACTER else w) for k in (*_CLASSES, "distinct") if k in used}
    return wide.withColumn("__stats", F.struct(*[made[k].alias(k) for k in NAMES if k in used])).drop("__counts")


NAMES = ("words", "word_length", "upper", "symbols", "marks", "stops", "digits", "lines", "distinct")
Rule = tuple[tuple[str, bool, float], ...]


@dataclass
class RuleModel:
    """Rules, each a conjunction of (statistic, greater, threshold), with weights and an intercept."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 20.0

    def score(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        z = np.full(len(stats[NAMES[0]]), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + w * holds(rule, stats)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as a column over columns of statistics."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            test = F.lit(True)
            for name, greater, at in rule:
                test = test & ((stats[name] > at) if greater else (stats[name] <= at))
            z = z + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def holds(rule: Rule, stats: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(stats[NAMES[0]]), bool)
    for name, greater, at in rule:
        out &= stats[name] > at if greater else stats[name] <= at
    return out


def _best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float]:
    """(gain in Gini impurity, threshold) of the best split of one statistic."""
    order = np.argsort(x, kind="stable")
    v, c = x[order], np.cumsum(y[order])
    n = len(v)
    k = np.arange(1, n)
    ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
    if not ok.any():
        return 0.0, 0.0
    left, right = c[:-1], c[-1] - c[:-1]
    cost = left * (1 - left / k) + right * (1 - right / (n - k))
    cost = np.where(ok, cost, np.inf)
    at = int(np.argmin(cost))
    return float(c[-1] * (1 - c[-1] / n) - cost[at]), float((v[at] + v[at + 1]) / 2)


def _paths(stats: dict[str, np.ndarray], y: np.ndarray, rows: np.ndarray, names: list[str], depth: int, least: int, so_far: Rule) -> list[Rule]:
    out = [so_far] if so_far else []
    if depth == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
        return out
    gain, name, at = max((*_best_split(stats[k][rows], y[rows], least)[:1], k, _best_split(stats[k][rows], y[rows], least)[1]) for k in names)
    if gain <= 1e-9:
        return out
    for greater in (False, True):
        side = rows[(stats[name][rows] > at) == greater]
        out += _paths(stats, y, side, names, depth - 1, least, (*so_far, (name, greater, at)))
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, d = x.shape
    step = 4.0 / (np.linalg.norm(np.c_[x, np.ones(n)], 2) ** 2 / n + 1e-12)
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(x @ v + vb))) - y
        u = v - step * (x.T @ r / n)
        new, nb = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), vb - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


def fit(stats: dict[str, np.ndarray], good: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 0.004, seed: int = 6) -> RuleModel:
    """Grows trees, takes their paths as rules and weighs them by the lasso."""
    y = good.astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return RuleModel()
    rng = np.random.Generator(np.random.PCG64(seed))
    least = max(3, len(y) // 500)
    rules: dict[Rule, None] = {}
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    for _ in range(trees):
        m = min(len(classes[0]), len(classes[1]), 500)
        rows = np.concatenate([rng.choice(c, size=max(m, 1), replace=True) for c in classes])
        names = sorted(rng.choice(NAMES, size=4, replace=False).tolist())
        for rule in _paths(stats, y, np.sort(rows), names, depth, least, ()):
            rules[tuple((n, g, float(f"{a:.5g}")) for n, g, a in rule)] = None
    kept, columns, seen = [], [], set()
    for rule in rules:
        h = holds(rule, stats)
        if h.all() or not h.any() or (key := h.tobytes()) in seen:
            continue
        seen.add(key)
        kept.append(rule)
        columns.append(h)
    if not kept:
        return RuleModel()
    w, b = lasso_logistic(np.stack(columns, axis=1).astype(np.float64), y, penalty)
    top = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel([kept[i] for i in top], [float(w[i]) for i in top], float(b))


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and classes of a sample of at most ``max_labels`` labelled documents."""
    lab = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__q"))
    lab = lab.orderBy(F.xxhash64("__id"), "__id").limit(max_labels).groupBy("__id").agg(F.max("__q").alias("__q"))
    part = docs.select("doc_id", "text").join(F.broadcast(lab), F.col("doc_id") == F.col("__id"))
    rows = with_statistics(part, set(NAMES)).select("__q", "__id", "__stats.*").toPandas().sort_values(["__id", *NAMES])
    return {k: rows[k].to_numpy(np.float64) for k in NAMES}, rows["__q"].to_numpy(np.int64)


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> RuleModel:
    stats, q = labelled_statistics(docs, labels, max_labels)
    return fit(stats, q)


def scored(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """``docs`` with a column __score; only the statistics that a rule reads are computed."""
    used = {name for rule in model.rules for name, _, _ in rule}
    if not used:
        return docs.withColumn("__score", F.lit(float(1 / (1 + np.exp(-model.intercept)))))
    wide = with_statistics(docs, used, text)
    return wide.withColumn("__score", model.column({k: F.col("__stats").getField(k) for k in used})).drop("__stats")


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; all columns stay."""
    rows, at = plain(docs)
    return named(scored(rows, model, at["text"]).filter(F.col("__score") >= threshold), docs)
