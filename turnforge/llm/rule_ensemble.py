"""Quality classifier: a sparse ensemble of rules taken from trees.

1. Statistics of every document (built-in expressions), stored.
2. On a bounded sample of labelled documents, outside the held-out fold: boosted
   regression trees of depth ``DEPTH`` on the logistic loss.
3. Every path from a root to a node is a rule, a conjunction of thresholds.
4. Lasso logistic regression over the rules (proximal gradient with momentum)
   drops most of them.
5. The rules left become one Spark column: sigmoid(intercept + sum of weights of
   the rules that hold), clipped to 0..1 by its nature.

Scores depend on the statistics of the text alone: no label, language, source
or id is read when scoring.

Cases: a null or empty text has statistics of zero and gets a score like any
other; without labels, or with one kind, the score is the share of good ones
(0.5 without any); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnforge.llm.common import fold_of, stored
from turnforge.llm.decision_list import Condition, Rule, covers
from turnforge.llm.stats import LABELLED_ROWS, RATIOS, labelled, with_stats

FEATURES = ["n_words", *RATIOS]
TREES = 40
DEPTH = 3
SHRINK = 0.2
BINS = 64
LEAST_LEAF = 10
LAMBDA = 2e-4
STEPS = 600
THRESHOLD = 0.3


def _tree(codes: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, weight: np.ndarray) -> list[tuple[Rule, np.ndarray, float]]:
    """(path, rows, value) of every node below the root; the leaves are those with a value."""
    out: list = []

    def split(rows: np.ndarray, path: Rule, depth: int) -> bool:
        best, choice = 1e-6, None
        total = grad[rows].sum() ** 2 / (weight[rows].sum() + 1)
        for j, e in enumerate(edges):
            c = codes[rows, j]
            g, h, n = (np.cumsum(np.bincount(c, w, len(e) + 1)) for w in (grad[rows], weight[rows], None))
            ok = (n >= LEAST_LEAF) & (n[-1] - n >= LEAST_LEAF)
            gain = np.where(ok, g ** 2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - total, 0)[:-1]
            if len(gain) and gain.max() > best:
                best, choice = gain.max(), (j, int(gain.argmax()))
        if choice is None:
            return False
        j, k = choice
        low = codes[rows, j] <= k
        for above, part in ((False, rows[low]), (True, rows[~low])):
            rule = (*path, Condition(FEATURES[j], above, float(edges[j][k])))
            node = len(out)
            out.append(None)
            inner = depth + 1 < DEPTH and split(part, rule, depth + 1)
            out[node] = (rule, part, None if inner else grad[part].sum() / (weight[part].sum() + 1))
        return True

    split(np.arange(len(grad)), (), 0)
    return out


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees; conditions on one statistic and side are merged into the tightest."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # code <= k: x <= edges[k]
    margin = np.full(len(y), np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        for path, rows, value in _tree(codes, edges, y - p, p * (1 - p)):
            tight: dict[tuple[str, bool], float] = {}
            for c in path:
                old = tight.get((c.feature, c.above), c.threshold)
                tight[c.feature, c.above] = max(old, c.threshold) if c.above else min(old, c.threshold)
            rules[tuple(Condition(f, a, t) for (f, a), t in sorted(tight.items()))] = None
            if value is not None:
                margin[rows] += SHRINK * np.clip(value, -4, 4)
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss + LAMBDA * sum of absolute weights."""
    n, k = z.shape
    w, b = np.zeros(k), np.log(y.mean() / (1 - y.mean()))
    v, c, t = w.copy(), b, 1.0
    step = 4 / (np.linalg.norm(z.T @ z / n, 2) + 1)
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        w2 = v - step * (z.T @ r / n)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * LAMBDA, 0)
        b2 = c - step * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b), w


def fit(sample: list) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    y = np.array([float(r["y"] > 0) for r in sample])
    if not len(y) or y.min() == y.max():
        mean = y.mean() if len(y) else 0.5
        return float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), []
    x = np.array([[r[f] for f in FEATURES] for r in sample], float)
    rules = extract_rules(x, y)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    named = dict(zip(FEATURES, x.T, strict=True))
    z = np.stack([covers(r, named) for r in rules], axis=1).astype(float)
    b, w = lasso(z, y)
    return b, [(float(a), r) for a, r in zip(w, rules, strict=True) if abs(a) > 1e-4]


def score(model: tuple[float, list[tuple[float, Rule]]]) -> Column:
    b, rules = model
    total = F.lit(b)
    for w, rule in rules:
        total = total + F.when(reduce(Column.__and__, (c.column() for c in rule)), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, the ``keep`` columns, held_out, score and predicted of every row."""
    stats = stored(with_stats(docs, keep), "statistics")
    held = fold_of() == 0
    model = fit(labelled(stats.where(~held), labels, FEATURES, rows))
    out = stats.select("doc_id", *keep, held.alias("held_out"), score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))




def accepted(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they were."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select("doc_id", "text", whole.alias("__row"))
    return scored(packed, labels, ("__row",), rows).where("predicted = 1").select("__row.*")
