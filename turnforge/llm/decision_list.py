"""Quality rules: learned decision lists, as ordered Spark conditional expressions.

Sequential covering over the statistics of labelled documents.  A rule is grown on
two thirds of the rows that no earlier rule covers: the condition (statistic above
or below a threshold) with the largest information gain is added until the rule
covers no good document or no condition helps.  It is then pruned on the last
third: conditions are dropped from the end while (bad - good) / (bad + good)
does not fall.  A rule is kept if, on the rows for pruning, at least
``PRECISION`` of what it covers is bad; else covering ends.

The list is `when(rule 1, reject).when(rule 2, reject)...otherwise(keep)`.

Main path: built-in functions only; the driver learns from a bounded sample of
labelled statistics.  Cases: a null or empty text has no words and fails
the base rule; without labels, or with labels of one kind, nothing is learned and the
verdict is to keep; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnforge.llm.common import stored
from turnforge.llm.stats import RATIOS, labelled, with_stats

MAX_RULES = 12
MAX_CONDITIONS = 4
THRESHOLDS = 48  # per statistic, at quantiles of the rows in question
PRECISION = 0.7
LEAST_BAD = 5  # bad documents that a rule must cover among those for pruning


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # else at most the threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(next(iter(x.values()))), bool)


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p or not n:
            break
        best, chosen = 0.0, None
        for feature, v in x.items():
            for t in np.unique(np.quantile(v[inside], np.linspace(0, 1, THRESHOLDS + 1)[:-1])):
                for above in (True, False):
                    now = inside & ((v > t) if above else (v <= t))
                    p1 = (now & bad).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / now.sum()) - np.log2(p / (p + n)))
                        if gain > best + 1e-9:
                            best, chosen = gain, Condition(feature, above, float(t))
        if chosen is None:
            break
        rule = (*(c for c in rule if (c.feature, c.above) != (chosen.feature, chosen.above)), chosen)
        inside &= chosen.holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    rules: list[Rule] = []
    growing = np.arange(len(bad)) % 3 != 2  # rows come in hashed order
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        g, h = left & growing, left & ~growing
        if not bad[g].any() or not bad[h].any():
            break
        rule = prune(grow({f: v[g] for f, v in x.items()}, bad[g]), {f: v[h] for f, v in x.items()}, bad[h])
        inside = covers(rule, x) & left
        hit, miss = (inside & h & bad).sum(), (inside & h & ~bad).sum()
        if not rule or hit < LEAST_BAD or hit < PRECISION * (hit + miss):
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    when = lambda so_far, rule: so_far.when(reduce(Column.__and__, (c.column() for c in rule)), F.lit(False))
    return reduce(when, rules, F).otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """(statistics with base_failed and kept, the learned rules)."""
    stats = stored(with_stats(docs), "statistics")
    sample = labelled(stats, labels, RATIOS)
    x = {f: np.array([r[f] for r in sample], float) for f in RATIOS}
    rules = learn(x, np.array([r["y"] == 0 for r in sample], bool))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", F.when(failed, F.lit(False)).otherwise(verdict(rules))), rules
