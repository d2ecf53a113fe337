"""Quality rules: a decision list learned by sequential covering, emitted as Spark conditional expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats
from .common import kept, labelled_sample

#: Labelled rows that the list is learned from at most, chosen by a hash of the id.
MAX_LABELLED = 20_000
#: (feature, "<=" or ">", threshold)
Condition = tuple[str, str, float]

FEATURES = (*stats.RATIOS, "n_words")


def holds(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, sign, limit in rule:
        column = x[:, FEATURES.index(name)]
        out &= column > limit if sign == ">" else column <= limit
    return out


def grow(x: np.ndarray, bad: np.ndarray, steps: int = 32, most: int = 4) -> list[Condition]:
    """Add the threshold of the largest information gain (bad rows covered times the gain in log precision) until no good row is covered."""
    rule: list[Condition] = []
    rows = np.ones(len(x), bool)
    while len(rule) < most and bad[rows].any() and not bad[rows].all():
        p, n = bad[rows].sum(), rows.sum()
        best, found = 1e-9, None
        for f, name in enumerate(FEATURES):
            values = x[rows, f]
            for limit in np.unique(np.r_[np.quantile(values, np.linspace(0, 1, steps)), np.quantile(values[bad[rows]], np.linspace(0, 1, steps))]):
                for sign, take in ((">", values > limit), ("<=", values <= limit)):
                    covered, right = take.sum(), (take & bad[rows]).sum()
                    if right and covered < n:
                        gain = right * (np.log2(right / covered) - np.log2(p / n))
                        if gain > best:
                            best, found = gain, (name, sign, float(limit))
        if not found:
            break
        rule.append(found)
        rows &= holds(x, [found])
    return rule


def prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Drop final conditions while that does not lower (bad - good) / (bad + good + 2) among the covered held-back rows."""
    def worth(r):
        rows = holds(x, r)
        p, n = (bad & rows).sum(), (~bad & rows).sum()
        return (p - n) / (p + n + 2)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, good: np.ndarray, most_rules: int = 16, least_precision: float = 0.95, least_cover: int = 3) -> list[list[Condition]]:
    """Ordered rules that reject; what no rule covers is kept.

    Two thirds of the rows grow a rule, one third prunes it.  A rule stays if it covers enough bad rows at the asked
    precision; the rows it covers are then taken away.  Rows of one kind only give an empty list.
    """
    bad = ~good
    part = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < most_rules and bad[left].any() and good[left].any():
        rule = grow(x[left & ~part], bad[left & ~part])
        if not rule:
            break
        rule = prune(rule, x[left & part], bad[left & part])
        rows = holds(x, rule) & left
        if (bad & rows).sum() < least_cover or (bad & rows).sum() < least_precision * rows.sum():
            break
        rules.append(rule)
        left &= ~rows
    return rules


def column(name: str) -> Column:
    return F.col("n_words").cast("double") if name == "n_words" else stats.ratio(name)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: number of the first rule that rejects, NULL if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules):
        test = F.lit(True)
        for name, sign, limit in rule:
            test &= column(name) > F.lit(limit) if sign == ">" else column(name) <= F.lit(limit)
        out = out.when(test, F.lit(k))
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> list[list[Condition]]:
    """Rules for ``labels.quality`` = 0 from labelled documents."""
    rows = labelled_sample(docs, labels, "quality", F.lit(True), max_rows)
    got = kept(stats.stats(rows)).join(F.broadcast(rows.select("doc_id", "label")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select(
        "label", *[column(name).alias(name) for name in FEATURES]).toPandas().to_numpy(float)
    return learn(got[:, 1:], got[:, 0] == 1)


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the counts of every whole text, base_failed, rule (the first that rejects) and kept.

    A NULL or empty text has no words and fails the base rule; repeated rows are judged alike.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stats.stats(docs).withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
