"""Quality rules (operator 7): learned decision lists. DataFrame functions only.

``learn`` is sequential covering with growing and pruning: the labelled rows are split in two by turns; on the growing
part a conjunction of threshold conditions is grown condition by condition (highest information gain for the target
label over the conditions in ``thresholds``), then on the pruning part its last conditions are dropped while that
doesn't lower (p - n) / (p + n); a rule that isn't right more often than the default is on the pruning part ends the
list. Covered rows leave both parts. The list is ordered and ends in a default; ``expression`` makes it one Spark
conditional expression.

Candidate thresholds are quantiles of the labelled statistics. Fitting looks at a bounded sample of labelled rows
(``max_rows``), on the driver; statistics, rules and verdicts cover every document.

Defined results: a null text has statistics of 0 and fails the base rules (too few words); repeated rows are judged each;
without labels of both kinds the list is just its default; of conditions with equal gain the first in the order of features
and thresholds is taken; an empty table gives an empty table; a very long text is counted whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text_stats
from .boosting import fetched, training_rows
from .common import stored


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each a conjunction and its verdict, and the verdict where none fits."""

    rules: tuple[tuple[tuple[Condition, ...], bool], ...]
    default: bool

    def expression(self) -> Column:
        out = None
        for conditions, verdict in self.rules:
            test = F.lit(True)
            for c in conditions:
                test = test & c.column()
            out = F.when(test, F.lit(verdict)) if out is None else out.when(test, F.lit(verdict))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def __str__(self) -> str:
        lines = [f"if {' and '.join(map(str, c))}: {'keep' if v else 'drop'}" for c, v in self.rules]
        return "\n".join([*lines, f"else: {'keep' if self.default else 'drop'}"])


def learn(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], cuts: int = 24, max_rules: int = 16, max_conditions: int = 4, min_cover: int = 4) -> DecisionList:
    """x: statistics; y: 1 keep, 0 drop. Rules are for the rarer label; the default is the commoner one."""
    if not len(y) or y.min() == y.max():
        return DecisionList((), bool(len(y) == 0 or y[0] == 1))
    target = 0 if y.mean() >= 0.5 else 1
    positive = y == target
    conditions, masks = [], []
    for f, name in enumerate(features):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, cuts + 1)[:-1])):
            for above in (True, False):
                conditions.append(Condition(name, above, float(t)))
                masks.append(x[:, f] > t if above else x[:, f] <= t)
    masks = np.array(masks)
    turn = np.zeros(len(y), bool)  # the pruning part: every third row of each label, in the order of a hash of the ids
    for label in (0, 1):
        turn[np.flatnonzero(y == label)[2::3]] = True
    left, rules = np.ones(len(y), bool), []
    while len(rules) < max_rules and (left & positive).any():
        cover, chosen = left & ~turn, []
        while len(chosen) < max_conditions:
            p0, n0 = (cover & positive).sum(), (cover & ~positive).sum()
            if not p0 or not n0:
                break
            p, n = masks[:, cover & positive].sum(axis=1), masks[:, cover & ~positive].sum(axis=1)
            gain = p * (np.log2((p + 0.1) / (p + n + 0.2)) - np.log2(p0 / (p0 + n0)))
            gain[p < min_cover] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= 1e-9:
                break
            chosen.append(best)
            cover = cover & masks[best]
        prune = left & turn

        def worth(rule: list[int]) -> float:
            hit = prune & masks[rule].all(axis=0) if rule else prune
            p, n = (hit & positive).sum(), (hit & ~positive).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(chosen) > 1 and worth(chosen[:-1]) >= worth(chosen):
            chosen.pop()
        if not chosen or worth(chosen) <= 0:
            break
        rules.append((tuple(conditions[i] for i in chosen), target == 1))
        left = left & ~masks[chosen].all(axis=0)
    return DecisionList(tuple(rules), target == 0)


def judged(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), max_rows: int = 20_000) -> tuple[DataFrame, DecisionList]:
    """The statistics, base_failed and kept of every document, and the list behind kept."""
    features = stored(text_stats.with_features(docs.select(id_col, text_col, *keep), text_col), "rules")
    sample = training_rows(features.filter(~F.col("base_failed")), labels, label_col, F.lit(True), id_col, max_rows)
    rows = fetched(sample)
    rules = learn(rows[:, :-1], rows[:, -1], text_stats.FEATURES)
    return features.withColumn("kept", ~F.col("base_failed") & rules.expression()), rules
