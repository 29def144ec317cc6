"""Decoding two conditions: over a window, or at every time point."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import in_condition
from .signals import crop


def stratified_folds(y: np.ndarray, n_splits: int, seed: int | None) -> np.ndarray:
    """Fold of each row: every class is shuffled and dealt in turn."""
    rng = np.random.default_rng(seed)
    fold = np.empty(len(y), int)
    shift = 0
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        fold[rng.permutation(at)] = (np.arange(len(at)) + shift) % n_splits
        shift += len(at)
    return fold


def anova_f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One-way F of each column; constant columns give 0."""
    groups = [x[y == c] for c in np.unique(y)]
    mean = x.mean(axis=0)
    between = sum(len(g) * (g.mean(axis=0) - mean) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / max(len(x) - len(groups), 1)
    return np.where(within > 0, between / np.where(within > 0, within, 1), np.where(between > 0, np.inf, 0.0))


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Hinge-loss separator with weighted rows, by dual coordinate descent; the constant is a column of ones."""
    z = np.hstack([x, np.ones((len(x), 1))])
    s = np.where(y > 0, 1.0, -1.0)
    alpha, w = np.zeros(len(x)), np.zeros(z.shape[1])
    q = (z**2).sum(axis=1)
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(x)):
            if q[i] == 0:
                continue
            new = min(max(alpha[i] - (s[i] * (w @ z[i]) - 1) / q[i], 0.0), c * weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * s[i] * z[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-8:
            break
    return w[:-1], float(w[-1])


def lda(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Two-class linear discriminant with the pooled covariance."""
    a, b = x[y == 0], x[y == 1]
    pooled = ((a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) + (b - b.mean(axis=0)).T @ (b - b.mean(axis=0))) / max(len(x) - 2, 1)
    w = np.linalg.pinv(pooled) @ (b.mean(axis=0) - a.mean(axis=0))
    return w, float(-w @ (a.mean(axis=0) + b.mean(axis=0)) / 2 + np.log(len(b) / len(a)))


def auc(y: np.ndarray, score: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Weighted area under the curve; ties count half. One sort: each value's weight of zeros below it and at it."""
    weight = np.ones(len(y)) if weight is None else weight
    level, at = np.unique(score, return_inverse=True)
    ones, zeros = (np.bincount(at, np.where(y == k, weight, 0.0), len(level)) for k in (1, 0))
    below = np.cumsum(zeros) - zeros
    return float((ones * (below + zeros / 2)).sum() / (ones.sum() * zeros.sum()))


def cross_validate(x: np.ndarray, y: np.ndarray, n_splits: int, seed: int | None, scoring: str = "roc_auc", hard: bool = False, percentile: int = 10) -> float:
    """Mean score over folds: scaling and (for roc_auc) the best features by F are fitted on training rows alone.

    ``hard`` scores predictions, weighted so that classes balance, as the window decoder does.
    Without any usable feature a fold scores 1 or 0.5, as the classes' means agree between training and test or not.
    """
    fold = stratified_folds(y, n_splits, seed)
    balance = np.where(y == 1, 1 / max((y == 1).sum(), 1), 1 / max((y == 0).sum(), 1))
    scores = []
    for k in range(n_splits):
        train, test = fold != k, fold == k
        if len(np.unique(y[test])) < 2 or len(np.unique(y[train])) < 2:
            continue
        mean, spread = x[train].mean(axis=0), x[train].std(axis=0)
        a, b = ((v - mean) / np.where(spread > 0, spread, 1) for v in (x[train], x[test]))
        if scoring == "roc_auc":
            f = anova_f(a, y[train])
            keep = np.sort(np.argsort(-f, kind="stable")[: max(1, int(np.ceil(len(f) * percentile / 100)))])
            if not np.any(f[keep] > 0):
                up = [x[m & (y == 1)].mean() > x[m & (y == 0)].mean() for m in (train, test)]
                scores.append(1.0 if up[0] == up[1] else 0.5)
                continue
            w, c = linear_svm(a[:, keep], y[train], balance[train] if hard else np.ones(train.sum()))
            score = b[:, keep] @ w + c
            scores.append(auc(y[test], (score > 0).astype(float), balance[test]) if hard else auc(y[test], score))
        else:
            w, c = lda(a, y[train])
            scores.append(float(((b @ w + c > 0) == (y[test] == 1)).mean()))
    return float(np.mean(scores)) if scores else 0.5


def _labelled(signals: DataFrame, condition_a: Sequence[str], condition_b: Sequence[str], tmin: float | None, tmax: float | None, keys: Sequence[str]) -> DataFrame:
    """Rows of both conditions, label 0 or 1. An element takes part if every condition is one of its own by exact name; rows are
    then taken by name or by /-separated tags, the first condition's before the second's."""
    c = F.col("condition")
    wanted = [str(x) for x in (*condition_a, *condition_b)]
    own = signals.groupBy(*keys).agg(F.collect_set("condition").alias("__have"))
    fit = own.where(F.size(F.array_except(F.array(*(F.lit(w) for w in wanted)), "__have")) == 0).select(*keys)
    label = F.when(in_condition(c, list(condition_a)), 0).when(in_condition(c, list(condition_b)), 1)
    return crop(signals.join(fit, list(keys), "left_semi").withColumn("label", label).where("label is not null"), tmin, tmax)


def window_decoding(signals: DataFrame, condition_a: Sequence[str], condition_b: Sequence[str], tmin: float | None = None, tmax: float | None = None, n_splits: int = 10, scoring: str = "roc_auc", seed: int | None = 0, keys: Sequence[str] = ("element",)) -> DataFrame:
    """Score of telling epochs of two conditions apart by all channels and times; 0.5 where one is missing.

    Elements are the unit of distribution: one recording's epochs are one group.
    """
    import pandas as pd

    types = {f.name: f.dataType.simpleString() for f in signals.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["label", "epoch", "ch_idx"]).groupby(["label", "epoch"], sort=True)
        x = np.stack([np.concatenate(g["data"].to_list()) for _, g in rows])
        y = np.array([k[0] for k, _ in rows])
        n = int(min(n_splits, len(y) / 2))
        value = cross_validate(x, y, n, seed, scoring, hard=scoring == "roc_auc") if n >= 2 and len(np.unique(y)) == 2 else 0.5
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "value": value}])

    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "value double"
    found = _labelled(signals, condition_a, condition_b, tmin, tmax, keys).groupBy(*keys).applyInPandas(run, schema)
    return signals.select(*keys).distinct().join(found, list(keys), "left").withColumn("value", F.coalesce("value", F.lit(0.5)))


def time_decoding(signals: DataFrame, condition_a: Sequence[str], condition_b: Sequence[str], tmin: float | None = None, tmax: float | None = None, n_splits: int = 5, scoring: str = "roc_auc", seed: int | None = 42, keys: Sequence[str] = ("element",)) -> DataFrame:
    """The same at each time point over channels: keys, t_idx, value. Elements that lack a condition have 100 points of 0.5."""
    import pandas as pd

    types = {f.name: f.dataType.simpleString() for f in signals.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=["label", "epoch"], columns="ch_idx", values="value")
        y = wide.index.get_level_values("label").to_numpy()
        n = min(n_splits, int(np.bincount(y, minlength=2).min()))
        value = cross_validate(wide.to_numpy(), y, n, seed, scoring) if n >= 2 else 0.5
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "t_idx": int(pdf["t_idx"].iloc[0]), "value": value}])

    samples = _labelled(signals, condition_a, condition_b, tmin, tmax, keys).select(*keys, "label", "epoch", "ch_idx", F.posexplode("data").alias("t_idx", "value"))
    both = samples.groupBy(*keys).agg(F.countDistinct("label").alias("n")).where("n = 2").select(*keys)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "t_idx int, value double"
    found = samples.join(both, list(keys), "left_semi").groupBy(*keys, "t_idx").applyInPandas(run, schema)
    lacking = signals.select(*keys).distinct().join(both, list(keys), "left_anti")
    chance = lacking.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(99))).alias("t_idx"), F.lit(0.5).alias("value"))
    return found.unionByName(chance)


def anova_by_sql(features: DataFrame, keys: Sequence[str], value: str = "value", label: str = "label") -> DataFrame:
    """F of each key between two labels, from sums and sums of squares alone: partial sums are all that is shuffled."""
    one, two = (F.when(F.col(label) == k, F.col(value)) for k in (0, 1))
    s = features.groupBy(*keys).agg(*(f(c).alias(f"{n}{k}") for k, c in ((0, one), (1, two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))
    n0, n1, m0, m1 = (F.col(c) for c in ("n0", "n1", "m0", "m1"))
    between = n0 * n1 / (n0 + n1) * (m0 - m1) ** 2
    within = (n0 * F.col("v0") + n1 * F.col("v1")) / (n0 + n1 - 2)
    return s.select(*keys, (between / within).alias("f"))
