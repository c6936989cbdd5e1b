"""Gradient-boosted trees on histograms for bounded samples, and a listwise model; fitted on the driver, applied in Arrow batches.

What a fit sees is bounded by its caller, as a sample or as counts of rows in equal bins; scoring is distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bins of a feature.
BINS = 64


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Booster:
    """Trees as arrays: per node feature (-1: a leaf), cut (left if at most), children and value; gains per feature."""

    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    gains: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; NaN goes left."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                high = x[rows, np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, np.where(high, right[at], left[at]), at)
            z += value[at]
        return _sigmoid(z)

    def importance(self) -> np.ndarray:
        """Gain of each feature, summing to 1 (0 without any split)."""
        return self.gains / self.gains.sum() if self.gains is not None and self.gains.sum() > 0 else np.zeros(0 if self.gains is None else len(self.gains))


def _quantiles(v, n, q):
    """``np.quantile`` of values of which each stands for ``n`` rows."""
    order = np.argsort(v, kind="stable")
    v, ends = v[order], np.cumsum(n[order])
    at = q * (ends[-1] - 1)
    a, b = (v[np.searchsorted(ends, k, side="right")] for k in (np.floor(at), np.ceil(at)))
    t = at - np.floor(at)
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))


def cuts_of(v, n=None) -> np.ndarray:
    """Upper bounds of a feature's bins but the last; with ``n`` each value stands for so many rows."""
    shares = np.linspace(0, 1, BINS + 1)[1:-1]
    return np.unique(np.quantile(v, shares) if n is None else _quantiles(v, n, shares))


def to_bins(x, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value, by feature."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)


def of_bins(bins, cuts: list[np.ndarray]) -> np.ndarray:
    """A value in each bin: to trees on these cuts the same as any other in it."""
    return np.stack([np.append(c, np.inf)[bins[:, j]] for j, c in enumerate(cuts)], axis=1)


def boost(x, y, weight=None, held=None, rounds: int = 200, rate: float = 0.1, leaves: int = 15, least: int = 20, features: float = 1.0, l2: float = 1.0, patience: int = 20, seed: int = 0, count=None, cuts=None) -> Booster:
    """A booster of logistic loss, trees grown by best gain to so many leaves.

    With ``count`` each row stands for so many equal ones, in the bins and in ``least`` too: the model is that of the rows written out.
    ``cuts`` are the bins' bounds by feature, where they aren't to be taken from ``x``.

    ``held`` marks rows that aren't fitted: when their loss hasn't fallen for ``patience`` rounds, the trees up to the best round are kept.
    Of one class only it is a constant.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = np.ones(len(y)) if count is None else np.asarray(count, float)
    w = n if weight is None else n * np.asarray(weight, float)
    held = np.zeros(len(y), bool) if held is None else np.asarray(held, bool)
    fit = np.flatnonzero(~held)
    mean = float(np.clip((w[fit] * y[fit]).sum() / max(w[fit].sum(), 1e-12), 1e-6, 1 - 1e-6)) if len(fit) else 0.5
    model = Booster(float(np.log(mean / (1 - mean))), [], np.zeros(x.shape[1]))
    if len(fit) < 2 or len(np.unique(y[fit])) < 2:
        return model
    cuts = [cuts_of(x[fit, j], None if count is None else n[fit]) for j in range(x.shape[1])] if cuts is None else cuts
    binned = to_bins(x, cuts)
    rng, z = np.random.default_rng(seed), np.full(len(y), model.base)
    loss, best, stale = np.inf, 0, 0
    for _ in range(rounds):
        p = _sigmoid(z)
        use = np.sort(rng.choice(x.shape[1], max(1, round(features * x.shape[1])), replace=False))
        tree, at = _tree(binned, cuts, w * (p - y), w * np.maximum(p * (1 - p), 1e-9), n, fit, use, leaves, least, l2, model.gains)
        value = -rate * tree[4]
        model.trees.append((*tree[:4], value))
        z += value[at]
        if held.any():
            q = np.clip(_sigmoid(z[held]), 1e-12, 1 - 1e-12)
            each = -(y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))
            now = each.mean() if count is None else np.average(each, weights=n[held])
            if now < loss - 1e-9:
                loss, best, stale = now, len(model.trees), 0
            else:
                stale += 1
            if stale >= patience:
                break
    if held.any():
        del model.trees[best:]
    return model


def _split(binned, cuts, g, h, n, rows, use, least, l2):
    """(gain, feature, bin) of the best split of a node's rows, or None."""
    sizes = np.array([len(cuts[j]) for j in use])
    width = sizes.max() + 1
    if width < 2:
        return None
    at = (binned[rows][:, use] + np.arange(len(use)) * width).ravel()
    gs, hs, ns = (np.cumsum(np.bincount(at, np.repeat(v[rows], len(use)), len(use) * width).reshape(len(use), width), axis=1)[:, :-1] for v in (g, h, n))
    g_all, h_all, n_all = g[rows].sum(), h[rows].sum(), n[rows].sum()
    ok = (ns >= least) & (n_all - ns >= least) & (np.arange(width - 1) < sizes[:, None])
    gain = np.where(ok, gs**2 / (hs + l2) + (g_all - gs) ** 2 / (h_all - hs + l2) - g_all**2 / (h_all + l2), -1.0)
    j, k = np.unravel_index(np.argmax(gain), gain.shape)
    return (float(gain[j, k]), int(use[j]), int(k)) if gain[j, k] > 1e-9 else None


def _tree(binned, cuts, g, h, n, fit, use, leaves, least, l2, gains):
    """One tree, and the leaf of every row, fitted or not."""
    feature, cut, left, right, value = [-1], [0.0], [0], [0], [g[fit].sum() / (h[fit].sum() + l2)]
    at = np.zeros(len(binned), np.int64)
    open_ = {0: (fit, _split(binned, cuts, g, h, n, fit, use, least, l2))}
    for _ in range(leaves - 1):
        node = max((n for n, (_, s) in open_.items() if s), key=lambda n: open_[n][1][0], default=None)
        if node is None:
            break
        rows, (gain, j, k) = open_.pop(node)
        gains[j] += gain
        feature[node], cut[node], left[node], right[node] = j, float(cuts[j][k]), len(feature), len(feature) + 1
        below = binned[:, j] <= k
        at = np.where(at == node, np.where(below, left[node], right[node]), at)
        for child, part in ((left[node], rows[binned[rows, j] <= k]), (right[node], rows[binned[rows, j] > k])):
            feature.append(-1), cut.append(0.0), left.append(0), right.append(0), value.append(g[part].sum() / (h[part].sum() + l2))
            open_[child] = (part, _split(binned, cuts, g, h, n, part, use, least, l2))
    return (np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)), at


def scored(df: DataFrame, models: dict[str, Booster], columns: list[str]) -> DataFrame:
    """``df`` with the probability by each model as a column, in one pass over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    names = list(models)

    def run(*parts: pd.Series) -> pd.DataFrame:
        x = np.stack([p.to_numpy(float) for p in parts], axis=1)
        return pd.DataFrame({n: shared.value[n].score(x) for n in names})

    made = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))
    return df.withColumn("_scores", made(*(F.col(c) for c in columns))).select(*df.columns, "_scores.*")


@dataclass
class Listwise:
    """Softmax over the slots of a list and a last slot for none of them: a linear score of each slot's features, a constant for none."""

    weights: np.ndarray
    none: float

    def score(self, slots: np.ndarray) -> np.ndarray:
        """Probabilities of the slots of one list, none's last."""
        z = np.append(slots @ self.weights, self.none)
        e = np.exp(z - z.max())
        return e / e.sum()


def listwise(lists: list[np.ndarray], labels: list[int], l2: float = 1e-3, steps: int = 300, rate: float = 0.5) -> Listwise:
    """Fitted by gradient steps on the likelihood of the label's slot; a label beyond the list means none."""
    if not lists:
        return Listwise(np.zeros(0), 0.0)
    sizes = np.array([len(s) for s in lists])
    x, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    hit, nobody = np.zeros(len(x)), np.zeros(len(lists))
    for i, k in enumerate(labels):
        if k < sizes[i]:
            hit[first[i] + k] = 1
        else:
            nobody[i] = 1
    model = Listwise(np.zeros(x.shape[1]), 0.0)
    for _ in range(steps):
        z = x @ model.weights
        top = np.maximum(np.maximum.reduceat(z, first), model.none)
        e, n = np.exp(z - top[of]), np.exp(model.none - top)
        total = np.add.reduceat(e, first) + n
        model.weights = model.weights - rate * (x.T @ (e / total[of] - hit) / len(lists) + l2 * model.weights)
        model.none -= rate * float((n / total - nobody).mean())
    return model


def listwise_scores(model: Listwise, slots: Column) -> Column:
    """``array<double>``: probabilities of an ``array<array<double>>`` of slot features, none's last."""
    return F.pandas_udf(lambda lists: pd.Series([model.score(np.array([list(s) for s in x], float).reshape(len(x), -1)).tolist() for x in lists]), "array<double>")(slots)
