"""Logistic models with random intercepts, of all folds at once, fitted from sums by level.

Penalised quasi-likelihood: a pass over the rows gives, for every fold, the weighted products of the fixed
columns and their sums by level of each grouping; with these the linear mixed model of the working response is
solved on the driver, variances included, and the next pass weighs the rows anew. Levels (donors, species) are
design data; rows never leave their tasks. The grouping with the most levels has a diagonal block and is
eliminated, so that thousands of levels cost no large matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folded import Batch, Folded, coded, independent, medians, missing_classes, scored, summed

#: Numbers that one task may gather for one fold; more levels than that are refused.
WIDTH = 4_000_000


def uniform(seed: int, id: Column) -> Column:
    """A number in [0, 1) of the row: the leading 32 bits of md5('seed|id')."""
    text = F.concat_ws("|", F.lit(str(seed)), id.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def shares(positives: np.ndarray, negatives: np.ndarray, ratio: float | None, cap: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the positives and of the negatives of each fold that are to be drawn.

    ``ratio`` negatives a positive are wanted (all where there are fewer); beyond ``cap`` rows both shares shrink alike.
    """
    neg = np.ones_like(negatives) if ratio is None else np.minimum(1, np.divide(ratio * positives, negatives, out=np.ones_like(negatives), where=negatives > 0))
    n = positives + neg * negatives
    both = np.ones_like(n) if cap is None else np.minimum(1, np.divide(cap, n, out=np.ones_like(n), where=n > 0))
    return both, neg * both


@dataclass
class Fit:
    """Fixed effects (intercept first), effects by level and variances of each grouping, share of the negatives drawn over that of the positives, both numbers drawn."""

    beta: np.ndarray
    effects: list[np.ndarray]
    variances: list[float]
    prior: float
    drawn: tuple[int, int] = (0, 0)


@dataclass
class Sums:
    """What one pass gives a fold; ``cross`` holds the weights shared by two groupings."""

    gram: np.ndarray
    rhs: np.ndarray
    deviance: float
    drawn: np.ndarray  # positives, negatives
    weight: list[np.ndarray]
    wx: list[np.ndarray]
    wz: list[np.ndarray]
    cross: dict[tuple[int, int], np.ndarray]


def layout(p: int, sizes: Sequence[int]) -> tuple[list[tuple[int, ...]], int]:
    """Shapes of the parts of ``Sums`` in their order, and their total size."""
    shapes: list[tuple[int, ...]] = [(p, p), (p,), (3,)]
    for n in sizes:
        shapes += [(n,), (n, p), (n,)]
    shapes += [(sizes[a], sizes[b]) for a in range(len(sizes)) for b in range(a + 1, len(sizes))]
    return shapes, sum(int(np.prod(s)) for s in shapes)


def unpack(v: np.ndarray, p: int, sizes: Sequence[int]) -> Sums:
    """Views into ``v``: adding to a part adds to ``v``."""
    parts, at = [], 0
    for s in layout(p, sizes)[0]:
        n = int(np.prod(s))
        parts.append(v[at : at + n].reshape(s))
        at += n
    g, pairs = len(sizes), [(a, b) for a in range(len(sizes)) for b in range(a + 1, len(sizes))]
    by = lambda i: [parts[3 + 3 * k + i] for k in range(g)]
    return Sums(parts[0], parts[1], float(parts[2][0]), parts[2][1:], by(0), by(1), by(2), dict(zip(pairs, parts[3 + 3 * g :])))


def solve(s: Sums, on: np.ndarray, variances: Sequence[float], rounds: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Coefficients of the columns ``on``, effects and variances of the linear mixed model that the sums describe.

    Variances are the mean squares of the effects and their uncertainty, iterated to a fixed point; only levels with
    rows count. A variance stays above 1e-4.
    """
    g = len(s.weight)
    big = max(range(g), key=lambda k: len(s.weight[k]))
    rest = [k for k in range(g) if k != big]
    scale = np.sqrt(np.diag(s.gram)[on])
    seen = [w > 0 for w in s.weight]
    cross = lambda a, b: s.cross[a, b] if a < b else s.cross[b, a].T
    corner = [[s.gram[np.ix_(on, on)] / np.outer(scale, scale), *[(s.wx[k][:, on] / scale).T for k in rest]]]
    for a in rest:
        corner.append([s.wx[a][:, on] / scale, *[np.diag(s.weight[a]) if a == b else cross(a, b) for b in rest]])
    corner = np.block(corner)
    side = np.hstack([s.wx[big][:, on] / scale, *[cross(big, k) for k in rest]])
    right = np.concatenate([s.rhs[on] / scale, *[s.wz[k] for k in rest]])
    q, var = len(on), list(variances)
    for _ in range(rounds):
        d = 1 / (s.weight[big] + 1 / var[big])
        penalty = np.concatenate([np.zeros(q), *[np.full(len(s.weight[k]), 1 / var[k]) for k in rest]])
        inverse = np.linalg.inv(corner + np.diag(penalty) - (side * d[:, None]).T @ side)
        first = inverse @ (right - side.T @ (d * s.wz[big]))
        effects, spread, at = {big: d * (s.wz[big] - side @ first)}, {big: d + d * d * ((side @ inverse) * side).sum(1)}, q
        for k in rest:
            n = len(s.weight[k])
            effects[k], spread[k] = first[at : at + n], np.diag(inverse)[at : at + n]
            at += n
        new = [max(1e-4, float(np.mean((effects[k] ** 2 + spread[k])[seen[k]]))) if seen[k].any() else var[k] for k in range(g)]
        moved = max(abs(np.log(a / b)) for a, b in zip(new, var))
        var = new
        if moved < tolerance:
            break
    beta = np.zeros(len(s.rhs))
    beta[on] = first[:q] / scale
    return beta, [effects[k] for k in range(g)], var


class Levels:
    """Codes of the levels of each grouping; -1 for one that no training row has. Missing values are a level of their own."""

    def __init__(self, names: Sequence[Sequence[str]]):
        self.of = [{v: i for i, v in enumerate(n)} for n in names]

    def codes(self, t: Batch) -> list[np.ndarray]:
        return [coded(c, of, -1) for of, c in zip(self.of, t.more)]


def fit(f: Folded, groups: Sequence[Column], fill: np.ndarray, draw: Column, ratio: float | None = None, cap: int | None = None, rounds: int = 25, epsilon: float = 1e-9) -> tuple[dict[int, Fit], Levels]:
    """A fit for each fold (by place) that has both classes, and the codes of the levels.

    ``draw`` is a number in [0, 1) of each row; a row takes part in a fold where it is below its class's share there.
    """
    some = f.rows.where(F.size("__trains") > 0)
    names = [sorted(r[0] for r in some.select(F.coalesce(c.cast("string"), F.lit(""))).distinct().collect()) for c in groups]  # design data
    levels, sizes, p = Levels(names), [max(1, len(n)) for n in names], len(f.features) + 1
    width = layout(p, sizes)[1]
    if width > WIDTH:
        raise ValueError(f"{sizes} levels need {width} sums a fold, more than {WIDTH}")
    part = shares(f.positives, f.negatives, ratio, cap)
    extra = [*[c.cast("string") for c in groups], draw]
    fits = {k: Fit(np.zeros(p), [np.zeros(n) for n in sizes], [1.0] * len(sizes), 1.0) for k in f.trained}
    live, before, used = list(f.trained), {}, f.used
    for _ in range(rounds + 1):
        if not live:
            break
        now, at = list(live), {k: (fits[k].beta, fits[k].effects) for k in live}

        def work(t: Batch, out: np.ndarray, now=now, at=at) -> None:
            code, u = levels.codes(t), np.asarray(t.more[-1].to_numpy(zero_copy_only=False), float)
            for k in now:
                on = t.trains[:, k] & (u < np.where(t.y == 1, part[0][k], part[1][k]))
                x = np.column_stack([np.ones(on.sum()), np.where(np.isnan(t.x[on]), fill[k], t.x[on]) * (1 if used is None else used[k])])
                y, c, s = t.y[on], [v[on] for v in code], unpack(out[k], p, sizes)
                beta, effects = at[k]
                eta = np.clip(x @ beta + sum(e[v] for e, v in zip(effects, c)), -30, 30)
                mu = 1 / (1 + np.exp(-eta))
                w = np.maximum(mu * (1 - mu), 1e-10)
                z = w * eta + y - mu
                s.gram[...] += (x * w[:, None]).T @ x
                s.rhs[...] += x.T @ z
                out[k, p * p + p : p * p + p + 3] += [2 * (np.logaddexp(0, eta) - y * eta).sum(), (y == 1).sum(), (y != 1).sum()]
                for i, v in enumerate(c):
                    s.weight[i][...] += np.bincount(v, w, sizes[i])
                    s.wz[i][...] += np.bincount(v, z, sizes[i])
                    for j in range(p):
                        s.wx[i][:, j] += np.bincount(v, x[:, j] * w, sizes[i])
                for (a, b), m in s.cross.items():
                    m += np.bincount(c[a] * sizes[b] + c[b], w, sizes[a] * sizes[b]).reshape(m.shape)

        got = summed(f, work, width, extra)
        for k in now:
            s, old = unpack(got[k], p, sizes), fits[k]
            if not s.drawn.all():  # a draw without one of the classes
                fits.pop(k)
                live.remove(k)
                continue
            penalised = s.deviance + sum((e**2).sum() / v for e, v in zip(old.effects, old.variances))
            if abs(before.get(k, np.inf) - penalised) < epsilon * (abs(penalised) + 0.1):
                live.remove(k)
                continue
            before[k] = penalised
            prior = (s.drawn[1] / f.negatives[k]) / (s.drawn[0] / f.positives[k])
            fits[k] = Fit(*solve(s, independent(s.gram), old.variances), prior, (int(s.drawn[0]), int(s.drawn[1])))
    return fits, levels


def glmm(random: Sequence[str] = ("donor",), ratio: float | None = None, cap: int | None = None, seed: int = 1729, id: str = "read_id") -> Callable[[Folded, Sequence[str]], DataFrame]:
    """Scores of a logistic model with random intercepts by the columns ``random``.

    Levels without training rows (the held-out donor) get no effect; others, such as a species, get theirs. All
    training rows are used unless ``ratio`` asks for so many negatives a positive or ``cap`` bounds the rows; both are
    drawn by a hash of ``id``. Where the classes are drawn at different shares, their ratio is taken back from the
    intercept. Missing values get the median of all training rows; a missing level is a level.
    """

    def scores(f: Folded, keep: Sequence[str]) -> DataFrame:
        groups = [F.col(c) for c in random]
        fill = np.nan_to_num(medians(f)[0])
        fits, levels = fit(f, groups, fill, uniform(seed, F.col(id)), ratio, cap)
        slim = [c.cast("string") for c in groups]

        def score(t: Batch) -> np.ndarray:
            out, code = np.full((len(t.y), len(fill)), np.nan), levels.codes(t)
            for k, m in fits.items():
                on = t.tests[:, k]
                x = np.where(np.isnan(t.x[on]), fill[k], t.x[on])
                eta = m.beta[0] + np.log(m.prior) + x @ m.beta[1:]
                for e, v in zip(m.effects, code):
                    eta = eta + np.append(e, 0.0)[v[on]]  # -1 is the last place
                out[on, k] = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            return out

        lost = replace(f, positives=np.array([float(k in fits) for k in range(len(f.folds))]), negatives=np.ones(len(f.folds)))
        return scored(f, keep, score, missing_classes(lost), slim)

    return scores
