"""Histogram gradient boosting of all folds at once, with class weight and missing values.

Features become bins: the edges are values of the features over all rows (no labels), at equal counts, or
every value where there are few. A tree grows level by level. One aggregation a level gives the sums of
gradients and curvatures by (fold, node, feature, bin), one shuffle brings those of a node together, and
running sums over the bins give the gain of each split, tried with the missing values on either side; the
driver gets the best one of each node. Positives weigh ``negatives / positives`` of the fold's training rows, beside the equal weight of
units.

Rows keep their margins (one a fold) in a written table, which is renewed every ``EVERY`` trees; younger trees
are walked again. So a pass costs the rows times the folds, whatever the number of trees so far, and a lost
executor is a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from ..session import scratch
from .folded import PLAIN, Batch, Folded, missing_classes, scored

#: Trees between two writings of the margins.
EVERY = 20
SPLITS = "k int, node int, g double, h double, f int, b int, miss_left boolean, gain double, g_left double, h_left double, n_left double, g_right double, h_right double, n_right double"
_SPLITS = pa.schema([(c.split(" ")[0], {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[c.split(" ")[1]]) for c in SPLITS.split(", ")])


@dataclass(frozen=True)
class Boost:
    depth: int = 6
    rate: float = 0.1
    rounds: int = 300
    bins: int = 256
    ridge: float = 1.0
    least_curvature: float = 1.0
    balanced: bool = True


def edges(f: Folded, bins: int = 256) -> list[np.ndarray]:
    """Each feature's edges, ascending: bin i holds values above edge i - 1 up to edge i. At most ``bins`` a feature."""
    long = f.rows.select(F.posexplode("__x").alias("j", "v")).where("v is not null")
    r = running(long.groupBy("j", "v").agg(F.count(F.lit(1)).alias("n")), ["j"], [F.col("v")], {"c": F.col("n"), "r": F.lit(1)})
    b = F.when(F.col("r_all") <= bins, F.col("r")).otherwise(F.floor((F.col("c") - 1) * bins / F.col("c_all")))
    got = r.groupBy("j", b.alias("b")).agg(F.max("v").alias("v")).collect()  # at most features x bins
    return [np.array(sorted(x.v for x in got if x.j == j)) for j in range(len(f.features))]


@dataclass
class Tree:
    """Nodes by place: the children of i are 2i + 1 (left) and 2i + 2; a node without a feature is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    left_if_missing: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n))

    def walk(self, code: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row (bins, -1 for missing) reaches within ``depth`` steps."""
        at, row = np.zeros(len(code), int), np.arange(len(code))
        for _ in range(depth):
            j = self.feature[at]
            on = j >= 0
            c = code[row, np.maximum(j, 0)]
            left = np.where(c < 0, self.left_if_missing[at], c <= self.bin[at])
            at = np.where(on, 2 * at + 2 - left, at)
        return at


@dataclass
class Forest:
    """The trees of each fold, so far; a fold that is done gets no more."""

    edges: list[np.ndarray]
    depth: int
    trees: list[list[Tree]] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)
        return np.where(np.isnan(x), -1, out)

    def since(self, number: int) -> Forest:
        return Forest(self.edges, self.depth, self.trees[number:])

    def add(self, margin: np.ndarray, code: np.ndarray) -> np.ndarray:
        """``margin`` (rows x folds) with all trees."""
        for trees in self.trees:
            for k, t in enumerate(trees):
                margin[:, k] += t.value[t.walk(code, self.depth)]
        return margin


def _weights(f: Folded, balanced: bool) -> np.ndarray:
    """folds x (negatives, positives)."""
    w = np.ones((len(f.folds), 2))
    if balanced:
        w[:, 1] = f.negatives / np.maximum(f.positives, 1)
    return w


def level_splits(f: Folded, rows: DataFrame, forest: Forest, growing: list[Tree], depth: int, folds: list[int], p: Boost) -> DataFrame:
    """The best split of each (k, node) of a level, from the rows that train each fold: see ``best_split``.

    ``forest`` has the trees that the rows' margins lack, ``growing`` the unfinished tree of each fold.
    A task sends one row of sums for each node it has rows of; a node's sums are added in the order of the
    tasks, so that the result does not depend on how they arrive.
    """
    slim = Folded(None, f.features, f.folds, f.units, f.weight, f.negatives, f.positives)
    classes, width = _weights(f, p.balanced), max([len(e) for e in forest.edges], default=0) + 1
    first, m = 2**depth - 1, len(f.features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, total = TaskContext.get().partitionId(), {}
        for b in batches:
            t = Batch(b, slim, 0)
            code = forest.codes(t.x)
            margin = np.asarray(b.column(len(PLAIN)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(t.y), -1).copy()
            forest.add(margin, code)
            for k in folds:
                at = growing[k].walk(code, depth)
                on = np.flatnonzero(t.trains[:, k] & (at >= first))
                if not len(on):
                    continue
                y = t.y[on]
                w = slim.weight[k, t.unit[on]] * classes[k, y.astype(int)]
                mu = 1 / (1 + np.exp(-margin[on, k]))
                names, node = np.unique(at[on], return_inverse=True)
                cell = ((node[:, None] * m + np.arange(m)) * width + code[on] + 1).ravel()
                each = [np.bincount(cell, np.repeat(v, m), len(names) * m * width).reshape(len(names), -1) for v in (w * (mu - y), w * mu * (1 - mu), np.ones(len(on)))]
                for i, name in enumerate(names.tolist()):
                    v = np.concatenate([e[i] for e in each])
                    total[k, name] = total[k, name] + v if (k, name) in total else v
        for (k, node), v in total.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (k, node, task)], pa.array([v], pa.list_(pa.float64()))], ["k", "node", "task", "v"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, found = None, None, []
        for b in batches:
            for k, node, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                v = np.asarray(v.values)
                if (k, node) != now:
                    if now is not None:
                        found.append({"k": now[0], "node": now[1], **best_split(total.reshape(3, m, width), p)})
                    now, total = (k, node), v.copy()
                else:
                    total += v
        if now is not None:
            found.append({"k": now[0], "node": now[1], **best_split(total.reshape(3, m, width), p)})
        yield pa.RecordBatch.from_pylist(found, schema=_SPLITS)

    each = rows.select(*PLAIN, "__margin").mapInArrow(sums, "k int, node int, task int, v array<double>")
    return each.repartition("k", "node").sortWithinPartitions("k", "node", "task").mapInArrow(best, SPLITS)


def best_split(sums: np.ndarray, p: Boost) -> dict:
    """The best split of a node whose gradients, curvatures and counts are ``sums`` (3 x features x bins, missing values first).

    A split sends bins up to b to the left; missing values are tried on both sides, and alone (b = -1). Of equal
    gains, the first feature, then the first bin, then missing values to the left. f is None where no split gains.
    """
    all_ = sums.sum(2, keepdims=True)
    up = np.cumsum(sums[:, :, 1:], 2)
    up = np.concatenate([np.zeros_like(all_), up], 2)  # bins -1, 0, 1, ...
    left = np.stack([up + sums[:, :, :1], up], 3)  # missing values left, right
    right = all_[..., None] - left
    part = lambda x: x[0] ** 2 / (x[1] + p.ridge)
    gain = np.round((part(left) + part(right) - part(all_[..., None])) / 2, 9)
    ok = (left[2] > 0) & (right[2] > 0) & (left[1] >= p.least_curvature) & (right[1] >= p.least_curvature) & (gain > 0)
    out = {"g": float(all_[0, 0, 0]), "h": float(all_[1, 0, 0])}
    if not ok.any():
        return out
    f, b, side = np.unravel_index(np.argmax(np.where(ok, gain, -np.inf)), gain.shape)
    out |= {"f": int(f), "b": int(b) - 1, "miss_left": bool(side == 0), "gain": float(gain[f, b, side])}
    return out | {f"{n}_{s}": float(x[i, f, b, side]) for s, x in (("left", left), ("right", right)) for i, n in enumerate("ghn")}


def fit(f: Folded, p: Boost = Boost()) -> Forest:
    """``rounds`` trees for each fold with both classes. Margins start at 0."""
    folds = f.trained
    forest = Forest(edges(f, p.bins), p.depth)
    start = F.array(*[F.lit(0.0) for _ in f.folds])
    rows, since = f.rows.select(*PLAIN, start.alias("__margin")), 0
    for r in range(p.rounds if folds and f.features else 0):
        if r - since >= EVERY:
            rows, since = _renewed(f, rows, forest.since(since)), r
        growing = [Tree.empty(p.depth) for _ in f.folds]
        for depth in range(p.depth):
            found = level_splits(f, rows, forest.since(since), growing, depth, folds, p).collect()  # a row a node
            for s in found:
                t = growing[s.k]
                t.value[s.node] = -p.rate * s.g / (s.h + p.ridge)
                if s.f is not None:
                    t.feature[s.node], t.bin[s.node], t.left_if_missing[s.node] = s.f, s.b, s.miss_left
                    t.value[2 * s.node + 1] = -p.rate * s.g_left / (s.h_left + p.ridge)
                    t.value[2 * s.node + 2] = -p.rate * s.g_right / (s.h_right + p.ridge)
            if all(s.f is None for s in found):
                break
        forest.trees.append(growing)
    return forest


def _renewed(f: Folded, rows: DataFrame, forest: Forest) -> DataFrame:
    """The rows with the trees of ``forest`` added to their margins, written."""
    slim = Folded(None, f.features, f.folds, f.units, f.weight, f.negatives, f.positives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Batch(b, slim, 0)
            margin = np.asarray(b.column(len(PLAIN)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(t.y), -1).copy()
            margin = forest.add(margin, forest.codes(t.x))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(margin), pa.list_(pa.float64()))], [*PLAIN, "__margin"])

    path = scratch(f.rows.sparkSession)
    rows.mapInArrow(run, rows.schema).write.parquet(path)
    return f.rows.sparkSession.read.schema(rows.schema).parquet(path)


def boosted(p: Boost = Boost()) -> Callable[[Folded, Sequence[str]], DataFrame]:
    """A family for all folds at once: missing values go to the side that each split has learned for them."""

    def run(f: Folded, keep: Sequence[str]) -> DataFrame:
        forest, folds = fit(f, p), len(f.folds)

        def score(t: Batch) -> np.ndarray:
            margin = forest.add(np.zeros((len(t.y), folds)), forest.codes(t.x))
            return 1 / (1 + np.exp(-margin))

        return scored(f, keep, score, missing_classes(f))

    return run

