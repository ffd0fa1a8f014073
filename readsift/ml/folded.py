"""Models fitted for all folds at once: a row is read once a pass and counts for every fold it trains.

A table for this has ``trains`` and ``tests``, the numbers of the folds in which a row takes part, ``unit``
(rows of a unit share their weight in a fold) and the features as an array ``x``. Folds, units and features
are design data: counts, medians and coefficients of all folds are small and held by the driver. What
leaves a task is one row of sums a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from ..session import scratch

#: Sums of one task for one fold.
SUMS = "k int, v array<double>"


def loeo(table: DataFrame, donor: str = "donor") -> DataFrame:
    """Add ``trains`` and ``tests``: fold i tests the i-th donor and trains on the others. Rows without a donor go."""
    names = [r[0] for r in table.where(F.col(donor).isNotNull()).select(donor).distinct().orderBy(donor).collect()]  # a handful
    i = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(donor)).cast("int") if names else F.lit(0)
    all_ = F.array(*[F.lit(k + 1) for k in range(len(names))]).cast("array<int>")
    return table.where(F.col(donor).isNotNull()).select("*", F.filter(all_, lambda k: k != i).alias("trains"), F.array(i).alias("tests"))


@dataclass
class Folded:
    """``rows`` (a written table), and for each of ``folds``: weight of a row by unit, counts of both classes.

    ``same`` is the place of the first fold with the same training rows; ``used`` names the features of a fold (None: all of them).
    """

    rows: DataFrame
    features: list[str]
    folds: list[int]
    units: list[str]
    weight: np.ndarray  # folds x units
    negatives: np.ndarray
    positives: np.ndarray
    same: list[int] | None = None
    used: np.ndarray | None = None  # folds x features
    middle: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False, compare=False)  # medians, once made

    @property
    def trained(self) -> list[int]:
        """Places of the folds that have both classes to train on."""
        return [i for i in range(len(self.folds)) if self.positives[i] and self.negatives[i]]


def prepare(table: DataFrame, features: Sequence[str], keep: Sequence[str], unit: str = "donor", used: Mapping[int, Sequence[str]] | None = None) -> Folded:
    """``table`` has y, ``trains``, ``tests``, ``unit`` and the features. Rows with neither part go; rows without a label do not train.

    ``used`` has the features of each fold where folds differ in them.
    """
    x = F.array(*[F.when(~F.isnan(v), v) for v in (F.col(f).cast("double") for f in features)])
    trains = F.when(F.col("y").isNotNull(), F.col("trains")).otherwise(F.array().cast("array<int>"))
    d = table.select(*keep, F.col("y").cast("double").alias("__y"), F.col(unit).cast("string").alias("__unit"), trains.alias("__trains"), F.col("tests").alias("__tests"), x.alias("__x"))
    path = scratch(table.sparkSession)
    d.write.parquet(path)
    d = table.sparkSession.read.schema(d.schema).parquet(path)
    # Rows of the same folds are counted before they are copied to each fold; training and tests in one pass.
    alike = d.groupBy("__unit", "__trains", "__tests").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__y") == 1).alias("p"))
    part = lambda c, on: F.transform(F.coalesce(c, F.array().cast("array<int>")), lambda k: F.struct(k.alias("k"), F.lit(on).alias("on")))
    each = alike.select("__unit", "n", "p", F.xxhash64("__trains", "__tests").alias("h"), F.explode(F.concat(part("__trains", True), part("__tests", False))).alias("s"))
    got = each.groupBy("s.k", "s.on", "__unit").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.bit_xor("h").alias("h")).collect()  # folds x units
    n = [r for r in got if r.on]
    folds = sorted({r.k for r in got})
    units = sorted({r["__unit"] or "" for r in n})
    count, pos, rows = np.zeros((len(folds), max(1, len(units)))), np.zeros(len(folds)), [[] for _ in folds]
    for r in n:
        i = folds.index(r.k)
        count[i, units.index(r["__unit"] or "")] += r.n
        pos[i] += r.p
        rows[i].append((r["__unit"] is None, r["__unit"] or "", r.n, r.p, r.h))
    rows = [sorted(r) for r in rows]
    whole = count.sum(1)
    weight = np.divide(whole[:, None], (count > 0).sum(1)[:, None] * count, out=np.zeros_like(count), where=count > 0)
    mask = None if used is None else np.array([[f in used[k] for f in features] for k in folds], bool).reshape(len(folds), len(features))
    return Folded(d, list(features), folds, units, weight, whole - pos, pos, [rows.index(r) for r in rows], mask)


class Batch:
    """One Arrow batch as arrays: x (NaN where null), y, unit, and which folds each row trains or is tested in."""

    def __init__(self, b: pa.RecordBatch, f: Folded, at: int):
        y, unit, trains, tests, x = (b.column(at + i) for i in range(5))
        self.more = [b.column(i) for i in range(at + 5, b.num_columns)]
        n = b.num_rows
        self.x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), float).reshape(n, len(f.features))
        self.y = np.asarray(y.to_numpy(zero_copy_only=False), float)
        place = {u: i for i, u in enumerate(f.units)}
        self.unit = coded(unit, place, 0)
        self.trains, self.tests = self._member(trains, f.folds, n), self._member(tests, f.folds, n)

    @staticmethod
    def _member(lists: pa.ListArray, folds: list[int], n: int) -> np.ndarray:
        out = np.zeros((n, len(folds)), bool)
        flat = np.asarray(lists.flatten())
        row = np.repeat(np.arange(n), np.asarray(lists.value_lengths().fill_null(0)))
        if len(flat):
            out[row, np.searchsorted(folds, flat)] = True
        return out


def coded(values: pa.Array, place: Mapping[str, int], other: int) -> np.ndarray:
    """The number of each text (a null is the empty one), ``other`` where it has none; texts are looked up once a batch."""
    d = values.dictionary_encode()
    numbers = np.array([*[place.get(u or "", other) for u in d.dictionary.to_pylist()], place.get("", other)], np.int64)
    return numbers[np.asarray(d.indices.fill_null(len(numbers) - 1))]


PLAIN = ["__y", "__unit", "__trains", "__tests", "__x"]


def summed(f: Folded, work: Callable[[Batch, np.ndarray], None], width: int, extra: Sequence[Column] = ()) -> np.ndarray:
    """folds x ``width`` sums over all rows; ``work`` adds a batch, with ``extra`` as its ``more``, to a task's own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros((len(slim.folds), width))
        for b in batches:
            work(Batch(b, slim, 0), v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], ["k", "v"])

    rows, slim = f.rows.select(*PLAIN, *[c.alias(f"__e{i}") for i, c in enumerate(extra)]), replace(f, rows=None)
    out = np.zeros((len(f.folds), width))
    got = rows.mapInArrow(run, SUMS).select("k", F.posexplode("v").alias("i", "x")).where("x <> 0").groupBy("k", "i").agg(F.sum("x").alias("x")).toArrow()
    out[got["k"].to_numpy(), got["i"].to_numpy()] = got["x"].to_numpy()
    return out


def scored(f: Folded, keep: Sequence[str], score: Callable[[Batch], np.ndarray], failed: dict[int, str] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """A row for each fold a row is tested in: keep, fold, score, error. ``score`` gives rows x folds."""
    slim = replace(f, rows=None)
    rows, n = f.rows.select(*keep, *PLAIN, *[c.alias(f"__e{i}") for i, c in enumerate(extra)]), len(keep)
    schema = f.rows.select(*keep, F.lit(0).alias("fold"), F.lit(0.0).alias("score"), F.lit("").alias("error")).schema
    schema["score"].nullable = schema["error"].nullable = True
    failed = failed or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = Batch(b, slim, n)
            s = score(t)
            row, k = np.nonzero(t.tests)
            fold = np.array(slim.folds, np.int32)[k]
            value, error = s[row, k], [failed.get(int(x)) for x in fold]
            value = np.where([e is not None for e in error], np.nan, value) if failed else value
            cols = [c.take(pa.array(row)) for c in b.columns[:n]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fold, pa.int32()), pa.array(value, mask=np.isnan(value)), pa.array(error, pa.string())], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def medians(f: Folded) -> tuple[np.ndarray, np.ndarray]:
    """(median, number of different values) of each fold's training rows: folds x features; a median is NaN without values.

    Equal values are counted first, for all folds in one aggregation, and put in one global order. Folds with the same
    training rows share theirs, and so do families that fit the same ``f``.
    """
    if not f.folds:
        return np.zeros((0, len(f.features))), np.zeros((0, len(f.features)), int)
    if f.middle is not None:
        return f.middle
    same = list(range(len(f.folds))) if f.same is None else f.same
    first = sorted(set(same))
    long = f.rows.select("__trains", F.posexplode("__x").alias("j", "v")).where("v is not null")
    counts = long.groupBy("j", "v").agg(*[F.count_if(F.array_contains("__trains", f.folds[i])).alias(f"n{i}") for i in first])
    r = running(counts, ["j"], [F.col("v")], {f"c{i}": F.col(f"n{i}") for i in first})

    def at(i: int, place: Column) -> Column:
        return F.max(F.when((place < F.col(f"c{i}")) & (place >= F.col(f"c{i}") - F.col(f"n{i}")), F.col("v")))

    each = []
    for i in first:
        h = (F.col(f"c{i}_all") - 1) / 2
        each += [((at(i, F.floor(h)) + at(i, F.ceil(h))) / 2).alias(f"m{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}")]
    med, values = np.full((len(f.folds), len(f.features)), np.nan), np.zeros((len(f.folds), len(f.features)), int)
    for row in r.groupBy("j").agg(*each).collect():  # a row a feature
        for i, k in enumerate(same):
            med[i, row.j] = np.nan if row[f"m{k}"] is None else row[f"m{k}"]
            values[i, row.j] = row[f"d{k}"]
    f.middle = med, values
    return f.middle


def independent(gram: np.ndarray, tolerance: float = 1e-11) -> np.ndarray:
    """Places of the columns that no combination of the columns before them gives, by elimination on their scaled products."""
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    a = gram / np.outer(np.where(scale > 0, scale, 1), np.where(scale > 0, scale, 1))
    keep = []
    for j in range(len(a)):
        if scale[j] > 0 and a[j, j] > tolerance:
            keep.append(j)
            a = a - np.outer(a[:, j], a[j]) / a[j, j]
    return np.array(keep, int)


def logistic(f: Folded, fill: np.ndarray, chosen: np.ndarray | None = None, weighted: bool = True, rounds: int = 25, epsilon: float = 1e-8) -> np.ndarray:
    """Coefficients (intercept first) of a logistic regression for each fold, by iteratively reweighted least squares.

    One aggregation a round gives X'WX and X'Wz of all folds that have not converged. ``fill`` (folds x features)
    replaces missing values; ``chosen`` (folds x features) names the columns of a fold. A column that depends on
    those before it gets no coefficient. Folds without both classes have NaN.
    """
    p = len(f.features) + 1
    beta, before = np.zeros((len(f.folds), p)), np.full(len(f.folds), np.inf)
    beta[[i for i in range(len(f.folds)) if i not in f.trained]] = np.nan
    live, weights = list(f.trained), f.weight if weighted else np.ones_like(f.weight)
    use = np.column_stack([np.ones(len(f.folds), bool), np.ones((len(f.folds), p - 1), bool) if chosen is None else chosen])
    for _ in range(rounds + 1):
        if not live:
            break
        now, b = list(live), beta.copy()

        def work(t: Batch, out: np.ndarray, now=now, b=b) -> None:
            for k in now:
                on = t.trains[:, k]
                x = np.column_stack([np.ones(on.sum()), np.where(np.isnan(t.x[on]), fill[k], t.x[on])]) * use[k]
                y, w = t.y[on], weights[k, t.unit[on]]
                eta = np.clip(x @ b[k], -30, 30)
                mu = 1 / (1 + np.exp(-eta))
                v = w * np.maximum(mu * (1 - mu), 1e-10)
                out[k, : p * p] += ((x * v[:, None]).T @ x).ravel()
                out[k, p * p : -1] += x.T @ (v * eta + w * (y - mu))
                out[k, -1] += 2 * (w * (np.logaddexp(0, eta) - y * eta)).sum()

        s = summed(f, work, p * p + p + 1)
        for k in now:
            gram, rhs, deviance = s[k, : p * p].reshape(p, p), s[k, p * p : -1], s[k, -1]
            if abs(before[k] - deviance) < epsilon * (abs(deviance) + 0.1):
                live.remove(k)
                continue
            before[k] = deviance
            on = independent(gram)
            scale = np.sqrt(np.diag(gram)[on])
            beta[k] = 0
            beta[k, on] = np.linalg.solve(gram[np.ix_(on, on)] / np.outer(scale, scale), rhs[on] / scale) / scale
    return beta


def probability(beta: np.ndarray, fill: np.ndarray) -> Callable[[Batch], np.ndarray]:
    def score(t: Batch) -> np.ndarray:
        out = np.full((len(t.y), len(beta)), np.nan)
        for k in range(len(beta)):
            on = t.tests[:, k]
            x = np.where(np.isnan(t.x[on]), fill[k], t.x[on])
            out[on, k] = 1 / (1 + np.exp(-np.clip(beta[k, 0] + x @ beta[k, 1:], -700, 700)))
        return out

    return score


def missing_classes(f: Folded) -> dict[int, str]:
    return {f.folds[i]: "training rows of one class only" for i in range(len(f.folds)) if i not in f.trained}


def glm(f: Folded, keep: Sequence[str], weighted: bool = True) -> DataFrame:
    """Logistic regression with weights of equal units (or none); missing values get the train median."""
    med = np.nan_to_num(medians(f)[0])
    return scored(f, keep, probability(logistic(f, med, f.used, weighted=weighted), med), missing_classes(f))


def best_features(f: Folded, ties: str, med: np.ndarray, values: np.ndarray) -> DataFrame:
    """(fold, feature, sign, auprc) of every candidate: average precision on the train rows, missing ones at the train median.

    A row is copied once a feature and sign, for all folds; only missing values, whose median differs, once a fold too.
    """
    fill = F.array(*[F.array(*[F.lit(None if np.isnan(v) else float(v)).cast("double") for v in m]) for m in med])
    d = f.rows.select(F.col(ties).alias("t"), "__y", "__trains", F.posexplode("__x").alias("j", "v")).where(F.size("__trains") > 0)
    known = d.where("v is not null").select("t", "__y", "__trains", "j", "v")
    each = d.where("v is null").select("t", "__y", F.explode("__trains").alias("k"), "j")
    place = F.array_position(F.array(*[F.lit(k) for k in f.folds]), F.col("k")).cast("int")
    imputed = each.select("t", "__y", F.array("k").alias("__trains"), "j", F.element_at(F.element_at(fill, place), F.col("j") + 1).alias("v")).where("v is not null")
    both = known.unionByName(imputed).select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")).withColumn("v", F.col("v") * F.col("sign"))
    inside = {i: F.array_contains("__trains", k) for i, k in enumerate(f.folds)}
    sums = {f"p{i}": on & (F.col("__y") == 1) for i, on in inside.items()} | {f"n{i}": on for i, on in inside.items()}
    r = running(both, ["j", "sign"], [F.desc("v"), F.col("t")], sums)
    ap = r.groupBy("j", "sign").agg(*[(F.sum(F.when(on & (F.col("__y") == 1), F.col(f"p{i}") / F.col(f"n{i}"))) / F.max(f"p{i}_all")).alias(f"a{i}") for i, on in inside.items()])
    several = F.array(*[F.array(*[F.lit(bool(v >= 2 and i in f.trained and (f.used is None or f.used[i, j]))) for j, v in enumerate(row)]) for i, row in enumerate(values)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(i).alias("i"), F.col(f"a{i}").alias("auprc")) for i, k in enumerate(f.folds)]))
    out = ap.select("j", "sign", rows.alias("r")).select("r.fold", "r.i", "j", "sign", "r.auprc").where(F.element_at(F.element_at(several, F.col("i") + 1), F.col("j") + 1))
    name = F.element_at(F.array(*[F.lit(n) for n in f.features]), F.col("j") + 1)
    return out.where("auprc is not null").select("fold", name.alias("feature"), "j", "sign", "auprc")


def chosen_features(f: Folded, ties: str, med: np.ndarray, values: np.ndarray) -> DataFrame:
    """(fold, feature, j, sign, auprc): the best candidate of each fold; of equals the first feature, the positive sign."""
    best = best_features(f, ties, med, values)
    top = F.max_by(F.struct("feature", "j", "sign", "auprc"), F.struct("auprc", -F.col("j"), "sign")).alias("b")
    return best.groupBy("fold").agg(top).select("fold", "b.*")


def fixed_threshold(f: Folded, keep: Sequence[str], ties: str = "read_id") -> DataFrame:
    """The feature and sign with the best train average precision, made a probability by a logistic fit without weights.

    Features with fewer than two values in training are skipped. Without any the score is 0.5; where the logistic
    fit fails, scores run from 0 to 1 over the range of all values that train or test the fold.
    """
    med, values = medians(f)
    best = {r.fold: r for r in chosen_features(f, ties, med, values).collect()}  # a row a fold
    chosen = np.zeros((len(f.folds), len(f.features)), bool)
    sign = np.ones(len(f.folds))
    for i, k in enumerate(f.folds):
        if k in best:
            chosen[i, best[k].j], sign[i] = True, best[k].sign
    fill = np.nan_to_num(med)
    beta = logistic(f, fill, chosen, weighted=False)
    calibrated = probability(beta, fill)
    odd = [i for i in range(len(f.folds)) if f.folds[i] in best and not np.isfinite(beta[i]).all()]
    span = ranges(f, chosen, sign, fill) if odd else None

    def score(t: Batch) -> np.ndarray:
        out = calibrated(t)
        for i in range(len(chosen)):
            on = t.tests[:, i]
            if not chosen[i].any():
                out[on, i] = 0.5
            elif i in odd:
                j = int(np.flatnonzero(chosen[i])[0])
                v = sign[i] * np.where(np.isnan(t.x[on, j]), fill[i, j], t.x[on, j])
                out[on, i] = (v - span[i, 0]) / max(span[i, 1] - span[i, 0], 1e-9)
        return out

    return scored(f, keep, score)


def ranges(f: Folded, chosen: np.ndarray, sign: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """folds x (least, largest) of the signed chosen feature over all rows that train or test the fold."""
    each = []
    for i, k in enumerate(f.folds):
        j = int(np.argmax(chosen[i]))
        v = F.lit(float(sign[i])) * F.coalesce(F.col("__x")[j], F.lit(float(fill[i, j])))
        v = F.when(F.array_contains("__trains", k) | F.array_contains("__tests", k), v)
        each += [F.min(v), F.max(v)]
    return np.array([0.0 if v is None else v for v in f.rows.agg(*each).first()]).reshape(-1, 2)
