"""Model families for grouped out-of-fold prediction: all folds at once (``Folds``), and forests on Spark ML.

Every model scores held-out donors only. A fold that fails is reported as a row with an error and
no score, not as silent nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import balance_weights
from ..operators.ranking import auprc
from . import boosting, folded, mixed_logistic

#: (max depth, learning rate, rounds) and (share of features, rows a leaf) that tuning tries (fixed values).
BOOST_GRID = tuple((d, e, r) for d in (4, 6) for e in (0.1, 0.3) for r in (200, 400))
FOREST_GRID = tuple((m, n) for m in (0.33, 0.66) for n in (5, 20))


class Folds:
    """A family that fits all folds at once; called as (train, test, features) it fits one. It reads the columns ``needs`` beside the features.

    With ``subsets`` it heeds ``Folded.used``: folds may differ in their features.
    """

    def __init__(self, scores: Callable[[folded.Folded, Sequence[str]], DataFrame], needs: Sequence[str] = (), subsets: bool = False):
        self.scores, self.needs, self.subsets = scores, tuple(needs), subsets

    def __call__(self, train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
        none, one = F.array().cast("array<int>"), F.array(F.lit(1))
        keep = [c for c in test.columns if c not in ("trains", "tests")]
        both = train.select(*keep, one.alias("trains"), none.alias("tests")).unionByName(test.select(*keep, none.alias("trains"), one.alias("tests")))
        return self.scores(folded.prepare(both, features, keep), keep)


fixed_threshold = Folds(folded.fixed_threshold, subsets=True)
glm = Folds(folded.glm, subsets=True)


def imputed(train: DataFrame, test: DataFrame, features: Sequence[str], indicators: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nulls become the train median (0 without one); ``indicators`` adds a 0/1 column for each feature.

    The medians are one row, read once.
    """
    med = train.agg(*[F.percentile(f, 0.5).alias(f) for f in features]).first()
    fill = {f: F.coalesce(F.col(f).cast("double"), F.lit(float(med[f]) if med[f] is not None else 0.0)) for f in features}
    miss = {f"{f}__na": F.col(f).isNull().cast("double") for f in features} if indicators else {}
    names = [*features, *miss]
    cols = {**miss, **fill}
    return train.withColumns(cols), test.withColumns(cols), names


def _spark(make: Callable, indicators: bool = False) -> Callable:
    def run(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
        a, b, names = imputed(train, test, features, indicators)
        pack = VectorAssembler(inputCols=names, outputCol="__x")
        model = make(len(names)).fit(pack.transform(a))
        return model.transform(pack.transform(b)).withColumn("score", vector_to_array("probability")[1])

    return run


def forest(trees: int = 500, share: float = 0.5, leaf: int = 10, seed: int = 1729) -> Callable:
    return _spark(lambda n: RandomForestClassifier(featuresCol="__x", labelCol="y", weightCol="weight", numTrees=trees, featureSubsetStrategy=str(max(1, round(share * n))), minInstancesPerNode=leaf, maxDepth=10, seed=seed))


def boosted(depth: int = 6, rate: float = 0.1, rounds: int = 300) -> Folds:
    """Histogram boosting with class weight; missing values take the side that each split has learned."""
    return Folds(boosting.boosted(boosting.Boost(depth, rate, rounds)))


def glmm(random: Sequence[str] = ("donor",), ratio: float | None = None, cap: int | None = None) -> Folds:
    """Logistic model with random intercepts by ``random``; see ``mixed_logistic.glmm``."""
    return Folds(mixed_logistic.glmm(random, ratio, cap), needs=random, subsets=True)


MODELS: dict[str, Callable] = {"fixed_threshold": fixed_threshold, "glm": glm, "random_forest": forest(), "boosted_trees": boosted(), "glmm": glmm()}


def out_of_fold(table: DataFrame, features: Sequence[str], model: str | Callable, donor: str = "donor", keep: Sequence[str] = ("read_id", "donor", "y")) -> DataFrame:
    """Scores of every donor by a model trained on the other donors, with equal weight for each donor.

    One model a donor is the definition of the scheme; donors are few.
    """
    fit = MODELS[model] if isinstance(model, str) else model
    if isinstance(fit, Folds):
        t = folded.loeo(table, donor)
        whole = [*keep, *[c for c in fit.needs if c not in keep]]
        return fit.scores(folded.prepare(t, features, whole, donor), keep).select(*keep, "fold", "score", "error")
    # Features and keys only: each fit and each scoring reads these, not what they were made of.
    table = table.select(*dict.fromkeys([*keep, donor, "y", *features])).persist()
    donors = [r[0] for r in table.select(donor).distinct().orderBy(donor).collect()]
    parts = []
    for i, d in enumerate(donors, 1):
        train = balance_weights(table.where(F.col(donor) != d), [donor])
        test = table.where(F.col(donor) == d)
        try:
            got = fit(train, test, features).select(*keep, F.lit(i).alias("fold"), F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("error"))
        except Exception as e:  # noqa: BLE001  the fold is reported, the others go on
            got = test.select(*keep, F.lit(i).alias("fold"), F.lit(None).cast("double").alias("score"), F.lit(str(e)[:200]).alias("error"))
        parts.append(got)
    return reduce(DataFrame.unionByName, parts)


#: A donor that is held out (None: none is), and the inner groups of the donors that are left.
Outer = tuple[str | None, Sequence[Sequence[str]]]


def numbered(on: Sequence[Column]) -> Column:
    """The numbers, from 1, of the conditions that a row meets."""
    return F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(on, 1)])).cast("array<int>")


def inner_scores(table: DataFrame, features: Sequence[str], families: Mapping[str, Callable], outer: Sequence[Outer], donor: str = "donor") -> dict[str, list[float | None]]:
    """Mean average precision over inner donor folds, of each family and for each of ``outer``; a held-out donor is never touched.

    Families of the kind ``Folds`` fit the inner folds of all of ``outer`` in the same passes over one table, and one ranking
    gives their metrics; others fit one inner fold after the other.
    """
    splits = [(i, d, held) for i, (d, groups) in enumerate(outer) for held in groups]
    got: dict[str, list[list[float]]] = {m: [[] for _ in outer] for m in families}
    left = lambda d: F.col(donor) != d if d is not None else F.col(donor).isNotNull()
    whole = {m: f for m, f in families.items() if isinstance(f, Folds)}
    if whole and splits:
        trains, tests = [left(d) & ~F.col(donor).isin(*held) for _, d, held in splits], [left(d) & F.col(donor).isin(*held) for _, d, held in splits]
        keep = list(dict.fromkeys(["read_id", "y", *[c for f in whole.values() for c in f.needs]]))
        f = folded.prepare(table.where(F.col(donor).isNotNull()).withColumns({"trains": numbered(trains), "tests": numbered(tests)}), features, keep, donor)
        each = [fit.scores(f, ["read_id", "y"]).select("read_id", "y", "fold", "score", F.lit(m).alias("model")) for m, fit in whole.items()]
        found = {(r.model, r.fold): r.auprc for r in auprc(reduce(DataFrame.unionByName, each), ["model", "fold"], "y", "score", ["read_id"]).collect()}  # a row a fit
        for m in whole:
            for k, (i, _, _) in enumerate(splits, 1):
                if found.get((m, k)) is not None:
                    got[m][i].append(found[m, k])
    for m, fit in families.items():
        for i, d, held in splits if m not in whole else []:
            train = table.where(left(d))
            a, b = train.where(~F.col(donor).isin(*held)), train.where(F.col(donor).isin(*held))
            s = auprc(fit(balance_weights(a, [donor]), b, features), [], "y", "score", ["read_id"]).first()
            if s is not None and s.auprc is not None:
                got[m][i].append(s.auprc)
    return {m: [sum(v) / len(v) if v else None for v in by] for m, by in got.items()}


def inner_score(train: DataFrame, features: Sequence[str], model: str | Callable, inner: Sequence[Sequence[str]], donor: str = "donor") -> float | None:
    """Mean average precision over inner donor folds; touches training donors only."""
    return inner_scores(train, features, {"": MODELS[model] if isinstance(model, str) else model}, [(None, inner)], donor)[""][0]


def tune(train: DataFrame, features: Sequence[str], candidates: Sequence[Callable], inner: Sequence[Sequence[str]]) -> Callable:
    """The candidate with the best inner score; the first of equals."""
    by = inner_scores(train, features, {str(i): c for i, c in enumerate(candidates)}, [(None, inner)])
    scored = [(by[str(i)][0], c) for i, c in enumerate(candidates)]
    best = max((s for s, _ in scored if s is not None), default=None)
    return next((c for s, c in scored if s == best), candidates[0])
