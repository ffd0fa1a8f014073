"""Model runs: predictions of every arm, model and fold from a feature table.

The table has read_id, donor, titration_level, species, label, end_reason_unblock and the features.
Ambiguous and indeterminate rows take no part. Arms, models, donors and held-out taxa are design
data, so the loops over them are few. Families of the kind ``models.Folds`` fit all their parts (arms, ablations,
held-out donors and taxa) in the same passes over one table; others fit part by part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import balance_weights, fold_table, inner_of, loto_folds, loto_masks
from . import folded, models, store

KEEP = ("read_id", "donor", "titration_level", "species", "y", "end_reason_unblock")
#: A model, or the candidates among which the inner folds choose.
Family = Callable | Sequence[Callable]


def usable(table: DataFrame) -> DataFrame:
    """Positive and negative rows with y."""
    return table.where(F.col("label").isin("positive", "negative")).withColumn("y", (F.col("label") == "positive").cast("double"))


def ablated(features: Sequence[str], blocks: Mapping[str, Sequence[str]], drop: Sequence[str]) -> list[str]:
    """The features without those of the blocks ``drop``."""
    gone = {f for b in drop for f in blocks[b]}
    return [f for f in features if f not in gone]


def one_fold(train: DataFrame, test: DataFrame, features: Sequence[str], family: Family, inner: Sequence[Sequence[str]], **names) -> DataFrame:
    """Scores of ``test`` with its names; a fit that fails gives its rows with the error and no score."""
    score, error = F.lit(None).cast("double"), F.lit(None).cast("string")
    train = balance_weights(train, ["donor"])
    try:
        fit = family if callable(family) else models.tune(train, features, family, inner)
        got = fit(train, test, features)
        score = F.col("score").cast("double")
    except Exception as e:  # noqa: BLE001  the fold is reported, the others go on
        got, error = test, F.lit(str(e)[:200])
    return got.select(*KEEP, *[F.lit(v).alias(k) for k, v in names.items()], score.alias("score"), error.alias("error"))


def _inner(t: DataFrame, families, k: int, seed: int, folds: DataFrame | None) -> dict:
    """Inner groups of each fold where a family has candidates to choose from; else none are needed."""
    if all(callable(f) for f in families):
        return {}
    return inner_of(fold_table(t, k, seed) if folds is None else folds)


def donors_of(table: DataFrame) -> list[str]:
    return [r[0] for r in table.select("donor").where("donor is not null").distinct().orderBy("donor").collect()]  # a handful


@dataclass
class Part:
    """One fit of a run: its names, its features, and the rows that train and test it."""

    arm: str
    model: str
    scheme: str
    fold: int
    features: Sequence[str]
    trains: Column
    tests: Column

    @property
    def names(self) -> dict[str, str | int]:
        return {"arm": self.arm, "model": self.model, "scheme": self.scheme, "fold": self.fold}


def at_once(t: DataFrame, parts: Sequence[Part], families: Mapping[str, models.Folds], inner: Mapping) -> Iterator[DataFrame]:
    """Predictions of ``parts``, which all ``families`` fit: one table, and one set of passes a family.

    Where such a fit fails, the parts are fitted one by one, so that only those that fail have no scores.
    """
    try:
        t = t.withColumns({"trains": models.numbered([p.trains for p in parts]), "tests": models.numbered([p.tests for p in parts])})
        keep = list(dict.fromkeys([*KEEP, *[c for fit in families.values() for c in fit.needs]]))
        names = list(dict.fromkeys(c for p in parts for c in p.features))
        alike = all(list(p.features) == names for p in parts)
        f = folded.prepare(t, names, keep, used=None if alike else {i: p.features for i, p in enumerate(parts, 1)})
    except Exception:  # noqa: BLE001  each part is tried by itself
        f = None
    which = F.element_at(F.array(*[F.struct(F.lit(p.arm).alias("arm"), F.lit(p.scheme).alias("scheme"), F.lit(p.fold).alias("fold")) for p in parts]), F.col("fold"))
    for m, fit in families.items():
        try:
            d = None if f is None else fit.scores(f, KEEP)
        except Exception:  # noqa: BLE001
            d = None
        if d is not None:
            yield d.withColumn("__p", which).select(*KEEP, "__p.arm", F.lit(m).alias("model"), "__p.scheme", "__p.fold", "score", "error")
            continue
        for p in parts:
            yield one_fold(t.where(p.trains), t.where(p.tests), p.features, fit, inner.get((p.scheme, p.fold), []), **(p.names | {"model": m}))


def predictions(t: DataFrame, parts: Sequence[Part], families: Mapping[str, Family], inner: Mapping) -> Iterator[DataFrame]:
    """Predictions of all parts, in pieces as they are made; no piece is made before it is asked for."""
    together: dict[tuple, tuple[list[Part], dict[str, models.Folds]]] = {}
    for m, fit in families.items():
        mine = [p for p in parts if p.model == m]
        if not isinstance(fit, models.Folds):
            for p in mine:
                yield one_fold(t.where(p.trains), t.where(p.tests), p.features, fit, inner.get((p.scheme, p.fold), []), **p.names)
            continue
        for features in [None] if fit.subsets else dict.fromkeys(tuple(p.features) for p in mine):
            some = [p for p in mine if features is None or tuple(p.features) == features]
            if some:  # families that fit the same parts share a table
                together.setdefault(tuple((p.arm, p.scheme, p.fold, tuple(p.features)) for p in some), (some, {}))[1][m] = fit
    for some, fits in together.values():
        yield from at_once(t, some, fits, inner)


def donor_parts(donors: Sequence[str], arms: Mapping[str, Sequence[str]], family: Iterable[str]) -> list[Part]:
    """Every arm and family for each held-out donor (scheme LOEO)."""
    return [Part(arm, m, "LOEO", i, features, F.col("donor") != d, F.col("donor") == d) for arm, features in arms.items() for i, d in enumerate(donors, 1) for m in family]


def taxon_parts(t: DataFrame, donors: Sequence[str], arm: str, features: Sequence[str], model: str) -> list[Part]:
    """Each taxon of the positives, held out together with half of the donors (scheme LOTO).

    A taxon whose part lacks positives or negatives in training or test has no fold. That is found from the kinds of rows
    (donor, taxon, label), not from a copy of every row for each taxon.
    """
    kinds = t.select("donor", "species", "label", "y").distinct()
    masked = loto_masks(kinds, loto_folds(kinds, kinds.where("y = 1")), kinds)
    whole = masked.groupBy("fold", "test_species").agg(*[F.count(F.when((F.col("part") == p) & (F.col("y") == v), 1)).alias(f"n{p}{v}") for p in ("train", "test") for v in (0, 1)])
    good = whole.where("ntrain0 > 0 and ntrain1 > 0 and ntest0 > 0 and ntest1 > 0").select("fold", "test_species").orderBy("fold").collect()  # one a taxon
    negative, out = F.col("label") == "negative", []
    for i, taxon in good:
        tested = [d for k, d in enumerate(donors, 1) if k % 2 == i % 2 or len(donors) == 1]
        test, held = F.col("donor").isin(*tested), F.col("species") == F.lit(taxon)
        out.append(Part(arm, model, "LOTO", i, features, ~test & (negative | ~held), test & (negative | held)))
    return out


def leave_one_donor_out(table: DataFrame, arms: Mapping[str, Sequence[str]], families: Mapping[str, Family], k: int = 3, seed: int = 1729, folds: DataFrame | None = None) -> DataFrame:
    """Predictions of every arm and family for each held-out donor (scheme LOEO).

    Families with candidates are tuned over the inner groups of ``folds`` (see ``fold_table``), made here if not given.
    """
    t = usable(table)
    return reduce(DataFrame.unionByName, predictions(t, donor_parts(donors_of(t), arms, families), families, _inner(t, families.values(), k, seed, folds)))


def leave_one_taxon_out(table: DataFrame, arm: str, features: Sequence[str], model: str, family: Family, k: int = 3, seed: int = 1729, folds: DataFrame | None = None) -> DataFrame | None:
    """Predictions for each taxon of the positives, held out together with half of the donors (see ``taxon_parts``); None without any."""
    t = usable(table)
    made = list(predictions(t, taxon_parts(t, donors_of(t), arm, features, model), {model: family}, _inner(t, [family], k, seed, folds)))
    return reduce(DataFrame.unionByName, made) if made else None


def inner_scores(table: DataFrame, arm: str, features: Sequence[str], families: Mapping[str, Callable], k: int = 3, seed: int = 1729, folds: DataFrame | None = None) -> DataFrame:
    """(arm, model, fold, inner_auprc) of each family over inner donor folds; never sees the held-out donor."""
    t = usable(table)
    donors, inner = donors_of(t), inner_of(fold_table(t, k, seed) if folds is None else folds)
    got = models.inner_scores(t, features, families, [(d, inner["LOEO", i]) for i, d in enumerate(donors, 1)])
    rows = [(arm, m, i, got[m][i - 1]) for i in range(1, len(donors) + 1) for m in families]
    return table.sparkSession.createDataFrame(rows, "arm string, model string, fold int, inner_auprc double")


def run(
    table: DataFrame, arms: Mapping[str, Sequence[str]], families: Mapping[str, Family], blocks: Mapping[str, Sequence[str]], ablations: Mapping[str, Sequence[str]],
    sources: Mapping[str, str | None], best: str = "boosted_trees", arm: str = "combined", loto: bool = True, into: str | None = None, folds: DataFrame | None = None,
) -> DataFrame:
    """All predictions of the study: arms by families, ablations and held-out taxa of ``best``, and the mixed
    model once for each species source (a column, or None for the donor term alone).

    An ablation that drops no feature and a source whose column is missing are left out. With ``into``, each
    part is written there as soon as it is made (see ``store``), and what is stored is returned. ``folds`` is a stored
    fold table (``store.load_folds``); without it inner groups are made anew.
    """
    parts: list[DataFrame] = []

    def done(part: DataFrame) -> None:
        parts.append(part)
        if into is not None:
            store.save(part, into)

    t = usable(table)
    donors = donors_of(t)
    cut = {f"{arm}_minus_{k}": ablated(arms[arm], blocks, drop) for k, drop in ablations.items()}
    cut = {k: v for k, v in cut.items() if len(v) < len(arms[arm])}
    mixed = {f"glmm_{k}": models.glmm(("donor",) if c is None else ("donor", c)) for k, c in sources.items() if c is None or c in table.columns}
    wanted = [*donor_parts(donors, arms, families), *donor_parts(donors, cut, [best])]
    if loto:
        wanted += taxon_parts(t, donors, arm, arms[arm], best)
    inner = _inner(t, families.values(), 3, 1729, folds)
    for part in predictions(t, wanted, families, inner):
        done(part)
    for part in predictions(t, donor_parts(donors, {arm: arms[arm]}, mixed), mixed, {}):
        done(part)
    return reduce(DataFrame.unionByName, parts) if into is None else store.load(table.sparkSession, into)
