"""Grouped cross-validation: fold tables, masks, weights, caps, missingness and imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import quantiles, running


def loeo_folds(donors: DataFrame, donor: str = "donor") -> DataFrame:
    """(fold, test_donor): fold i holds out the i-th donor; a null is none. Donors are a design table."""
    return donors.select(donor).where(F.col(donor).isNotNull()).distinct().select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(donor)).alias("fold"), F.col(donor).alias("test_donor"))


def loeo_masks(rows: DataFrame, folds: DataFrame, donor: str = "donor", label: str = "label") -> DataFrame:
    """Every usable row once a fold, with its part (train or test).

    Ambiguous and indeterminate rows are in neither part.
    """
    ok = rows.where(~F.col(label).isin("ambiguous", "indeterminate"))
    return ok.crossJoin(F.broadcast(folds)).withColumn("part", F.when(F.col(donor) == F.col("test_donor"), "test").otherwise("train"))


def loto_folds(donors: DataFrame, species: DataFrame, donor: str = "donor", taxon: str = "species") -> DataFrame:
    """(fold, test_species, test_parity): odd folds test the donors at odd places, even folds the others."""
    s = species.select(taxon).where(f"{taxon} is not null and {taxon} <> ''").distinct()
    return s.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(taxon)).alias("fold"), F.col(taxon).alias("test_species")).withColumn("test_parity", F.col("fold") % 2)


def loto_masks(rows: DataFrame, folds: DataFrame, donors: DataFrame, donor: str = "donor", taxon: str = "species", label: str = "label") -> DataFrame:
    """Positives of the held-out taxon are tested and never trained on; donors are split between the parts.

    A positive without a taxon is in neither part. A single donor is always tested, with nothing to train on.
    """
    place = loeo_folds(donors, donor).select(F.col("test_donor").alias("__d"), (F.col("fold") % 2).alias("__p"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("__n"))
    d = rows.where(F.col(label).isin("positive", "negative")).join(F.broadcast(place), F.col(donor) == F.col("__d"))
    d = d.crossJoin(F.broadcast(folds))
    test, held, neg = (F.col("__p") == F.col("test_parity")) | (F.col("__n") == 1), F.col(taxon) == F.col("test_species"), F.col(label) == "negative"
    part = F.when(test & (neg | held), "test").when(~test & (neg | ~held), "train")
    return d.withColumn("part", part).where("part is not null").drop("__d", "__p", "__n")


def fold_table(rows: DataFrame, k: int = 3, seed: int = 1729, donor: str = "donor", taxon: str = "species", label: str = "label") -> DataFrame:
    """All outer folds of both schemes with their inner groups, as one nested row a fold.

    (scheme, fold, test_species, test_donors, train_donors, inner): LOEO holds out a donor, LOTO a taxon of the positives
    together with every other donor (a single donor is tested and nothing trained). ``inner`` is an array of (group,
    donors): the training donors in the order of md5('seed|scheme|fold|donor'), cut into at most ``k`` groups whose
    sizes differ by one at most. A null donor and a null or empty taxon make no fold.
    """
    place = loeo_folds(rows, donor).select(F.col("test_donor").cast("string").alias("donor"), F.col("fold").alias("__p"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("__n"))
    loeo = place.select(F.col("__p").alias("fold")).crossJoin(F.broadcast(place)).select(F.lit("LOEO").alias("scheme"), "fold", F.lit(None).cast("string").alias("test_species"), "donor", (F.col("__p") == F.col("fold")).alias("__test"))
    taxa = loto_folds(rows, rows.where(F.col(label) == "positive"), donor, taxon)
    tested = (F.col("__p") % 2 == F.col("test_parity")) | (F.col("__n") == 1)
    loto = taxa.crossJoin(F.broadcast(place)).select(F.lit("LOTO").alias("scheme"), "fold", F.col("test_species").cast("string").alias("test_species"), "donor", tested.alias("__test"))
    every = loeo.unionByName(loto)

    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "scheme", F.col("fold").cast("string"), F.col("donor").cast("string")).cast("binary"))
    part = Window.partitionBy("scheme", "fold", "__test")
    at, n = F.row_number().over(part.orderBy(key, "donor")), F.count(F.lit(1)).over(part)
    every = every.withColumn("__g", F.floor((at - 1) * F.least(F.lit(k), n) / n).cast("int") + 1)
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("donor"))))
    t = every.groupBy("scheme", "fold", "test_species").agg(
        pick(F.col("__test")).alias("test_donors"), pick(~F.col("__test")).alias("train_donors"),
        F.array_sort(F.collect_set(F.when(~F.col("__test"), F.col("__g")))).alias("__gs"), F.collect_list(F.when(~F.col("__test"), F.struct("__g", "donor"))).alias("__all"),
    )
    of = lambda g: F.array_sort(F.transform(F.filter("__all", lambda x: x["__g"] == g), lambda x: x["donor"]))
    return t.select("scheme", "fold", "test_species", "test_donors", "train_donors", F.transform("__gs", lambda g: F.struct(g.alias("group"), of(g).alias("donors"))).alias("inner"))


def inner_of(table: DataFrame) -> dict[tuple[str, int], list[list[str]]]:
    """Inner groups by scheme and fold, for a driver that submits one fit a fold; a row a fold is gathered."""
    return {(r.scheme, r.fold): [list(g.donors) for g in r.inner] for r in table.select("scheme", "fold", "inner").collect()}


def balance_weights(df: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Equal total weight for each unit, mean weight 1.

    Counts are aggregated and joined, so a unit with most of the rows needs no window of its own.
    """
    n = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("__c"))
    all_ = n.agg(F.sum("__c").alias("__n"), F.count(F.lit(1)).alias("__u"))
    w = n.crossJoin(F.broadcast(all_)).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(unit)], (F.col("__n") / (F.col("__u") * F.col("__c"))).alias("weight"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(unit)]
    return df.join(w, on).drop(*[f"__k{i}" for i in range(len(unit))])


def stratified_cap(df: DataFrame, y: str, cap: int, order: Sequence[str]) -> DataFrame:
    """About ``cap`` rows with every class's share kept: the first round(cap/n * n_class) in ``order``.

    ``order`` should be a hash of the row for a random sample; n <= cap keeps all.
    """
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("__c").alias("__n")))).select(F.col(y).alias("__y"), F.when(F.col("__n") <= cap, F.col("__c")).otherwise(F.round(cap / F.col("__n") * F.col("__c"))).alias("__keep"))
    d = running(df, [y], [F.col(c) for c in order], {"__r": F.lit(1)})
    return d.join(F.broadcast(n), F.col(y).eqNullSafe(F.col("__y"))).where(F.col("__r") <= F.col("__keep")).drop("__r", "__r_all", "__y", "__keep")  # a row a class


def missingness(df: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(groups, feature, n_train, n_missing, pct_missing, all_na), all features in one aggregation."""
    g = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_train"), *[F.count_if(F.col(f).isNull()).alias(f"__{i}") for i, f in enumerate(features)])
    m = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"__{i}").alias("n_missing")) for i, f in enumerate(features)]))
    return g.select(*groups, "n_train", m.alias("m")).select(
        *groups, F.col("m.feature").alias("feature"), "n_train", F.col("m.n_missing").alias("n_missing"),
        F.round(100 * F.col("m.n_missing") / F.greatest("n_train", F.lit(1)), 2).alias("pct_missing"), (F.col("m.n_missing") == F.col("n_train")).alias("all_na"),
    )


def impute_median(train: DataFrame, test: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``test`` with nulls replaced by the train median of the group (0 where train has no value)."""
    med = quantiles(train, groups, {f"__{f}": (f, 0.5) for f in features})
    out = test.join(med, list(groups), "left")
    return out.withColumns({f: F.coalesce(F.col(f).cast("double"), F.col(f"__{f}"), F.lit(0.0)) for f in features}).drop(*[f"__{f}" for f in features])


def confounded(df: DataFrame, run: str = "run_id", donor: str = "donor") -> DataFrame:
    """One row: whether every run has exactly one donor."""
    n = df.select(run, donor).distinct().groupBy(run).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_runs"), F.max("n").alias("max_donors"), F.bool_and(F.col("n") == 1).alias("confounded"))
