"""Predictions that are kept: one folder a fold, read back by arm, model and scheme, and exported as calls per read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import read_calls

PARTITIONS = ("arm", "model", "scheme", "fold")
FOLDS = "scheme string, fold int, test_species string, test_donors array<string>, train_donors array<string>, inner array<struct<group: int, donors: array<string>>>"
#: Texts that stand for a missing taxon (fixed values).
BLANK = ("", "NA", '""')


def save(predictions: DataFrame, path: str, files: int = 1) -> None:
    """Write predictions under ``path``; folds that are there already are replaced, others stay.

    A fold's rows go to ``files`` files, dealt by read_id, so that no task writes more than its part of a fold.
    """
    part = F.pmod(F.xxhash64("read_id"), F.lit(files))
    dealt = predictions.repartition(*PARTITIONS, part)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def load(spark: SparkSession, path: str, **only: str | int | Sequence) -> DataFrame:
    """The predictions under ``path`` whose partitions match ``only``; other folders are not read. Names stay text."""
    found = spark.read.parquet(path)
    kinds = ", ".join(f"`{c}` {'int' if c == 'fold' else 'string' if c in PARTITIONS else t}" for c, t in found.dtypes)
    d = spark.read.schema(kinds).parquet(path)
    for name, value in only.items():
        if name not in PARTITIONS:
            raise ValueError(f"{name} is no partition of the predictions")
        d = d.where(F.col(name).isin(list(value) if isinstance(value, (list, tuple, set)) else [value]))
    return d


def folds_done(spark: SparkSession, path: str) -> DataFrame:
    """(arm, model, scheme, fold) with the numbers of rows, scored rows and failed rows."""
    return load(spark, path).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.count("error").alias("n_failed"))


def export_read_calls(
    spark: SparkSession, path: str, taxa: DataFrame, arm: str, model: str, scheme: str = "LOEO", recall: float = 0.95, key: Sequence[str] = ("read_id",), extra: Sequence[str] = ()
) -> DataFrame:
    """Calls of one arm and model at the score that keeps ``recall`` of the positives, beside the taxa that each read was given.

    ``taxa`` has ``key``, top_species, top_genus and columns ``extra``, one row a key; reads without one have nulls. Blank taxa are null.
    """
    if not (p := load(spark, path, arm=arm, model=model, scheme=scheme)).take(1):
        raise ValueError(f"no predictions of arm {arm} and model {model} ({scheme})")
    name = lambda c: F.when(~F.col(c).isin(*BLANK), F.col(c)).alias
    d = p.select(*key, "donor", "titration_level", name("species")("true_species"), "y", F.col("score").alias("model_score"))
    t = taxa.select(*key, name("top_species")("called_taxon"), name("top_genus")("called_genus"), *[name(c)(c) for c in extra])
    calls = read_calls(d.join(t, list(key), "left"), score="model_score", recall=recall)
    return calls.select(*key, "donor", "titration_level", "called_taxon", "called_genus", *extra, "true_species", "ground_truth", "model_score", "model_call", "correct")


def in_export_order(calls: DataFrame) -> DataFrame:
    return calls.orderBy("donor", "titration_level", F.desc("model_score"), "read_id")


def save_folds(folds: DataFrame, path: str) -> None:
    """Keep a fold table (``operators.folds.fold_table``) so that later fits and evaluations share its folds."""
    folds.coalesce(1).write.mode("overwrite").parquet(path)


def load_folds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOLDS).parquet(path)
