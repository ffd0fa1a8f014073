"""Folds and bounded samples of labelled rows, shared by the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id).cast("string")) % folds


def training_labels(labels: DataFrame, column: str, folds: int, held_out: int, id: str = "doc_id") -> DataFrame:
    """(doc_id, y) with y 0 or 1, one row an id, of the folds that may be learned from.

    Null ids and labels are left out; where an id has both labels, 1 counts.
    """
    d = labels.select(F.col(id).alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return d.where(fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))


def bounded_sample(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows, the first by a hash of doc_id; the same rows at each run."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)
