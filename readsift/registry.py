"""The queries of the engine and their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evaluation, extras, files, learning, reads, streams, study

Query = Callable[[SparkSession, str], DataFrame]
_modules = (reads, evaluation, learning, streams, extras, files, study)


def queries() -> dict[str, Query]:
    return {k: v for m in _modules for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _modules for k, v in m.ORACLES.items()}


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics of every model, by level and with or without truncated reads."""
    return evaluation.stratified_metrics(spark, sf_dir)
