"""Cut-off profiles, their provenance, region masks and small level helpers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import merge_intervals


@dataclass(frozen=True)
class Profile:
    """Label cut-offs; the defaults are the fixed profile (fixed values)."""

    name: str = "fixed"
    min_identity: float = 0.90
    min_coverage: float = 0.80


def resolve_profile(name: str, recommended: DataFrame | None = None) -> Profile:
    """``fixed`` gives the constants, ``calculated`` the recommended pair; anything else is an error."""
    if name == "fixed":
        return Profile()
    if name == "calculated":
        row = None if recommended is None else recommended.select("gt_min_identity", "gt_min_coverage").first()
        if row is None:
            raise FileNotFoundError("no recommended cut-offs: run the sensitivity sweep first")
        return Profile(name, row.gt_min_identity, row.gt_min_coverage)
    raise ValueError(f"unknown profile {name!r}")


def provenance(spark: SparkSession, profile: Profile, **settings: object) -> DataFrame:
    """One row with the settings that a run was made with."""
    row = {**asdict(profile), **settings}
    return spark.createDataFrame([tuple(map(str, row.values()))], ", ".join(f"{k} string" for k in row))


def region_mask(sources: Sequence[DataFrame], min_length: dict[int, int] | None = None) -> DataFrame:
    """Union of interval sources (tname, start, end), merged where they overlap or touch.

    ``min_length`` maps a source's place to the shortest interval it may give.
    """
    parts = [s.select("tname", "start", "end").where(F.col("end") - F.col("start") >= (min_length or {}).get(i, 1)) for i, s in enumerate(sources)]
    return merge_intervals(reduce(DataFrame.unionByName, parts), ["tname"]).select("tname", "start", "end")


def level_number(level: Column, levels: Sequence[str] = ("c1", "c2", "c3", "c4", "c5")) -> Column:
    """1 for the first level and so on; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), level), F.lit(0).cast("bigint"))


def vector_evenness(depth: Column) -> Column:
    """1 - Gini of an array of per-position depths; 0 without any depth."""
    d = F.array_sort(depth)
    n, total = F.size(d), F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    ranked = F.aggregate(F.transform(d, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when((n > 0) & (total > 0), 1 - (2 * ranked / (n * total) - (n + 1) / n)).otherwise(0.0)
