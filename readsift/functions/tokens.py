"""Classifier token lists: ``taxid:count taxid:count``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tokens(s: Column) -> Column:
    """array<struct<taxid: string, cnt: bigint>>; empty tokens are dropped, a bad count is null."""
    toks = F.filter(F.split(F.coalesce(s, F.lit("")), " "), lambda t: t != "")
    count = lambda t: F.get(F.split(t, ":"), F.lit(1)).try_cast("bigint")
    return F.transform(toks, lambda t: F.struct(F.split(t, ":")[0].alias("taxid"), count(t).alias("cnt")))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x["cnt"], F.lit(0).cast("bigint")))


def token_features(tokens: Column, assigned: Column) -> dict[str, Column]:
    """k2_conf (also as k2_kmers_taxon_frac) and k2_distinct_minimizers.

    Token "0" matches an assigned taxid 0, so an unclassified row can have confidence 1.
    """
    total = _sum(tokens)
    taxon = _sum(F.filter(tokens, lambda x: x["taxid"] == assigned.cast("string")))
    conf = F.when(total > 0, taxon / total).otherwise(0.0)
    distinct = F.size(F.array_distinct(F.transform(F.filter(tokens, lambda x: x["taxid"] != "0"), lambda x: x["taxid"])))
    return {"k2_conf": conf, "k2_kmers_taxon_frac": conf, "k2_distinct_minimizers": distinct.cast("long")}
