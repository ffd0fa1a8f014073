"""Sequence-complexity functions. Letters a-z are taken as A-Z."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LOW = "abcdefghijklmnopqrstuvwxyz"


def upper(s: Column) -> Column:
    return F.translate(s, _LOW, _LOW.upper())


def gc_fraction(s: Column) -> Column:
    n = F.length(s)
    return (n - F.length(F.translate(upper(s), "GC", ""))) / F.greatest(n, F.lit(1))


def homopolymer_frac(s: Column) -> Column:
    """Longest run of one character over the length; 0 for the empty text. Newlines end a run."""
    # Only runs of two or more are extracted: most characters of a text begin none.
    runs = F.regexp_extract_all(upper(s), F.lit(r"(?d)((.)\2+)"), 1)
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), s.rlike(r"(?d).").cast("int"))
    return longest / F.greatest(F.length(s), F.lit(1))


def _dust(text: bytes | None) -> float:
    x = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(x) < 3:
        return 0.0
    x = np.where((x >= 97) & (x <= 122), x - 32, x)
    c = np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:], return_counts=True)[1]
    return float((c * (c - 1)).sum() / (2 * (len(x) - 2)))


@F.pandas_udf(DoubleType())
def _dust_scores(texts: pd.Series) -> pd.Series:
    return texts.map(_dust).astype("float64")


def dust_score(text: str) -> Column:
    """Sum of c(c-1) over the counts c of a text's triplets, over 2(L-2); 0 below three characters and for null.

    Triplets are counted where the row is, so that nothing but the score leaves it; texts go to the counter in Arrow batches.
    """
    return _dust_scores(F.col(text).cast("binary"))


def dust_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dust_score) of each row."""
    return df.select(key, dust_score(text).alias("dust_score"))
