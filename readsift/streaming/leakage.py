"""Extension (the batch design has no streams): leakage counts over a stream of labelled events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_leakage(stream: DataFrame, at: str = "ts", key: str = "run_id", positive: str = "positive", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and positives of each key and window; late rows within the watermark are counted.

    State is one row a key and open window, so it is bounded by the watermark.
    """
    w = F.window(at, width)
    g = stream.withWatermark(at, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(positive)).alias("n_positive"))
    return g.select(F.col("window.start").alias("window_start"), key, "n", "n_positive", (F.col("n_positive") / F.col("n")).alias("share"))
