"""The stream extension run over a table: the same plan reads a stream of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming.leakage import windowed_leakage


def stream_leakage(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("run_id"), (F.col("event_type") == "error").alias("positive"))
    out = windowed_leakage(e)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "run_id", "n", "n_positive", F.round("share", 6).alias("share"))


QUERIES = {"stream_leakage": stream_leakage}
ORACLES = {
    "stream_leakage": """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id % 10 AS run_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_positive,
round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS share FROM events GROUP BY ALL"""
}
