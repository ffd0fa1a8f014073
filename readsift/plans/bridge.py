"""Views of the driver's tables in the roles that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Level of a sample by order priority, highest input first, and the cells loaded at each level (fixed values).
LEVELS = {"1-URGENT": "c1", "2-HIGH": "c2", "3-MEDIUM": "c3", "4-NOT SPECIFIED": "c4", "5-LOW": "c5"}
CELLS = {"c1": 78800000.0, "c2": 7880000.0, "c3": 788000.0, "c4": 78800.0, "c5": 7880.0}
TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as alignments: read = order, identity = 1 - discount, coverage = quantity / 50, score = price."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("read_id"), F.col("l_returnflag").alias("reference"), (1 - F.col("l_discount")).alias("identity"),
        (F.col("l_quantity") / 50.0).alias("coverage"), F.col("l_extendedprice").alias("score"), *TIES,
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored reads of two models and two arms."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels")
    p = d.join(l, "doc_id").select(
        F.col("doc_id").alias("read_id"), F.concat(F.lit("D"), F.col("doc_id") % 8).alias("donor"), F.col("lang").alias("titration_level"),
        F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("species"), F.col("quality").alias("y"), F.col("toxic").alias("end_reason_unblock"),
        (F.col("doc_id") % 8 + 1).cast("int").alias("fold"), (F.col("n_chars") / 20000.0).alias("s1"), ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("s2"),
    )
    models = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(m).alias("model"), s.alias("score")) for a, m, s in (("combined", "size", F.col("s1")), ("combined", "mixed", (F.col("s1") + F.col("s2")) / 2), ("single", "size", F.col("s2")))]))
    return p.withColumn("m", models).select("m.*", F.lit("LOEO").alias("scheme"), "read_id", "donor", "titration_level", "species", "y", "end_reason_unblock", "fold").drop("m")


PREDICTIONS_SQL = """
p0 AS (
  SELECT doc_id AS read_id, 'D' || (doc_id % 8) AS donor, lang AS titration_level, CASE WHEN doc_id % 11 <> 0 THEN source END AS species,
         quality AS y, toxic AS end_reason_unblock, (doc_id % 8 + 1)::INT AS fold, n_chars / 20000.0::DOUBLE AS s1, ((doc_id * 7919) % 1000) / 1000.0::DOUBLE AS s2
  FROM documents JOIN labels USING (doc_id)),
preds AS (
  SELECT 'combined' AS arm, 'size' AS model, s1 AS score, 'LOEO' AS scheme, * EXCLUDE (s1, s2) FROM p0
  UNION ALL SELECT 'combined', 'mixed', (s1 + s2) / 2, 'LOEO', * EXCLUDE (s1, s2) FROM p0
  UNION ALL SELECT 'single', 'size', s2, 'LOEO', * EXCLUDE (s1, s2) FROM p0)"""

HITS_SQL = """
hits AS (
  SELECT l_orderkey AS read_id, l_returnflag AS reference, 1 - l_discount AS identity, l_quantity / 50.0::DOUBLE AS coverage, l_extendedprice AS score,
         l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate
  FROM lineitem)"""


def labels(spark: SparkSession, sf_dir: str, min_identity: float = 0.93, min_coverage: float = 0.5) -> DataFrame:
    """Three-class labels of orders: N lines are the target, A and R lines the hosts, line 7 is ambiguous."""
    from ..operators.labels import three_class
    from ..operators.topk import best_per_key

    h = line_hits(spark, sf_dir)
    best = best_per_key(h.where("reference = 'N'"), ["read_id"], "score", TIES).select("read_id", "identity", "coverage", F.col("score").alias("target"), (F.col("l_linenumber") == 7).alias("ambiguous"), F.col("l_partkey"))
    host = h.where("reference <> 'N'").groupBy("read_id").agg(F.max(F.when(F.col("reference") == "A", F.col("score"))).alias("a"), F.max(F.when(F.col("reference") == "R", F.col("score"))).alias("r"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.col("o_custkey"), F.col("o_orderpriority"))
    d = o.join(best, "read_id", "left").join(host, "read_id", "left")
    human = F.greatest(F.coalesce("a", F.lit(0.0)), F.coalesce("r", F.lit(0.0)))
    d = d.withColumn("host", human).withColumn("label", three_class(F.col("identity"), F.col("coverage"), F.col("target"), human, F.col("ambiguous"), min_identity, min_coverage))
    return d.select("read_id", "o_custkey", "o_orderpriority", "identity", "coverage", "target", "host", "l_partkey", "label")


def labels_sql(name: str = "lab", min_identity: float = 0.93, min_coverage: float = 0.5) -> str:
    return f"""
{name}_best AS (
  SELECT read_id, identity, coverage, score AS target, l_linenumber = 7 AS ambiguous, l_partkey FROM hits WHERE reference = 'N'
  QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY score DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) = 1),
{name}_host AS (SELECT read_id, max(score) FILTER (reference = 'A') AS a, max(score) FILTER (reference = 'R') AS r FROM hits WHERE reference <> 'N' GROUP BY 1),
{name} AS (
  SELECT o_orderkey AS read_id, o_custkey, o_orderpriority, identity, coverage, target, greatest(coalesce(a, 0), coalesce(r, 0)) AS host, l_partkey,
         CASE WHEN coalesce(ambiguous, false) THEN 'ambiguous'
              WHEN coalesce(identity >= {min_identity}::DOUBLE AND coverage >= {min_coverage}::DOUBLE AND coalesce(target, 0) > greatest(coalesce(a, 0), coalesce(r, 0)), false) THEN 'positive'
              ELSE 'negative' END AS label
  FROM orders LEFT JOIN {name}_best ON o_orderkey = {name}_best.read_id LEFT JOIN {name}_host ON o_orderkey = {name}_host.read_id)"""
