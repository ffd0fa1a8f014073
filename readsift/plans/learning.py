"""Queries that fit models: out-of-fold scores of labelled documents by donor."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..ml import boosting, folded, mixed_logistic, models
from ..operators.ranking import auprc
from ..session import table

FEATURES = ["n_chars", "n_lines", "upper_share", "symbol_share"]


def training_table(spark, d):
    """Labelled documents with text features; donors are doc_id modulo 4."""
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda s: F.length(F.regexp_replace("text", f"[^{s}]+", "")) / n  # noqa: E731  runs of other characters go; translate looks up each one
    return t.select(
        F.col("doc_id").alias("read_id"), F.concat(F.lit("D"), (F.col("doc_id") % 4).cast("string")).alias("donor"), F.col("lang").alias("species"),
        F.col("quality").cast("double").alias("y"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.when(F.col("doc_id") % 13 != 0, share("A-Z")).alias("upper_share"), share("#*$%&|<>!").alias("symbol_share"),
    )


def _oof(model):
    def run(spark, d):
        t = training_table(spark, d)
        return models.out_of_fold(t, FEATURES, model).withColumn("score", F.round("score", 6))

    return run


def model_comparison(spark, d):
    """Average precision of each family over its out-of-fold scores."""
    from functools import reduce

    keep = ("read_id", "donor", "y")  # the mixed model needs no more
    f = folded.prepare(folded.loeo(training_table(spark, d)), FEATURES, keep)  # texts are read once for all families
    each = [models.MODELS[m].scores(f, keep).withColumn("model", F.lit(m)) for m in ("fixed_threshold", "glm", "glmm")]
    return auprc(reduce(lambda a, b: a.unionByName(b), each), ["model"], "y", "score", ["read_id"]).withColumn("auprc", F.round("auprc", 6))


def species_source_glmm(spark, d):
    """Out-of-fold scores with a species intercept beside the donor's."""
    t = training_table(spark, d)
    return models.out_of_fold(t, FEATURES, models.glmm(("donor", "species"))).withColumn("score", F.round("score", 6))


def _folded(spark, d):
    return folded.prepare(folded.loeo(training_table(spark, d)), FEATURES, ["read_id"])


def fixed_threshold_choice(spark, d):
    """The feature and sign that each fold's training rows choose, with their average precision."""
    f = _folded(spark, d)
    return folded.chosen_features(f, "read_id", *folded.medians(f)).select("fold", "feature", "sign", F.round("auprc", 6).alias("auprc"))


def boosted_first_split(spark, d):
    """The first split of each fold's first tree: gradients of all folds in one aggregation."""
    f, p = _folded(spark, d), boosting.Boost(depth=1, bins=32)
    forest = boosting.Forest(boosting.edges(f, p.bins), 1)
    rows = f.rows.withColumn("__margin", F.array(*[F.lit(0.0) for _ in f.folds]))
    best = boosting.level_splits(f, rows, forest, [boosting.Tree.empty(1) for _ in f.folds], 0, f.trained, p).where("f is not null")
    at = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i + 1)
    cut = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(float(v)) for v in e]).cast("array<double>") for e in forest.edges]), F.col("f") + 1), F.col("b") + 1)
    sums = [F.round(c, 4).alias(c) for c in ("gain", "g_left", "h_left", "g_right", "h_right")]
    return best.select(at(f.folds, F.col("k")).alias("fold"), at(FEATURES, F.col("f")).alias("feature"), F.round(cut, 9).alias("threshold"), "miss_left", F.col("n_left").cast("long").alias("n_left"), F.col("n_right").cast("long").alias("n_right"), *sums)


def glmm_case_control(spark, d):
    """The rows each fold draws for the mixed model at 0.1 negatives a positive and at most 200 rows, and what that takes from the intercept."""
    f = folded.prepare(folded.loeo(training_table(spark, d)), FEATURES, ["read_id", "donor"])
    fits, _ = mixed_logistic.fit(f, [F.col("donor")], np.zeros((len(f.folds), len(FEATURES))), mixed_logistic.uniform(1729, F.col("read_id")), ratio=0.1, cap=200, rounds=0)
    rows = [(f.folds[k], *m.drawn, round(float(np.log(m.prior)), 9)) for k, m in fits.items()]
    return spark.createDataFrame(rows, "fold int, n_pos long, n_neg long, log_prior double")


QUERIES = {
    "glmm_case_control": glmm_case_control,
    "fixed_threshold_choice": fixed_threshold_choice,
    "boosted_first_split": boosted_first_split,
    "fixed_threshold_oof": _oof("fixed_threshold"),
    "glm_oof": _oof("glm"),
    "forest_oof": _oof(models.forest(trees=20)),
    "boosted_oof": _oof(models.boosted(depth=4, rounds=10)),
    "glmm_oof": _oof("glmm"),
    "glmm_species_oof": species_source_glmm,
    "model_comparison": model_comparison,
}
_ROWS = """
raw AS (
  SELECT doc_id AS read_id, doc_id % 4 + 1 AS own, quality::DOUBLE AS y, text, n_chars, greatest(length(text), 1) AS n FROM documents JOIN labels USING (doc_id)),
wide AS (
  SELECT read_id, own, y, n_chars::DOUBLE AS n_chars, len(string_split(text, chr(10)))::DOUBLE AS n_lines,
         CASE WHEN read_id % 13 <> 0 THEN (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / n::DOUBLE END AS upper_share,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g'))) / n::DOUBLE AS symbol_share
  FROM raw),
long AS (
  SELECT read_id, own, y, unnest([0, 1, 2, 3]) AS j, unnest(['n_chars', 'n_lines', 'upper_share', 'symbol_share']) AS feature,
         unnest([n_chars, n_lines, upper_share, symbol_share]) AS v
  FROM wide),
folds AS (SELECT DISTINCT own AS fold FROM wide WHERE y IS NOT NULL),
train AS (SELECT fold, long.* FROM long JOIN folds ON own <> fold WHERE y IS NOT NULL)"""

_CHOICE = f"""
WITH {_ROWS},
med AS (SELECT fold, j, median(v) AS m, count(DISTINCT v) AS d FROM train GROUP BY ALL),
signed AS (SELECT fold, j, feature, sign, read_id, y, sign * coalesce(v, m) AS s FROM train JOIN med USING (fold, j), (VALUES (1), (-1)) t(sign) WHERE d >= 2),
steps AS (
  SELECT *, sum(y) OVER (PARTITION BY fold, j, sign ORDER BY s DESC, read_id) / row_number() OVER (PARTITION BY fold, j, sign ORDER BY s DESC, read_id) AS p FROM signed),
ap AS (SELECT fold, j, feature, sign, sum(p) FILTER (y = 1) / sum(y) AS a FROM steps GROUP BY ALL HAVING sum(y) > 0 AND sum(1 - y) > 0)
SELECT fold::INT AS fold, feature, sign, round(a, 6) AS auprc FROM ap QUALIFY row_number() OVER (PARTITION BY fold ORDER BY a DESC, j, sign DESC) = 1
"""

_SPLIT = f"""
WITH {_ROWS},
counts AS (SELECT j, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY ALL),
cum AS (SELECT j, v, sum(n) OVER (PARTITION BY j ORDER BY v) AS c, sum(n) OVER (PARTITION BY j) AS all_, row_number() OVER (PARTITION BY j ORDER BY v) AS r, count(*) OVER (PARTITION BY j) AS d FROM counts),
named AS (SELECT j, v, CASE WHEN d <= 32 THEN r ELSE (c - 1) * 32 // all_ END AS b FROM cum),
edge AS (SELECT j, b, max(v) AS top, row_number() OVER (PARTITION BY j ORDER BY b) - 1 AS bin FROM named GROUP BY j, b),
coded AS (SELECT t.*, coalesce(bin, -1) AS bin, top FROM train t LEFT JOIN named n ON n.j = t.j AND n.v = t.v LEFT JOIN edge e ON e.j = t.j AND e.b = n.b),
base AS (SELECT fold, own, count(*) / 4 AS c FROM train GROUP BY ALL),
weight AS (SELECT fold, own, sum(c) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * c) AS w FROM base),
class AS (SELECT fold, sum(1 - y) / greatest(sum(y), 1) AS pos FROM train WHERE j = 0 GROUP BY fold HAVING sum(y) > 0 AND sum(1 - y) > 0),
hist AS (
  SELECT c.fold, c.j, c.feature, c.bin, max(top) AS top, sum(w * CASE WHEN y = 1 THEN pos ELSE 1 END * (0.5 - y)) AS g, sum(w * CASE WHEN y = 1 THEN pos ELSE 1 END * 0.25) AS h, count(*) AS n
  FROM coded c JOIN weight USING (fold, own) JOIN class USING (fold) GROUP BY ALL),
run AS (
  SELECT fold, j, feature, bin, top, miss_left,
         sum(CASE WHEN bin >= 0 THEN g ELSE 0 END) OVER u + CASE WHEN miss_left THEN coalesce(sum(CASE WHEN bin < 0 THEN g END) OVER o, 0) ELSE 0 END AS g_left,
         sum(CASE WHEN bin >= 0 THEN h ELSE 0 END) OVER u + CASE WHEN miss_left THEN coalesce(sum(CASE WHEN bin < 0 THEN h END) OVER o, 0) ELSE 0 END AS h_left,
         sum(CASE WHEN bin >= 0 THEN n ELSE 0 END) OVER u + CASE WHEN miss_left THEN coalesce(sum(CASE WHEN bin < 0 THEN n END) OVER o, 0) ELSE 0 END AS n_left,
         sum(g) OVER o AS ga, sum(h) OVER o AS ha, sum(n) OVER o AS na
  FROM hist, (VALUES (true), (false)) t(miss_left)
  WINDOW u AS (PARTITION BY fold, j, miss_left ORDER BY bin), o AS (PARTITION BY fold, j, miss_left)),
gains AS (SELECT *, round((g_left * g_left / (h_left + 1) + (ga - g_left) * (ga - g_left) / (ha - h_left + 1) - ga * ga / (ha + 1)) / 2, 9) AS gain FROM run WHERE bin >= 0 OR miss_left)
SELECT fold::INT AS fold, feature, round(top, 9) AS threshold, miss_left, n_left::BIGINT AS n_left, (na - n_left)::BIGINT AS n_right, round(gain, 4) AS gain,
       round(g_left, 4) AS g_left, round(h_left, 4) AS h_left, round(ga - g_left, 4) AS g_right, round(ha - h_left, 4) AS h_right
FROM gains WHERE n_left > 0 AND na > n_left AND h_left >= 1 AND ha - h_left >= 1 AND gain > 0
QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, j, bin, miss_left DESC) = 1
"""

_DRAWN = f"""
WITH {_ROWS},
one AS (SELECT fold, read_id, y, ('0x' || substr(md5('1729|' || read_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM train WHERE j = 0),
n AS (SELECT fold, sum(y) AS p, sum(1 - y) AS q FROM one GROUP BY fold HAVING sum(y) > 0 AND sum(1 - y) > 0),
few AS (SELECT *, least(1, 0.1::DOUBLE * p / q) AS s FROM n),
part AS (SELECT *, least(1, 200 / (p + s * q)) AS c FROM few),
got AS (SELECT fold, p, q, count(*) FILTER (y = 1 AND u < c) AS n_pos, count(*) FILTER (y = 0 AND u < s * c) AS n_neg FROM one JOIN part USING (fold) GROUP BY ALL)
SELECT fold::INT AS fold, n_pos, n_neg, round(ln((n_neg / q) / (n_pos / p)), 9) AS log_prior FROM got WHERE n_pos > 0 AND n_neg > 0
"""

ORACLES: dict[str, str] = {"glmm_case_control": _DRAWN, "fixed_threshold_choice": _CHOICE, "boosted_first_split": _SPLIT}
